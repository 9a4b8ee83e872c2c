"""A table of fields in binary files as a Spark data source: ``spark.read.format("panelbin").load(folder)``.

One file holds one field of one instrument, ``<instrument>/<field>.<freq>.bin``: little-endian 32-bit floats, the first the calendar place of the second. A row is (instrument, field, cal_idx, value); missing
values are NaN in the file and NULL in the table.

Reading plans one partition for some BATCH files. What is asked of instruments and fields chooses files before any is opened, a range of cal_idx is read by its offset, so only these bytes are touched. It is asked by options (``load``'s
arguments), or with ``push`` by the query's own filters, which the format ``panelbin-pushed`` takes. Spark keeps one set of pushed filters for each load, so a frame loaded with ``push`` may stand in a plan once; load it again for a second use.
Writing takes rows of whole files (``save`` deals them out) in one of three modes: ``overwrite`` makes the file new, ``append`` adds what lies behind its end, with a gap of missing values where bars are left out, and ``rewrite`` also puts values in the place
of stored ones, before its start too. Tasks write beside the files; the files take their names when all tasks are done, and go if one fails.
"""

from __future__ import annotations

import fnmatch
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

FORMAT = "panelbin"
SCHEMA = "instrument string, field string, cal_idx long, value double"
ARROW = pa.schema([("instrument", pa.string()), ("field", pa.string()), ("cal_idx", pa.int64()), ("value", pa.float64())])
BATCH = 64
MODES = ("overwrite", "append", "rewrite")


def filesystem(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _names(path: str) -> tuple[str, str, str]:
    instrument, name = path.rsplit("/", 2)[-2:]
    field, freq, _ = name.rsplit(".", 2)
    return instrument, field, freq


@dataclass
class Files(InputPartition):
    paths: list[str]
    low: int | None
    high: int | None


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.freq = options["path"], options.get("freq", "day")
        listed = lambda k: set(json.loads(options[k])) if k in options else None
        self.instruments, self.fields = listed("instruments"), listed("fields")
        self.low, self.high = (int(options[k]) if k in options else None for k in ("low", "high"))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = filesystem(self.folder)
        found = []
        folders = [f"{root}/{i}" for i in sorted(self.instruments)] if self.instruments is not None else [root]  # with instruments asked for, no other folder is listed
        for folder in folders:
            for info in system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
                if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, f"*.{self.freq}.bin") and (self.fields is None or _names(info.path)[1] in self.fields):
                    found.append(info.path)
        found.sort()
        return [Files(found[k : k + BATCH], self.low, self.high) for k in range(0, len(found), BATCH)] or [Files([], None, None)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(self.folder)
        for path in partition.paths:
            start, values = ranged(system, path, partition.low, partition.high)
            if not len(values):
                continue
            instrument, field, _ = _names(path)
            n, x = len(values), values.astype(np.float64)
            yield pa.record_batch([pa.array([instrument] * n), pa.array([field] * n), pa.array(np.arange(start, start + n, dtype=np.int64)), pa.array(x, mask=np.isnan(x))], schema=ARROW)


class PushedReader(Reader):
    """Also takes filters of the query."""

    def pushFilters(self, filters: list[Filter]):
        """Takes equality and lists on instrument and field, and bounds on cal_idx; returns the filters that stay with Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in ("instrument", "field") and isinstance(f, (EqualTo, In)):
                chosen = {f.value} if isinstance(f, EqualTo) else set(f.value)
                key = f"{name}s"
                setattr(self, key, chosen if getattr(self, key) is None else getattr(self, key) & chosen)
            elif name == "cal_idx" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                least = f.value + isinstance(f, GreaterThan)
                self.low = least if self.low is None else max(self.low, least)
            elif name == "cal_idx" and isinstance(f, (LessThan, LessThanOrEqual)):
                most = f.value - isinstance(f, LessThan)
                self.high = most if self.high is None else min(self.high, most)
            elif name == "cal_idx" and isinstance(f, EqualTo):
                self.low, self.high = max(f.value, self.low if self.low is not None else f.value), min(f.value, self.high if self.high is not None else f.value)
            else:
                yield f


def ranged(system, path: str, low: int | None = None, high: int | None = None) -> tuple[int, np.ndarray]:
    """The place of the first value and the values of a file, cut to low .. high without reading the rest."""
    with system.open_input_file(path) as f:
        count = f.size() // 4 - 1
        if count < 0:
            return 0, np.zeros(0, "<f4")
        first = int(np.frombuffer(f.read_at(4, 0), "<f4")[0])
        a = 0 if low is None else max(0, low - first)
        b = count if high is None else min(count, high - first + 1)
        return (first + a, np.frombuffer(f.read_at(4 * (b - a), 4 + 4 * a), "<f4")) if a < b else (first, np.zeros(0, "<f4"))


def merged(start: int, stored: np.ndarray, places: np.ndarray, values: np.ndarray, mode: str) -> tuple[int, np.ndarray]:
    """A file's content after values were put at places (sorted, each once)."""
    if mode == "overwrite" or not len(stored):
        start, stored = int(places[0]), np.zeros(0, "<f4")
    elif mode == "append":
        later = places >= start + len(stored)
        places, values = places[later], values[later]
        if not len(places):
            return start, stored
    first, end = min(start, int(places[0])), max(start + len(stored), int(places[-1]) + 1)
    out = np.full(end - first, np.nan, "<f4")
    out[start - first : start - first + len(stored)] = stored
    out[places - first] = values
    return first, out


def _changes(names: pa.Array) -> np.ndarray:
    """Whether each name but the first is another than the one before."""
    return pc.fill_null(pc.not_equal(names[1:], names[:-1]), True).to_numpy(zero_copy_only=False)


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, freq: str, mode: str):
        self.folder, self.freq, self.mode = folder, freq, mode

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = filesystem(self.folder)
        moves, key, places, values = [], None, [], []

        def put():
            instrument, field = key
            order = np.argsort(np.concatenate(places), kind="stable")
            p, v = np.concatenate(places)[order], np.concatenate(values)[order]
            last = np.concatenate([p[1:] != p[:-1], [True]])  # of rows with one place the last stays
            final = f"{root}/{instrument}/{field}.{self.freq}.bin"
            from pyarrow import fs

            there = self.mode != "overwrite" and system.get_file_info(final).type == fs.FileType.File
            start, out = merged(*(ranged(system, final) if there else (0, np.zeros(0, "<f4"))), p[last], v[last], self.mode)
            beside = f"{root}/{instrument}/.{field}.{uuid.uuid4().hex}"
            system.create_dir(f"{root}/{instrument}", recursive=True)
            with system.open_output_stream(beside) as f:
                f.write(np.concatenate([[start], out]).astype("<f4").tobytes())
            moves.append((beside, final))

        for batch in iterator:
            c = [batch.column(k) for k in range(4)]
            if not batch.num_rows:
                continue
            at, x = c[2].to_numpy(zero_copy_only=False), c[3].to_numpy(zero_copy_only=False).astype("<f4")
            edge = np.concatenate([[True], _changes(c[0]) | _changes(c[1])]).nonzero()[0].tolist()
            for a, b in zip(edge, [*edge[1:], batch.num_rows], strict=True):
                name = (c[0][a].as_py(), c[1][a].as_py())
                if name != key:
                    if key is not None:
                        put()
                    key, places, values = name, [], []
                places.append(at[a:b])
                values.append(x[a:b])
        if key is not None:
            put()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = filesystem(self.folder)
        for m in messages:
            for beside, final in m.moves if m else ():
                system.move(beside, final)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = filesystem(self.folder)
        for m in messages:
            for beside, _ in m.moves if m else ():
                system.delete_file(beside)


class BinStore(DataSource):
    """Options: path, freq (day), mode (append, or overwrite by Spark's own mode, or rewrite)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        mode = self.options.get("how", "overwrite" if overwrite else "append")
        if mode not in MODES:
            raise ValueError(f"how must be one of {MODES}")
        return Writer(self.options["path"], self.options.get("freq", "day"), mode)


class PushedBinStore(BinStore):
    """The same files; filters are pushed into the reader."""

    @classmethod
    def name(cls) -> str:
        return f"{FORMAT}-pushed"

    def reader(self, schema) -> Reader:
        return PushedReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session, and lets Spark push filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BinStore)
    spark.dataSource.register(PushedBinStore)


def load(spark: SparkSession, folder: str, freq: str = "day", instruments: Sequence[str] | None = None, fields: Sequence[str] | None = None, low: int | None = None, high: int | None = None, push: bool = False) -> DataFrame:
    """The files of the instruments and fields, from low to high (all where None). push: the query's filters choose too, once."""
    register(spark)
    asked = {"instruments": json.dumps(list(instruments)) if instruments is not None else None, "fields": json.dumps(list(fields)) if fields is not None else None, "low": low, "high": high}
    reader = spark.read.format(PushedBinStore.name() if push else FORMAT).option("freq", freq)
    for k, v in asked.items():
        reader = reader if v is None else reader.option(k, v)
    return reader.load(folder)


def save(values: DataFrame, folder: str, how: str = "append", freq: str = "day") -> None:
    """Writes (instrument, field, cal_idx, value): each file's rows come to one task, in order."""
    register(values.sparkSession)
    rows = values.select(F.col("instrument").cast("string"), F.col("field").cast("string"), F.col("cal_idx").cast("long"), F.col("value").cast("double"))
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, "instrument", "field").sortWithinPartitions("instrument", "field", "cal_idx").write.format(FORMAT).option("freq", freq).option("how", how).mode("append").save(folder)
