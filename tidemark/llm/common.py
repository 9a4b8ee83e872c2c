"""What several operators share: batches of documents, packed key exchange, working tables.

The packed exchange is used where a text has so many keys (words, phrases) that a
row for each would cost more than the keys themselves. Documents are dealt into
batches by a hash of their id and text. A batch sends each key partition one row
that holds its *distinct* keys as sorted 64-bit integers; the key partition answers
each batch in the same order. A key held by a third of all rows therefore arrives
once per batch, not once per row, and no task gathers rows of one key.
"""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside tasks: sorts before every other id.
NULL_ID = -(2**63)
BATCH_BYTES = 8 << 20
M64 = (1 << 64) - 1


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only in local mode, where none is set (tests)."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir() or found


#: Working tables of this process that are still there, in the order of their making.
TABLES: list[str] = []


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors.

    The table goes when the driver's JVM ends, or with ``dropped`` before.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    place = _place(spark, path)
    place[0].deleteOnExit(place[1])
    TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Deletes working tables that nothing reads any more."""
    for path in paths:
        system, place = _place(spark, path)
        system.delete(place, True)
        TABLES.remove(path)


#: Rows of one key that a join leaves together; a key with more is dealt over shares of about so many.
HOT_ROWS = 1_000_000
#: Hot keys that are broadcast: beyond HOT_ROWS times as many rows Spark chooses the join.
HOT_KEYS = 1_000_000


def joined_in_shares(rows: DataFrame, table: DataFrame, on: list[str], freq: str, spread: list[str], hot: int = HOT_ROWS) -> DataFrame:
    """rows joined (inner) with table on keys without nulls, where table's column freq says how many of the rows have the key; freq goes.

    A key that more than hot rows have is dealt into shares of them: a row takes the share that a hash of its columns spread names, the table's rows of the key go to all shares. table is read twice, so it should be
    a written one. Hot keys are fewer than rows / hot.
    """
    shares = F.ceil(F.col(freq) / hot).cast("int")
    keys = table.filter(F.col(freq) > hot).groupBy(*on).agg(F.max(shares).alias("_shares"))
    n = keys.count()
    if not n:
        return rows.join(table.drop(freq), on)
    dealt = rows.join(F.broadcast(keys) if n <= HOT_KEYS else keys, on, "left").withColumn("_share", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_shares")), F.lit(0)).cast("int"))
    copied = table.withColumn("_share", F.explode(F.sequence(F.lit(0), F.greatest(shares, F.lit(1)) - 1)))
    return dealt.drop("_shares").join(copied.drop(freq), [*on, "_share"]).drop("_share")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch_count(docs: DataFrame, column: str = "text", batch_bytes: int = BATCH_BYTES) -> int:
    """Batches of about batch_bytes each, and at least one for each shuffle partition."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(partitions(docs.sparkSession), math.ceil(total / batch_bytes))


def key_partitions(spark: SparkSession, batches: int, per_partition: int) -> int:
    """Partitions of the packed exchange: at least the session's, and more as the batches grow in number, so that none outgrows a task."""
    return max(partitions(spark), math.ceil(batches / per_partition))


def in_batches(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """(batch, id, text, more) of docs. Null ids become NULL_ID, null texts stay null."""
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    text = F.col(text_col).cast("string")
    return docs.select(F.pmod(F.xxhash64(ident, text), F.lit(n)).cast("int").alias("batch"), ident.alias("id"), text.alias("text"), *(v.alias(k) for k, v in more.items()))


def null_id(column: str, alias: str):
    """The id as it came: NULL_ID becomes null again."""
    return F.when(F.col(column) != NULL_ID, F.col(column)).alias(alias)


def column(table: pa.Table, name: str) -> pa.Array:
    got = table.column(name).combine_chunks()
    return got if isinstance(got, pa.Array) else pa.concat_arrays(got.chunks) if got.num_chunks else pa.array([], got.type)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return column(table, name).to_numpy(zero_copy_only=False)


def as_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def deal(keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(partition, from, to) of sorted keys, dealt by their leading bits, so that each partition's keys are a run; only of partitions that get some."""
    if not len(keys):
        return []
    part = ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return list(zip(part[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))


def text_slices(table: pa.Table, name: str = "text") -> tuple[memoryview, np.ndarray]:
    """The UTF-8 bytes of a column, without copying, and its n + 1 offsets; null is empty."""
    got = column(table, name)
    got = got.fill_null("") if got.null_count else got
    if not len(got):
        return memoryview(b""), np.zeros(1, np.int64)
    buf = got.buffers()
    offsets = np.frombuffer(buf[1], np.int32 if got.type in (pa.string(), pa.binary()) else np.int64)[got.offset : got.offset + len(got) + 1].astype(np.int64)
    return memoryview(buf[2] or b""), offsets


def pieces(offsets: np.ndarray, size: int = 1 << 20):
    """(first, last) row of runs of texts of about size bytes; a longer text is a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1))
        yield a, b
        a = b


# --- packed keys -----------------------------------------------------------------------------------------------


def _zstd():
    import zstandard

    return zstandard


def pack(a: np.ndarray) -> bytes:
    """An integer array as bytes: byte planes, then zstandard."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.zeros((a.dtype.itemsize, 0), np.uint8)
    return _zstd().ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(_zstd().ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys as differences: the leading bytes vanish."""
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Base of the rolling polynomial hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.ones(1, np.uint64)
        while len(got) < n:  # doubling
            got = np.concatenate([got, got * np.uint64(pow(base, len(got), 1 << 64))])
        if n <= 1 << 22:
            _powers[base] = got
    return got[:n]


#: The white space of the word rule [^\x20\x09-\x0D]+ and lower case for A-Z only.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE = 1 << 20


def word_hashes(data: memoryview, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words of each text, in order, and the number of words of each text.

    gap: which bytes stand between words; a space must be one.

    Works on pieces of about PIECE bytes, cut between words, so memory doesn't grow with the length of a text.
    """
    sizes = np.diff(offsets)
    flat = np.frombuffer(b" ".join([data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]) + b" ", np.uint8)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])  # where each text starts in flat
    hashes, begun, at = [], [], 0
    while at < len(flat):
        end = min(at + PIECE, len(flat))
        while end < len(flat) and not gap[flat[end - 1]]:
            more = np.flatnonzero(gap[flat[end : end + PIECE]])
            end = end + int(more[0]) + 1 if len(more) else min(end + PIECE, len(flat))
        piece = LOWER[flat[at:end]]
        space = gap[piece]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        start, stop = edge[0::2], edge[1::2]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(piece)), dtype=np.uint64)])
        h = (total[stop] - total[start]) * powers(BASE_INV, len(piece) + 1)[start]
        hashes.append(mix(h ^ ((stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))))
        begun.append(start + at)
        at = end
    begun = np.concatenate(begun) if begun else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(begun, first))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def sliding_min(a: np.ndarray, t: int) -> np.ndarray:
    """Minimum of every t neighbours: result[i] = min(a[i : i + t])."""
    return _sliding(a, t, np.minimum)


def sliding_max(a: np.ndarray, t: int) -> np.ndarray:
    return _sliding(a, t, np.maximum)


def _sliding(a: np.ndarray, t: int, f) -> np.ndarray:
    if len(a) < t:
        return a[:0]
    width, m = 1, a
    while 2 * width <= t:
        m = f(m[: len(m) - width], m[width:])
        width *= 2
    n = len(a) - t + 1
    return f(m[:n], m[t - width : t - width + n]) if width < t else m[:n]
