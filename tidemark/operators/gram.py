"""Covariances of many series from block Gram matrices.

Series are numbered and cut into bands of neighbouring numbers. The values are packed once, some ten bytes each, and a band's packed values go to one group for each other band: a task holds two bands, and
fills dense pieces of BLOCK series and PIECE dates of both, x for the values and m for the marks of what is known, and adds up their products x'x, m'm, x'm and m'x. So a pair of series gets its number of
common dates, its sum of products and its sums over the common dates; finished pairs leave the task, no sums of them are exchanged. There is no pivot and no row for each pair and date.

A band holds some BLOCK * SHARE values, so bands, and with them how often a value is sent, grow in number with the values and not with the series. Where a band is down to one block and calendars are
longer than that, or pairs of blocks are fewer than tasks, the dates are dealt into shares, and BLOCK x BLOCK arrays of the shares are added up. A task holds two bands and some blocks, whatever the number of dates or series.

Values are centred by their series' mean before, so that sums of products keep their digits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.working import cut, written

#: Series in a dense block, dates in a dense piece.
BLOCK, PIECE = 256, 4096
#: A band holds as many values as a block of series with so many dates each.
SHARE = 16384
#: Rows that are packed at a time.
GATHER = 1 << 20
#: So many names (some dozen bytes each) or dates may be broadcast.
SMALL = 1_000_000
MISSING = ("ignore", "mask", "fill")
PACKED = "own int, share int, codes binary, sizes binary, dates binary, cells binary"
PACKED_SCHEMA = pa.schema([("own", pa.int32()), ("share", pa.int32()), *((c, pa.binary()) for c in ("codes", "sizes", "dates", "cells"))])
PARTS = "bi int, bj int, products binary, counts binary, lefts binary, rights binary"
PART_SCHEMA = pa.schema([("bi", pa.int32()), ("bj", pa.int32()), *((c, pa.binary()) for c in ("products", "counts", "lefts", "rights"))])
PAIRS = "x long, y long, n double, xy double, sx double, sy double"
PAIR_SCHEMA = pa.schema([("x", pa.int64()), ("y", pa.int64()), *((c, pa.float64()) for c in ("n", "xy", "sx", "sy"))])


def _pack(place: np.dtype):
    """Rows (own, share, code, date, value), in any order, as a row for each band and share of some GATHER of them: numbers of the series, how many values each has, and these values' dates, sorted."""

    def pack(held):
        t = pa.Table.from_batches(held)
        c = {k: t.column(k).to_numpy() for k in t.column_names}
        order = np.lexsort((c["date"], c["code"], c["share"], c["own"]))
        c = {k: v[order] for k, v in c.items()}
        edges = np.flatnonzero((c["own"][1:] != c["own"][:-1]) | (c["share"][1:] != c["share"][:-1])) + 1
        rows = []
        for a, b in zip([0, *edges], [*edges, len(order)], strict=True):
            codes, sizes = np.unique(c["code"][a:b], return_counts=True)
            rows.append((int(c["own"][a]), int(c["share"][a]), codes.astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), c["date"][a:b].astype(place).tobytes(), c["value"][a:b].astype("<f8").tobytes()))
        return pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), PACKED_SCHEMA, strict=True)], schema=PACKED_SCHEMA)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= GATHER:
                yield pack(held)
                held = []
        if held:
            yield pack(held)

    return run


class Band:
    """A band's values, by series and date."""

    def __init__(self, rows: list[tuple], place: np.dtype):
        codes, sizes, dates, cells = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in enumerate(("<i8", "<i4", place, "<f8")))
        self.codes, at = np.unique(codes, return_inverse=True)
        at = np.repeat(at.astype(np.int32), sizes)
        order = np.argsort(at, kind="stable")
        self.at, self.dates, self.cells = at[order], dates[order], cells[order]

    def blocks(self, block: int) -> list[tuple[int, int]]:
        return [(a, min(a + block, len(self.codes))) for a in range(0, len(self.codes), block)]

    def piece(self, a: int, b: int, first: int, span: int) -> np.ndarray:
        """Values of the series a to b on the dates from first on, and beside them the marks of those that are known."""
        own = slice(*np.searchsorted(self.at, [a, b]))
        at, date, cell = self.at[own] - a, self.dates[own].astype(np.int64) - first, self.cells[own]
        inside = (date >= 0) & (date < span)
        out = np.zeros((span, 2 * (b - a)))
        out[date[inside], at[inside]] = cell[inside]
        out[date[inside], at[inside] + (b - a)] = 1
        return out


def _sums(left: Band, right: Band, block: int, days: int):
    """(numbers of the left series, of the right ones, their four products) for the pairs of blocks; of one band with itself those on and above the diagonal."""
    for a, b in left.blocks(block):
        for c, d in right.blocks(block):
            if left is right and c < a:
                continue
            w, total = b - a, np.zeros((2 * (b - a), 2 * (d - c)))
            for first in range(0, days, PIECE):
                span = min(PIECE, days - first)
                total += left.piece(a, b, first, span).T @ right.piece(c, d, first, span)
            v = d - c
            yield left.codes[a:b], right.codes[c:d], np.stack([total[:w, :v], total[w:, v:], total[:w, v:], total[w:, :v]])


def _pairs(block: int, days: int, shares: int, place: np.dtype):
    """Groups of packed rows come sorted by pair of bands and share. Without shares the pairs of series are finished, else each group's sums are a part of its pair of blocks."""

    def part(key, whole):
        return pa.record_batch([pa.array([v], f.type) for v, f in zip([key[0], key[1], *(t.tobytes() for t in whole)], PART_SCHEMA, strict=True)], schema=PART_SCHEMA)

    def out(key, sides):
        left = Band(sides[0], place) if sides[0] else None
        right = left if key[0] == key[1] else Band(sides[1], place) if sides[1] else None
        if left is None or right is None:
            if shares > 1:  # the pair may have no share with both
                yield part(key, np.zeros((4, block, block)))
            return
        for i, j, total in _sums(left, right, block, days):
            if shares > 1:
                whole = np.zeros((4, block, block))
                whole[np.ix_(range(4), i - key[0] * block, j - key[1] * block)] = total
                yield part(key, whole)
                continue
            columns = [np.repeat(i, len(j)), np.tile(j, len(i)), *(total[k].ravel() for k in (1, 0, 2, 3))]
            if i[-1] > j[0]:  # a block with itself
                above = columns[0] <= columns[1]
                columns = [v[above] for v in columns]
            yield pa.record_batch([pa.array(v) for v in columns], schema=PAIR_SCHEMA)

    def run(batches):
        key, sides = None, ([], [])
        for batch in batches:
            for r in batch.to_pylist():
                own = (r["bi"], r["bj"], r["share"])
                if own != key:
                    if key is not None:
                        yield from out(key, sides)
                    key, sides = own, ([], [])
                sides[r["side"]].append((r["codes"], r["sizes"], r["dates"], r["cells"]))
        if key is not None:
            yield from out(key, sides)

    return run


def _whole(block: int, series: int):
    """The shares of a pair of blocks, sorted by pair, added up to a row for each pair of series, those without a common date too."""

    def out(key, total):
        n, xy, sx, sy = total[1], total[0], total[2], total[3]
        i, j = np.arange(block) + key[0] * block, np.arange(block) + key[1] * block
        x, y = np.nonzero((i[:, None] <= j[None, :]) & (j[None, :] < series))
        return pa.record_batch([pa.array(x + key[0] * block), pa.array(y + key[1] * block), *(pa.array(v[x, y]) for v in (n, xy, sx, sy))], schema=PAIR_SCHEMA)

    def run(batches):
        key, total = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["bi"], r["bj"]) != key:
                    if total is not None:
                        yield out(key, total)
                    key, total = (r["bi"], r["bj"]), np.zeros((4, block, block))
                total += np.stack([np.frombuffer(r[c]).reshape(block, block) for c in ("products", "counts", "lefts", "rights")])
        if total is not None:
            yield out(key, total)

    return run


def pair_sums(values: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, n, xy, sx, sy, ma, mb, na, nb, da, db) for a <= b of values (instrument, datetime, value): common dates, sums over them of products and of each value less its series' mean; of each series
    the mean, number and deviation of all values. The values are written once, as they are read three times and may differ in the last digit when worked out anew."""
    return _pair_sums(_stored(values), block)


def _stored(values: DataFrame) -> DataFrame:
    return written(values.select("instrument", "datetime", F.col("value").cast("double").alias("value")))


def _pair_sums(values: DataFrame, block: int) -> DataFrame:
    spark = values.sparkSession
    known = values.filter(F.col("value").isNotNull() & F.col("instrument").isNotNull())
    means = known.groupBy("instrument").agg(F.avg("value").alias("mean"), F.count("value").alias("count"), F.stddev_samp("value").alias("std"))
    names = Window.orderBy("instrument")  # over the list of names
    before = F.coalesce(F.sum("count").over(names.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    codes = cut(means.select("instrument", "mean", "count", "std", (F.row_number().over(names) - 1).cast("long").alias("code"), before.alias("before")))
    calendar = cut(known.select("datetime").distinct().select("datetime", (F.row_number().over(Window.orderBy("datetime")) - 1).alias("date")))  # over the list of dates
    found, cells = codes.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
    days, n = calendar.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    room = block * SHARE
    bands = max(1, min(-(-found // block), max(math.ceil(2 * math.sqrt(n)), -(-cells // room))))
    pairs = bands * (bands + 1) // 2
    shares = max(1, min(days, max(-(-cells // (bands * room)), n // pairs))) if bands * block >= found else 1
    own = F.floor(F.col("code") / block) if shares > 1 else F.floor(F.col("before") * bands / max(1, cells))
    place = np.dtype("<u2" if days <= 1 << 16 else "<i4")
    of = codes.select("instrument", "mean", "code", own.cast("int").alias("own"))
    rows = known.join(F.broadcast(of) if found <= SMALL else of, "instrument").join(F.broadcast(calendar.withColumnRenamed("datetime", "_day")) if days <= SMALL else calendar.withColumnRenamed("datetime", "_day"), F.col("datetime").eqNullSafe(F.col("_day")))
    rows = rows.select("own", F.pmod("date", F.lit(shares)).cast("int").alias("share"), "code", F.floor(F.col("date") / shares).cast("int").alias("date"), (F.col("value") - F.col("mean")).alias("value"))
    packed = cut(rows.mapInArrow(_pack(place), PACKED))
    sent = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("other"))
    sent = sent.select(F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "share", (F.col("own") > F.col("other")).cast("int").alias("side"), "codes", "sizes", "dates", "cells")
    groups = sent.repartition(max(n, pairs * shares), "bi", "bj", "share").sortWithinPartitions("bi", "bj", "share")
    sums = groups.mapInArrow(_pairs(block, -(-days // shares), shares, place), PARTS if shares > 1 else PAIRS)
    if shares > 1:
        sums = sums.repartition(n, "bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(_whole(block, found), PAIRS)
    for c, name in (("x", "a"), ("y", "b")):
        side = codes.select(F.col("code").alias(c), F.col("instrument").alias(name), F.col("mean").alias(f"m{name}"), F.col("count").alias(f"n{name}"), F.col("std").alias(f"d{name}"))
        sums = sums.join(F.broadcast(side) if found <= SMALL else side, c)
    return sums.select("a", "b", "n", "xy", "sx", "sy", "ma", "mb", "na", "nb", "da", "db")


def sample_covariance(values: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, n, cov, corr) for a <= b over the n dates that both have, n - 1 below, NULL for one; corr divides by the deviations of each series over all of its dates. Pairs without a common date have no row."""
    p = pair_sums(values, block).filter("n > 0")
    cov = F.when(F.col("n") > 1, (F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1))
    p = p.select("a", "b", F.col("n").cast("long").alias("n"), cov.alias("cov"), "da", "db")
    return p.select("a", "b", "n", "cov", F.try_divide("cov", F.col("da") * F.col("db")).alias("corr"))


def covariance(values: DataFrame, missing: str = "mask", centred: bool = False, block: int = BLOCK) -> DataFrame:
    """(a, b, cov) for a <= b, with the number of observations below. centred: values count as centred already.

    missing: ``mask`` centres each series by its own mean and takes the dates that both have; ``ignore`` the same, but a pair with any missing value is NULL; ``fill``: missing values
    are 0, over all dates. Dates are those that any series has.
    """
    if missing not in MISSING:
        raise ValueError(f"missing must be one of {MISSING}")
    values = _stored(values)
    p = _pair_sums(values, block)
    if missing != "fill":
        p = p.filter("n > 0")
    if missing == "fill":
        t = F.lit(values.select("datetime").distinct().count()).cast("double")
        level = F.col("na") * F.col("ma") / t * (F.col("nb") * F.col("mb") / t)  # product of the means with zeros filled in
        raw = F.col("xy") + F.col("ma") * F.col("sy") + F.col("mb") * F.col("sx") + F.col("n") * F.col("ma") * F.col("mb")
        return p.select("a", "b", (raw / t - (F.lit(0.0) if centred else level)).alias("cov"))
    total = F.col("xy")
    if centred:
        total = total + F.col("ma") * F.col("sy") + F.col("mb") * F.col("sx") + F.col("n") * F.col("ma") * F.col("mb")
    cov = F.try_divide(total, F.col("n"))
    if missing == "ignore":
        cov = F.when(F.col("n") == values.select("datetime").distinct().count(), cov)
    return p.select("a", "b", cov.alias("cov"))
