"""Exact quantiles of any number of groups without sorting or listing a group.

A quantile between ranks needs one or two order statistics. Each is closed in on. The first look counts all rows by the logarithm of their size, STEPS to a factor of e; the bucket that holds a rank is its first bracket, and
only the rows in such brackets, mostly a few in a hundred, are read from there on. They fall into BINS equal bins, a count for each bin
tells which bin holds the rank, and that bin's least and greatest value are the next bracket. All groups and ranks go together, and counts are added up in the tasks before
they are shuffled, so a group that holds a third of all rows costs each task as many counts as it has buckets. A bracket of at most FEW rows is read off as a list;
one whose ends are equal needs no more. Each round's brackets are a small table, kept in the shared folder; all rows are read twice, those in brackets once a round, and there are one or two.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.working import cut

#: Bins of a bracket, rows of a bracket that are listed, brackets that are broadcast.
BINS, FEW, SMALL = 2048, 256, 200_000
#: Buckets of the first look to a factor of e, on both sides of 0.
STEPS = 24


def order_statistics(rows: DataFrame, keys: Sequence[str], ranks: DataFrame, bins: int = BINS, few: int = FEW, max_rounds: int = 100, buckets: DataFrame | None = None) -> DataFrame:
    """(keys, rank, value): the value of each 0-based rank that ranks (keys, rank) asks of the group's values in order; rows: (keys, value), no missing ones. Null keys are groups too.

    Rows are read once for the buckets (``bucketed``, where they aren't given) and once for what is in brackets, and must be the same each time: write them first (``quantiles`` does).
    """
    buckets = bucketed(rows, keys) if buckets is None else buckets
    named = {k: f"_k{i}" for i, k in enumerate(keys)}
    plain = rows.select(*(F.col(k).alias(v) for k, v in named.items()), F.col("value").cast("double").alias("value"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*named.values()).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = buckets.select(*(F.col(k).alias(v) for k, v in named.items()), "bucket", "lo", "hi", "n").withColumn("below", before)
    asked = ranks.select(*(F.col(k).alias(v) for k, v in named.items()), F.col("rank").cast("long").alias("rank")).distinct()
    wide = cut(asked.alias("a").join(ends.alias("e"), _same(named)).filter("a.rank >= e.below and a.rank < e.below + e.n").select("a.*", "e.lo", "e.hi", "e.n", "e.below"))
    plain = _bracketed(plain, wide, named, buckets)
    settled = None
    for turn in range(max_rounds):
        now = wide.filter(f"lo = hi or n <= {few}")
        settled = now if settled is None else settled.unionByName(now)
        wide = wide.filter(f"lo <> hi and n > {few}")
        if wide.isEmpty():
            break
        wide = cut(_narrowed(plain, wide, named, bins, turn % 2 == 1))
    else:
        raise RuntimeError(f"order_statistics: not settled after {max_rounds} rounds")
    told = settled.filter("lo = hi").select(*named.values(), "rank", F.col("lo").alias("value"))
    done = told.unionByName(_listed(plain, settled.filter("lo <> hi"), named))
    return done.select(*(F.col(v).alias(k) for k, v in named.items()), "rank", "value")


def _same(named: dict[str, str], a: str = "a", b: str = "e"):
    out = F.lit(True)
    for k in named.values():
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def bucketed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, bucket, lo, hi, n): each group's rows by the logarithm of their size, buckets in the order of values. Written, as sizes, ends and first brackets are read from it."""
    at = F.floor(F.greatest(F.least(_magnitude(F.col("value").cast("double")) * STEPS, F.lit(1e6)), F.lit(-1e6))).cast("int")
    return cut(rows.groupBy(*keys, at.alias("bucket")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n")))


def _bracketed(plain: DataFrame, brackets: DataFrame, named: dict[str, str], buckets: DataFrame) -> DataFrame:
    """The rows that fall into any of the first brackets, which are buckets and so don't overlap; written. All rows, as they are, where that is more than half of them."""
    spans = brackets.filter("lo <> hi").select(*named.values(), "lo", "hi", "n").distinct()
    held, n = spans.agg(F.sum("n")).first()[0], buckets.agg(F.sum("n")).first()[0]
    return plain if 2 * (held or 0) > (n or 0) else cut(_within(plain, spans, named).select("a.*"))


def _within(plain: DataFrame, brackets: DataFrame, named: dict[str, str]) -> DataFrame:
    few = F.broadcast(brackets) if brackets.count() <= SMALL else brackets
    return plain.alias("a").join(few.alias("e"), _same(named)).filter("a.value >= e.lo and a.value <= e.hi")


def _listed(plain: DataFrame, brackets: DataFrame, named: dict[str, str]) -> DataFrame:
    held = _within(plain, brackets, named).groupBy(*(f"e.{k}" for k in named.values()), "e.rank", "e.below").agg(F.array_sort(F.collect_list("a.value")).alias("values"))
    return held.select(*named.values(), "rank", F.get("values", (F.col("rank") - F.col("below")).cast("int")).alias("value"))


def _magnitude(x):
    """Grows with x, by the logarithm of its size on both sides of 0."""
    size = F.greatest(F.ln(F.abs(x)) + 745, F.lit(0.0))
    return F.when(x == 0, F.lit(0.0)).when(x > 0, size).otherwise(-size)


def _narrowed(plain: DataFrame, brackets: DataFrame, named: dict[str, str], bins: int, logarithmic: bool) -> DataFrame:
    """The next round's brackets. Every other round's bins are equal in the logarithm, as a few far values may put all others into one equal bin."""
    value, low, high = (_magnitude(F.col(c)) if logarithmic else F.col(c) / bins for c in ("a.value", "e.lo", "e.hi"))
    at = F.when(F.col("a.value") == F.col("e.hi"), bins - 1).when(high == low, F.lit(0)).otherwise(F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1)))
    keys = [*named.values(), "rank"]
    counted = _within(plain, brackets, named).select(*(f"e.{k}" for k in keys), "e.below", F.col("a.value").alias("value"), at.cast("int").alias("bin")).groupBy(*keys, "below", "bin").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("below", F.col("below") + before)
    return placed.filter("rank >= below and rank < below + n").select(*keys, "lo", "hi", "n", "below")


def quantiles(rows: DataFrame, keys: Sequence[str], probabilities: Sequence[float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """(keys, p, value) for each group of rows (keys, value) and each probability, linear between ranks; missing values don't count, a group without values has no row.

    The rows are written once: they are read several times, and a sum that comes out another last digit when worked out anew falls out of the bracket that it made.
    """
    known = cut(rows.filter(F.col("value").isNotNull()).select(*keys, "value"))
    return _of_stored(known, bucketed(known, keys), keys, probabilities, bins, few)


def _of_stored(known: DataFrame, buckets: DataFrame, keys: Sequence[str], probabilities: Sequence[float], bins: int = BINS, few: int = FEW) -> DataFrame:
    sizes = buckets.groupBy(*keys).agg(F.sum("n").alias("n"))
    at = F.col("p") * (F.col("n") - 1)
    asked = sizes.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in probabilities)))).select(*keys, "p", F.floor(at).alias("low"), F.ceil(at).alias("high"), (at - F.floor(at)).alias("part"))
    ranks = asked.select(*keys, F.col("low").alias("rank")).unionByName(asked.select(*keys, F.col("high").alias("rank")))
    found = order_statistics(known, keys, ranks, bins, few, buckets=buckets)
    out = asked
    for name in ("low", "high"):
        side = found.select(*(F.col(k).alias(f"_{name}_{k}") for k in keys), F.col("rank").alias(f"_{name}"), F.col("value").alias(f"{name}_value"))
        cond = F.col(name) == F.col(f"_{name}")
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_{name}_{k}"))
        out = out.join(side, cond).drop(f"_{name}", *(f"_{name}_{k}" for k in keys))
    value = F.when(F.col("part") == 0, F.col("low_value")).otherwise(F.col("low_value") * (1 - F.col("part")) + F.col("high_value") * F.col("part"))
    return out.select(*keys, "p", value.alias("value"))


def median_and_deviation(rows: DataFrame, keys: Sequence[str], stored: bool = False, **more) -> DataFrame:
    """(keys, median, mad, low, high): the median, the median distance from it and the ends of each group of rows (keys, value). The rows are written once, as they are read four times; stored: they come from a written table already.

    Distances are worked out each time that they are read: a difference of two stored numbers is the same wherever it is made.
    """
    rows = rows.filter(F.col("value").isNotNull()).select(*keys, "value")
    rows = rows if stored else cut(rows)
    buckets = bucketed(rows, keys)
    ends = buckets.groupBy(*(F.col(k).alias(f"_m{i}") for i, k in enumerate(keys))).agg(F.min("lo").alias("low"), F.max("hi").alias("high"))
    found = _of_stored(rows, buckets, keys, [0.5], **more).select(*keys, F.col("value").alias("median"))
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_m{i}"))
    middle = cut(found.join(ends, cond).select(*ends.columns, "median"))
    small = F.broadcast(middle) if middle.count() <= SMALL else middle
    away = rows.join(small, cond).select(*keys, F.abs(F.col("value") - F.col("median")).alias("value"))
    mad = _of_stored(away, bucketed(away, keys), keys, [0.5], **more).select(*keys, F.col("value").alias("mad"))
    return mad.join(middle, cond).select(*keys, "median", "mad", "low", "high")


def percentile_bins(values: DataFrame, benchmark: DataFrame, n: int, **more) -> DataFrame:
    """values (instrument, datetime, value, any more) with bin: the bin of each date's benchmark (datetime, value) quantiles that the value falls into, 1 holding the largest.

    A bin starts at its lower quantile; the lowest and the highest are open. Missing values and dates without a benchmark have no bin.
    """
    edges = quantiles(benchmark, ["datetime"], [k / n for k in range(1, n)], **more)
    edges = cut(edges.groupBy("datetime").agg(F.array_sort(F.collect_list("value")).alias("edges")))
    small = F.broadcast(edges) if edges.count() <= SMALL else edges
    reached = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    return values.join(small, "datetime", "left").select(*(F.col(f"`{c}`") for c in values.columns), F.when(F.col("value").isNotNull() & F.col("edges").isNotNull(), (n - reached).cast("int")).alias("bin"))
