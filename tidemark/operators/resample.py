"""Operators that change the grain: resampling to time bins, and calendars of lower frequency."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.compiler import Panel, features

FUNCTIONS = {
    "sum": lambda x, t: F.sum(x), "mean": lambda x, t: F.avg(x), "max": lambda x, t: F.max(x), "min": lambda x, t: F.min(x), "count": lambda x, t: F.count(x),
    "std": lambda x, t: F.stddev_samp(x), "var": lambda x, t: F.var_samp(x), "median": lambda x, t: F.percentile(x, F.lit(0.5)), "prod": lambda x, t: F.product(x),
    "first": lambda x, t: F.min_by(x, F.when(x.isNotNull(), t)), "last": lambda x, t: F.max_by(x, F.when(x.isNotNull(), t)),
}


def register(name: str):
    """Decorator: adds an aggregate for resample, body(x, time, *others) -> Column of Spark aggregates; Spark adds up parts of a bin in the tasks before it shuffles them, so a crowded bin isn't one group."""

    def put(body):
        FUNCTIONS[name] = body
        return body

    return put


@register("wmean")
def _weighted_mean(x, t, weight):
    """Over bars where both are known."""
    return F.try_divide(F.sum(x * weight), F.sum(F.when(x.isNotNull(), weight)))


UNITS = {"min": "minutes", "minute": "minutes", "h": "hours", "d": "days", "day": "days", "w": "weeks", "week": "weeks"}


def duration(freq: str) -> str:
    m = re.fullmatch(r"(\d*)\s*(minute|min|h|day|d|week|w)", freq.lower())
    if not m:
        raise ValueError(f"no frequency {freq!r}")
    return f"{int(m[1] or 1)} {UNITS[m[2]]}"


def resample(panel: Panel, fields: dict[str, tuple[str, ...]], freq: str) -> DataFrame:
    """instrument, datetime (the bin's start) and name = function of expression for {name: (expression, function)}, or of several for {name: (expression, function, further expressions ...)}.

    Bins between an instrument's first and last that have no bar are kept with NULLs.
    """
    i, t = panel.keys
    rows = features(panel, {f"{k}|{j}": e for k, (first, _, *more) in fields.items() for j, e in enumerate((first, *more))})
    stamp = F.col(t).cast("timestamp")
    every = duration(freq)
    binned = rows.groupBy(i, F.window(stamp, every)["start"].alias("bin")).agg(*(FUNCTIONS[f](F.col(f"`{k}|0`").cast("double"), stamp, *(F.col(f"`{k}|{j + 1}`").cast("double") for j in range(len(more)))).alias(k) for k, (_, f, *more) in fields.items()))
    spine = binned.groupBy(i).agg(F.min("bin").alias("a"), F.max("bin").alias("b")).select(i, F.explode(F.expr(f"sequence(a, b, interval {every})")).alias("bin"))
    return spine.join(binned, [i, "bin"], "left").withColumnRenamed("bin", t)


def period_starts(calendar: DataFrame, time: str, freq: str, every: int = 1) -> DataFrame:
    """The first bar of each day, week or month of a calendar, then every so many of them."""
    cut: Column = F.date_trunc({"day": "day", "week": "week", "month": "month"}[freq], F.col(time).cast("timestamp"))
    firsts = calendar.groupBy(cut.alias("p")).agg(F.min(time).alias(time))
    k = F.row_number().over(Window.orderBy(time)) - 1  # over the calendar's periods
    return firsts.withColumn("k", k).filter(F.col("k") % every == 0).select(time)
