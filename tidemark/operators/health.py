"""Data checks on bars: missing values, large steps, absent columns and factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def missing(bars: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values of each column by instrument."""
    return bars.groupBy("instrument").agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))


def large_steps(bars: DataFrame, column: str, threshold: float) -> DataFrame:
    """instrument, largest step (relative change) and its date, where above the threshold."""
    step = F.abs(F.try_divide(F.col(column), F.lag(column).over(Window.partitionBy("instrument").orderBy("datetime"))) - 1)
    found = bars.select("instrument", "datetime", step.alias("step")).groupBy("instrument").agg(F.max("step").alias("step"), F.max_by("datetime", "step").alias("datetime"))
    return found.filter(F.col("step") > threshold)


def absent_columns(bars: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c not in bars.columns]


def without_factor(bars: DataFrame, factor: str = "factor") -> DataFrame:
    """Instruments whose factor is missing throughout."""
    return bars.groupBy("instrument").agg(F.count(factor).alias("n")).filter("n = 0").select("instrument")


def differences(source: DataFrame, stored: DataFrame, columns: list[str], rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Rows of either side whose values aren't close to the other's."""
    both = source.alias("a").join(stored.alias("b"), ["instrument", "datetime"], "full")
    near = F.lit(True)
    for c in columns:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        near = near & F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), x.isNull() & y.isNull())
    return both.filter(~near).select("instrument", "datetime", *(F.col(f"a.{c}").alias(c) for c in columns), *(F.col(f"b.{c}").alias(f"{c}_stored") for c in columns))
