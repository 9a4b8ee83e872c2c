"""Dynamic universes: membership spans narrowed by rules, and row selectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.compiler import Panel, features
from tidemark.sources.panels import clip_universe, spans_of


@dataclass(frozen=True)
class NameFilter:
    """Instruments whose code matches the pattern from its start on."""

    pattern: str

    def apply(self, panel: Panel, universe: DataFrame) -> DataFrame:
        return universe.filter(F.col("instrument").rlike(f"^(?:{self.pattern})"))


@dataclass(frozen=True)
class ExpressionFilter:
    """Bars for which an expression holds; ``start`` .. ``end`` bounds where the rule works, ``keep`` decides for instruments without bars."""

    expression: str
    start: object = None
    end: object = None
    keep: bool = False

    def apply(self, panel: Panel, universe: DataFrame) -> DataFrame:
        c = panel.context
        held = panel.bars.select(c.instrument, c.time, c.index).join(
            universe.select(F.col("instrument").alias("_i"), F.col("start").alias("_s"), F.col("end").alias("_e")),
            (F.col(c.instrument) == F.col("_i")) & (F.col(c.time) >= F.col("_s")) & (F.col(c.time) <= F.col("_e")), "left_semi",
        )
        rule = features(panel, {"keep": self.expression})
        flags = held.join(rule, panel.keys, "left")
        outside = F.lit(False)
        if self.start is not None:
            outside = outside | (F.col(c.time) < F.lit(self.start))
        if self.end is not None:
            outside = outside | (F.col(c.time) > F.lit(self.end))
        flags = flags.withColumn("keep", outside | F.coalesce(F.col("keep").cast("boolean"), F.lit(self.keep)))
        found = spans_of(flags, "keep", c)
        if not self.keep:
            return found
        empty = universe.join(panel.bars.select(F.col(c.instrument).alias("instrument")).distinct(), "instrument", "left_anti").select("instrument", "start", "end")
        return found.unionByName(empty)


def instruments(panel: Panel, universe: DataFrame, filters: tuple = (), start=None, end=None) -> DataFrame:
    """Spans cut to the range, then the filters in order."""
    out = clip_universe(universe, start, end)
    for f in filters:
        out = f.apply(panel, out)
    return out


def full_history(panel_rows: DataFrame, start, end) -> DataFrame:
    """Rows of instruments whose data reach from start to end."""
    ends = panel_rows.groupBy("instrument").agg(F.min("datetime").alias("a"), F.max("datetime").alias("b"))
    return panel_rows.join(ends.filter((F.col("a") <= F.lit(start)) & (F.col("b") >= F.lit(end))), "instrument", "left_semi")


def tradable(bars: DataFrame, limit: float, close: str = "close", change: str = "change") -> DataFrame:
    """Adds suspended, limit_buy and limit_sell: no close, or a change beyond the limit."""
    gone = F.col(close).isNull()
    return bars.select("*", gone.alias("suspended"), (gone | F.coalesce(F.col(change) >= limit, F.lit(False))).alias("limit_buy"), (gone | F.coalesce(F.col(change) <= -limit, F.lit(False))).alias("limit_sell"))
