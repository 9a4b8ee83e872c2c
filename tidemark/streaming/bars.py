"""Streams: ticks to bars with a watermark, and features that follow an append-only table of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.compiler import Panel, features, reach
from tidemark.plans.expr import parse
from tidemark.sources.panels import merge_latest, panel


def stream_bars(ticks: DataFrame, instrument: str, time: str, value: str, size: str = "1 day", delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Bars of a stream of ticks; ticks later than delay behind the newest are dropped."""
    stamped = ticks.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", delay)
    bin_ = F.window("_t", size, slide) if slide else F.window("_t", size)
    found = stamped.groupBy(bin_.alias("w"), F.col(instrument).cast("string").alias("instrument")).agg(
        F.min_by(value, "_t").alias("open"), F.max_by(value, "_t").alias("close"), F.max(value).alias("high"), F.min(value).alias("low"), F.count("*").cast("double").alias("volume"), F.avg(value).alias("vwap")
    )
    return found.select("instrument", F.col("w.start").alias("datetime"), "open", "close", "high", "low", "volume", "vwap")


def sessions(ticks: DataFrame, instrument: str, time: str, value: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of ticks with no pause longer than gap."""
    stamped = ticks.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", delay)
    found = stamped.groupBy(F.session_window("_t", gap).alias("w"), F.col(instrument).cast("string").alias("instrument")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select("instrument", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def run_available(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Everything that is there now, written as Parquet under path, and nothing later."""
    stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def updated_features(stored: DataFrame, bars: DataFrame, fields: dict[str, str], since) -> DataFrame:
    """stored features with those of the bars after since added, and those recomputed that look ahead past it.

    Only the bars that the expressions reach back to are read again.
    """
    whole: Panel = panel(bars)
    reaches = [reach(parse(e)) for e in fields.values()]
    if None in reaches:
        return features(whole, fields)
    ahead = max(b for _, b in reaches)
    place = whole.bars.filter(F.col("datetime") <= F.lit(since)).agg(F.max("cal_idx")).first()[0]
    first = whole.bars.filter(F.col("cal_idx") > (place if place is not None else -1) - ahead).agg(F.min("datetime")).first()[0]
    return merge_latest(stored, features(whole, fields, start=first, lookback=True))
