"""Files: calendars, universes, bars from CSV or Parquet, dated facts, and materialised feature tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.compiler import Panel, features
from tidemark.plans.expr import Node, parse


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """(datetime, cal_idx) of a text file with a time on each line."""
    lines = spark.read.text(path).select(F.to_timestamp(F.trim("value")).alias("datetime")).filter("datetime is not null").distinct()
    return lines.withColumn("cal_idx", F.row_number().over(Window.orderBy("datetime")).cast("long") - 1)


def write_calendar(calendar: DataFrame, path: str) -> None:
    calendar.select(F.date_format(F.col("datetime").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("value")).orderBy("value").coalesce(1).write.mode("overwrite").text(path)  # one file: a calendar


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """(instrument, start, end) of a tab-separated file; an instrument may have several spans."""
    return spark.read.csv(path, sep="\t", schema="instrument string, start date, end date")


def write_universe(universe: DataFrame, path: str) -> None:
    universe.select("instrument", "start", "end").write.mode("overwrite").csv(path, sep="\t")


def read_bars(spark: SparkSession, path: str, kind: str = "csv", instrument: str = "symbol", time: str = "date") -> DataFrame:
    """Bars of CSV (leading zeros of codes are kept) or Parquet files, with keys instrument and datetime."""
    df = spark.read.csv(path, header=True) if kind == "csv" else spark.read.parquet(path)
    others = [c for c in df.columns if c not in (instrument, time)]
    return df.select(F.col(instrument).cast("string").alias("instrument"), F.to_date(time).alias("datetime"), *(F.col(c).cast("double").alias(c) for c in others))


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by year; each task holds whole instruments, so that windows over the table read few files."""
    bars.withColumn("year", F.year("datetime")).repartition("year", "instrument").sortWithinPartitions("instrument", "datetime").write.mode(mode).partitionBy("year").parquet(path)


def read_facts(spark: SparkSession, path: str, instrument: str = "instrument") -> DataFrame:
    """Dated facts from CSV with columns date (YYYYMMDD), period, value, field and the instrument."""
    df = spark.read.csv(path, header=True)
    return df.select(F.col(instrument).alias("instrument"), "field", F.to_date(F.col("date").cast("string"), "yyyyMMdd").alias("pub_date"), F.col("period").cast("int").alias("period"), F.col("value").cast("double").alias("value"))


def later_facts(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Facts published after the last stored one of their instrument and field."""
    last = stored.groupBy("instrument", "field").agg(F.max("pub_date").alias("known_to"))
    return new.join(last, ["instrument", "field"], "left").filter(F.col("known_to").isNull() | (F.col("pub_date") > F.col("known_to"))).drop("known_to")


def code_of(fields: dict[str, str | Node], freq: str = "day") -> str:
    """A key of a field list that doesn't depend on how its texts are written."""
    text = "|".join(f"{k}={parse(v)}" for k, v in sorted(fields.items()))
    return hashlib.md5(f"{freq}|{text}".encode(), usedforsecurity=False).hexdigest()


def materialised(panel: Panel, fields: dict[str, str | Node], folder: str, freq: str = "day") -> DataFrame:
    """The features, read from the table under folder that an earlier call with an equal field list has written, or written now."""
    spark = panel.bars.sparkSession
    path = f"{folder}/{code_of(fields, freq)}"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        features(panel, fields).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
