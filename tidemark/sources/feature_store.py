"""Stored features that follow their bars: only what new bars change is computed again, only partitions that change are written.

A store is a Parquet table partitioned by ``part``, the month of the bar. ``update`` finds for each instrument the bars behind its last stored one, and before that as many as the fields look ahead;
these rows are computed from the bars that the fields reach back to. Months that get rows are put together with what stays of them, kept in the shared folder, and swapped in by
dynamic partition overwrite; all other months keep their files. An update that broke off can be run again: it starts from what is stored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import chunked
from tidemark.plans.compiler import Panel, features, reach
from tidemark.plans.expr import parse
from tidemark.sources.working import cut

#: Months whose names may be broadcast.
SMALL = 100_000
KEYS = ["instrument", "datetime"]


def computed(panel: Panel, fields: Mapping[str, str]) -> DataFrame:
    """The fields in chunks of time where they allow it, else over whole series."""
    plan = chunked.features if all(chunked.chunkable(parse(e)) for e in fields.values()) else features
    return plan(panel, dict(fields))


def parted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("part", F.date_format("datetime", "yyyyMM"))


def create(panel: Panel, fields: Mapping[str, str], root: str) -> None:
    """Writes the features of all bars."""
    parted(computed(panel, fields)).repartition("part").write.partitionBy("part").mode("overwrite").parquet(root)


def read(spark: SparkSession, root: str) -> DataFrame:
    """instrument, datetime and the features, with part, by which filters read only their months."""
    table = spark.read.parquet(root)
    return table.withColumn("part", F.col("part").cast("string"))


def changed(stored: DataFrame, panel: Panel, fields: Mapping[str, str]) -> DataFrame:
    """The rows of instruments with new bars that update would put."""
    reaches = [reach(parse(e)) for e in fields.values()]
    whole = None in reaches
    back, ahead = (0, 0) if whole else (max(a for a, _ in reaches), max(b for _, b in reaches))
    index, bars = panel.context.index, panel.bars
    last = stored.groupBy("instrument").agg(F.max("datetime").alias("datetime")).join(bars.select(*KEYS, index), KEYS, "left").select("instrument", F.col(index).alias("_last"))
    ends = bars.groupBy("instrument").agg(F.max(index).alias("_end")).join(last, "instrument", "left").filter(F.col("_last").isNull() | (F.col("_end") > F.col("_last")))
    first = F.lit(0).cast("long") if whole else F.coalesce(F.col("_last") + 1 - ahead, F.lit(0).cast("long"))
    own = bars.join(ends.select("instrument", first.alias("_first")), "instrument").withColumn("_fresh", F.col(index) >= F.col("_first"))
    own = own if whole else own.filter(F.col(index) >= F.col("_first") - back)
    return computed(Panel(own.drop("_first"), panel.context, panel.pit), {**fields, "_fresh": "$_fresh"}).filter("_fresh").drop("_fresh")


def merge(spark: SparkSession, root: str, rows: DataFrame) -> int:
    """Puts rows into the store, in place of those with their keys, and says how many months that wrote. rows: as the store's, without part; each key once."""
    fresh = cut(parted(rows))
    months = fresh.select("part").distinct()
    n = months.count()
    if not n:
        return 0
    stored = read(spark, root)
    touched = stored.join(F.broadcast(months) if n <= SMALL else months, "part", "left_semi").join(fresh.select(*KEYS), KEYS, "left_anti")
    staged = cut(touched.select(*fresh.columns).unionByName(fresh))
    staged.repartition("part").write.option("partitionOverwriteMode", "dynamic").partitionBy("part").mode("overwrite").parquet(root)
    return n


def update(root: str, panel: Panel, fields: Mapping[str, str]) -> int:
    """Brings the store up to the panel's bars, and says how many months that wrote: none when nothing is new."""
    spark = panel.bars.sparkSession
    return merge(spark, root, changed(read(spark, root), panel, fields))
