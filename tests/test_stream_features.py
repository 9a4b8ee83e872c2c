"""Stateful features of a stream equal those of the table, over batches, late bars and a restart."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans.compiler import Panel, features
from tidemark.streaming import features as streaming

FEATURES = (streaming.Feature("mean", "mean", 4), streaming.Feature("rank", "rank", 5), streaming.Feature("before", "ref", 3), streaming.Feature("ema", "ema", 5))
EXPRESSIONS = {"mean": "Mean($value, 4)", "rank": "Rank($value, 5)", "before": "Ref($value, 3)", "ema": "EMA($value, 5)"}


def rows_of(df):
    return sorted((r.instrument, str(r.datetime), *(None if r[f] is None or r[f] != r[f] else round(r[f], 9) for f in EXPRESSIONS)) for r in df.collect())


def test_stream_equals_table(spark, tmp_path):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    bars = [(i, start + dt.timedelta(hours=k), None if rng.random() < 0.1 else float(rng.randint(1, 30))) for k in range(60) for i in ("a", "b", "c") if rng.random() < 0.8]
    bars.sort(key=lambda r: r[1].timestamp() + rng.uniform(-1.5, 1.5) * 3600)  # out of order by up to three hours
    schema = "instrument string, datetime timestamp, value double"
    source = tmp_path / "in"
    stream = lambda: streaming.stream_features(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)), FEATURES, "4 hours")
    third = len(bars) // 3
    for part in range(3):
        own = bars[part * third : (part + 1) * third if part < 2 else None]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(source))
        streaming.run_available(stream(), str(tmp_path / "out"))  # each run is a restart from the state of the one before
    last = spark.createDataFrame([(i, start + dt.timedelta(hours=400), 1.0) for i in "abc"], schema)
    last.coalesce(1).write.mode("append").parquet(str(source))  # lets the watermark pass all others
    streaming.run_available(stream(), str(tmp_path / "out"))
    spark.createDataFrame([("a", start, 99.0)], schema).coalesce(1).write.mode("append").parquet(str(source))  # too late: dropped
    streaming.run_available(stream(), str(tmp_path / "out"))
    table = spark.createDataFrame(bars, schema).withColumn("cal_idx", F.row_number().over(Window.partitionBy("instrument").orderBy("datetime")).cast("long") - 1)  # bars that came are neighbours
    expect = features(Panel(table), EXPRESSIONS)
    got = spark.read.parquet(str(tmp_path / "out/data"))
    assert rows_of(got.filter(F.col("datetime") < start + dt.timedelta(hours=399))) == rows_of(expect)


def test_carried_sums_and_reach():
    rng = np.random.default_rng(1)
    x = np.where(rng.random(40) < 0.2, np.nan, rng.random(40))
    whole = streaming.followed(x, FEATURES, {}, 0)
    carried = {}
    first = streaming.followed(x[:15], FEATURES, carried, 0)
    second = streaming.followed(x[15 - 4 :], FEATURES, carried, 4)
    for f in FEATURES:
        assert np.allclose(np.concatenate([first[f.name], second[f.name]]), whole[f.name], equal_nan=True)
    with pytest.raises(ValueError, match="op must be"):
        streaming.Feature("x", "slope", 3)
