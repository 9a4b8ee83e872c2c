"""Windows over chunks of time equal windows over whole series."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.plans import chunked
from tidemark.plans.compiler import features
from tidemark.plans.expr import parse
from tidemark.sources import panels

FIELDS = [
    *(f"{op}($a, {n})" for op in ("Mean", "Sum", "Std", "Var", "Max", "Min", "Count", "Med", "IdxMax", "IdxMin", "Mad", "Rank", "WMA", "Slope", "Rsquare", "Resi") for n in (1, 2, 7) if not (op in ("Slope", "Rsquare", "Resi") and n == 1)),
    "Skew($a, 7)", "Kurt($a, 7)", "Skew($c, 5)", "Kurt($c, 5)", "Quantile($a, 7, 0.8)", "Quantile($a, 1, 0.3)", "Corr($a, $b, 7)", "Cov($a, $b, 7)", "Corr($a, $c, 5)", "Rsquare($c, 5)",
    "Ref($a, 3)", "Ref($a, -3)", "Delta($a, 2)", "Rolling($a, 5, 'median')", "Rolling($a, 5, 'max')",
    "Mean(Ref($a, -2) / Ref($a, 4) - 1, 3)", "Std(Mean($a, 3) - Med($b, 4), 5) + $a", "Corr($a / Ref($a, 1), Log($b / Ref($b, 1) + 1), 5)", "If($a > Mean($a, 4), 1, 0)", "Sum(Greater($a - Ref($a, 1), 0), 4)", "$a * 2",
]


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(4)
    days = [f"2024-01-{d:02d}" for d in range(1, 32)] + [f"2024-02-{d:02d}" for d in range(1, 30)]
    rows = []
    for name, first, last in (("x", 0, 60), ("y", 5, 40), ("z", 30, 33), ("one", 17, 18), ("none", 20, 50)):
        for d in days[first:last]:
            if rng.random() < 0.85:
                rows.append((name, d, None if name == "none" or rng.random() < 0.1 else round(rng.gauss(50, 10), 1), float(rng.randint(1, 5)), 3.0))
    bars = spark.createDataFrame(rows, "instrument string, datetime string, a double, b double, c double").withColumn("datetime", F.to_date("datetime"))
    return panels.panel(bars)


def same(a, b):
    return (a is None) == (b is None) and (a is None or a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.mark.parametrize("chunk", [5, 2048])
def test_chunks_equal_whole_series(panel, monkeypatch, chunk):
    monkeypatch.setattr(chunked, "HALO", 1)
    expect = {(r[0], r[1]): r for r in features(panel, FIELDS).collect()}
    got = {(r[0], r[1]): r for r in chunked.features(panel, FIELDS, chunk=chunk).collect()}
    assert expect.keys() == got.keys() and len(expect) > 100
    wrong = [(k, f, expect[k][i + 2], got[k][i + 2]) for k in expect for i, f in enumerate(FIELDS) if not same(expect[k][i + 2], got[k][i + 2])]
    assert not wrong, wrong[:5]


def test_range_and_universe_are_cut_the_same(panel, spark):
    import datetime as dt

    members = spark.createDataFrame([("x", dt.date(2024, 1, 5), dt.date(2024, 1, 20)), ("y", dt.date(2024, 1, 1), dt.date(2024, 1, 12))], "instrument string, start date, end date")
    ask = dict(start=dt.date(2024, 1, 3), end=dt.date(2024, 2, 10), universe=members, drop_empty=True)
    a, b = features(panel, ["Mean($a, 3)"], **ask), chunked.features(panel, ["Mean($a, 3)"], **ask)
    assert a.count() > 5 and sorted(a.collect()) == sorted(b.collect())


def test_one_exchange_and_many_tasks_for_one_series(spark):
    bars = spark.range(20_000).select(F.lit("only").alias("instrument"), F.timestamp_seconds(F.col("id") * 60).alias("datetime"), F.col("id").alias("cal_idx"), (F.col("id") % 97).cast("double").alias("a"))
    panel = chunked.Panel(bars)
    out = chunked.features(panel, ["Mean($a, 20)", "Med(Mean($a, 5), 60)", "Rank($a, 30)"], chunk=500, partitions=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
    tasks = out.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 12 and out.count() == 20_000


def test_what_has_no_chunks(panel):
    assert not any(map(chunked.chunkable, map(parse, ["EMA($a, 5)", "Mean($a, 0)", "Mean($a, 0.5)", "Ref($a, 0)", "FFillNan($a)", "Mean(Select($b > 2, $a), 3)", "DayLast($a)"])))
    with pytest.raises(ValueError, match="no chunks for EMA"):
        chunked.features(panel, ["Mean($a, 3)", "EMA($a, 5)"])


def test_a_panel_with_gaps_raises(panel):
    gappy = chunked.Panel(panel.bars.filter("cal_idx % 7 <> 3"), panel.context)
    with pytest.raises(Exception, match="dense panel"):
        chunked.features(gappy, ["Mean($a, 3)"]).collect()


def test_sorted_buffer_equals_sorting(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.where(rng.random(500) < 0.2, np.nan, rng.integers(0, 20, 500).astype(float))
    rows = kernels.Rows(np.isin(np.arange(500), [0, 3, 120, 400]))
    calls = [("Med", ("x",), 9, ()), ("Quantile", ("x",), 9, (0.8,)), ("Rank", ("x",), 9, ()), ("Quantile", ("x",), 1, (0.0,))]
    plain = kernels.evaluate(rows, {"x": x}, calls)
    monkeypatch.setattr(kernels, "SORTED", 1)
    monkeypatch.setattr(kernels, "BLOCK", 50)
    for a, b in zip(plain, kernels.evaluate(rows, {"x": x}, calls), strict=True):
        assert np.allclose(a, b, equal_nan=True)
