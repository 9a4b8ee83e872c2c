"""Exact quantiles, bins and what is fitted by them, against NumPy and pandas."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import processors, quantiles


def groups(rng):
    return {
        "even": [float(k) for k in range(1000)],
        "one": [3.5],
        "same": [2.0] * 500,
        "ties": [float(rng.randint(0, 3)) for _ in range(700)],
        "tail": [10.0 ** rng.uniform(-8, 9) for _ in range(900)],
        "two": [-1.0, 1e12] * 300,
        "huge": [1e308, -1e308] + [rng.gauss(0, 1) for _ in range(400)],
        None: [rng.gauss(0, 1) for _ in range(300)],
    }


@pytest.mark.parametrize("more", [{}, {"bins": 16, "few": 3}])
def test_quantiles_equal_numpy(spark, more):
    """Also with few bins and short lists, so that brackets take many rounds."""
    values = groups(random.Random(1))
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("even", None), ("unknown", None)]
    frame = spark.createDataFrame(rows, "g string, value double").repartition(4)
    asked = [0, 0.1, 0.25, 0.5, 0.77, 0.999, 1]
    got = {(r.g, r.p): r.value for r in quantiles.quantiles(frame, ["g"], asked, **more).collect()}
    assert got.keys() == {(k, p) for k in values for p in asked}
    for (k, p), v in got.items():
        assert v == pytest.approx(np.quantile(values[k], p), rel=1e-12, abs=1e-300 if k == "huge" else 1e-12), (k, p)


def test_brackets_close_in_quickly(spark):
    """A group of many rows takes three rounds, and no list is longer than asked."""
    frame = spark.range(200_000).select(F.lit(1).alias("g"), F.pow(F.rand(3), F.lit(5.0)).alias("value")).persist()
    got = quantiles.quantiles(frame, ["g"], [0.5, 0.9])
    exact = frame.agg(F.percentile("value", F.array(F.lit(0.5), F.lit(0.9)))).first()[0]
    assert [r.value for r in got.orderBy("p").collect()] == pytest.approx(exact)
    ranks = spark.createDataFrame([(1, 100_000)], "g int, rank long")
    assert quantiles.order_statistics(frame, ["g"], ranks, max_rounds=3).count() == 1


def test_percentile_bins(spark):
    rng = random.Random(2)
    values = [(f"i{k}", d, None if rng.random() < 0.1 else float(rng.randint(0, 30))) for k in range(40) for d in ("a", "b", "c")]
    bench = [(d, v) for _, d, v in values[:60] if d != "c"]
    got = {(r.instrument, r.datetime): r.bin for r in quantiles.percentile_bins(spark.createDataFrame(values, "instrument string, datetime string, value double"), spark.createDataFrame(bench, "datetime string, value double"), 4).collect()}
    for i, d, v in values:
        edges = np.percentile([x for e, x in bench if e == d and x is not None], np.linspace(0, 100, 5)) if d != "c" else None
        if v is None or edges is None:
            assert got[i, d] is None
            continue
        edges[0], edges[-1] = -np.inf, np.inf
        assert got[i, d] == next(4 - k for k in range(4) if edges[k] <= v < edges[k + 1])


def test_robust_fit(spark):
    rng = random.Random(7)
    frame = spark.createDataFrame([("x", str(k), rng.gauss(3, 2) if k % 7 else None, 1.0) for k in range(999)], "instrument string, datetime string, a double, b double")
    fitted = processors.RobustZScore().fit(frame, {"f": ["a", "b"]})
    a = np.array([r.a for r in frame.collect() if r.a is not None])
    assert fitted.numbers["a"] == pytest.approx((np.median(a), np.median(np.abs(a - np.median(a))))) and fitted.numbers["b"] == (1.0, 0.0)


def measured(x, shrink=True, clip=False, fill=True):
    x = x - x.median()
    x = x / (x.abs().median() * 1.4826)
    if clip:
        x = x.clip(-3, 3)
    if shrink:
        x = x.where(x.isna() | (x <= 3), 3 + (x - 3) / (x.max() - 3) * 0.5)
        x = x.where(x.isna() | (x >= -3), -3 - (x + 3) / (x.min() + 3) * 0.5)
    return x.fillna(0) if fill else x


@pytest.mark.parametrize("more", [{}, {"shrink": False, "clip": True, "fill": False}])
def test_section_equals_pandas(spark, more):
    """Shapes, the columns that two patterns match, outliers, missing values, a constant column, labels."""
    rng = random.Random(4)
    names = ["KLEN", "KLOW2", "KMID", "HIGH0", "MAX5", "MA5", "MIN5", "STD5", "RSQR5", "CORR5", "WVMA5", "RANK5", "LABEL0"] if not more else ["KMID", "MA5", "LABEL0"]
    rows = []
    for d in ("2024-01-01", "2024-01-02", "2024-01-03"):
        for k in range(60):
            values = [rng.uniform(-0.1, 2) if c not in ("KMID", "LABEL0") else rng.gauss(0, 1) ** 5 for c in names]
            rows.append((f"i{k}", d, *(None if rng.random() < 0.05 else 7.0 if c == "MA5" and d == "2024-01-03" else v for c, v in zip(names, values, strict=True))))
    frame = spark.createDataFrame(rows, "instrument string, datetime string, " + ", ".join(f"{c} double" for c in names))
    pdf = pd.DataFrame(rows, columns=["instrument", "datetime", *names]).set_index(["instrument", "datetime"]).astype(float)
    shape = {
        "KLEN": [lambda x: x**0.25], "KLOW2": [lambda x: x**0.25, lambda x: x**0.5], "KMID": [lambda x: x], "HIGH0": [lambda x: (x - 1) ** 0.5], "MAX5": [lambda x: x, lambda x: (x - 1) ** 0.5], "MA5": [lambda x: x],
        "MIN5": [lambda x: (1 - x) ** 0.5], "STD5": [lambda x: np.log(x.where(x > 0))], "RSQR5": [lambda x: x.fillna(0)], "CORR5": [np.exp], "WVMA5": [np.log1p], "RANK5": [],
    }
    expect = {}
    for c in names:
        for d, x in pdf[c].groupby(level="datetime"):
            if c == "LABEL0":
                x = ((x - x.mean()) / x.std()).fillna(0)
            else:
                for f in shape[c]:
                    x = measured(f(x), **more)
            for key, v in x.items():
                expect[(*key, c)] = v
    got = processors.Section(**more).apply(frame, {"feature": names[:-1], "label": names[-1:]})
    for r in got.collect():
        for c in names:
            v = expect[r.instrument, r.datetime, c]
            assert (r[c] is None) == (not np.isfinite(v)) and (r[c] is None or r[c] == pytest.approx(v, abs=1e-9)), (c, r.instrument, r.datetime)


def test_section_sends_one_row_a_date(spark):
    frame = spark.createDataFrame([("i", "2024-01-01", 1.0, 2.0)], "instrument string, datetime string, KMID double, ROC5 double")
    plan = processors.Section().apply(frame, {"f": ["KMID", "ROC5"]})._jdf.queryExecution().toString().split("Physical Plan")[-1]
    assert "Window" not in plan


def test_values_that_come_out_otherwise_when_read_again(spark):
    """Sums of a group may differ in the last digit from one reading to the next."""

    @F.udf("double")
    def shaken(x):
        return x * (1 + random.uniform(-1e-9, 1e-9))

    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") + 1).cast("double").alias("v"))
    frame = rows.select("g", shaken.asNondeterministic()("v").alias("value"))
    got = {(r.g, r.p): r.value for r in quantiles.quantiles(frame, ["g"], [0, 0.3, 0.5, 1], bins=8, few=2).collect()}
    assert got == {(g, p): pytest.approx(np.quantile(np.arange(g + 1, 3001, 3), p), rel=1e-8) for g in range(3) for p in (0, 0.3, 0.5, 1)}


def test_section_makes_its_rows_once(spark):
    """Two turns, medians and distances read what was written, not what made it."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return x

    rows = spark.range(400).select(F.col("id").cast("string").alias("instrument"), F.lit("2024-01-01").alias("datetime"), (F.col("id") / 100).alias("v"))
    frame = rows.select("instrument", "datetime", counted.asNondeterministic()("v").alias("KLOW2"))
    got = processors.Section().apply(frame, {"f": ["KLOW2"]}).collect()
    assert len(got) == 400 and made.value == 400


def test_later_rounds_read_few_rows(spark, monkeypatch):
    """After the first look only the rows of the bucket that holds a rank are read."""
    read, keep = [], quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda plain, *a: (read.append(plain.count()), keep(plain, *a))[1])
    frame = spark.range(100_000).select((F.col("id") % 2).alias("g"), F.pow(F.rand(5), F.lit(2.0)).alias("value")).persist()
    got = {r.g: (r.median, r.mad) for r in quantiles.median_and_deviation(frame, ["g"]).collect()}
    for g in (0, 1):
        x = np.array([r.value for r in frame.filter(F.col("g") == g).collect()])
        assert got[g] == pytest.approx((np.median(x), np.median(np.abs(x - np.median(x)))))
    assert read and max(read) < 10_000


def test_every_rank_of_far_and_tiny_values(spark):
    """Buckets are in the order of the values: denormal ones, zeros of both signs, infinities, neighbours in the last digit."""
    near = [float(x) for x in np.nextafter(np.exp(np.arange(-3, 4) / quantiles.STEPS), [[-9.0], [0.0], [9.0]]).ravel()]
    sizes = [5e-324, 1e-310, 2.2e-308, 1e-9, 1.0, 1.5, 1.7e308, float("inf"), *near]
    values = [*sizes, *(-x for x in sizes), 0.0, -0.0] * 2
    frame = spark.createDataFrame([(1, v) for v in values], "g int, value double").repartition(3)
    ranks = spark.createDataFrame([(1, k) for k in range(len(values))], "g int, rank long")
    got = {r["rank"]: r.value for r in quantiles.order_statistics(frame, ["g"], ranks, bins=4, few=1).collect()}
    assert [got[k] for k in range(len(values))] == sorted(values)
