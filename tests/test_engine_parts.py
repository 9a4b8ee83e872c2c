"""Processors, filters, files, risk models and the backtest on small frames with known answers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest, execution, filters, loaders, processors, riskmodels
from tidemark.operators.portfolio import brinson
from tidemark.sources import files, panels
from tidemark.streaming import bars as streaming

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(12)]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    rows = [(i, d, float(rng.normal(10, 2)), 0.0) for i in "abcd" for d in DAYS]
    rows[5] = (*rows[5][:2], None, 0.0)
    return spark.createDataFrame(rows, "instrument string, datetime date, x double, flat double")


def test_constant_columns_stay(frame):
    groups = {"feature": ["x", "flat"]}
    for p in (processors.ZScore(), processors.MinMax()):
        assert p.fit(frame, groups).apply(frame, groups).filter("flat <> 0").count() == 0


def test_fit_range_and_training_only(frame):
    groups = {"feature": ["x"], "label": ["flat"]}
    p = processors.ZScore("feature", start=DAYS[0], end=DAYS[5]).fit(frame, groups)
    mean = frame.filter(F.col("datetime") <= F.lit(DAYS[5])).agg(F.avg("x")).first()[0]
    assert p.numbers["x"][0] == pytest.approx(mean)
    with pytest.raises(ValueError, match="training only"):
        processors.Handler(frame, groups, infer=[processors.DropMissingLabel()]).setup()


def test_infinite_values_take_the_dates_mean(spark):
    df = spark.createDataFrame([("a", DAYS[0], float("inf")), ("b", DAYS[0], 1.0), ("c", DAYS[0], 3.0), ("d", DAYS[0], None)], "instrument string, datetime date, x double")
    got = {r.instrument: r.x for r in processors.ReplaceInfinite().apply(df, {"feature": ["x"]}).collect()}
    assert got == {"a": 2.0, "b": 1.0, "c": 3.0, "d": None}


def test_columns_of_groups(frame):
    groups = {"feature": ["x"], "label": ["flat"]}
    assert processors.KeepColumns("feature", ["x"]).apply(frame, groups).columns == frame.columns
    assert processors.DropColumns(columns=["x"]).groups(groups) == {"feature": [], "label": ["flat"]}


def test_universe_with_two_spans(spark, frame):
    p = panels.panel(frame)
    spans = spark.createDataFrame([("a", DAYS[0], DAYS[2]), ("a", DAYS[6], DAYS[8]), ("b", DAYS[3], DAYS[4])], "instrument string, start date, end date")
    got = filters.instruments(p, spans, (filters.ExpressionFilter("$x > -1000"),), DAYS[1], DAYS[7])
    assert sorted(map(tuple, got.collect())) == [("a", DAYS[1], DAYS[2]), ("a", DAYS[6], DAYS[7]), ("b", DAYS[3], DAYS[4])]


def test_files_round_trip(spark, frame, tmp_path):
    universe = panels.universe_of(frame)
    files.write_universe(universe, f"{tmp_path}/u")
    assert sorted(map(tuple, files.read_universe(spark, f"{tmp_path}/u").collect())) == sorted(map(tuple, universe.collect()))
    files.write_calendar(panels.calendar_of(frame), f"{tmp_path}/c")
    assert [r.datetime.date() for r in files.read_calendar(spark, f"{tmp_path}/c").orderBy("cal_idx").collect()] == DAYS
    files.write_bars(frame, f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b").count() == frame.count()
    p = panels.panel(frame)
    a = files.materialised(p, {"m": "Mean($x, 3)"}, str(tmp_path))
    b = files.materialised(p, {"m": "Mean( $x,3 )"}, str(tmp_path))
    assert a.inputFiles() == b.inputFiles() and a.count() == p.bars.count()


def test_feature_files(spark, frame, tmp_path):
    folder = tmp_path / "sh1"
    folder.mkdir()
    np.array([2, 1.5, np.nan, 3.5], "<f4").tofile(folder / "close.day.bin")
    got = files_rows = panels.read_feature_files(spark, str(tmp_path), panels.calendar_of(frame)).orderBy("datetime").collect()
    assert [(r.instrument, r.field, r.datetime, r.value) for r in files_rows] == [("sh1", "close", DAYS[2], 1.5), ("sh1", "close", DAYS[3], None), ("sh1", "close", DAYS[4], 3.5)] and len(got) == 3


def test_rolling_segments():
    got = loaders.rolling_segments(loaders.Segment((0, 9), (10, 14), (15, 19)), 5, 27)
    assert [s.test for s in got] == [(15, 19), (20, 24), (25, 27)] and got[1].train == (5, 14)
    assert loaders.horizon("Ref($close, -2) / Ref($close, -1) - 1") == 2
    assert loaders.without_leak(got[0], "Ref($close, -2)").train == (0, 7)


def test_risk_models():
    x = np.random.default_rng(0).normal(size=(200, 6)) @ np.diag([1, 2, 3, 1, 2, 3])
    x -= x.mean(axis=0)
    for name, make in riskmodels.ESTIMATORS.items():
        cov = make(x)
        assert np.allclose(cov, cov.T) and np.linalg.eigvalsh(cov).min() > 0, name
        np.testing.assert_allclose(np.diag(cov), np.diag(x.T @ x / 200), rtol=0.9)
    w = riskmodels.risk_parity(riskmodels.shrink(x))
    part = w * (riskmodels.shrink(x) @ w)
    np.testing.assert_allclose(part, part.mean(), rtol=1e-6)
    assert riskmodels.minimum_variance(np.diag([1.0, 4.0])) == pytest.approx([0.8, 0.2])


def test_brinson_adds_up(spark):
    rows = spark.createDataFrame([(DAYS[0], "g", 0.6, 0.1, 0.5, 0.05), (DAYS[0], "h", 0.4, None, 0.5, 0.02)], "datetime date, group string, pw double, pr double, bw double, br double")
    r = brinson(rows).first()
    assert r.raa + r.rss + r.rin == pytest.approx(r.rtotal)


def test_backtest_without_costs(spark):
    """One name that doubles: the account follows it."""
    bars = spark.createDataFrame([("a", d, 10.0 * (1 + k)) for k, d in enumerate(DAYS[:4])] + [("b", d, 5.0) for d in DAYS[:4]], "instrument string, datetime date, close double")
    scores = bars.select("instrument", "datetime", F.when(F.col("instrument") == "a", 1.0).otherwise(0.0).alias("score"))
    s = backtest.TopkDropout("one", k=1, n_drop=0, cash=1000, risk_degree=1.0, open_cost=0, close_cost=0, min_cost=0)
    got = [r.account for r in backtest.backtest(scores, bars, [s]).orderBy("datetime").collect()]
    assert got == pytest.approx([1000, 1000, 1500, 2000])


def test_costs_and_lots(spark):
    df = spark.createDataFrame([(1000.0, 10000.0), (0.0, 10000.0), (10.0, 10000.0)], "v double, t double")
    got = [r.c for r in df.select(execution.cost(F.col("v"), F.col("t"), 0.01, 5, 1.0).alias("c")).collect()]
    assert got == pytest.approx([20.0, 0.0, 5.0])
    assert df.select(execution.round_lots(F.lit(199.95), 100).alias("x")).first().x == 200


def test_sessions_and_late_ticks(spark, tmp_path):
    ticks = spark.createDataFrame([("u", dt.datetime(2024, 1, 1, 0, m), 1.0) for m in (0, 5, 50)] + [("u", dt.datetime(2024, 1, 3), 1.0)], "who string, ts timestamp, v double")
    ticks.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in")
    streaming.run_available(streaming.sessions(stream, "who", "ts", "v"), f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out/data").orderBy("start").collect()
    assert [(r.n, r.total) for r in got] == [(2, 2.0), (1, 1.0)]  # the last session is still open


def test_updated_features_equal_recomputed(frame):
    fields = {"v": "Mean($x, 3) + Ref($x, -1)"}
    whole = panels.panel(frame)
    from tidemark.plans.compiler import features

    old = features(panels.panel(frame.filter(F.col("datetime") <= F.lit(DAYS[7]))), fields)
    got = streaming.updated_features(old, frame, fields, DAYS[7])
    key = lambda df: sorted((r.instrument, r.datetime, None if r.v is None else round(r.v, 9)) for r in df.collect())
    assert key(got) == key(features(whole, fields))
