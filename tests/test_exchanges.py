"""Only bars are exchanged, not the rows that densifying adds; what facts say of the last period needs no series of periods."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import pit, quantiles
from tidemark.plans.expr import parse
from tidemark.sources import bin_store, panels
from tidemark.supply_queries import bin_round_trip

DAY = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(9)]


@pytest.fixture(scope="module")
def bars(spark):
    rows = [("a", 0, 2.0, 1.0), ("a", 3, 4.0, 1.0), ("a", 3, 6.0, 1.0), ("a", 4, 5.0, 0.0), ("a", 8, 3.0, 2.0), ("b", 4, None, 1.0), ("b", 5, 0.0, 1.0), ("b", 7, 7.0, 1.0)]
    return spark.createDataFrame([(i, DAY[k], c, v) for i, k, c, v in rows], "instrument string, datetime date, close double, volume double")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_dense_exchanges_only_bars(bars):
    out = panels.dense(bars)
    got = sorted((r.instrument, r.cal_idx, r.close or -1.0) for r in out.collect())
    # the calendar has no bar for days 1, 2 and 6
    at = {0: 0, 3: 1, 4: 2, 5: 3, 7: 4, 8: 5}
    expect = [("a", at[0], 2.0), ("a", at[3], 4.0), ("a", at[3], 6.0), ("a", at[4], 5.0), ("a", at[5], -1.0), ("a", at[7], -1.0), ("a", at[8], 3.0), ("b", at[4], -1.0), ("b", at[5], -1.0), ("b", at[7], 7.0)]
    assert got == sorted(expect) and exchanges(out) <= 1


def test_repair_and_adjustment_need_no_exchange_of_dense_rows(bars):
    own = bars.repartition("instrument")
    assert exchanges(panels.normalised(own, calendar=panels.calendar_of(bars))) <= 2
    got = {(r.instrument, r.datetime): (r.close, r.change) for r in panels.normalised(bars).collect()}
    assert got["a", DAY[3]] == (4.0, 1.0) and got["a", DAY[4]] == (None, 0.0) and got["a", DAY[5]] == (None, 0.0) and got["a", DAY[8]] == (3.0, -0.25)
    assert got["b", DAY[4]] == (None, None) and got["b", DAY[5]] == (0.0, None) and got["b", DAY[7]] == (7.0, None)


def test_last_period_needs_no_series(spark):
    facts = spark.createDataFrame([("a", "x_a", DAY[k], p, v) for k, p, v in ((0, 2000, 1.0), (2, 1990, 5.0), (3, 2001, None), (5, 2000, 9.0), (6, 2001, 4.0))], "instrument string, field string, pub_date date, period int, value double")
    whole = pit.states(facts, ["x_a"], False)
    last = whole.groupBy("instrument", "as_of").agg(F.max_by(F.struct("n", "x_a"), "n").alias("s")).select("instrument", "as_of", "s.n", "s.x_a")
    assert set(pit.latest(facts, ["x_a"], False).collect()) == set(last.collect())
    old = {(r.as_of, r.x_a) for r in whole.filter("n = 2000").collect() if r.as_of in (DAY[0], DAY[5])}
    assert {(r.as_of, r.x_a) for r in pit.latest(facts, ["x_a"], False, 2000).collect()} == old
    panel = panels.Panel(panels.dense(spark.createDataFrame([("a", d) for d in DAY], "instrument string, datetime date")), pit=facts)
    for text in ("P($$x_a)", "PRef($$x_a, 2000)"):
        assert "Generate" not in pit.as_of(panel, parse(text), "v").select("v")._jdf.queryExecution().optimizedPlan().toString().split("cal_idx")[0]


def test_bins_keep_more_columns(spark):
    rows = spark.createDataFrame([("a", DAY[0], 1.0, 5), ("b", DAY[0], 2.0, 6)], "instrument string, datetime date, value double, volume int")
    assert {(r.volume, r.bin) for r in quantiles.percentile_bins(rows, rows.select("datetime", "value"), 2).collect()} == {(5, 2), (6, 1)}


def test_only_days_with_sales_are_written(spark, monkeypatch):
    sent = []
    keep = bin_store.save
    monkeypatch.setattr(bin_store, "save", lambda rows, *a, **k: (sent.append(rows.filter("value is null").count()), keep(rows, *a, **k)))
    assert bin_round_trip(spark, "/root/testdata/sf0.001").filter("value is null").count() > 0 and sent == [0, 0]
