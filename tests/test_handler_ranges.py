"""Ranges of dates that roll, and loaders over handlers, by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import analytics, loaders, processors


def day(n):
    return dt.date(2024, 1, n)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [("a", day(n), float(n), float(-n)) for n in (1, 2, 4, 5, 8)] + [("b", day(n), None, 1.0) for n in (2, 5)]
    return spark.createDataFrame(rows, "instrument string, datetime date, x double, y double")


def held(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.upto.day, set()).add((r.instrument, r.datetime.day))
    return found


def test_ranges(frame):
    every = [("a", 1), ("a", 2), ("b", 2), ("a", 4), ("a", 5), ("b", 5), ("a", 8)]
    dates = [1, 2, 4, 5, 8]
    for periods, least in ((2, None), (3, 0), (1, 1), (9, 0), (9, None)):
        start = periods if least is None else least
        want = {d: {r for r in every if r[1] in dates[max(0, k - periods + 1) : k + 1]} for k, d in enumerate(dates) if k >= start}
        assert held(processors.ranges(frame, periods, least)) == want
    assert processors.ranges(frame, 2).columns == ["upto", *frame.columns]
    assert processors.ranges(frame.limit(0), 2).count() == 0


def test_upto(frame):
    h = processors.Handler(frame, {"f": ["x"], "l": ["y"]}, infer=[processors.Fill("f")], learn=[processors.DropMissingLabel("l")]).setup()
    assert sorted((r.instrument, r.datetime.day) for r in h.upto(day(5), 2).collect()) == [("a", 4), ("a", 5), ("b", 5)]
    assert h.upto(day(2), 7, "raw", "f").columns == ["instrument", "datetime", "x"] and h.upto(day(2), 7, "raw").count() == 3
    with pytest.raises(KeyError):
        h.upto(day(3), 2)


def test_from_handlers(frame):
    one = processors.Handler(frame, {"f": ["x"], "l": ["y"]})
    other = processors.Handler(frame.filter("instrument = 'b'").select("instrument", "datetime", (F.col("y") * 2).alias("x")), {"f": ["x"]}, infer=[processors.Fill("f")]).setup()
    single = loaders.from_handlers(one, start=day(2), end=day(4))
    assert single.groups == {"f": ["x"], "l": ["y"]} and single.rows.count() == 3
    both = loaders.from_handlers({"p": one, "q": other}, prefix=True)
    assert both.groups == {"p": ["p_x", "p_y"], "q": ["q_x"]}
    assert {(r.instrument, r.datetime.day): r.q_x for r in both.rows.collect() if r.q_x is not None} == {("b", 2): 2.0, ("b", 5): 2.0} and both.rows.count() == 7
    with pytest.raises(ValueError):
        loaders.from_handlers({"p": one, "q": other})


def test_group_ensemble(spark):
    rows = [("m", "a", 1, "i", 1.0), ("m", "a", 1, "j", 3.0), ("m", "a", 2, "j", -3.0), ("m", "b", 1, "i", 5.0), ("m", "b", 1, "j", 5.0), ("n", "a", 1, "i", 2.0), ("n", "a", 1, "j", 8.0)]
    scores = spark.createDataFrame(rows, "market string, model string, run int, instrument string, score double").withColumn("datetime", F.lit("2024-01-01").cast("date"))
    got = {(r.market, r.instrument): r.score and round(r.score, 6) for r in analytics.group_ensemble(scores, ["market"]).collect()}
    top = round(0.5**0.5, 6)
    assert got == {("m", "i"): top, ("m", "j"): -top, ("n", "i"): -top, ("n", "j"): top}  # model b has no spread, so it has no say
    latest = {(r.market, r.model, r.instrument): r.score for r in analytics.latest_runs(scores, ["market", "model"]).collect()}
    assert latest["m", "a", "j"] == -3.0 and len(latest) == 6
