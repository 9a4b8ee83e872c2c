"""Operators against pandas on series with gaps, constants and single rows; the parser; the compiler's plans."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.plans.compiler import Panel, features, reach
from tidemark.plans.expr import Call, ExpressionError, Field, Literal, parse
from tidemark.sources import panels

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(40)]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    x = rng.normal(100, 10, 40)
    x[[0, 5, 6, 7, 20]] = np.nan
    flat = np.concatenate([np.full(10, 3.0), rng.normal(0, 1, 30)])
    return pd.DataFrame({"instrument": ["a"] * 40 + ["b"] * 40 + ["c"], "datetime": [*DAYS, *DAYS, DAYS[3]], "x": [*x, *flat, 1.5], "y": [*rng.normal(0, 1, 40), *rng.normal(5, 2, 40), 2.0]})


@pytest.fixture(scope="module")
def panel(spark, frame):
    rows = [(i, d, None if np.isnan(x) else float(x), float(y)) for i, d, x, y in frame.itertuples(index=False)]
    return panels.panel(spark.createDataFrame(rows, "instrument string, datetime date, x double, y double"))


def values(panel, text, name="a"):
    rows = features(panel, {"v": text}).filter(f"instrument = '{name}'").orderBy("datetime").collect()
    return np.array([np.nan if r.v is None else float(r.v) for r in rows])


ROLLING = {
    "Mean($x, 6)": lambda s: s.rolling(6, min_periods=1).mean(),
    "Sum($x, 6)": lambda s: s.rolling(6, min_periods=1).sum(),
    "Std($x, 6)": lambda s: s.rolling(6, min_periods=1).std(),
    "Var($x, 6)": lambda s: s.rolling(6, min_periods=1).var(),
    "Skew($x, 6)": lambda s: s.rolling(6, min_periods=1).skew(),
    "Kurt($x, 6)": lambda s: s.rolling(6, min_periods=1).kurt(),
    "Max($x, 6)": lambda s: s.rolling(6, min_periods=1).max(),
    "Min($x, 6)": lambda s: s.rolling(6, min_periods=1).min(),
    "Med($x, 6)": lambda s: s.rolling(6, min_periods=1).median(),
    "Quantile($x, 6, 0.3)": lambda s: s.rolling(6, min_periods=1).quantile(0.3),
    "Count($x, 6)": lambda s: s.rolling(6, min_periods=0).count(),
    "Rank($x, 6)": lambda s: s.rolling(6, min_periods=1).rank(pct=True),
    "Mad($x, 6)": lambda s: s.rolling(6, min_periods=1).apply(lambda w: np.nanmean(np.abs(w - np.nanmean(w))), raw=True),
    "EMA($x, 6)": lambda s: s.ewm(span=6, min_periods=1).mean(),
    "Mean($x, 0.3)": lambda s: s.ewm(alpha=0.3, min_periods=1).mean(),
    "Mean($x, 0)": lambda s: s.expanding(1).mean(),
    "Ref($x, 3)": lambda s: s.shift(3),
    "Ref($x, -3)": lambda s: s.shift(-3),
    "Delta($x, 2)": lambda s: s - s.shift(2),
    "FFillNan($x)": lambda s: s.ffill(),
    "BFillNan($x)": lambda s: s.bfill(),
}


@pytest.mark.parametrize("text", ROLLING)
@pytest.mark.parametrize("name", ["a", "b"])
def test_rolling_equals_pandas(panel, frame, text, name):
    s = frame[frame.instrument == name].set_index("datetime").x
    s = s[s.first_valid_index() and s.index[0] :]
    np.testing.assert_allclose(values(panel, text, name), ROLLING[text](s).to_numpy(), rtol=1e-6, atol=1e-8)


def test_pairs_equal_pandas(panel, frame):
    own = frame[frame.instrument == "a"]
    x, y = own.x.reset_index(drop=True), own.y.reset_index(drop=True)
    np.testing.assert_allclose(values(panel, "Corr($x, $y, 8)"), x.rolling(8, min_periods=1).corr(y), rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(values(panel, "Cov($x, $y, 8)"), x.rolling(8, min_periods=1).cov(y), rtol=1e-6, atol=1e-8)


def test_regression_drops_missing_pairs(panel, frame):
    x = frame[frame.instrument == "a"].x.to_numpy()
    got = {k: values(panel, f"{k}($x, 7)") for k in ("Slope", "Rsquare", "Resi")}
    for t in range(40):
        w = x[max(0, t - 6) : t + 1]
        at = np.flatnonzero(~np.isnan(w))
        if len(at) < 2:
            assert np.isnan(got["Slope"][t])
            continue
        slope, level = np.polyfit(at, w[at], 1)
        np.testing.assert_allclose(got["Slope"][t], slope, rtol=1e-6, atol=1e-7)
        np.testing.assert_allclose(got["Rsquare"][t], np.corrcoef(at, w[at])[0, 1] ** 2, rtol=1e-6, atol=1e-7)
        if not np.isnan(x[t]):
            np.testing.assert_allclose(got["Resi"][t], x[t] - (slope * (len(w) - 1) + level), rtol=1e-6, atol=1e-6)


def test_constant_window(panel):
    assert values(panel, "Corr($x, $y, 5)", "b")[8] != values(panel, "Corr($x, $y, 5)", "b")[8]  # missing
    assert values(panel, "Skew($x, 5)", "b")[8] == 0 and values(panel, "Kurt($x, 5)", "b")[8] == -3


def test_missing_in_comparisons(panel, frame):
    assert values(panel, "$x > Ref($x, 1)")[0] == 0 and values(panel, "Ne($x, $x)")[0] == 1


def test_division_by_zero(spark):
    rows = spark.createDataFrame([("a", DAYS[0], 1.0, 0.0), ("a", DAYS[1], 0.0, 0.0)], "instrument string, datetime date, x double, y double")
    assert [r.v for r in features(panels.panel(rows), {"v": "$x / $y"}).orderBy("datetime").collect()] == [None, None]
    strict = [r.v for r in features(panels.panel(rows, strict=True), {"v": "$x / $y"}).orderBy("datetime").collect()]
    assert strict == [float("inf"), None]


def test_value_does_not_depend_on_range(panel):
    whole = features(panel, {"v": "EMA($x, 5) + Mean($x, 0)"}).filter("datetime >= '2024-01-20'").orderBy("instrument", "datetime").collect()
    part = features(panel, {"v": "EMA($x, 5) + Mean($x, 0)"}, start=dt.date(2024, 1, 20)).orderBy("instrument", "datetime").collect()
    assert whole == part


def test_lookback_gives_the_same(panel):
    text, start, end = {"v": "Mean(Ref($x, 2), 5) + Ref($x, -3)"}, dt.date(2024, 1, 15), dt.date(2024, 1, 25)
    assert reach(parse(text["v"])) == (6, 3)
    a = features(panel, text, start=start, end=end).orderBy("instrument", "datetime").collect()
    b = features(panel, text, start=start, end=end, lookback=True).orderBy("instrument", "datetime").collect()
    assert a == b


def test_one_exchange_for_a_field_list(spark, frame):
    rows = spark.createDataFrame([("a", DAYS[0], 0, 1.0)], "instrument string, datetime date, cal_idx long, x double")
    plan = features(Panel(rows), {"m": "Mean($x > Ref($x, 1), 5)", "s": "Std($x, 20)", "d": "Delta($x, 3)"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_parser():
    assert parse("Mean($close, 5) - 1") == Call("Sub", (Call("Mean", (Field("close"), Literal(5))), Literal(1)))
    assert parse("-$x * 2") == parse("(-1 * $x) * 2")
    for bad in ("$x.y", "[1]", "Mean($x", "lambda: 1", "x"):
        with pytest.raises(ExpressionError):
            parse(bad)


def test_unknown_names(panel):
    with pytest.raises(ExpressionError):
        features(panel, ["$nothing"])
    with pytest.raises(ExpressionError):
        features(panel, ["Nothing($x)"])
    with pytest.raises(ExpressionError):
        features(panel, ["__import__('os')"])
    assert features(panel, {"v": "$nothing"}, on_missing="null").filter("v is not null").count() == 0


def test_change_instrument(panel, frame):
    got = features(panel, {"v": "ChangeInstrument('b', Mean($x, 3))"}).filter("instrument = 'a'").orderBy("datetime").collect()
    expect = frame[frame.instrument == "b"].x.rolling(3, min_periods=1).mean().to_numpy()
    np.testing.assert_allclose([r.v for r in got], expect[-len(got) :], rtol=1e-9)


def test_point_in_time(spark):
    """Revisions, two periods on one day, and a gap between periods."""
    facts = [("s", "roe_q", dt.date(2024, 1, 5), 202301, 1.0), ("s", "roe_q", dt.date(2024, 1, 10), 202303, 3.0), ("s", "roe_q", dt.date(2024, 1, 10), 202301, 1.5), ("s", "roe_q", dt.date(2024, 1, 12), 202303, 3.5)]
    pit = spark.createDataFrame(facts, "instrument string, field string, pub_date date, period int, value double")
    bars = spark.createDataFrame([("s", d, 1.0) for d in DAYS[:14]], "instrument string, datetime date, one double")
    p = panels.panel(bars, pit=pit)
    got = {r.datetime.day: (r.last, r.mean, r.first, r.prior) for r in features(p, {"last": "P($$roe_q)", "mean": "P(Mean($$roe_q, 3))", "first": "PRef($$roe_q, 202301)", "prior": "P(Ref($$roe_q, 1))"}).collect()}
    assert got[4] == (None, None, None, None)
    assert got[5] == (1.0, 1.0, 1.0, None)
    assert got[10] == (3.0, 2.25, 1.5, None)  # the period between is missing
    assert got[14] == (3.5, 2.5, 1.5, None)
