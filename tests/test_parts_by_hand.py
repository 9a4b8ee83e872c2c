"""Small parts against plain Python: vendor data, sessions with a lunch break, holdings, gap filling, limits, checks."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest, execution, filters, health, holdings, loaders, portfolio, processors
from tidemark.sources import files, panels, sessions

D = dt.date


# --- vendor data ------------------------------------------------------------------------------------------------


def repaired(close):
    """Divides by 100 what stands some hundred times above the known close before it, again and again until nothing does."""
    x = pd.Series(close, dtype=float)
    while True:
        known = x.ffill()
        change = known / known.shift(1) - 1
        mask = (change >= 89) & (change <= 111)
        if not mask.any():
            return x
        x[mask] /= 100


def test_repair_equals_the_loop(spark):
    rng = random.Random(6)
    series, rows = {}, []
    for k in range(60):
        level, out = 50.0, []
        for _ in range(40):
            level *= rng.choice([1.0, 1.01, 0.99, 1.0, 1.6 if rng.random() < 0.1 else 1.02])
            times = rng.choice([1, 1, 1, 100, 100, 10_000 if rng.random() < 0.3 else 1])
            out.append(None if rng.random() < 0.1 else level * times)
        out[0] = out[0] or level
        series[f"s{k:02d}"] = out
        rows += [(f"s{k:02d}", D(2024, 1, 1) + dt.timedelta(i), c, c, 0.0 if c is None else 5.0) for i, c in enumerate(out)]
    bars = spark.createDataFrame(rows, "instrument string, datetime date, close double, high double, volume double")
    got = {(r.instrument, r.datetime): (r.close, r.high) for r in panels.normalised(bars).collect()}
    divided = 0
    for name, close in series.items():
        for i, v in enumerate(repaired(close)):
            x, h = got[name, D(2024, 1, 1) + dt.timedelta(i)]
            assert (x is None) == (v != v) and (x is None or x == pytest.approx(v) and h == pytest.approx(v)), (name, i)
            divided += x is not None and x < (close[i] or 0) / 50
    assert divided > 100


def test_first_row_by_source_order(spark):
    rows = [("a", D(2024, 1, 1), 9.0, 1.0, 0), ("a", D(2024, 1, 1), 2.0, 1.0, 1), ("a", D(2024, 1, 2), 3.0, 1.0, 2)]
    bars = spark.createDataFrame(rows, "instrument string, datetime date, close double, volume double, at int")
    assert [r.close for r in panels.normalised(bars, "at").orderBy("datetime").collect()] == [9.0, 3.0]
    assert [r.close for r in panels.normalised(bars.drop("at")).orderBy("datetime").collect()] == [2.0, 3.0]


def test_adjusted_prices(spark):
    rows = [("a", D(2024, 1, 1), 10.0, 5.0, 12.0, 100.0), ("a", D(2024, 1, 2), 12.0, None, 13.0, 10.0), ("a", D(2024, 1, 3), 20.0, 20.0, 21.0, 6.0)]
    out = panels.adjusted(spark.createDataFrame(rows, "instrument string, datetime date, close double, adjclose double, high double, volume double")).orderBy("datetime").collect()
    assert [r.close for r in out] == pytest.approx([1.0, 1.2, 4.0]) and [r.factor for r in out] == pytest.approx([0.1, 0.1, 0.2])
    assert [r.high for r in out] == pytest.approx([1.2, 1.3, 4.2]) and [r.volume for r in out] == pytest.approx([1000.0, 100.0, 30.0])


def test_facts_from_files(spark, tmp_path):
    (tmp_path / "facts.csv").write_text("date,period,value,field,symbol\n20240105,202304,1.5,roe,a\n20240301,202401,,roe,a\n20240301,202401,2,eps,b\n")
    facts = files.read_facts(spark, str(tmp_path / "facts.csv"), "symbol")
    assert {(r.instrument, r.field, r.pub_date, r.period, r.value) for r in facts.collect()} == {("a", "roe", D(2024, 1, 5), 202304, 1.5), ("a", "roe", D(2024, 3, 1), 202401, None), ("b", "eps", D(2024, 3, 1), 202401, 2.0)}
    later = files.later_facts(facts, facts.filter("pub_date < '2024-02-01'"))
    assert {(r.instrument, r.field, r.pub_date) for r in later.collect()} == {("a", "roe", D(2024, 3, 1)), ("b", "eps", D(2024, 3, 1))}


# --- checks and small operators ---------------------------------------------------------------------------------


def test_health_checks(spark):
    schema = "instrument string, datetime date, close double, factor double"
    a = spark.createDataFrame([("x", D(2024, 1, 1), 1.0, None), ("x", D(2024, 1, 2), 2.0, None), ("y", D(2024, 1, 1), None, 1.0)], schema)
    b = spark.createDataFrame([("x", D(2024, 1, 1), 1.0000001, None), ("x", D(2024, 1, 2), 2.1, None), ("y", D(2024, 1, 1), None, 1.0), ("z", D(2024, 1, 1), 4.0, 1.0)], schema)
    assert {(r.instrument, r.close, r.close_stored) for r in health.differences(a, b, ["close"]).collect()} == {("x", 2.0, 2.1), ("z", None, 4.0)}
    assert health.absent_columns(a, ["close", "open", "factor"]) == ["open"] and [r.instrument for r in health.without_factor(a).collect()] == ["x"]
    marks = filters.tradable(a.withColumn("change", F.when(F.col("close") == 1, 0.1).when(F.col("close") == 2, -0.2)), 0.095).collect()
    assert {(r.close, r.suspended, r.limit_buy, r.limit_sell) for r in marks} == {(1.0, False, True, False), (2.0, False, False, True), (None, True, True, True)}


def test_order_indicators_and_their_means(spark):
    orders = spark.createDataFrame([(10.0, 5.0, 11.0, 10.0, 1, 1), (4.0, 4.0, 9.0, 10.0, -1, 3), (5.0, 0.0, None, 10.0, 1, 2)], "amount double, deal_amount double, trade_price double, base_price double, direction int, count int")
    out = backtest.order_indicators(orders)
    assert [(r.ffr, r.pa, r.pos) for r in out.orderBy("count").collect()] == [(0.5, pytest.approx(-0.1), 0.0), (0.0, None, None), (1.0, pytest.approx(-0.1), 0.0)]
    mean = portfolio.indicator_means(out).first()
    assert (mean.ffr, mean.pa, mean.pos) == (pytest.approx((0.5 + 0 + 3) / 6), pytest.approx(-0.1), 0.0)


def test_static_frames_and_aligned_values(spark):
    a = spark.createDataFrame([("x", 1, 1.0), ("y", 1, 2.0)], "instrument string, datetime int, f double")
    b = spark.createDataFrame([("x", 1, 5.0), ("z", 1, 6.0)], "instrument string, datetime int, l double")
    frame = loaders.static({"feature": a, "label": b})
    assert frame.groups == {"feature": ["f"], "label": ["l"]} and {(r.instrument, r.f, r.l) for r in frame.rows.collect()} == {("x", 1.0, 5.0), ("y", 2.0, None), ("z", None, 6.0)}
    x, y = (d.withColumnRenamed(d.columns[-1], "value") for d in (a, b))
    assert {(r.instrument, r.x, r.y) for r in execution.aligned(x, y, ["instrument", "datetime"], 0.0).collect()} == {("x", 1.0, 5.0), ("y", 2.0, 0.0), ("z", 0.0, 6.0)}


def test_shared_norm_and_cast(spark):
    frame = spark.createDataFrame([("i", "d", 1.0, 3.0, 9.0), ("i", "e", 5.0, None, 2.0)], "instrument string, datetime string, a double, b double, v double")
    fitted = processors.SharedNorm(sets={"price": ["a", "b"], "volume": ["v"]}, logs=("volume",)).fit(frame, {})
    values = np.array([1.0, 3.0, 5.0])
    std = np.abs(values - values.mean()).std()
    out = {r.datetime: r for r in fitted.apply(frame, {}).collect()}
    assert out["d"].a == pytest.approx((1 - 3) / std) and out["d"].b == pytest.approx(0.0) and out["e"].a == pytest.approx((5 - 3) / std) and out["e"].b == 0.0
    assert fitted.numbers["volume"][0] == pytest.approx(np.log1p([9.0, 2.0]).mean())
    assert dict(processors.Cast().apply(frame, {"f": ["a"]}).dtypes)["a"] == "float"


# --- sessions ---------------------------------------------------------------------------------------------------

LUNCH = sessions.Sessions((("09:30", "11:30"), ("13:00", "15:00")), 30)


def test_slots_with_a_lunch_break(spark):
    times = ["09:29", "09:30", "10:00", "11:29", "11:30", "12:59", "13:00", "14:59", "15:00"]
    frame = spark.createDataFrame([(f"2024-01-02 {t}:00",) for t in times], "t string").select("t", F.to_timestamp("t").alias("datetime"))
    rows = frame.select("t", LUNCH.slot(F.col("datetime")).alias("s"), LUNCH.aligned(F.col("datetime"), 3).cast("string").alias("a")).collect()
    assert LUNCH.slots == 8 and [r.s for r in rows] == [None, 0, 1, 3, None, None, 4, 7, None]
    assert [r.a and r.a[11:16] for r in rows] == [None, "09:30", "09:30", "11:00", None, None, "11:00", "14:00", None]
    back = spark.range(8).select(LUNCH.slot(LUNCH.start(F.lit(D(2024, 1, 2)), F.col("id").cast("int"))).alias("s"), "id").collect()
    assert all(r.s == r.id for r in back)
    with pytest.raises(ValueError, match="whole bars"):
        sessions.Sessions((("09:30", "11:40"),), 30)


def test_shifts_cross_breaks_and_nights(spark):
    days = spark.createDataFrame([(D(2024, 1, 2), 0), (D(2024, 1, 3), 1), (D(2024, 1, 8), 2)], "day date, day_idx long")
    rows = spark.createDataFrame([("2024-01-03 11:00:00",), ("2024-01-03 14:30:00",), ("2024-01-02 09:30:00",), ("2024-01-03 12:00:00",)], "t string").select(F.to_timestamp("t").alias("datetime"))
    move = lambda n: {str(r.datetime)[5:16]: r.shifted and str(r.shifted)[5:16] for r in sessions.shifted(rows, LUNCH, days, n).collect()}
    assert move(1) == {"01-03 11:00": "01-03 13:00", "01-03 14:30": "01-08 09:30", "01-02 09:30": "01-02 10:00", "01-03 12:00": None}
    assert move(-4) == {"01-03 11:00": "01-02 14:30", "01-03 14:30": "01-03 11:00", "01-02 09:30": None, "01-03 12:00": None}


def test_session_panel_and_earlier_days(spark):
    stamps = [("a", "2024-01-02 14:30", 1.0), ("a", "2024-01-03 09:30", 2.0), ("a", "2024-01-03 14:30", 3.0), ("a", "2024-01-08 10:00", 4.0), ("a", "2024-01-08 12:00", 9.0)]
    bars = spark.createDataFrame(stamps, "instrument string, t string, close double").select("instrument", F.to_timestamp("t", "yyyy-MM-dd HH:mm").alias("datetime"), "close")
    p = sessions.panel(bars, LUNCH)
    rows = p.bars.orderBy("cal_idx").collect()
    assert [r.cal_idx for r in rows] == list(range(7, 18)) and [r.close for r in rows] == [1.0, 2.0, *[None] * 6, 3.0, None, 4.0]
    assert str(rows[1].datetime) == "2024-01-03 09:30:00" and str(rows[-1].datetime) == "2024-01-08 10:00:00"
    placed = sessions.placed(bars, LUNCH)
    got = {(r.day_idx, r.slot): (r.same, r.close) for r in sessions.earlier(placed, {"same": "close"}).collect()}
    assert got == {(0, 7): (None, 1.0), (1, 0): (None, 2.0), (1, 7): (1.0, 3.0), (2, 1): (None, 4.0)}
    last = {(r.day_idx, r.slot): r.last for r in sessions.earlier(placed, {"last": "close"}, slot=7).collect()}
    assert last == {(0, 7): None, (1, 0): 1.0, (1, 7): 1.0, (2, 1): 3.0}


def test_frequency_falls_back_to_a_finer_one():
    assert [sessions.nearest_frequency(w, s) for w, s in (("day", ["day", "min"]), ("day", ["min"]), ("month", ["day", "min"]), ("week", ["min"]), ("month", ["month"]))] == ["day", "min", "day", "min", "month"]
    for wanted, stored in (("min", ["day"]), ("day", ["week"]), ("year", ["day"])):
        with pytest.raises(ValueError, match="frequency|nothing stored"):
            sessions.nearest_frequency(wanted, stored)


# --- holdings ---------------------------------------------------------------------------------------------------


def test_statuses_of_spells(spark):
    rows = [("h", i, d, a, 2.0) for d, names in ((1, "ab"), (3, "bc"), (4, "c"), (7, "abc")) for i, a in ((n, 1.0 + ord(n) - ord("a")) for n in names)] + [("g", "a", 3, 5.0, 1.0)]
    got = {(r.holder, r.instrument, r.datetime): (r.status, round(r.weight, 4)) for r in holdings.statuses(spark.createDataFrame(rows, "holder string, instrument string, datetime int, amount double, price double")).collect()}
    assert got == {
        ("h", "a", 1): (1, 0.3333), ("h", "b", 1): (1, 0.6667), ("h", "b", 3): (0, 0.4), ("h", "c", 3): (1, 0.6), ("h", "a", 3): (-1, 0.3333), ("h", "c", 4): (0, 1.0), ("h", "b", 4): (-1, 0.4),
        ("h", "a", 7): (1, 0.1667), ("h", "b", 7): (1, 0.3333), ("h", "c", 7): (0, 0.5), ("g", "a", 3): (1, 1.0),
    }
    cash = spark.createDataFrame([("g", 3, 15.0)], "holder string, datetime int, cash double")
    assert holdings.statuses(spark.createDataFrame(rows[-1:], "holder string, instrument string, datetime int, amount double, price double"), cash).first().weight == 0.25


def test_values_by_the_last_known_price(spark):
    amounts = spark.createDataFrame([("h", "a", 1, 1.0), ("h", "a", 3, 2.0), ("g", "a", 3, 4.0), ("h", "b", 2, 1.0)], "holder string, instrument string, datetime int, amount double")
    prices = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 11.0), ("a", 4, 12.0), ("b", 3, 7.0), ("a", 3, None)], "instrument string, datetime int, price double")
    assert {(r.holder, r.instrument, r.datetime, r.price) for r in holdings.valued(amounts, prices).collect()} == {("h", "a", 1, 10.0), ("h", "a", 3, 11.0), ("g", "a", 3, 11.0), ("h", "b", 2, None)}


# --- sequences and limits ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("fill", processors.FILLS)
def test_gaps_in_sequences(spark, fill):
    rng = random.Random(3)
    values = [None if rng.random() < 0.4 else float(k) for k in range(30)]
    frame = spark.createDataFrame([("i", k, v, v) for k, v in enumerate(values)], "instrument string, datetime int, a double, b double")
    for r in processors.sequences(frame, ["a", "b"], 5, fill=fill).collect():
        w = [None] * max(0, 4 - r.datetime) + values[max(0, r.datetime - 4) : r.datetime + 1]
        if fill != "none":
            w = pd.Series(w, dtype=float).ffill()
            w = [None if x != x else x for x in (w.bfill() if fill == "ffill+bfill" else w)]
        assert [x[0] for x in r.steps] == w and [x[1] for x in r.steps] == w


def test_orders_on_one_instrument_share_its_limit(spark):
    """Dealt by turns as a plain loop does it; the least of several limits holds."""
    rng = random.Random(1)
    rows = [(f"o{p}", i, t, p, float(rng.randint(0, 9)), float(rng.randint(0, 12)) if i == "x" else 10.0, float(rng.randint(0, 6))) for i in ("x", "y") for t in range(20) for p in range(3)]
    volume = {}
    rows = [(o, i, t, p, a, volume.setdefault((i, t), v), c) for o, i, t, p, a, v, c in rows]
    frame = spark.createDataFrame(rows, "order_id string, instrument string, datetime int, place int, amount double, volume double, cap double")
    for others in ((), ("cap",)):
        dealt, expect = {"x": 0.0, "y": 0.0}, {}
        for o, i, t, p, a, v, c in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
            limit = 0.5 * sum(volume[i, s] for s in range(t + 1)) - dealt[i]
            expect[i, t, p] = max(min(limit, a, *([c] if others else [])), 0.0)
            dealt[i] += expect[i, t, p]
        got = {(r.instrument, r.datetime, r.place): r.deal_amount for r in execution.volume_limited(frame, 0.5, "cum", "place", others=others).collect()}
        assert got == pytest.approx(expect)
    two = spark.createDataFrame([("a", "x", 1, 4.0, 10.0), ("b", "x", 1, 4.0, 10.0)], "order_id string, instrument string, datetime int, amount double, volume double")
    assert sorted(r.deal_amount for r in execution.volume_limited(two, 0.5, "cum").collect()) == [1.0, 4.0]
