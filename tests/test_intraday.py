"""Intraday sets against the same sets written in the expression language, which runs over whole series."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intraday
from tidemark.plans.compiler import features
from tidemark.sources import sessions

DAY = sessions.Sessions((("09:30", "11:30"), ("13:00", "15:00")), 30)
N = DAY.slots


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows = random.Random(5), []
    times = [f"{9 + (30 + 30 * k) // 60:02d}:{(30 + 30 * k) % 60:02d}" for k in range(4)] + [f"{13 + k // 2}:{30 * (k % 2):02d}" for k in range(4)]
    for name, first in (("a", 0), ("b", 3)):  # b starts within the first day
        for d in range(9):
            for s, t in enumerate(times):
                ends = (d == 0 and s == first) or (d == 8 and s == N - 1)
                if d * N + s < first or (rng.random() < 0.35 and not ends):
                    continue
                some = lambda: None if rng.random() < 0.2 else rng.choice([0.0, 1.5, 2.0, 3.25, 7.0])
                rows.append((name, dt.datetime.fromisoformat(f"2024-03-{d + 1:02d} {t}"), some(), some(), some(), some(), 1.0, rng.choice([1.0, 2.0])))
    bars = spark.createDataFrame(rows, "instrument string, datetime timestamp, open double, close double, vwap double, volume double, factor double, traded double")
    return sessions.panel(bars, DAY)


def cells(df):
    return {(r.instrument, r.datetime): tuple(None if x is None else round(x, 9) for x in r[2:]) for r in df.collect()}


def price(p, shift, anchor):
    value = f"If(IsNull(${p}), $close, ${p})"
    moved = f"Ref({value}, {shift})" if shift else value
    return f"FFillNan({moved} / DayLast(Ref(FFillNan($close), {anchor})))"


def share(shift, days):
    moved = f"Ref($volume, {shift})" if shift else "$volume"
    ratio = f"{moved} / Ref(DayLast(Mean($volume, {days * N})), {N})"
    return f"If(IsNull({ratio}), 0, {ratio})"


@pytest.mark.parametrize("anchors", [None, (N + 3, N + 3), (5, 2 * N + 7)])
def test_normalised_is_the_expressions(panel, anchors):
    a, b = anchors or (2 * N, N)
    fields = {"open": price("open", 0, a), "vwap": price("vwap", 0, a), "open_1": price("open", N, b), "vwap_1": price("vwap", N, b), "volume": share(0, 4), "volume_1": share(N, 4)}
    want = cells(features(panel, fields))
    got = cells(intraday.normalised(panel, DAY, ("open", "vwap"), anchors=anchors, volume_days=4))
    firsts = {r.instrument: r.a for r in panel.bars.groupBy("instrument").agg(F.min("cal_idx").alias("a")).collect()}
    left = {(r.instrument, r.datetime) for r in panel.bars.collect() if r.cal_idx - firsts[r.instrument] >= 2 * N}
    assert set(got) == left and len(left) > 100
    assert got == {k: v for k, v in want.items() if k in left}


def test_keep_decides_the_rows(panel):
    got = cells(intraday.normalised(panel, DAY, ("open",), volume_days=4, keep=F.col("traded") > 1))
    traded = {(r.instrument, r.datetime) for r in panel.bars.filter("traded > 1").collect()}
    want = cells(features(panel, {"open": price("open", 0, 2 * N), "open_1": price("open", N, N)}))
    assert set(got) == traded and all(v[:2] == want[k] for k, v in got.items())


def test_quotes(panel):
    got = cells(intraday.quotes(panel, DAY, keep=F.col("traded") > 1))
    fields = {"close": "FFillNan(Select(Gt($traded, 1), $close))", "vwap": "If(IsNull($vwap), FFillNan($close), $vwap)", "volume": "If(IsNull($volume), 0, $volume)", "factor": "If(IsNull($factor), 0, $factor)"}
    want = cells(features(panel, fields))
    assert got and got == {k: want[k] for k in got} and set(got) == {(r.instrument, r.datetime) for r in panel.bars.filter("traded > 1").collect()}
    every = cells(intraday.quotes(panel, DAY))
    assert every == {k: v for k, v in cells(features(panel, fields | {"close": "FFillNan($close)"})).items() if k in every} and len(every) > 100


def test_no_window_over_a_series_of_bars(panel, capsys):
    intraday.normalised(panel, DAY, ("open", "close")).explain("simple")
    plan = capsys.readouterr().out
    windows = re.findall(r"Window \[.*\], \[([^\]]*)\], \[([^\]]*)\]$", plan, re.M)
    assert windows and all("_day#" in part or "_slot#" in part or "_day#" in order for part, order in windows)


def test_empty(spark, panel):
    none = type(panel)(panel.bars.limit(0), panel.context)
    assert intraday.normalised(none, DAY, ("open",)).count() == 0 and intraday.quotes(none, DAY).count() == 0
