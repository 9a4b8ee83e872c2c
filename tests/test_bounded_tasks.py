"""What a task holds stays bounded."""

import datetime as dt

import numpy as np
import pyarrow as pa

from tidemark.operators import holdings
from tidemark.plans import chunked
from tidemark.sources import working
from tidemark.supply_queries import holding_label_ranks


def test_a_layer_gathers_few_cells():
    n, wide = 60_000, 60
    table = pa.table({"instrument": pa.array(np.repeat(np.arange(n // 10), 10).astype(str)), "cal_idx": np.tile(np.arange(10), n // 10), "_chunk": np.zeros(n, int), **{f"x{k}": np.arange(n, dtype=float) for k in range(wide)}})
    run = chunked._layer("instrument", "cal_idx", ["m"], [("Mean", ("x0",), 3, ())])
    sizes = [b.num_rows for b in run(iter(table.to_batches()))]
    assert sum(sizes) == n and max(sizes) < 20_000


def test_ranks_hold_no_date_again(spark):
    day = dt.date(2024, 1, 1)
    states = spark.createDataFrame([(1, k, day, s) for k, s in (("a", 0), ("b", 0), ("c", 1), ("d", 1))], "holder int, instrument string, datetime date, status int")
    labels = spark.createDataFrame([("a", day, 2.0), ("b", day, 2.0), ("c", day, 5.0)], "instrument string, datetime date, label double")
    out = holdings.label_ranks(states, labels)
    assert {r.instrument: (r.rank_ratio, r.rank_label_mean, r.excess_return) for r in out.collect()} == {"a": (62.5, 62.5, -1.0), "b": (62.5, 62.5, -1.0), "c": (25.0, 25.0, 2.0), "d": (None, 25.0, None)}
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


HELD = [("h", i, dt.date(2024, 1, d)) for d, names in ((1, "ab"), (3, "bc"), (4, "c"), (7, "abc")) for i in names] + [("g", "a", dt.date(2024, 1, 3))]


def test_statuses_exchange_positions_once(spark):
    """By holder and instrument for the spells; a holder's dates are few and are broadcast."""
    rows = spark.createDataFrame([(*r, 2.0, 3.0) for r in HELD], "holder string, instrument string, datetime date, amount double, price double")
    states = holdings.statuses(rows)
    assert states._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    few = holdings.spells(rows.select("holder", "instrument", "datetime"))
    assert sorted(few.collect()) == sorted(states.select(*few.columns).collect()) and few.count() == 11


def test_ranks_with_a_bound_are_written_once(spark, monkeypatch):
    rows = spark.createDataFrame(HELD, "holder string, instrument string, datetime date")
    labels = spark.createDataFrame([(i, dt.date(2024, 1, d), float(v)) for i, d, v in (("a", 1, 2), ("b", 1, 2), ("c", 3, 1), ("b", 3, 4), ("a", 3, 4), ("b", 4, 0), ("a", 7, 3))], "instrument string, datetime date, label double")
    counted = holdings.label_ranks(holdings.spells(rows), labels)
    stored, keep = [], holdings.written
    monkeypatch.setattr(holdings, "written", lambda df: stored.append(df.columns) or keep(df))
    monkeypatch.setattr(holdings, "TASK_ROWS", 3)
    bounded = holdings.label_ranks(holdings.spells(rows), labels, 2 * len(HELD))
    assert stored == [[*counted.columns[:5], "_ends"]] and bounded.columns == counted.columns
    got = {tuple(r) for r in bounded.collect()}
    assert got == {tuple(r) for r in counted.collect()} and len(got) == 11
    assert {(r.instrument, r.rank_ratio) for r in bounded.filter("holder = 'h' and datetime = '2024-01-03'").collect()} == {("a", 50.0), ("b", 50.0), ("c", 100.0)}


def test_ranks_store_no_amounts(spark, monkeypatch):
    """What the ranks don't read is neither exchanged nor written."""
    stored = []
    for place, name in ((holdings, "cut"), (holdings, "written"), (working, "written")):
        monkeypatch.setattr(place, name, lambda df, keep=getattr(place, name): stored.append(df.columns) or keep(df))
    assert holding_label_ranks(spark, "/root/testdata/sf0.001").count() > 0
    assert stored and not {"amount", "price", "weight"} & set().union(*stored)
