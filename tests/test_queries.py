"""Every query of the engine with SQL gives DuckDB's rows on the smallest tables; the entry point's contract."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import queries as engine

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(rows, names):
    def cell(x):
        if x is None or x != x:
            return "None"
        if isinstance(x, float):
            return f"{round(x, 5) + 0.0:.5f}"
        return str(x)[:10] if hasattr(x, "year") else str(x)

    return sorted([cell(r[n]) for n in names] for r in rows)


@pytest.mark.parametrize("name", engine.SQL)
def test_equals_duckdb(spark, duck, name):
    got = engine.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    cursor = duck.execute(engine.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    expect = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert plain([r.asDict() for r in got.collect()], names) == plain(expect, names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rows_only(spark):
    out = engine.QUERIES["topk_dropout"](spark, SF)
    rows = out.collect()
    assert {r.strategy for r in rows} == {"k10", "k20"} and all(r.account > 0 and r.n_held <= 20 for r in rows)
    assert len(engine.QUERIES["lagged_features"](spark, SF).columns) == 2 + 6 * 60
