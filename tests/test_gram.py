"""Block Gram covariances against NumPy and pandas."""

import random

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import gram


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(3)
    rows = [(f"s{k:02d}", f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", rng.gauss(100, 1 + k)) for k in range(13) for d in range(80) if rng.random() < 0.7 or k in (4, 5)]
    rows += [("zz", "2024-01-05", None), ("early", "2024-01-01", 2.0), ("late", "2024-03-24", 3.0)]
    frame = spark.createDataFrame(rows, "instrument string, datetime string, value double").repartition(5)
    wide = pd.DataFrame(rows, columns=["i", "d", "v"]).dropna().pivot(index="d", columns="i", values="v")
    return frame, wide


def close(got, expect, n):
    assert got.keys() == expect.keys() and len(got) == n
    for k in got:
        assert (got[k] is None) == (expect[k] is None) and (got[k] is None or abs(got[k] - expect[k]) < 1e-8), k


@pytest.mark.parametrize("block", [4, 256])
def test_sample_covariance_equals_pandas(panel, block, monkeypatch):
    frame, wide = panel
    monkeypatch.setattr(gram, "PIECE", 7)
    monkeypatch.setattr(gram, "SHARE", 9)
    got = {(r.a, r.b): r.cov for r in gram.sample_covariance(frame, block).collect()}
    expect = {}
    for a in wide.columns:
        for b in wide.columns:
            both = wide[[a, b]].dropna() if a != b else wide[[a]].dropna()
            if a <= b and len(both):
                expect[a, b] = float(both[a].cov(both[b])) if len(both) > 1 else None
    close(got, expect, len(expect))
    corr = {(r.a, r.b): r.corr for r in gram.sample_covariance(frame.filter("instrument in ('s04', 's05')"), block).collect()}
    assert corr["s04", "s04"] == pytest.approx(1) and corr["s04", "s05"] == pytest.approx(wide["s04"].corr(wide["s05"]))


@pytest.mark.parametrize("centred", [False, True])
@pytest.mark.parametrize("missing", gram.MISSING)
def test_missing_values(panel, missing, centred):
    """By plain NumPy: fill with zeros, mask pairwise, or leave missing values in the products."""
    frame, wide = panel
    x = wide.to_numpy()
    x = np.nan_to_num(x) if missing == "fill" else x
    x = x if centred else x - np.nanmean(x, axis=0)
    known = (~np.isnan(x)).astype(float)
    total, n = np.nan_to_num(x).T @ np.nan_to_num(x), known.T @ known
    names, expect = list(wide.columns), {}
    for i, a in enumerate(names):
        for j, b in enumerate(names[i:], i):
            if n[i, j]:
                expect[a, b] = None if missing == "ignore" and n[i, j] < len(x) else float(total[i, j] / n[i, j])
    close({(r.a, r.b): r.cov for r in gram.covariance(frame, missing, centred, 5).collect()}, expect, len(expect))


def test_plan_has_no_pivot_and_no_self_join(panel):
    frame, _ = panel
    plan = gram.pair_sums(frame)._jdf.queryExecution().toString().split("Physical Plan")[-1]
    assert plan.count("MapInArrow") == 2 and "Pivot" not in plan and "CartesianProduct" not in plan and "FlatMapGroups" not in plan


def test_no_rows(spark):
    none = spark.createDataFrame([], "instrument string, datetime string, value double")
    assert gram.sample_covariance(none).collect() == [] and gram.covariance(none, "fill").collect() == []


@pytest.mark.parametrize("rows", [1, 3])
def test_batches_that_end_inside_a_date(spark, panel, rows):
    """A batch may hold nothing but more rows of the date before."""
    frame, wide = panel
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        got = {(r.a, r.b): r.n for r in gram.sample_covariance(frame, 8).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    known = wide.notna().astype(int)
    n = known.T @ known
    assert got == {(a, b): n.loc[a, b] for a in wide.columns for b in wide.columns if a <= b and n.loc[a, b]}


def expected(wide):
    known = wide.notna().astype(int)
    n = known.T @ known
    return {(a, b): n.loc[a, b] for a in wide.columns for b in wide.columns if a <= b}


def test_finished_pairs_are_not_exchanged(panel, monkeypatch):
    """Bands are wider than a block here, and their values are packed before they are sent: one exchange by pairs of bands, of few rows, after which pairs are finished."""
    frame, wide = panel
    stored = []
    keep = gram.cut
    monkeypatch.setattr(gram, "cut", lambda df: stored.append(keep(df)) or stored[-1])
    sums = gram.pair_sums(frame, 2)
    plan = sums._jdf.queryExecution().toString().split("Physical Plan")[-1]
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1
    packed = stored[-1]
    assert packed.select("own").distinct().count() == 4 and packed.count() <= 4 * 5 < wide.notna().to_numpy().sum() / 10
    got = {(r.a, r.b): r.n for r in sums.collect()}
    assert got == expected(wide)


@pytest.mark.parametrize("gather", [1, 1 << 20])
@pytest.mark.parametrize("share", [1, 4, 16384])
def test_uneven_series_and_no_common_share(spark, monkeypatch, share, gather):
    """One series has nearly all values, so bands stay empty; a and b never have a date together, and still have a row."""
    monkeypatch.setattr(gram, "SHARE", share)
    monkeypatch.setattr(gram, "PIECE", 5)
    monkeypatch.setattr(gram, "GATHER", gather)
    rows = [("a", 2 * d, 1.0 + d) for d in range(30)] + [("b", 2 * d + 1, 2.0 * d) for d in range(4)] + [("c", 1, 3.0), ("c", 2, 5.0), ("d", 3, 1.0)]
    frame = spark.createDataFrame(rows, "instrument string, datetime int, value double").repartition(3)
    wide = pd.DataFrame(rows, columns=["i", "d", "v"]).pivot(index="d", columns="i", values="v")
    got = {(r.a, r.b): r.n for r in gram.pair_sums(frame, 1).collect()}
    assert got == expected(wide) and got["a", "b"] == 0
    fill = wide.fillna(0)
    expect = {(a, b): float((fill[a] * fill[b]).mean() - fill[a].mean() * fill[b].mean()) for a, b in got}
    close({(r.a, r.b): r.cov for r in gram.covariance(frame, "fill", block=1).collect()}, expect, len(expect))
