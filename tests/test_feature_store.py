"""Stored features: an update equals computing once, twice is the same as once, months without new rows keep their files."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import feature_store, panels

FIELDS = {"mean": "Mean($close, 5)", "next": "Ref($close, -2) / $close - 1", "rank": "Rank($close, 8)"}


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(4)
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(120)]
    spans = {"all": (0, 120), "gone": (0, 40), "sleeps": (0, 30), "new": (100, 120), "short": (50, 95)}
    rows = [(i, d, float(rng.randint(1, 50))) for i, (a, b) in spans.items() for k, d in enumerate(days) if a <= k < b and rng.random() < 0.9]
    rows += [("sleeps", days[110], 7.0)]
    return spark.createDataFrame(rows, "instrument string, datetime date, close double")


def rows_of(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("instrument", "datetime", *FIELDS).collect()) if df is not None else []


def files(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def plain(rows):
    return sorted(str(r) for r in rows)


@pytest.mark.parametrize("fields", [FIELDS, {**FIELDS, "rank": "EMA($close, 5)"}])
def test_update_equals_computing_once(spark, bars, tmp_path, fields):
    root = str(tmp_path / "store")
    early = bars.filter(F.col("datetime") < dt.date(2024, 4, 5))
    feature_store.create(panels.panel(early), fields, root)
    before = files(root)
    wrote = feature_store.update(root, panels.panel(bars), fields)
    expect = feature_store.computed(panels.panel(bars), fields)
    names = ["instrument", "datetime", *fields]
    rounded = lambda df: plain(df.select("instrument", "datetime", *(F.round(c, 9).alias(c) for c in fields)).collect())
    assert rounded(feature_store.read(spark, root).select(*names)) == rounded(expect.select(*names))
    after = files(root)
    if "EMA" not in fields["rank"]:
        assert wrote == 4  # the sleeper's gap reaches back to January; all months from there on get rows
    assert feature_store.update(root, panels.panel(bars), fields) == 0 and files(root) == after
    assert set(after) != set(before)


def test_untouched_months_keep_their_files(spark, bars, tmp_path):
    root = str(tmp_path / "store")
    own = bars.filter("instrument in ('all', 'new')")
    feature_store.create(panels.panel(own.filter(F.col("datetime") < dt.date(2024, 4, 20))), FIELDS, root)
    before = files(root)
    assert feature_store.update(root, panels.panel(own), FIELDS) == 1
    after = files(root)
    kept = {f: t for f, t in before.items() if "part=202404" not in f}
    assert kept and all(after.get(f) == t for f, t in kept.items()) and not any("part=202404" in f and f in before for f in after)


def test_merged_rows_replace_those_with_their_keys(spark, bars, tmp_path):
    root = str(tmp_path / "store")
    feature_store.create(panels.panel(bars), FIELDS, root)
    n = feature_store.read(spark, root).count()
    new = spark.createDataFrame([("all", dt.date(2024, 1, 5), 1.0, 2.0, 3.0), ("other", dt.date(2024, 2, 5), 4.0, 5.0, 6.0)], "instrument string, datetime date, mean double, next double, rank double")
    assert feature_store.merge(spark, root, new) == 2 and feature_store.merge(spark, root, new.limit(0)) == 0
    got = feature_store.read(spark, root)
    assert got.count() == n + 1 and got.filter("instrument = 'all' and datetime = '2024-01-05'").first().rank == 3.0
