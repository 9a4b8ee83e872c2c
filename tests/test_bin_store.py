"""The data source of binary field files: round trips, modes, and filters that choose files."""

import glob
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import bin_store


def frame(spark, rows):
    return spark.createDataFrame(rows, bin_store.SCHEMA).repartition(3)


def rows_of(df):
    return sorted((r.instrument, r.field, r.cal_idx, r.value) for r in df.collect())


ROWS = [(i, f, k, None if k == 4 else k + len(i) / 2) for i in ("a", "bb", "ccc") for f in ("close", "volume") for k in range(3, 9)]


@pytest.fixture
def stored(spark, tmp_path):
    bin_store.save(frame(spark, ROWS), str(tmp_path))
    return str(tmp_path)


def test_round_trip(spark, stored):
    assert rows_of(bin_store.load(spark, stored)) == sorted(ROWS, key=lambda r: r[:3])
    raw = np.fromfile(f"{stored}/bb/close.day.bin", "<f4")
    assert raw[0] == 3 and raw[1] == 4 and math.isnan(raw[2]) and len(raw) == 7
    assert not [f for f in glob.glob(f"{stored}/*/.*") if os.path.isfile(f)]  # nothing is left beside the files


def test_modes(spark, stored):
    read = lambda: [(r[2], r[3]) for r in rows_of(bin_store.load(spark, stored).filter("instrument = 'a' and field = 'close'"))]
    base = [(k, None if k == 4 else k + 0.5) for k in range(3, 9)]
    bin_store.save(frame(spark, [("a", "close", 8, 100.0), ("a", "close", 10, 1.0)]), stored)
    assert read() == [*base, (9, None), (10, 1.0)]  # what is stored stays, left out bars are missing
    bin_store.save(frame(spark, [("a", "close", 4, 2.0), ("a", "close", 1, 3.0)]), stored, "rewrite")
    assert read() == [(1, 3.0), (2, None), (3, 3.5), (4, 2.0), *base[2:], (9, None), (10, 1.0)]
    bin_store.save(frame(spark, [("a", "close", 20, 5.0)]), stored, "overwrite")
    assert read() == [(20, 5.0)] and len(rows_of(bin_store.load(spark, stored).filter("field = 'volume'"))) == 18
    bin_store.save(frame(spark, [("new", "close", 2, 1.0), ("new", "close", 2, 6.0)]), stored)
    assert len(rows_of(bin_store.load(spark, stored).filter("instrument = 'new'"))) == 1


def test_asked_files_and_ranges(spark, stored):
    expect = [(i, "close", k, k + len(i) / 2) for i in ("a", "bb") for k in (5, 6, 7)]
    asked = bin_store.load(spark, stored, instruments=["a", "bb"], fields=["close"], low=5, high=7)
    assert rows_of(asked) == expect and rows_of(asked.filter("cal_idx = 5").unionByName(asked.filter("instrument = 'a'"))) == sorted([*(r for r in expect if r[2] == 5), *(r for r in expect if r[0] == "a")])
    pushed = bin_store.load(spark, stored, push=True).filter("instrument in ('a', 'bb') and field = 'close' and cal_idx >= 5 and cal_idx < 8")
    open(f"{stored}/ccc/close.day.bin", "wb").write(b"xx")  # a broken file that is left out
    assert rows_of(asked) == expect and rows_of(pushed) == expect
    scan = pushed._jdf.queryExecution().explainString(pushed.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [" in scan and "EqualTo(field,close)" in scan
    reader = bin_store.PushedReader({"path": stored})
    left = list(reader.pushFilters([bin_store.In(("instrument",), ("a", "bb")), bin_store.EqualTo(("field",), "close"), bin_store.GreaterThan(("cal_idx",), 4), bin_store.LessThan(("cal_idx",), 8), bin_store.EqualTo(("value",), 1.0)]))
    assert [f.attribute for f in left] == [("value",)]
    parts = reader.partitions()
    assert [os.path.relpath(p, stored) for part in parts for p in part.paths] == ["a/close.day.bin", "bb/close.day.bin"] and (parts[0].low, parts[0].high) == (5, 7)


def test_a_failed_write_leaves_the_files(spark, stored):
    before = {f: open(f, "rb").read() for f in glob.glob(f"{stored}/*/*")}
    bad = frame(spark, [("a", "close", 50, 1.0), ("zz", "close", 1, 2.0)]).withColumn("value", F.when(F.col("instrument") == "zz", F.raise_error(F.lit("no"))).otherwise(F.col("value")).cast("double"))
    with pytest.raises(Exception, match="no"):
        bin_store.save(bad, stored)
    assert {f: open(f, "rb").read() for f in glob.glob(f"{stored}/*/*")} == before


def test_other_frequencies_and_empty_folders(spark, tmp_path):
    bin_store.save(frame(spark, [("a", "close", 0, 1.0)]), str(tmp_path), freq="1min")
    assert bin_store.load(spark, str(tmp_path)).count() == 0 and bin_store.load(spark, str(tmp_path), "1min").count() == 1
    assert bin_store.load(spark, str(tmp_path / "none")).collect() == []
