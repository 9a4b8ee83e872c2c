"""Runs the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark import queries as engine

NAMES = ["supply_factors", "technical_features", "lagged_features", "feature_families", "expr_mean", "expr_rank", "expr_ema", "panel_dense", "process_date_rank", "handler_learn", "ic", "group_returns", "turnover", "risk", "long_short_backtest", "topk_dropout", "pit_latest", "resample_week", "filter_expression"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g")).config("spark.sql.codegen.cache.maxEntries", "1000").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    engine.QUERIES["expr_field"](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in NAMES:
        began = time.perf_counter()
        engine.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
