"""Features of a stream of bars, with the last bars of each instrument as state.

A processor keeps, for each instrument, the bars that its windows still reach and the carried sums of its exponential means. Bars are held until the watermark has passed them, so those that come late but in time take their
place in order; then a timer lets them through the windows, and their rows go out. A restart goes on from the state in the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import kernels

#: Windows that follow a stream: name -> operator.
WINDOWS = {name.lower(): name for name in ("Mean", "Sum", "Std", "Var", "Max", "Min", "Count", "Med", "Rank", "WMA", "Mad", "Ref", "Delta")}
BAR = "datetime timestamp, value double"


@dataclass(frozen=True)
class Feature:
    """op over the last n bars of the value; ``ema`` is the exponential mean of span n."""

    name: str
    op: str
    n: int

    def __post_init__(self):
        if self.op != "ema" and self.op not in WINDOWS or self.n < 1:
            raise ValueError(f"{self.name}: op must be ema or one of {sorted(WINDOWS)}, n at least 1")


def followed(values: np.ndarray, features: tuple[Feature, ...], carried: dict[str, tuple[float, float]], skip: int) -> dict[str, np.ndarray]:
    """The features of values[skip:], whose windows reach back into values[:skip]; carried: each exponential mean's weighted sum and weight so far, brought up to date."""
    rows = kernels.Rows(np.arange(len(values)) == 0)
    calls = [(WINDOWS[f.op], ("x",), f.n, ()) for f in features if f.op != "ema"]
    found = dict(zip((f.name for f in features if f.op != "ema"), kernels.evaluate(rows, {"x": values}, calls), strict=True))
    out = {}
    for f in features:
        if f.op != "ema":
            out[f.name] = found[f.name][skip:]
            continue
        rest, (total, weight), line = 1 - 2 / (f.n + 1), carried.get(f.name, (0.0, 0.0)), []
        for x in values[skip:].tolist():
            known = x == x
            total, weight = total * rest + (x if known else 0.0), weight * rest + known
            line.append(total / weight if weight > 0 else np.nan)  # a missing bar takes the mean before it
        carried[f.name], out[f.name] = (total, weight), np.array(line)
    return out


class LastBars(StatefulProcessor):
    """State: bars that wait for the watermark, bars that windows reach, carried sums."""

    def __init__(self, features: tuple[Feature, ...]):
        self.features, self.reach = features, max((f.n - (f.op not in ("ref", "delta")) for f in features if f.op != "ema"), default=0)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", BAR)
        self.last = handle.getListState("last", BAR)
        self.carried = handle.getMapState("carried", "name string", "total double, weight double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        for chunk in rows:
            for t, v in zip(chunk["datetime"], chunk["value"], strict=True):
                if t > passed:
                    self.waiting.appendValue((t.to_pydatetime(), None if pd.isna(v) else float(v)))
                    self.handle.registerTimer(int(t.value // 1_000_000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        stamp = lambda r: int(pd.Timestamp(r[0]).value // 1_000_000)
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        ready = {}
        for r in sorted((r for r in waiting if stamp(r) <= passed), key=stamp):
            ready[stamp(r)] = r  # of bars with one time the last to come stays
        if not ready:
            return
        kept = [tuple(r) for r in waiting if stamp(r) > passed]
        self.waiting.clear()
        if kept:
            self.waiting.put(kept)
        before = list(self.last.get()) if self.last.exists() else []
        bars = [*((r[0], r[1]) for r in before), *((r[0], r[1]) for r in ready.values())]
        carried = {f.name: tuple(self.carried.getValue((f.name,))) for f in self.features if f.op == "ema" and self.carried.containsKey((f.name,))}
        values = np.array([np.nan if v is None else v for _, v in bars])
        out = followed(values, self.features, carried, len(before))
        for name, sums in carried.items():
            self.carried.updateValue((name,), tuple(map(float, sums)))
        self.last.clear()
        if self.reach and bars:
            self.last.put([(t, v) for t, v in bars[-self.reach :]])
        yield pd.DataFrame({"instrument": key[0], "datetime": [r[0] for r in ready.values()], **out})

    def close(self) -> None:
        pass


def stream_features(bars: DataFrame, features: tuple[Feature, ...], delay: str = "1 day") -> DataFrame:
    """(instrument, datetime, features) of a stream of bars (instrument, datetime, value), each once its time is a delay behind the newest bar. Bars later than that are dropped; windows count the bars that came."""
    stamped = bars.select(F.col("instrument").cast("string").alias("instrument"), F.col("datetime").cast("timestamp").alias("datetime"), F.col("value").cast("double").alias("value")).withWatermark("datetime", delay)
    schema = "instrument string, datetime timestamp, " + ", ".join(f"`{f.name}` double" for f in features)
    return stamped.groupBy("instrument").transformWithStateInPandas(LastBars(features), outputStructType=schema, outputMode="append", timeMode="eventTime")


def run_available(stream: DataFrame, path: str) -> None:
    """Everything that is there now, written as Parquet under path; the state needs the store that keeps large state on the executors' disks."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
