"""Ready-made intraday sets over session panels: prices over an earlier day's close, volumes over the mean of past days, quotes for execution.

Nothing runs over an instrument's whole series. What a bar needs of other days is one row for each instrument and day (last known prices, sums of volumes), found by a partial aggregate; windows by instrument run over
these day rows alone, windows over bars stay inside a day or a slot. A long minute history is therefore as many tasks as it has instrument days.

Panels are dense (``sessions.panel``): a row for each slot from an instrument's first bar to its last, missing values NULL. Values don't depend on how far the last day has come: a day's anchors are those at its last slot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.compiler import Panel
from tidemark.sources.sessions import Sessions

PRICES = ("open", "high", "low", "close", "vwap")
KEY = ["instrument", "_day"]
VOLUME_DAYS = 30


def _rows(panel: Panel, slots: int, values: dict[str, Column], keep: Column | None) -> DataFrame:
    place = F.col("cal_idx")
    return panel.bars.select(
        "instrument", "datetime", "cal_idx", F.floor(place / slots).cast("long").alias("_day"), F.pmod(place, F.lit(slots)).cast("int").alias("_slot"),
        (F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))).alias("_keep"), *(v.alias(n) for n, v in values.items()),
    )


def _past(frame_end: int) -> Window:
    return Window.partitionBy("instrument").orderBy("_day").rowsBetween(Window.unboundedPreceding, frame_end)


def _latest(name: str, until: int | None = None) -> Column:
    """A day's last value of a column, up to a slot."""
    known = F.col(name).isNotNull() if until is None else F.col(name).isNotNull() & (F.col("_slot") <= until)
    return F.max_by(name, F.when(known, F.col("_slot")))


def carried(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """rows with each missing value of names replaced by the last one before it: inside the day by a window, over days from the days' last values."""
    ends = rows.groupBy(KEY).agg(*(_latest(n).alias(n) for n in names))
    before = ends.select(*KEY, *(F.last(n, ignorenulls=True).over(_past(-1)).alias(f"_before_{n}") for n in names))
    day = Window.partitionBy(KEY).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select("*", *(F.last(n, ignorenulls=True).over(day).alias(f"_own_{n}") for n in names))
    value = lambda n: F.coalesce(f"_own_{n}", f"_before_{n}").alias(n)
    return own.join(before, KEY).select(*(value(c) if c in names else c for c in rows.columns))


def normalised(panel: Panel, sessions: Sessions, prices: Sequence[str] = PRICES, volume: str = "volume", anchors: tuple[int, int] | None = None, volume_days: int = VOLUME_DAYS, keep: Column | None = None) -> DataFrame:
    """instrument, datetime, prices, prices of the day before (name_1), volume, volume_1.

    A price (the close where it's missing) over the last known close so many bars before the day's last slot: anchors for the bar's own and the day before's prices, two days and one by default; missing ratios take the last one.
    A volume over the mean of volume_days days before; missing is 0. keep: a condition on bars that decides which rows stay, else those from each instrument's third day of bars on. Division by zero is missing.
    Fixed values: the anchors, 30 days and two days left out are those of published intraday sets; models trained on these expect them.
    """
    slots = sessions.slots
    back = anchors or (2 * slots, slots)
    names = [f"_p_{p}" for p in prices]
    values = {n: F.coalesce(F.col(p), F.col("close")).cast("double") for n, p in zip(names, prices, strict=True)}
    rows = _rows(panel, slots, values | {"_close": F.col("close").cast("double"), "_volume": F.col(volume).cast("double")}, keep)
    days = rows.groupBy(KEY).agg(
        _latest("_close").alias("_end"), *(_latest("_close", slots - 1 - b % slots).alias(f"_at_{k}") for k, b in enumerate(back)),
        F.sum("_volume").alias("_sum"), F.count("_volume").alias("_n"), F.min("cal_idx").alias("_from"),
    )
    series, month = Window.partitionBy("instrument").orderBy("_day"), Window.partitionBy("instrument").orderBy("_day").rowsBetween(-volume_days, -1)
    days = days.select("*", F.last("_end", ignorenulls=True).over(_past(-1)).alias("_before"))
    days = days.select(
        *KEY, *(F.lag(F.coalesce(f"_at_{k}", "_before"), b // slots).over(series).alias(f"_base_{k}") for k, b in enumerate(back)),
        F.try_divide(F.sum("_sum").over(month), F.sum("_n").over(month)).alias("_mean"), F.min("_from").over(_past(0)).alias("_first"),
    )
    slot = Window.partitionBy("instrument", "_slot").orderBy("_day")
    both = rows.select("*", *(F.lag(n).over(slot).alias(f"{n}_1") for n in (*names, "_volume"))).join(days, KEY)
    ratios = {f"{p}{s}": F.try_divide(F.col(f"_p_{p}{s}"), F.col(f"_base_{k}")) for k, s in enumerate(("", "_1")) for p in prices}
    shares = {f"volume{s}": F.coalesce(F.try_divide(F.col(f"_volume{s}"), F.col("_mean")), F.lit(0.0)) for s in ("", "_1")}
    out = carried(both.select("instrument", "datetime", "cal_idx", "_day", "_slot", "_keep", "_first", *(c.alias(n) for n, c in (ratios | shares).items())), list(ratios))
    stays = F.col("_keep") if keep is not None else F.col("cal_idx") - F.col("_first") >= 2 * slots
    return out.filter(stays).select("instrument", "datetime", *ratios, *shares)


def quotes(panel: Panel, sessions: Sessions, prices: Sequence[str] = ("vwap",), amounts: Sequence[str] = ("volume", "factor"), keep: Column | None = None) -> DataFrame:
    """instrument, datetime, close0 (last known close of the bars that stay), prices (the last known close where missing) and amounts (0 where missing), each with a 0 behind its name: what an execution reads.

    keep: a condition on bars that decides which rows stay, else those from each instrument's third day of bars on.
    """
    slots, close = sessions.slots, F.col("close").cast("double")
    masked = close if keep is None else F.when(F.coalesce(keep, F.lit(False)), close)
    rows = _rows(panel, slots, {"close0": masked, "_close": close} | {f"{n}0": F.col(n).cast("double") for n in (*prices, *amounts)}, keep)
    out = carried(rows, ["close0", "_close"])
    if keep is None:
        firsts = rows.groupBy("instrument").agg(F.min("cal_idx").alias("_first"))
        out = out.join(firsts, "instrument").filter(F.col("cal_idx") - F.col("_first") >= 2 * slots)
    return out.filter("_keep").select(
        "instrument", "datetime", "close0", *(F.coalesce(f"{p}0", "_close").alias(f"{p}0") for p in prices), *(F.coalesce(f"{a}0", F.lit(0.0)).alias(f"{a}0") for a in amounts),
    )
