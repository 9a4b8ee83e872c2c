"""Intraday calendars with breaks: a bar is a (day, slot), so shifts and joins are arithmetic on two whole numbers.

``Sessions`` lists the spans of a trading day; the bars of ``step`` minutes in them are numbered through the day from 0, breaks left out. Days are the calendar's own, numbered from 0.
A bar's place in the calendar is day * slots + slot: windows of expressions run over the breaks and nights as the bars do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.library import Context
from tidemark.plans.compiler import Panel

#: Days of a calendar that are broadcast: some 3,000 years of trading.
SMALL = 1_000_000


def _seconds(text: str) -> int:
    h, m = text.split(":")
    return int(h) * 3600 + int(m) * 60


@dataclass(frozen=True)
class Sessions:
    """Spans (start, end) of a day as "HH:MM", in order, each a whole number of bars of step minutes; a bar starts at its time, ends are left out."""

    spans: tuple[tuple[str, str], ...] = (("09:30", "11:30"), ("13:00", "15:00"))
    step: int = 1

    def __post_init__(self):
        last = 0
        for a, b in self.edges:
            if not last <= a < b or (b - a) % (60 * self.step):
                raise ValueError(f"spans must follow each other and hold whole bars of {self.step} minutes: {self.spans}")
            last = b

    @property
    def edges(self) -> list[tuple[int, int]]:
        return [(_seconds(a), _seconds(b)) for a, b in self.spans]

    @property
    def slots(self) -> int:
        return sum(b - a for a, b in self.edges) // (60 * self.step)

    def slot(self, time: Column) -> Column:
        """The bar's number in its day; NULL in a break or outside."""
        second, out, before = F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time), F.lit(None).cast("int"), 0
        for a, b in reversed(self.edges):
            before = self.slots_before(a)
            out = F.when((second >= a) & (second < b), F.floor((second - a) / (60 * self.step)).cast("int") + before).otherwise(out)
        return out

    def slots_before(self, second: int) -> int:
        return sum(min(b, max(a, second)) - a for a, b in self.edges) // (60 * self.step)

    def start(self, day: Column, slot: Column) -> Column:
        """The time at which a slot of a day starts."""
        second, before = None, self.slots
        for a, b in reversed(self.edges):
            before -= (b - a) // (60 * self.step)
            own = F.lit(a) + (slot - before) * 60 * self.step
            second = own if second is None else F.when(slot >= before + (b - a) // (60 * self.step), second).otherwise(own)
        return F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(day)) + second)

    def aligned(self, time: Column, bars: int) -> Column:
        """The start of the run of so many bars that time falls into; runs start with the day and cross breaks, not days."""
        slot = self.slot(time)
        return self.start(F.to_date(time), slot - slot % bars)


def days_of(bars: DataFrame) -> DataFrame:
    """(day, day_idx): the days of bars, numbered. The window without a partition is over days."""
    return bars.select(F.to_date("datetime").alias("day")).distinct().select("day", (F.row_number().over(Window.orderBy("day")) - 1).cast("long").alias("day_idx"))


def _small(days: DataFrame) -> DataFrame:
    return F.broadcast(days) if days.count() <= SMALL else days


def placed(bars: DataFrame, sessions: Sessions, days: DataFrame | None = None) -> DataFrame:
    """bars with day_idx, slot and cal_idx; those outside the sessions or the days go."""
    days = _small(days_of(bars) if days is None else days)
    rows = bars.withColumn("slot", sessions.slot(F.col("datetime"))).filter("slot is not null").withColumn("day", F.to_date("datetime")).join(days, "day").drop("day")
    return rows.withColumn("cal_idx", F.col("day_idx") * sessions.slots + F.col("slot"))


def panel(bars: DataFrame, sessions: Sessions, days: DataFrame | None = None, strict: bool = False) -> Panel:
    """A dense panel over the sessions' bars, from each instrument's first bar to its last. bars: one row for each instrument and slot, at the slot's start."""
    days = days_of(bars) if days is None else days
    rows = placed(bars, sessions, days).drop("day_idx", "slot", "datetime")
    ends = rows.groupBy("instrument").agg(F.min("cal_idx").alias("a"), F.max("cal_idx").alias("b"))
    spine = ends.select("instrument", F.explode(F.sequence("a", "b")).alias("cal_idx")).withColumn("day_idx", F.floor(F.col("cal_idx") / sessions.slots))
    spine = spine.join(_small(days), "day_idx").select("instrument", "cal_idx", sessions.start(F.col("day"), (F.col("cal_idx") % sessions.slots).cast("int")).alias("datetime"))
    full = spine.join(rows, ["instrument", "cal_idx"], "left")
    return Panel(full.select("instrument", "datetime", "cal_idx", *(c for c in rows.columns if c not in ("instrument", "cal_idx"))), Context(strict=strict))


def shifted(rows: DataFrame, sessions: Sessions, days: DataFrame, bars: int, name: str = "shifted") -> DataFrame:
    """rows (datetime, ...) with the time so many bars later (earlier below 0) in the sessions of days; NULL beyond the calendar or outside of the sessions."""
    days = _small(days)
    at = rows.withColumn("_day", F.to_date("datetime")).join(days.toDF("_day", "_from"), "_day", "left")
    place = F.col("_from") * sessions.slots + sessions.slot(F.col("datetime")) + bars
    at = at.withColumn("_place", place).withColumn("_to", F.floor(F.col("_place") / sessions.slots)).join(days.toDF("_target", "_to"), "_to", "left")
    when = sessions.start(F.col("_target"), F.pmod("_place", F.lit(sessions.slots)).cast("int"))
    return at.select(*rows.columns, when.alias(name))


def earlier(bars: DataFrame, fields: Mapping[str, str], days_back: int = 1, slot: int | None = None) -> DataFrame:
    """bars (instrument, day_idx, slot, fields, ...) with fields of so many days before: of the same slot, or of one slot of that day. fields: name -> field."""
    then = bars.select(F.col("instrument").alias("_i"), (F.col("day_idx") + days_back).alias("_d"), F.col("slot").alias("_s"), *(F.col(f).alias(n) for n, f in fields.items()))
    on = (F.col("instrument") == F.col("_i")) & (F.col("day_idx") == F.col("_d"))
    if slot is None:
        return bars.join(then, on & (F.col("slot") == F.col("_s")), "left").drop("_i", "_d", "_s")
    return bars.join(then.filter(F.col("_s") == slot), on, "left").drop("_i", "_d", "_s")


#: From coarse to fine; a frequency that isn't stored falls back to a finer one.
FREQUENCIES = ("month", "week", "day", "min")


def nearest_frequency(wanted: str, stored: Sequence[str]) -> str:
    """The frequency to read for a wanted one: itself, else days, for what is coarser than a day, else minutes. ValueError if none is stored."""
    if wanted not in FREQUENCIES:
        raise ValueError(f"frequency must be one of {FREQUENCIES}")
    for freq in (wanted, *(f for f in ("day", "min") if FREQUENCIES.index(f) > FREQUENCIES.index(wanted))):
        if freq in stored:
            return freq
    raise ValueError(f"nothing stored for {wanted} or finer")


def at_frequency(wanted: str, stored: Mapping[str, DataFrame], how: Mapping[str, Column]) -> DataFrame:
    """(instrument, datetime, names): bars of the wanted frequency from what is stored. how: name -> aggregate over the finer bars; datetime is the day, or the first stored bar of the week or month."""
    freq = nearest_frequency(wanted, list(stored))
    rows = stored[freq]
    if wanted == "min":
        return rows.groupBy("instrument", "datetime").agg(*(c.alias(n) for n, c in how.items()))
    unit = F.date_trunc(wanted, F.col("datetime").cast("timestamp"))
    firsts = rows.groupBy(unit.alias("_unit")).agg(F.min(F.to_date("datetime")).alias("_first"))
    out = rows.groupBy("instrument", unit.alias("_unit")).agg(*(c.alias(n) for n, c in how.items()))
    return out.join(_small(firsts), "_unit").select("instrument", F.col("_first").alias("datetime"), *how)
