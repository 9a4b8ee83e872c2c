"""Dataset processors: transforms of feature columns, some fitted on a time range, some across a date.

A frame is (instrument, datetime, columns); ``Groups`` names the columns of each group. ``fit`` runs one
aggregate job and keeps its numbers; ``apply`` is lazy.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.quantiles import SMALL, median_and_deviation
from tidemark.sources.working import cut, written

EPS = 1e-12
#: Fixed value: makes a median absolute deviation comparable with a standard deviation.
MAD_SCALE = 1.4826
Groups = dict[str, list[str]]


def by_date() -> WindowSpec:
    """The rows of a date."""
    return Window.partitionBy("datetime")


@dataclass
class Processor:
    group: str | None = None
    columns: list[str] | None = None

    for_infer = True

    def names(self, groups: Groups) -> list[str]:
        if self.columns is not None:
            return self.columns
        return groups[self.group] if self.group else [c for g in groups.values() for c in g]

    def fit(self, df: DataFrame, groups: Groups) -> Processor:
        return self

    def change(self, name: str) -> Column:
        raise NotImplementedError

    def apply(self, df: DataFrame, groups: Groups) -> DataFrame:
        own = set(self.names(groups))
        return df.select(*(self.change(c).alias(c) if c in own else F.col(f"`{c}`") for c in df.columns))

    def groups(self, groups: Groups) -> Groups:
        return groups


@dataclass
class DropMissing(Processor):
    """Rows with a missing value in the group go."""

    def apply(self, df, groups):
        return df.dropna("any", subset=self.names(groups))


@dataclass
class DropMissingLabel(DropMissing):
    """The same for labels, in training only."""

    group: str | None = "label"
    for_infer = False


@dataclass
class DropColumns(Processor):
    def apply(self, df, groups):
        return df.drop(*self.columns)

    def groups(self, groups):
        return {g: [c for c in cs if c not in self.columns] for g, cs in groups.items()}


@dataclass
class KeepColumns(Processor):
    """Of the group only the listed columns stay; other groups are whole."""

    def apply(self, df, groups):
        return df.drop(*(c for c in groups[self.group] if c not in self.columns))

    def groups(self, groups):
        return groups | {self.group: [c for c in groups[self.group] if c in self.columns]}


@dataclass
class Tanh(Processor):
    def names(self, groups):
        return [c for g, cs in groups.items() if g != "label" for c in cs]

    def change(self, name):
        return F.tanh(F.col(name) - 1)


@dataclass
class ReplaceInfinite(Processor):
    """Infinite values become the date's mean of finite ones."""

    def change(self, name):
        x = F.col(name)
        infinite = F.abs(x) == F.lit(math.inf)
        return F.when(infinite, F.avg(F.when(~infinite, x)).over(by_date())).otherwise(x)


@dataclass
class Fill(Processor):
    value: float = 0.0

    def change(self, name):
        return F.coalesce(F.col(name), F.lit(float(self.value)))


@dataclass
class FillWithDateMean(Processor):
    def change(self, name):
        return F.coalesce(F.col(name), F.avg(name).over(by_date()))


def stacked(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, column, value) of the known values of the named columns; column: the name's place in names."""
    cells = F.array(*(F.col(f"`{c}`").cast("double") for c in names))
    return df.select(*keys, F.posexplode(cells).alias("column", "value")).filter(F.col("value").isNotNull())


@dataclass
class Fitted(Processor):
    start: object = None
    end: object = None
    numbers: dict[str, tuple[float, ...]] = field(default_factory=dict)

    def slice(self, df: DataFrame) -> DataFrame:
        if self.start is not None:
            df = df.filter(F.col("datetime") >= F.lit(self.start))
        return df.filter(F.col("datetime") <= F.lit(self.end)) if self.end is not None else df

    def collect(self, df: DataFrame, names: list[str], *aggregates) -> dict[str, tuple]:
        """One row with every aggregate of every column."""
        row = df.agg(*(f(c).alias(f"{c}|{k}") for c in names for k, f in enumerate(aggregates))).first()
        return {c: tuple(row[f"{c}|{k}"] for k in range(len(aggregates))) for c in names}


@dataclass
class MinMax(Fitted):
    def fit(self, df, groups):
        self.numbers = self.collect(self.slice(df), self.names(groups), F.min, F.max)
        return self

    def change(self, name):
        low, high = self.numbers[name]
        return F.col(name) if low is None or low == high else (F.col(name) - low) / (high - low)


@dataclass
class ZScore(Fitted):
    def fit(self, df, groups):
        self.numbers = self.collect(self.slice(df), self.names(groups), F.avg, F.stddev_pop)
        return self

    def change(self, name):
        mean, std = self.numbers[name]
        return F.col(name) if not std else (F.col(name) - mean) / std


@dataclass
class RobustZScore(Fitted):
    """By median and median absolute deviation, both exact; clipped to -3 .. 3. Fitting closes in on order statistics, so no task holds a column."""

    clip: bool = True

    def fit(self, df, groups):
        names = self.names(groups)
        found = {names[r["column"]]: (r["median"], r["mad"]) for r in median_and_deviation(stacked(self.slice(df), [], names), ["column"]).collect()}  # a row for each column
        self.numbers = {c: found.get(c, (None, None)) for c in names}
        return self

    def change(self, name):
        mid, mad = self.numbers[name]
        if mid is None:
            return F.col(name)
        z = (F.col(name) - mid) / ((mad + EPS) * MAD_SCALE)
        return F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(3.0)), F.lit(-3.0))) if self.clip else z


@dataclass
class DateZScore(Processor):
    """Across the instruments of a date; method zscore (sample deviation) or robust."""

    method: str = "zscore"

    def apply(self, df, groups):
        names = self.names(groups)
        if self.method == "zscore":
            return df.select(*(F.try_divide(F.col(c) - F.avg(c).over(by_date()), F.stddev_samp(c).over(by_date())).alias(c) if c in names else F.col(c) for c in df.columns))
        df = df.select("*", *((F.col(c) - F.percentile(c, F.lit(0.5)).over(by_date())).alias(f"{c}|d") for c in names))
        z = {c: F.try_divide(F.col(f"{c}|d"), F.percentile(F.abs(F.col(f"{c}|d")), F.lit(0.5)).over(by_date()) * MAD_SCALE) for c in names}
        return df.select(*((F.when(z[c].isNotNull(), F.greatest(F.least(z[c], F.lit(3.0)), F.lit(-3.0))).alias(c) if c in names else F.col(c)) for c in df.columns if not c.endswith("|d")))


#: Which columns of the 158 are normalised how, in this order; a column that several patterns match goes through each in turn.
SECTIONS = [
    (r"^KLEN|^KLOW|^KUP", "x ** 0.25"),
    (r"^KLOW2|^KUP2", "x ** 0.5"),
    (r"^KMID|^KSFT|^OPEN|^HIGH(?!0$)|^LOW(?!0$)|^CLOSE|^VWAP|^ROC|^MA|^BETA|^RESI|^QTLU|^QTLD|^RSV|^SUMP|^SUMN|^SUMD|^VSUMP|^VSUMN|^VSUMD", "x"),
    (r"^STD|^VOLUME|^VMA|^VSTD", "log(x)"),
    (r"^RSQR", "x or 0"),
    (r"^MAX|^HIGH0", "(x - 1) ** 0.5"),
    (r"^MIN|^LOW0", "(1 - x) ** 0.5"),
    (r"^CORR|^CORD", "exp(x)"),
    (r"^WVMA", "log(1 + x)"),
]
SHAPES = {
    "x": lambda x: x,
    "x ** 0.25": lambda x: F.when(x >= 0, F.pow(x, F.lit(0.25))),
    "x ** 0.5": lambda x: F.when(x >= 0, F.sqrt(x)),
    "log(x)": lambda x: F.when(x > 0, F.ln(x)),
    "x or 0": lambda x: F.coalesce(x, F.lit(0.0)),
    "(x - 1) ** 0.5": lambda x: F.when(x >= 1, F.sqrt(x - 1)),
    "(1 - x) ** 0.5": lambda x: F.when(x <= 1, F.sqrt(1 - x)),
    "exp(x)": F.exp,
    "log(1 + x)": lambda x: F.when(x > -1, F.log1p(x)),
}


@dataclass
class Section(Processor):
    """Normalises the technical feature set across each date: columns are shaped by SECTIONS, then measured by median and median absolute deviation; labels by mean and sample deviation.

    With ``shrink`` values beyond 3 are drawn in to 3 .. 3.5 by their share of the date's largest, likewise below -3; with ``clip`` they are cut; with ``fill`` missing ones become 0. Where the shape isn't defined (roots of
    negative numbers, logarithms of 0 and less) a value is missing. Statistics of all columns come from one stack of (date, column, value) rows, by partial counts, and go back as one row a date. The shaped
    rows are written once a turn: statistics, values and the next turn start from there, so what made the rows runs once.
    """

    shrink: bool = True
    clip: bool = False
    fill: bool = True
    clip_label: bool = False
    fill_label: bool = True

    def apply(self, df, groups):
        names = self.names(groups)
        steps = {c: [shape for pattern, shape in SECTIONS if re.search(pattern, c)] for c in names if not c.startswith("LABEL")}
        for turn in range(max(map(len, steps.values()), default=0)):
            df = self._normalised(df, {c: s[turn] for c, s in steps.items() if len(s) > turn})
        return self._labels(df, [c for c in names if c.startswith("LABEL")])

    def _normalised(self, df: DataFrame, shapes: dict[str, str]) -> DataFrame:
        shaped = written(df.select(*(SHAPES[shapes[c]](F.col(f"`{c}`").cast("double")).alias(c) if c in shapes else F.col(f"`{c}`") for c in df.columns)))
        place = {c: i for i, c in enumerate(shapes)}
        found = median_and_deviation(stacked(shaped, ["datetime"], list(shapes)), ["datetime", "column"], stored=True).withColumn("scale", F.col("mad") * MAD_SCALE)
        entry = F.struct("median", "scale", *(F.try_divide(F.col(x) - F.col("median"), F.col("scale")).alias(x) for x in ("low", "high")))
        stats = cut(found.groupBy(F.col("datetime").alias("_d")).agg(*(F.max(F.when(F.col("column") == i, entry)).alias(f"_s{i}") for i in place.values())))
        rows = shaped.join(F.broadcast(stats) if stats.count() <= SMALL // max(1, len(shapes)) else stats, F.col("datetime") == F.col("_d"), "left")
        # two selects: Spark keeps them apart, so a measured value that the second names several times is worked out once
        measured = rows.select(*(F.try_divide(F.col(f"`{c}`") - F.col(f"_s{place[c]}")["median"], F.col(f"_s{place[c]}")["scale"]).alias(c) if c in shapes else F.col(f"`{c}`") for c in df.columns), *(f"_s{i}" for i in place.values()))
        return measured.select(*(self._bounded(F.col(f"`{c}`"), F.col(f"_s{place[c]}")).alias(c) if c in shapes else F.col(f"`{c}`") for c in df.columns))

    def _bounded(self, z: Column, ends: Column) -> Column:
        if self.clip:
            z = F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(3.0)), F.lit(-3.0)))
        if self.shrink:
            beyond, most = F.abs(z) - 3, F.abs(F.when(z > 0, ends["high"]).otherwise(ends["low"])) - 3  # one branch for both sides: a method that is too long isn't compiled
            z = F.when(beyond > 0, F.signum(z) * (3 + F.try_divide(beyond, most) * 0.5)).otherwise(z)
        return F.coalesce(z, F.lit(0.0)) if self.fill else z

    def _labels(self, df: DataFrame, names: list[str]) -> DataFrame:
        if not names:
            return df
        z = {c: F.try_divide(F.col(c) - F.avg(c).over(by_date()), F.stddev_samp(c).over(by_date())) for c in names}
        if self.clip_label:
            z = {c: F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(3.0)), F.lit(-3.0))) for c, x in z.items()}
        return df.select(*((F.coalesce(z[c], F.lit(0.0)) if self.fill_label else z[c]).alias(c) if c in z else F.col(f"`{c}`") for c in df.columns))


@dataclass
class DateRank(Processor):
    """(percent rank with ties averaged - 0.5) * 3.46 across a date."""

    def change(self, name):
        rank = F.rank().over(by_date().orderBy(F.col(name).asc_nulls_last()))
        ties = F.count(F.lit(1)).over(Window.partitionBy("datetime", name))
        return F.when(F.col(name).isNotNull(), ((rank + (ties - 1) / 2) / F.count(name).over(by_date()) - 0.5) * 3.46)


@dataclass
class Cast(Processor):
    kind: str = "float"

    def change(self, name):
        return F.col(name).cast(self.kind)


@dataclass
class SharedNorm(Fitted):
    """Groups of columns share one mean and one deviation of absolute values; columns named in logs go through log1p first; missing becomes 0."""

    sets: dict[str, list[str]] = field(default_factory=dict)
    logs: tuple[str, ...] = ()

    def _value(self, name: str, c: str) -> Column:
        return F.log1p(F.col(c)) if name in self.logs else F.col(c)

    def fit(self, df, groups):
        df = self.slice(df)
        for name, cs in self.sets.items():
            stacked = df.select(F.explode(F.array(*(self._value(name, c) for c in cs))).alias("x"))
            mean = stacked.agg(F.avg("x")).first()[0]
            std = stacked.agg(F.stddev_pop(F.abs(F.col("x") - F.lit(mean)))).first()[0]
            self.numbers[name] = mean, std
        return self

    def apply(self, df, groups):
        of = {c: name for name, cs in self.sets.items() for c in cs}

        def norm(c):
            mean, std = self.numbers[of[c]]
            return F.coalesce((self._value(of[c], c) - mean) / std, F.lit(0.0)) if std else F.lit(0.0)

        return df.select(*(norm(c).alias(c) if c in of else F.col(c) for c in df.columns))


@dataclass
class Handler:
    """Raw frame, and lazily the frames for learning and inference.

    shared processors come first; infer and learn follow: learn on top of infer (append) or beside it.
    """

    raw: DataFrame
    groups: Groups
    shared: list[Processor] = field(default_factory=list)
    infer: list[Processor] = field(default_factory=list)
    learn: list[Processor] = field(default_factory=list)
    append: bool = True

    def _run(self, df: DataFrame, groups: Groups, steps: list[Processor], fit: bool, training: bool) -> tuple[DataFrame, Groups]:
        for p in steps:
            if not training and not p.for_infer:
                raise ValueError(f"{type(p).__name__} is for training only")
            if fit:
                p.fit(df, groups)
            df, groups = p.apply(df, groups), p.groups(groups)
        return df, groups

    def setup(self, fit: bool = True) -> Handler:
        base = self._run(self.raw, self.groups, self.shared, fit, True)
        self.inferred = self._run(*base, self.infer, fit, False)
        self.learned = self._run(*(self.inferred if self.append else base), self.learn, fit, True)
        return self

    def stage(self, key: str) -> tuple[DataFrame, Groups]:
        """The frame and its groups: raw, infer or learn."""
        if key == "raw":
            return self.raw, self.groups
        return {"infer": lambda: self.inferred, "learn": lambda: self.learned}[key]()

    def fetch(self, key: str = "infer", start=None, end=None, group: str | None = None) -> DataFrame:
        df, groups = self.stage(key)
        if start is not None:
            df = df.filter(F.col("datetime") >= F.lit(start))
        if end is not None:
            df = df.filter(F.col("datetime") <= F.lit(end))
        return df.select("instrument", "datetime", *groups[group]) if group else df

    def upto(self, date, periods: int, key: str = "infer", group: str | None = None) -> DataFrame:
        """The rows of the last periods dates up to date, all before it if they are fewer. KeyError if the frame doesn't have the date."""
        df = self.fetch(key, end=date)
        found = df.select("datetime").distinct().orderBy(F.desc("datetime")).limit(periods).agg(F.min("datetime").alias("a"), F.max(F.col("datetime") == F.lit(date)).alias("has")).first()
        if not found["has"]:
            raise KeyError(f"no rows on {date}")
        return self.fetch(key, found["a"], date, group)


def ranges(df: DataFrame, periods: int, least: int | None = None) -> DataFrame:
    """(upto, columns of df): for each date but the first least (periods by default), the rows of the last periods dates up to it.

    All ranges are one plan: a row goes to the at most periods dates that look back to it. What a window expresses needs no ranges; these are for whole frames of a range, such as fits that roll.
    """
    least = periods if least is None else least
    dates = df.select("datetime").distinct().select("datetime", (F.row_number().over(Window.orderBy("datetime")) - 1).alias("_k"))  # over the calendar
    n = dates.count()
    small = lambda d: F.broadcast(d) if n <= SMALL else d
    first, last = F.greatest(F.col("_k"), F.lit(least)), F.least(F.col("_k") + periods - 1, F.lit(n - 1))
    rows = df.join(small(dates), "datetime").filter(first <= last).withColumn("_at", F.explode(F.sequence(first, last)))
    return rows.join(small(dates.toDF("upto", "_at")), "_at").select("upto", *df.columns)


FILLS = ("none", "ffill", "ffill+bfill")


def sequences(df: DataFrame, columns: list[str], steps: int, start=None, end=None, fill: str = "none") -> DataFrame:
    """(instrument, datetime, steps): the last rows of each instrument, oldest first, filled with NULL on the left.

    fill: what stands for a row that has none of its columns, and for those before the first: NULLs (none), the row before it in the sequence (ffill), or, where there's none, the one after it (ffill+bfill). Rows are carried
    whole: a row with some of its columns is left as it is.
    """
    if fill not in FILLS:
        raise ValueError(f"fill must be one of {FILLS}")
    w = Window.partitionBy("instrument").orderBy("datetime").rowsBetween(1 - steps, 0)
    values = F.array(*(F.col(c).cast("double") for c in columns))
    gap = F.array(*(F.lit(None).cast("double") for _ in columns))
    if fill == "none":
        rows = F.collect_list(values).over(w)
        steps_ = F.concat(F.array_repeat(gap, F.lit(steps) - F.size(rows)), rows)
    else:
        known = F.when(F.coalesce(*(F.col(c).cast("double") for c in columns)).isNotNull(), values)
        held = F.transform(F.collect_list(F.struct(known.alias("v"))).over(w), lambda e: e["v"])
        none = F.lit(None).cast("array<double>")
        rows = _carried(F.concat(F.array_repeat(none, F.lit(steps) - F.size(held)), held))
        rows = F.reverse(_carried(F.reverse(rows))) if fill == "ffill+bfill" else rows
        steps_ = F.transform(rows, lambda e: F.coalesce(e, gap))
    out = df.select("instrument", "datetime", steps_.alias("steps"))
    if start is not None:
        out = out.filter(F.col("datetime") >= F.lit(start))
    return out.filter(F.col("datetime") <= F.lit(end)) if end is not None else out


def _carried(values: Column) -> Column:
    """The array with missing elements replaced by the one before: a fold that carries the last element."""
    empty = F.array().cast("array<array<double>>")
    return F.aggregate(values, empty, lambda done, e: F.concat(done, F.array(F.coalesce(e, F.when(F.size(done) > 0, F.element_at(done, -1))))))


def day_batches(df: DataFrame, columns: list[str], slots: int | None = None) -> DataFrame:
    """(datetime, slot, instrument, values): the rows of each day as a batch, in order of instruments. slots: a memory of so many places that an instrument keeps for good, its number modulo slots; else its place in the day."""
    values = F.array(*(F.col(c).cast("double") for c in columns)).alias("values")
    if slots is None:
        return df.select("datetime", (F.row_number().over(by_date().orderBy("instrument")) - 1).alias("slot"), "instrument", values)
    numbers = df.select("instrument").distinct().select("instrument", ((F.row_number().over(Window.orderBy("instrument")) - 1) % slots).alias("slot"))  # over the list of names
    return df.join(numbers, "instrument").select("datetime", "slot", "instrument", values)
