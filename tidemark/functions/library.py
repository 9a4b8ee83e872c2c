"""The operators of the expression language as Spark columns.

Missing values are NULL. Comparisons with a missing value are false (Ne: true). A window of N rows counts
missing rows and needs one value; N = 0 is the whole past; 0 < N < 1 is an exponential mean with that alpha for operators
of one series (the compiler takes it apart into the layers of _Ema...). Division by zero gives NULL, or with ``strict`` what IEEE arithmetic gives.

An operator is registered with ``register``; windows come from the context, which also says whether a
function needs its arguments materialised first (window functions don't nest).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Standard deviations below this count as zero in Corr and Rsquare.
FLAT = 2e-5
#: The weights of an exponential mean differ by a factor of at most 2 ** EMA_OCTAVES within a chunk of rows.
EMA_OCTAVES = 200


@dataclass(frozen=True)
class Context:
    """Columns of the panel and settings that operators use."""

    instrument: str = "instrument"
    time: str = "datetime"
    index: str = "cal_idx"
    strict: bool = False

    @property
    def series(self) -> WindowSpec:
        return Window.partitionBy(self.instrument).orderBy(self.time)

    def rows(self, n: int) -> WindowSpec:
        return self.series.rowsBetween(Window.unboundedPreceding if n == 0 else 1 - n, 0)

    @property
    def whole(self) -> WindowSpec:
        return self.series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    @property
    def day(self) -> WindowSpec:
        return Window.partitionBy(self.instrument, F.to_date(self.time))


@dataclass(frozen=True)
class Operator:
    name: str
    body: Callable
    arity: tuple[int, int]
    window: bool


OPERATORS: dict[str, Operator] = {}


def register(name: str, arity: int | tuple[int, int], window: bool = False):
    """Decorator: body(context, *args) -> Column. Expression arguments are Columns, literals stay Python values."""

    def put(body: Callable) -> Callable:
        OPERATORS[name] = Operator(name, body, arity if isinstance(arity, tuple) else (arity, arity), window)
        return body

    return put


def num(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(None if x is None else float(x))


def known(*xs: Column) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & x.isNotNull()
    return out


def quotient(a: Column, b: Column, strict: bool) -> Column:
    safe = F.try_divide(a, b)
    if not strict:
        return safe
    inf = F.lit(math.inf)
    return F.when(b == 0, F.when(a > 0, inf).when(a < 0, -inf)).otherwise(safe)


# --- element-wise ----------------------------------------------------------------------------------------------


@register("Abs", 1)
def _abs(c, x):
    return F.abs(num(x))


@register("Sign", 1)
def _sign(c, x):
    return F.signum(num(x))


@register("Log", 1)
def _log(c, x):
    x = num(x)
    if c.strict:
        return F.when(x == 0, F.lit(-math.inf)).when(x > 0, F.ln(x))
    return F.when(x > 0, F.ln(x))


@register("Not", 1)
def _not(c, x):
    return ~F.coalesce(x.cast("boolean"), F.lit(False))


@register("IsNull", 1)
def _is_null(c, x):
    return x.isNull()


@register("IsInf", 1)
def _is_inf(c, x):
    return F.coalesce(F.abs(num(x)) == F.lit(math.inf), F.lit(False))


@register("Date", 1)
def _date(c, x):
    return F.to_date(c.time)


for _name, _f in {
    "Add": lambda c, a, b: num(a) + num(b),
    "Sub": lambda c, a, b: num(a) - num(b),
    "Mul": lambda c, a, b: num(a) * num(b),
    "Div": lambda c, a, b: quotient(num(a), num(b), c.strict),
    "Power": lambda c, a, b: F.nanvl(F.pow(num(a), num(b)), F.lit(None).cast("double")),
    "Greater": lambda c, a, b: F.when(known(num(a), num(b)), F.greatest(num(a), num(b))),
    "Less": lambda c, a, b: F.when(known(num(a), num(b)), F.least(num(a), num(b))),
    "Gt": lambda c, a, b: F.coalesce(num(a) > num(b), F.lit(False)),
    "Ge": lambda c, a, b: F.coalesce(num(a) >= num(b), F.lit(False)),
    "Lt": lambda c, a, b: F.coalesce(num(a) < num(b), F.lit(False)),
    "Le": lambda c, a, b: F.coalesce(num(a) <= num(b), F.lit(False)),
    "Eq": lambda c, a, b: F.coalesce(num(a) == num(b), F.lit(False)),
    "Ne": lambda c, a, b: F.coalesce(num(a) != num(b), F.lit(True)),
    "And": lambda c, a, b: F.coalesce(num(a) != 0, F.lit(False)) & F.coalesce(num(b) != 0, F.lit(False)),
    "Or": lambda c, a, b: F.coalesce(num(a) != 0, F.lit(False)) | F.coalesce(num(b) != 0, F.lit(False)),
}.items():
    register(_name, 2)(_f)


#: By bits, for trees of whole numbers; a missing value gives a missing one, a boolean counts as 0 or 1.
BITWISE = {"And": lambda a, b: a.bitwiseAND(b), "Or": lambda a, b: a.bitwiseOR(b), "Not": lambda a: F.bitwise_not(a)}


@register("If", 3)
def _if(c, cond, a, b):
    cond = num(cond)
    return F.when((cond != 0) | cond.isNull(), num(a)).otherwise(num(b))


# --- windows over one series -----------------------------------------------------------------------------------


def alpha_of(op: str, n) -> float | None:
    """The weight of the newest value if op with N = n is an exponential mean, else None."""
    if op == "EMA" and n >= 1:
        return 2 / (n + 1)
    return float(n) if 0 < n < 1 and (op == "EMA" or op.lower() in ROLLING) else None


def ema_chunk(alpha: float) -> int:
    return max(1, int(EMA_OCTAVES / -math.log2(1 - alpha)))


def _chunk(c: Context, alpha: float) -> WindowSpec:
    return Window.partitionBy(c.instrument, F.floor(F.col(c.index) / ema_chunk(alpha))).orderBy(c.time)


# An adjusted exponential mean over the whole past, in layers, as windows don't nest. The series is cut into chunks of bars. Within a chunk running sums of
# values times growing weights give numerator and denominator; the last chunk's sums are carried over. What came before has a weight of less than
# 2 ** -EMA_OCTAVES, beyond what a double can tell. A missing value passes time without weight, so the mean stays what it was.


@register("_EmaPart", 2, window=True)
def _ema_part(c, x, alpha):
    x = num(x)
    weight = F.pow(F.lit(1 / (1 - alpha)), F.col(c.index) % ema_chunk(alpha))
    past = _chunk(c, alpha).rowsBetween(Window.unboundedPreceding, 0)
    return F.struct(F.sum(x * weight).over(past).alias("n"), F.sum(F.when(x.isNotNull(), weight)).over(past).alias("d"))


@register("_EmaBefore", 1, window=True)
def _ema_before(c, part):
    return F.lag(part).over(c.series)


@register("_EmaCarried", 2, window=True)
def _ema_carried(c, before, alpha):
    return F.first(before).over(_chunk(c, alpha).rowsBetween(Window.unboundedPreceding, 0))


@register("_EmaValue", 4)
def _ema_value(c, x, part, carried, alpha):
    rest = (1 - alpha) ** ema_chunk(alpha)
    n, d = (F.coalesce(part[f], F.lit(0.0)) + F.coalesce(carried[f], F.lit(0.0)) * rest for f in ("n", "d"))
    return F.when(num(x).isNotNull(), F.try_divide(n, d))


def rolling(name: str):
    """An operator of a series and N."""

    def put(body: Callable) -> Callable:
        def run(c: Context, x, n, *more):
            x = num(x)
            if n != int(n) or n < 0:
                raise ValueError(f"{name}: N must be a whole number or between 0 and 1")
            return body(c, x, c.rows(int(n)), int(n), *more)

        register(name, 3 if name == "Quantile" else 2, window=True)(run)
        ROLLING[name.lower()] = run
        return body

    return put


ROLLING: dict[str, Callable] = {}


@rolling("Mean")
def _mean(c, x, w, n):
    return F.avg(x).over(w)


@rolling("Sum")
def _sum(c, x, w, n):
    return F.sum(x).over(w)


@rolling("Std")
def _std(c, x, w, n):
    return F.stddev_samp(x).over(w)


@rolling("Var")
def _var(c, x, w, n):
    return F.var_samp(x).over(w)


@rolling("Max")
def _max(c, x, w, n):
    return F.max(x).over(w)


@rolling("Min")
def _min(c, x, w, n):
    return F.min(x).over(w)


@rolling("Count")
def _count(c, x, w, n):
    return F.count(x).over(w).cast("double")


@rolling("Med")
def _med(c, x, w, n):
    return F.percentile(x, F.lit(0.5)).over(w)


@rolling("Quantile")
def _quantile(c, x, w, n, q):
    return F.percentile(x, F.lit(float(q))).over(w)


@rolling("Skew")
def _skew(c, x, w, n):
    if 0 < n < 3:
        raise ValueError("Skew: N must be 0 or at least 3")
    k = F.count(x).over(w)
    flat = F.min(x).over(w) == F.max(x).over(w)
    return F.when((k >= 3) & flat, 0.0).when(k >= 3, F.skewness(x).over(w) * F.try_divide(F.sqrt(k * (k - 1)), k - 2))


@rolling("Kurt")
def _kurt(c, x, w, n):
    if 0 < n < 4:
        raise ValueError("Kurt: N must be 0 or at least 4")
    k = F.count(x).over(w)
    flat = F.min(x).over(w) == F.max(x).over(w)
    return F.when((k >= 4) & flat, -3.0).when(k >= 4, F.try_divide(k - 1, (k - 2) * (k - 3)) * ((k + 1) * F.kurtosis(x).over(w) + 6))


def held(x: Column, w: WindowSpec) -> Column:
    """The window's values in order, missing ones as nulls."""
    return F.transform(F.collect_list(F.struct(x.alias("v"))).over(w), lambda e: e["v"])


def _extreme_place(c, x, w, best):
    values = held(x, w)
    gap = F.array_position(F.transform(values, lambda e: F.when(e.isNull(), 1).otherwise(0)), 1)
    return F.when(F.count(x).over(w) > 0, F.when(gap > 0, gap).otherwise(F.array_position(values, best(x).over(w)))).cast("double")


@rolling("IdxMax")
def _idx_max(c, x, w, n):
    return _extreme_place(c, x, w, F.max)


@rolling("IdxMin")
def _idx_min(c, x, w, n):
    return _extreme_place(c, x, w, F.min)


@rolling("Mad")
def _mad(c, x, w, n):
    mean = F.avg(x).over(w)
    return F.try_divide(F.aggregate(F.collect_list(x).over(w), F.lit(0.0), lambda s, e: s + F.abs(e - mean)), F.count(x).over(w))


@rolling("Rank")
def _rank(c, x, w, n):
    values = F.collect_list(x).over(w)
    below, same = F.size(F.filter(values, lambda e: e < x)), F.size(F.filter(values, lambda e: e == x))
    return F.when(x.isNotNull(), (below + (same + 1) / 2) / F.size(values))


@rolling("WMA")
def _wma(c, x, w, n):
    values = held(x, w)
    weighted = F.aggregate(F.transform(values, lambda e, i: F.coalesce(e * (i + 1), F.lit(0.0))), F.lit(0.0), lambda s, e: s + e)
    m = F.size(values)
    return F.try_divide(weighted / (m * (m + 1) / 2), F.count(x).over(w))


@register("EMA", 2, window=True)
def _ema(c, x, n):
    """N = 0: each bar's mean has the span of all bars so far; other N are taken apart by the compiler."""
    x = num(x)
    values = held(x, c.rows(0))
    a = 1 - F.lit(2.0) / (1 + F.size(values))
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
    return F.aggregate(values, zero, lambda s, e: F.struct((s["n"] * a + F.coalesce(e, F.lit(0.0))).alias("n"), (s["d"] * a + 1).alias("d")), lambda s: F.try_divide(s["n"], s["d"]))


@register("Ref", 2, window=True)
def _ref(c, x, n):
    x = num(x)
    if n == 0:
        return F.first(x).over(c.whole)
    return F.lag(x, int(n)).over(c.series) if n > 0 else F.lead(x, int(-n)).over(c.series)


@register("Delta", 2, window=True)
def _delta(c, x, n):
    return num(x) - _ref(c, x, n)


def _line(c: Context, x: Column, w: WindowSpec):
    t = F.col(c.index).cast("double")
    enough = F.count(x).over(w) >= 2
    return t, enough, F.regr_slope(x, t).over(w), F.regr_intercept(x, t).over(w)


@rolling("Slope")
def _slope(c, x, w, n):
    _, enough, slope, _ = _line(c, x, w)
    return F.when(enough, slope)


@rolling("Rsquare")
def _rsquare(c, x, w, n):
    t = F.col(c.index).cast("double")
    spread = F.stddev_samp(x).over(w)
    r2 = F.regr_r2(x, t).over(w)
    return F.when(F.count(x).over(w) >= 2, F.when(spread > FLAT, r2) if n else F.when(spread > 0, r2))


@rolling("Resi")
def _resi(c, x, w, n):
    t, enough, slope, intercept = _line(c, x, w)
    return F.when(enough, x - (slope * t + intercept))


def _pairs(c, a, b, n):
    a, b = num(a), num(b)
    w = c.rows(int(n))
    return a, b, F.when(b.isNotNull(), a), F.when(a.isNotNull(), b), w


@register("Corr", 3, window=True)
def _corr(c, a, b, n):
    a, b, x, y, w = _pairs(c, a, b, n)
    varied = (F.stddev_samp(a).over(w) > FLAT) & (F.stddev_samp(b).over(w) > FLAT)
    return F.when(varied, F.try_divide(F.covar_samp(x, y).over(w), F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w)))


@register("Cov", 3, window=True)
def _cov(c, a, b, n):
    _, _, x, y, w = _pairs(c, a, b, n)
    return F.when(F.count(x).over(w) >= 2, F.covar_samp(x, y).over(w))


@register("Rolling", (3, 4), window=True)
def _rolling(c, x, n, name, *more):
    named = {"median": "med", "quantile": "quantile"}.get(str(name).lower(), str(name).lower())
    if named not in ROLLING:
        raise ValueError(f"Rolling: no function {name}")
    return ROLLING[named](c, x, n, *more)


# --- within a day, filling, and rows that are left out ---------------------------------------------------------


@register("DayLast", 1, window=True)
def _day_last(c, x):
    return F.last(num(x), ignorenulls=True).over(c.day.orderBy(c.time).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


@register("DayCumsum", (1, 3), window=True)
def _day_cumsum(c, x, start=0, end=2**31 - 1):
    """Running sum over the day's bars start .. end (0 based), 0 outside."""
    bars = c.day.orderBy(c.time)
    at = F.row_number().over(bars) - 1
    past = bars.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.coalesce(num(x), F.lit(0.0))).over(past)
    if start > 0:  # what the bars before start add up to
        values = F.collect_list(F.coalesce(num(x), F.lit(0.0))).over(bars.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        total = total - F.aggregate(F.slice(values, 1, int(start)), F.lit(0.0), lambda s, e: s + e)
    return F.when((at >= int(start)) & (at <= int(end)), total).otherwise(0.0)


@register("FFillNan", 1, window=True)
def _ffill(c, x):
    return F.last(x, ignorenulls=True).over(c.rows(0))


@register("BFillNan", 1, window=True)
def _bfill(c, x):
    return F.first(x, ignorenulls=True).over(c.series.rowsBetween(0, Window.unboundedFollowing))


@register("Select", 2)
def _select(c, cond, x):
    """x where cond holds, else missing; windows over it see only the bars where cond holds (the compiler gives them a panel of their own)."""
    return F.when(F.coalesce(num(cond) != 0, F.lit(False)), x)


@register("Cut", 3, window=True)
def _cut(c, x, left, right):
    """Without the first left and the last -right rows of the series."""
    if not (left is None or left > 0) or not (right is None or right < 0):
        raise ValueError("Cut: left must be positive and right negative, or None")
    kept = F.lit(True)
    if left:
        kept = kept & (F.row_number().over(c.series) > int(left))
    if right:
        kept = kept & (F.row_number().over(Window.partitionBy(c.instrument).orderBy(F.col(c.time).desc())) > int(-right))
    return F.when(kept, x)
