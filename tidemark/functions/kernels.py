"""Windows of a few rows over many series at once, as arrays.

Rows come sorted by series; missing values are NaN inside. Each series is set apart by missing rows, so that one
strided view gives the window of every row. What several functions need of the same values and width (counts, means,
deviations, sorted values) is worked out once for each block of rows.

A window of over SORTED rows isn't sorted anew for each row: quantiles and ranks of such go through a sorted buffer that rows enter and leave.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np

from tidemark.functions.library import FLAT

#: Elements of the windows that are in memory at once.
BLOCK = 1 << 21
#: Rows of a window from which values stay sorted from row to row.
SORTED = 256


class Rows:
    """Series one after the other: ``starts`` marks the first row of each."""

    def __init__(self, starts: np.ndarray):
        n = len(starts)
        first = np.flatnonzero(starts)
        self.size, self.number = n, np.cumsum(starts) - 1
        self.place = np.arange(n) - first[self.number] if n else np.zeros(0, np.int64)

    def shifted(self, x: np.ndarray, n: int) -> np.ndarray:
        """The value n rows before (n < 0: after) in the same series."""
        out = np.full(self.size, np.nan)
        if abs(n) >= self.size:
            return out
        if n >= 0:
            same = self.number[n:] == self.number[: self.size - n]
            out[n:][same] = x[: self.size - n][same]
        else:
            same = self.number[:n] == self.number[-n:]
            out[:n][same] = x[-n:][same]
        return out

    def padded(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """x with n - 1 missing rows before each series, and where each row's window starts in it."""
        at = np.arange(self.size) + self.number * (n - 1)
        out = np.full((int(at[-1]) + n) if self.size else 0, np.nan)
        out[at + n - 1] = x
        return out, at


class Block:
    """The windows of some rows over one or two columns, and what functions share of them."""

    def __init__(self, w: np.ndarray, place: np.ndarray, other: np.ndarray | None = None):
        self.width = w.shape[1]
        self.w, self.rows = w, np.minimum(place + 1, self.width)  # rows of the series in each window
        self.other, self.made = other, {}

    def get(self, name: str):
        if name not in self.made:
            self.made[name] = getattr(self, f"_{name}")()
        return self.made[name]

    def _known(self):
        return ~np.isnan(self.w)

    def _count(self):
        return self.get("known").sum(axis=1)

    def _filled(self):
        return np.where(self.get("known"), self.w, 0.0)

    def _sum(self):
        return self.get("filled").sum(axis=1)

    def _mean(self):
        return ratio(self.get("sum"), self.get("count"))

    def _off(self):
        """Deviations from the mean, 0 where missing."""
        with np.errstate(invalid="ignore"):
            return np.where(self.get("known"), self.w - self.get("mean")[:, None], 0.0)

    def _squares(self):
        off = self.get("off")
        return np.einsum("ij,ij->i", off, off)

    def _var(self):
        return ratio(self.get("squares"), self.get("count") - 1)

    def _std(self):
        return np.sqrt(self.get("var"))

    def _top(self):
        return np.where(self.get("count") > 0, np.where(self.get("known"), self.w, -np.inf).max(axis=1), np.nan)

    def _bottom(self):
        return np.where(self.get("count") > 0, np.where(self.get("known"), self.w, np.inf).min(axis=1), np.nan)

    def _sorted(self):
        return np.sort(self.w, axis=1)  # missing values last

    def _line(self):
        """Slope over the row's place, means of place and value, and both sums of squares."""
        place = np.arange(self.width, dtype=float)
        middle = ratio(self.get("known") @ place, self.get("count"))
        away = np.where(self.get("known"), place[None, :] - middle[:, None], 0.0)
        across, along = np.einsum("ij,ij->i", away, self.get("off")), np.einsum("ij,ij->i", away, away)
        return ratio(across, along), middle, across, along

    def pairs(self) -> tuple[Block, Block]:
        """Both columns, each missing where the other is."""
        if "pairs" not in self.made:
            missing = np.isnan(self.w) | np.isnan(self.other)
            self.made["pairs"] = tuple(Block(np.where(missing, np.nan, x), self.rows - 1) for x in (self.w, self.other))
        return self.made["pairs"]

    def covariance(self) -> np.ndarray:
        a, b = self.pairs()
        return ratio(np.einsum("ij,ij->i", a.get("off"), b.get("off")), a.get("count") - 1)


def ratio(a, b) -> np.ndarray:
    """a / b, missing where b is 0 or less."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b > 0, a / b, np.nan)


KERNELS: dict[str, Callable] = {}


def kernel(name: str):
    def put(f):
        KERNELS[name] = f
        return f

    return put


for _name, _of in (("Mean", "mean"), ("Std", "std"), ("Var", "var"), ("Max", "top"), ("Min", "bottom")):
    kernel(_name)(lambda b, _of=_of: b.get(_of))


@kernel("Sum")
def _sum(b):
    return np.where(b.get("count") > 0, b.get("sum"), np.nan)


@kernel("Count")
def _count(b):
    return b.get("count").astype(float)


@kernel("Quantile")
def _quantile(b, q):
    values, last = b.get("sorted"), b.get("count") - 1
    at = np.maximum(last, 0) * q
    low = np.floor(at).astype(np.int64)
    rows = np.arange(len(values))
    below, above = values[rows, low], values[rows, np.minimum(low + 1, np.maximum(last, 0))]
    with np.errstate(invalid="ignore"):
        return np.where(last >= 0, np.where(at == low, below, (low + 1 - at) * below + (at - low) * above), np.nan)


@kernel("Med")
def _med(b):
    return _quantile(b, 0.5)


@kernel("Skew")
def _skew(b):
    k, off = b.get("count").astype(float), b.get("off")
    flat = b.get("top") == b.get("bottom")
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.einsum("ij,ij,ij->i", off, off, off) / k / (b.get("squares") / k) ** 1.5 * np.sqrt(k * (k - 1)) / (k - 2)
    return np.where(k >= 3, np.where(flat, 0.0, value), np.nan)


@kernel("Kurt")
def _kurt(b):
    k, off = b.get("count").astype(float), b.get("off")
    flat, two = b.get("top") == b.get("bottom"), off * off
    with np.errstate(divide="ignore", invalid="ignore"):
        excess = np.einsum("ij,ij->i", two, two) / k / (b.get("squares") / k) ** 2 - 3
        value = (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * excess + 6)
    return np.where(k >= 4, np.where(flat, -3.0, value), np.nan)


def _place(b, best):
    """1-based place in the window's rows: of the first missing one, else of the first best value."""
    skip = b.width - b.rows
    inside = np.arange(b.width)[None, :] >= skip[:, None]
    gap = inside & ~b.get("known")
    at = np.where(gap.any(axis=1), gap.argmax(axis=1), best)
    return np.where(b.get("count") > 0, at - skip + 1.0, np.nan)


@kernel("IdxMax")
def _idx_max(b):
    return _place(b, np.where(b.get("known"), b.w, -np.inf).argmax(axis=1))


@kernel("IdxMin")
def _idx_min(b):
    return _place(b, np.where(b.get("known"), b.w, np.inf).argmin(axis=1))


@kernel("Mad")
def _mad(b):
    return ratio(np.abs(b.get("off")).sum(axis=1), b.get("count"))


@kernel("Rank")
def _rank(b):
    now = b.w[:, -1:]
    return np.where(np.isnan(now[:, 0]), np.nan, ratio((b.w < now).sum(axis=1) + ((b.w == now).sum(axis=1) + 1) / 2, b.get("count")))


@kernel("WMA")
def _wma(b):
    m = b.rows.astype(float)
    weighted = b.get("filled") @ np.arange(1, b.width + 1, dtype=float) - (b.width - m) * b.get("sum")
    return ratio(weighted / (m * (m + 1) / 2), b.get("count"))


@kernel("Slope")
def _slope(b):
    return np.where(b.get("count") >= 2, b.get("line")[0], np.nan)


@kernel("Resi")
def _resi(b):
    slope, middle, *_ = b.get("line")
    return np.where(b.get("count") >= 2, b.w[:, -1] - (b.get("mean") + slope * (b.width - 1 - middle)), np.nan)


@kernel("Rsquare")
def _rsquare(b):
    _, _, across, along = b.get("line")
    with np.errstate(invalid="ignore"):
        return np.where(b.get("std") > FLAT, ratio(across * across, along * b.get("squares")), np.nan)


@kernel("Cov")
def _cov(b):
    return np.where(b.pairs()[0].get("count") >= 2, b.covariance(), np.nan)


@kernel("Corr")
def _corr(b):
    x, y = b.pairs()
    with np.errstate(invalid="ignore"):
        varied = (b.get("std") > FLAT) & (Block(b.other, b.rows - 1).get("std") > FLAT)
        return np.where(varied, ratio(b.covariance(), x.get("std") * y.get("std")), np.nan)


def _buffered(rows: Rows, x: np.ndarray, n: int, name: str, q: float) -> np.ndarray:
    """Quantile or Rank over long windows: a sorted buffer that each row enters and the row that falls out leaves."""
    out, buffer, number, values = np.full(rows.size, np.nan), [], -1, x.tolist()
    for k, (s, p) in enumerate(zip(rows.number.tolist(), rows.place.tolist(), strict=True)):
        if s != number:
            buffer, number = [], s
        now = values[k]
        if p >= n and not math.isnan(gone := values[k - n]):
            del buffer[bisect_left(buffer, gone)]
        if not math.isnan(now):
            insort(buffer, now)
        if not buffer:
            continue
        if name == "Rank":
            if not math.isnan(now):
                below = bisect_left(buffer, now)
                out[k] = (below + (bisect_right(buffer, now) - below + 1) / 2) / len(buffer)
        else:
            at = q * (len(buffer) - 1)
            low = int(at)
            out[k] = buffer[low] if at == low else (low + 1 - at) * buffer[low] + (at - low) * buffer[low + 1]
    return out


def evaluate(rows: Rows, columns: dict[str, np.ndarray], calls: list[tuple[str, tuple[str, ...], int, tuple]]) -> list[np.ndarray]:
    """The values of calls (operator, argument columns, rows of the window, further parameters)."""
    out: list[np.ndarray | None] = [None] * len(calls)
    shared: dict[tuple, list[int]] = {}
    for k, (name, args, n, more) in enumerate(calls):
        if name in ("Ref", "Delta"):
            before = rows.shifted(columns[args[0]], n)
            out[k] = before if name == "Ref" else columns[args[0]] - before
        elif n >= SORTED and name in ("Med", "Quantile", "Rank"):
            out[k] = _buffered(rows, columns[args[0]], n, name, more[0] if more else 0.5)
        else:
            out[k] = np.empty(rows.size)
            shared.setdefault((args, n), []).append(k)
    for (args, n), some in shared.items():
        padded = [rows.padded(columns[a], n) for a in args]
        views = [np.lib.stride_tricks.sliding_window_view(p, n) for p, _ in padded if len(p)]
        step = max(1, BLOCK // n)
        for a in range(0, rows.size, step):
            own = slice(a, a + step)
            w = [v[padded[0][1][own]] for v in views]
            block = Block(w[0], rows.place[own], *w[1:])
            for k in some:
                out[k][own] = KERNELS[calls[k][0]](block, *calls[k][3])
    return out
