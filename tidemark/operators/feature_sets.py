"""Ready-made feature sets, built from families of expressions."""

from __future__ import annotations

WINDOWS = (5, 10, 20, 30, 60)
LABEL = {"LABEL0": "Ref($close, -2) / Ref($close, -1) - 1"}
VWAP_LABEL = {"LABEL0": "Ref($vwap, -2) / Ref($vwap, -1) - 1"}
TINY = "1e-12"


def lags(fields: tuple[str, ...] = ("close", "open", "high", "low", "vwap"), steps: int = 60) -> dict[str, str]:
    """Prices of the last bars over the newest close, volumes over the newest volume: 360 columns by default."""
    out = {}
    for f in fields:
        for k in range(steps - 1, -1, -1):
            out[f"{f.upper()}{k}"] = f"Ref(${f}, {k}) / $close" if k else f"${f} / $close"
    for k in range(steps - 1, -1, -1):
        out[f"VOLUME{k}"] = f"Ref($volume, {k}) / ($volume + {TINY})" if k else f"$volume / ($volume + {TINY})"
    return out


def candle() -> dict[str, str]:
    """Shape of a bar: body, range and shadows. Fixed values, as in ``families``."""
    span = f"($high - $low + {TINY})"
    top, bottom = "Greater($open, $close)", "Less($open, $close)"
    return {
        "KMID": "($close - $open) / $open", "KLEN": "($high - $low) / $open", "KMID2": f"($close - $open) / {span}",
        "KUP": f"($high - {top}) / $open", "KUP2": f"($high - {top}) / {span}", "KLOW": f"({bottom} - $low) / $open",
        "KLOW2": f"({bottom} - $low) / {span}", "KSFT": "(2 * $close - $high - $low) / $open", "KSFT2": f"(2 * $close - $high - $low) / {span}",
    }


def _moves(x: str) -> tuple[str, str, str]:
    step = f"{x} - Ref({x}, 1)"
    return f"Greater({step}, 0)", f"Greater(Ref({x}, 1) - {x}, 0)", f"Abs({step})"


def families() -> dict[str, callable]:
    """Name -> expression for a window of d bars. Names and formulas of a published feature set, which users' models expect as they are."""
    up, down, size = _moves("$close")
    v_up, v_down, v_size = _moves("$volume")
    swing = "Abs($close / Ref($close, 1) - 1) * $volume"
    gain, loss = "$close > Ref($close, 1)", "$close < Ref($close, 1)"
    return {
        "ROC": lambda d: f"Ref($close, {d}) / $close",
        "MA": lambda d: f"Mean($close, {d}) / $close",
        "STD": lambda d: f"Std($close, {d}) / $close",
        "BETA": lambda d: f"Slope($close, {d}) / $close",
        "RSQR": lambda d: f"Rsquare($close, {d})",
        "RESI": lambda d: f"Resi($close, {d}) / $close",
        "MAX": lambda d: f"Max($high, {d}) / $close",
        "MIN": lambda d: f"Min($low, {d}) / $close",
        "QTLU": lambda d: f"Quantile($close, {d}, 0.8) / $close",
        "QTLD": lambda d: f"Quantile($close, {d}, 0.2) / $close",
        "RANK": lambda d: f"Rank($close, {d})",
        "RSV": lambda d: f"($close - Min($low, {d})) / (Max($high, {d}) - Min($low, {d}) + {TINY})",
        "IMAX": lambda d: f"IdxMax($high, {d}) / {d}",
        "IMIN": lambda d: f"IdxMin($low, {d}) / {d}",
        "IMXD": lambda d: f"(IdxMax($high, {d}) - IdxMin($low, {d})) / {d}",
        "CORR": lambda d: f"Corr($close, Log($volume + 1), {d})",
        "CORD": lambda d: f"Corr($close / Ref($close, 1), Log($volume / Ref($volume, 1) + 1), {d})",
        "CNTP": lambda d: f"Mean({gain}, {d})",
        "CNTN": lambda d: f"Mean({loss}, {d})",
        "CNTD": lambda d: f"Mean({gain}, {d}) - Mean({loss}, {d})",
        "SUMP": lambda d: f"Sum({up}, {d}) / (Sum({size}, {d}) + {TINY})",
        "SUMN": lambda d: f"Sum({down}, {d}) / (Sum({size}, {d}) + {TINY})",
        "SUMD": lambda d: f"(Sum({up}, {d}) - Sum({down}, {d})) / (Sum({size}, {d}) + {TINY})",
        "VMA": lambda d: f"Mean($volume, {d}) / ($volume + {TINY})",
        "VSTD": lambda d: f"Std($volume, {d}) / ($volume + {TINY})",
        "WVMA": lambda d: f"Std({swing}, {d}) / (Mean({swing}, {d}) + {TINY})",
        "VSUMP": lambda d: f"Sum({v_up}, {d}) / (Sum({v_size}, {d}) + {TINY})",
        "VSUMN": lambda d: f"Sum({v_down}, {d}) / (Sum({v_size}, {d}) + {TINY})",
        "VSUMD": lambda d: f"(Sum({v_up}, {d}) - Sum({v_down}, {d})) / (Sum({v_size}, {d}) + {TINY})",
    }


def technical(windows: tuple[int, ...] = WINDOWS, include: tuple[str, ...] | None = None) -> dict[str, str]:
    """Candle shapes, four prices and the rolling families: 158 columns by default."""
    out = candle() | {f"{f.upper()}0": f"${f} / $close" for f in ("open", "high", "low", "vwap")}
    for name, make in families().items():
        if include is None or name in include:
            out |= {f"{name}{d}": make(d) for d in windows}
    return out
