"""Covariance estimators and portfolio weights over the returns of a group of instruments.

A group (``key``) is one as-of date's or one sector's instruments: its dense matrix is what the estimators need, so it
runs in one task, and many groups run side by side. Plain covariances of any number of instruments need
no matrix: ``pair_covariance`` is a join and an aggregate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_covariance(returns: DataFrame) -> DataFrame:
    """(a, b, cov) for a <= b over the dates that both have, of returns (instrument, datetime, ret)."""
    r = returns.filter("ret is not null")
    a, b = (r.select(F.col("instrument").alias(n), "datetime", F.col("ret").alias(f"r{n}")) for n in "ab")
    return a.join(b, "datetime").filter("a <= b").groupBy("a", "b").agg(F.covar_samp("ra", "rb").alias("cov"))


def _sample(x: np.ndarray, centred: bool) -> np.ndarray:
    return x.T @ x / len(x) if centred else np.cov(x, rowvar=False, bias=True)


def shrink(x: np.ndarray, target: str = "const_var") -> np.ndarray:
    """Ledoit-Wolf shrinkage of centred returns (days, names) to a constant variance, a constant correlation or one factor."""
    t, n = x.shape
    s = x.T @ x / t
    var = np.diag(s)
    if target == "const_var":
        f = np.eye(n) * var.mean()
    elif target == "const_corr":
        std = np.sqrt(var)
        corr = s / np.outer(std, std)
        mean = (corr.sum() - n) / (n * (n - 1)) if n > 1 else 0.0
        f = mean * np.outer(std, std)
        np.fill_diagonal(f, var)
    elif target == "single_factor":
        market = x.mean(axis=1)
        cov = x.T @ market / t
        f = np.outer(cov, cov) / (market @ market / t)
        np.fill_diagonal(f, var)
    else:
        raise ValueError(f"no target {target}")
    spread = ((x**2).T @ (x**2)) / t - s**2
    if target == "const_corr":
        # co-variation of the target's entries with the sample's
        theta = ((x**3).T @ x) / t - var[:, None] * s
        np.fill_diagonal(theta, 0)
        rho = np.diag(spread).sum() + mean * ((np.outer(1 / std, std)) * theta).sum()
    elif target == "single_factor":
        rho = np.diag(spread).sum()
    else:
        rho = 0.0
    gap = ((s - f) ** 2).sum()
    weight = min(1.0, max(0.0, (spread.sum() - rho) / gap / t)) if gap > 0 else 1.0
    return weight * f + (1 - weight) * s


def factors(x: np.ndarray, k: int) -> np.ndarray:
    """k principal components and a diagonal rest."""
    s = x.T @ x / len(x)
    values, vectors = np.linalg.eigh(s)
    top = vectors[:, -k:]
    low = (top * values[-k:]) @ top.T
    return low + np.diag(np.diag(s - low))


def thresholded(x: np.ndarray, k: int, strength: float = 1.0) -> np.ndarray:
    """k principal components and a rest whose small entries are shrunk to zero."""
    t, n = x.shape
    s = x.T @ x / t
    values, vectors = np.linalg.eigh(s)
    top = vectors[:, n - k :]
    low = (top * values[n - k :]) @ top.T
    rest = s - low
    scale = np.sqrt(np.maximum(np.outer(np.diag(rest), np.diag(rest)), 0))
    limit = strength * scale * (1 / np.sqrt(n) + np.sqrt(np.log(n) / t))
    small = np.sign(rest) * np.maximum(np.abs(rest) - limit, 0)
    np.fill_diagonal(small, np.diag(rest))
    return low + small


def minimum_variance(cov: np.ndarray) -> np.ndarray:
    w = np.linalg.solve(cov, np.ones(len(cov)))
    return w / w.sum()


def inverse_volatility(cov: np.ndarray) -> np.ndarray:
    w = 1 / np.sqrt(np.diag(cov))
    return w / w.sum()


def risk_parity(cov: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Equal contributions to the variance, by cyclic coordinate steps."""
    n = len(cov)
    w = inverse_volatility(cov)
    for _ in range(rounds):
        before = w.copy()
        for i in range(n):
            other = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (-other + np.sqrt(other**2 + 4 * cov[i, i] / n)) / (2 * cov[i, i])
        if np.abs(w - before).max() < 1e-12:
            break
    return w / w.sum()


ESTIMATORS = {"sample": lambda x: _sample(x, True), "const_var": lambda x: shrink(x, "const_var"), "const_corr": lambda x: shrink(x, "const_corr"), "single_factor": lambda x: shrink(x, "single_factor"), "pca": lambda x: factors(x, min(3, x.shape[1])), "poet": lambda x: thresholded(x, min(1, x.shape[1]))}
WEIGHTS = {"gmv": minimum_variance, "inv": inverse_volatility, "rp": risk_parity}


def _matrix(rows: pd.DataFrame) -> tuple[np.ndarray, list[str]]:
    wide = rows.pivot_table(index="datetime", columns="instrument", values="ret").sort_index(axis=1)
    x = wide.to_numpy()
    x = x - np.nanmean(x, axis=0)
    return np.where(np.isnan(x), 0.0, x), list(wide.columns)


def covariances(returns: DataFrame, estimator: str = "const_var") -> DataFrame:
    """(key, a, b, cov) of returns (key, instrument, datetime, ret); missing returns count as the mean."""
    make = ESTIMATORS[estimator]

    def run(key, rows):
        x, names = _matrix(rows)
        cov = make(x)
        i, j = np.triu_indices(len(names))
        return pd.DataFrame({"key": key[0], "a": [names[k] for k in i], "b": [names[k] for k in j], "cov": cov[i, j]})

    return returns.select("key", "instrument", "datetime", "ret").groupBy("key").applyInPandas(run, "key string, a string, b string, cov double")


def weights(returns: DataFrame, method: str = "gmv", estimator: str = "const_var") -> DataFrame:
    """(key, instrument, weight) by minimum variance, inverse volatility or risk parity."""
    make, solve = ESTIMATORS[estimator], WEIGHTS[method]

    def run(key, rows):
        x, names = _matrix(rows)
        return pd.DataFrame({"key": key[0], "instrument": names, "weight": solve(make(x))})

    return returns.select("key", "instrument", "datetime", "ret").groupBy("key").applyInPandas(run, "key string, instrument string, weight double")
