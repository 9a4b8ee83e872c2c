"""Backtests: declarative preparation and reports around a compact fold over dates.

The fold is sequential by nature. It runs once for each strategy in ``applyInPandas``, so many parameter sets run side by
side, over the candidates only: instruments that were near the top on some date. Any instrument that
a strategy can hold has been among them.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import asdict, dataclass
from itertools import islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TopkDropout:
    """Holds k names and replaces up to n_drop of the worst each bar; buys share the free cash evenly."""

    name: str
    k: int = 10
    n_drop: int = 2
    cash: float = 1e6
    risk_degree: float = 0.95
    open_cost: float = 0.0015
    close_cost: float = 0.0025
    min_cost: float = 5.0
    unit: float = 0.0  # lots of so many shares; 0: any amount


METRICS = "strategy string, datetime date, account double, ret double, turnover double, cost double, value double, cash double, n_held int"


def candidates(scores: DataFrame, bars: DataFrame, strategies: list[TopkDropout]) -> DataFrame:
    """strategy, its parameters, and date, instrument, score (of the bar before), close of the names it may come to hold."""
    spark = scores.sparkSession
    settings = spark.createDataFrame([tuple(v if k in ("name", "k", "n_drop") else float(v) for k, v in asdict(s).items()) for s in strategies], "strategy string, k int, n_drop int, cash double, risk_degree double, open_cost double, close_cost double, min_cost double, unit double")
    date = Window.partitionBy("datetime").orderBy(F.col("score").desc_nulls_last(), "instrument")
    placed = scores.filter("score is not null").withColumn("place", F.row_number().over(date))
    best = placed.groupBy("instrument").agg(F.min("place").alias("best"))
    prior = F.lag("score").over(Window.partitionBy("instrument").orderBy("datetime"))
    quoted = bars.select("instrument", "datetime", "close").join(scores, ["instrument", "datetime"], "left").withColumn("signal", prior).join(best, "instrument")
    return quoted.join(F.broadcast(settings), F.col("best") <= 2 * F.col("k") + F.col("n_drop")).drop("score")


def replaced(order: list[str], held: dict[str, float], signals: int, k: int, n_drop: int) -> tuple[list[str], list[str]]:
    """Which held names go, best first, and the rivals for their places and the free ones, best first.

    order: all names best first, of which the first ``signals`` can be bought. Rivals are as many of the best names that aren't held as could get in. A held name goes if fewer than n_drop of the held names and
    the rivals stand behind it: counted by places, no list of both is made.
    """
    free = max(0, k - len(held))
    rivals = list(islice((p for p, name in enumerate(order[:signals]) if name not in held), n_drop + free if len(held) <= k else max(0, n_drop + k - len(held))))
    mine = [p for p, name in enumerate(order) if name in held]
    behind = {p: len(mine) - 1 - i + len(rivals) - bisect_left(rivals, p) for i, p in enumerate(mine)}
    return [order[p] for p in mine if behind[p] < n_drop], [order[p] for p in rivals]


def fold(key, rows):
    """One strategy's metrics, bar by bar. Without a price a name can't be traded and keeps its last value."""
    import pandas as pd

    s = rows.iloc[0]
    cash, held, last, before, out = float(s.cash), {}, {}, float(s.cash), []
    for day, bar in rows.sort_values(["datetime", "instrument"]).groupby("datetime", sort=True):
        price = {i: p for i, p in zip(bar.instrument, bar.close, strict=True) if p == p and p and p > 0}
        signal = {i: x for i, x in zip(bar.instrument, bar.signal, strict=True) if x == x and x is not None}
        ranked = sorted(signal, key=lambda i: (-signal[i], i))
        traded = cost = 0.0
        wanted = len(held)
        if ranked:
            order = [*ranked, *sorted(i for i in held if i not in signal)]  # names without a signal come last
            sell, rivals = replaced(order, held, len(ranked), int(s.k), int(s.n_drop))
            for i in sell:
                if i in price:
                    worth = held.pop(i) * price[i]
                    fee = max(worth * s.close_cost, s.min_cost) if worth else 0.0
                    cash += worth - fee
                    traded, cost = traded + worth, cost + fee
            buy = [i for i in rivals[: max(0, int(s.k) - wanted + len(sell))] if i in price]
            budget = cash * s.risk_degree / len(buy) if buy else 0.0
            for i in buy:
                amount = budget / (price[i] * (1 + s.open_cost))
                if s.unit:
                    amount = math.floor(amount / s.unit + 0.1) * s.unit
                worth = amount * price[i]
                fee = max(worth * s.open_cost, s.min_cost) if worth else 0.0
                if worth and worth + fee <= cash:
                    held[i] = held.get(i, 0.0) + amount
                    cash -= worth + fee
                    traded, cost = traded + worth, cost + fee
        last.update(price)
        value = sum(a * last[i] for i, a in held.items())
        account = cash + value
        out.append((key[0], day, account, (account + cost) / before - 1, traded / before, cost / before, value, cash, len(held)))
        before = account
    return pd.DataFrame(out, columns=[c.split()[0] for c in METRICS.split(", ")])


def backtest(scores: DataFrame, bars: DataFrame, strategies: list[TopkDropout]) -> DataFrame:
    """Metrics of each strategy and bar: account, ret (before cost), turnover, cost, value, cash, n_held."""
    return candidates(scores, bars, strategies).groupBy("strategy").applyInPandas(fold, METRICS)


def order_indicators(orders: DataFrame) -> DataFrame:
    """(amount, deal_amount, trade_price, base_price, direction) -> ffr, pa, pos of each order."""
    pa = F.when(F.col("direction") > 0, -1.0).otherwise(1.0) * (F.try_divide(F.col("trade_price"), F.col("base_price")) - 1)
    return orders.select("*", F.try_divide(F.col("deal_amount"), F.col("amount")).alias("ffr"), pa.alias("pa"), (pa > 0).cast("double").alias("pos"))
