"""Portfolio analytics on return series (series, datetime, ret), and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bars of a year by frequency.
YEAR = {"minute": 240 * 238, "day": 238, "week": 50, "month": 12}


def risk(returns: DataFrame, freq: str = "day", every: int = 1) -> DataFrame:
    """series, mean, std, annualized_return, information_ratio, max_drawdown, of summed returns."""
    n = YEAR[freq] / every
    w = Window.partitionBy("series").orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.withColumn("level", F.sum("ret").over(w))
    rows = rows.withColumn("fall", F.col("level") - F.max("level").over(w))
    return rows.groupBy("series").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), (F.avg("ret") * n).alias("annualized_return"), (F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * n**0.5).alias("information_ratio"), F.min("fall").alias("max_drawdown"))


def compound_risk(returns: DataFrame, freq: str = "day", every: int = 1) -> DataFrame:
    """The same for compounded returns: geometric mean, deviation of log returns, drawdown of the level."""
    n = YEAR[freq] / every
    w = Window.partitionBy("series").orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.withColumn("level", F.exp(F.sum(F.log1p("ret")).over(w)))
    rows = rows.withColumn("fall", F.col("level") / F.greatest(F.max("level").over(w), F.lit(0.0)) - 1)
    mean = F.exp(F.avg(F.log1p("ret"))) - 1
    std = F.stddev_samp(F.log1p("ret"))
    return rows.groupBy("series").agg(mean.alias("mean"), std.alias("std"), (F.pow(1 + mean, n) - 1).alias("annualized_return"), (F.try_divide(F.avg(F.log1p("ret")), std) * n**0.5).alias("information_ratio"), F.min("fall").alias("max_drawdown"))


def monthly_risk(returns: DataFrame) -> DataFrame:
    """risk of each month of each series."""
    keyed = returns.withColumn("month", F.date_format("datetime", "yyyyMM"))
    return risk(keyed.select(F.struct("series", "month").alias("series"), "datetime", "ret")).select("series.series", "series.month", "mean", "std", "annualized_return", "information_ratio", "max_drawdown")


def report(returns: DataFrame) -> DataFrame:
    """Running sums of (series, datetime, ret, bench, cost) and drawdowns, with and without cost."""
    w = Window.partitionBy("series").orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    net, over, over_net = F.col("ret") - F.col("cost"), F.col("ret") - F.col("bench"), F.col("ret") - F.col("bench") - F.col("cost")
    names = {"cum_bench": F.col("bench"), "cum_return": F.col("ret"), "cum_return_net": net, "cum_excess": over, "cum_excess_net": over_net}
    rows = returns.select("series", "datetime", *(F.sum(v).over(w).alias(k) for k, v in names.items()))
    return rows.select("*", *((F.col(k) - F.max(k).over(w)).alias(k.replace("cum", "drawdown")) for k in ("cum_return", "cum_return_net", "cum_excess", "cum_excess_net")))


def beta(returns: DataFrame) -> DataFrame:
    """series, beta, alpha, volatility, sharpe of (series, datetime, ret, bench)."""
    b = F.try_divide(F.covar_samp("ret", "bench"), F.var_samp("bench"))
    return returns.groupBy("series").agg(b.alias("beta"), ((F.avg("ret") - b * F.avg("bench")) * YEAR["day"]).alias("alpha"), (F.stddev_samp("ret") * YEAR["day"] ** 0.5).alias("volatility"), (F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * YEAR["day"] ** 0.5).alias("sharpe"))


def indicator_means(orders: DataFrame, weight: str = "count") -> DataFrame:
    """ffr and pa over orders (ffr, pa, pos, count, amount, value) weighted by a column; pos always by count."""
    w = F.col(weight)
    return orders.agg(*(F.try_divide(F.sum(F.col(c) * w), F.sum(F.when(F.col(c).isNotNull(), w))).alias(c) for c in ("ffr", "pa")), F.try_divide(F.sum(F.col("pos") * F.col("count")), F.sum("count")).alias("pos"))


def brinson(rows: DataFrame) -> DataFrame:
    """Attribution of (datetime, group, pw, pr, bw, br): weights and returns of portfolio and benchmark groups.

    RAA = sum (pw - bw) br, RSS = sum bw (pr - br), RIN = sum (pw - bw)(pr - br); a group return that is missing takes the benchmark's.
    """
    pr = F.coalesce("pr", "br")
    d = F.col("pw") - F.col("bw")
    return rows.groupBy("datetime").agg(F.sum(d * F.col("br")).alias("raa"), F.sum(F.col("bw") * (pr - F.col("br"))).alias("rss"), F.sum(d * (pr - F.col("br"))).alias("rin"), F.sum(F.col("pw") * pr - F.col("bw") * F.col("br")).alias("rtotal"))


def benchmark(bars: DataFrame) -> DataFrame:
    """datetime, bench: mean over instruments of close / the close before - 1; missing is 0."""
    r = F.try_divide(F.col("close"), F.lag("close").over(Window.partitionBy("instrument").orderBy("datetime"))) - 1
    return bars.select("datetime", r.alias("r")).groupBy("datetime").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("bench"))


def long_short_backtest(scores: DataFrame, bars: DataFrame, k: int) -> DataFrame:
    """datetime, long, short, long_short: next bar's mean return of the best and worst k over that of all."""
    w = Window.partitionBy("instrument").orderBy("datetime")
    nxt = bars.select("instrument", "datetime", (F.try_divide(F.lead("close").over(w), F.col("close")) - 1).alias("nxt"))
    date = Window.partitionBy("datetime")
    rows = scores.filter("score is not null").select("*", F.row_number().over(date.orderBy(F.col("score").desc(), "instrument")).alias("t"), F.row_number().over(date.orderBy("score", "instrument")).alias("b")).join(nxt, ["instrument", "datetime"])
    long, short, every = F.avg(F.when(F.col("t") <= k, F.col("nxt"))), F.avg(F.when(F.col("b") <= k, F.col("nxt"))), F.avg("nxt")
    return rows.groupBy("datetime").agg((long - every).alias("long"), (every - short).alias("short"), (long - short).alias("long_short"))
