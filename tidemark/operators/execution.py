"""Order preparation and execution rules that are column expressions: costs, limits, lots, slicing, indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cost(value: Column, total: Column, rate: float, minimum: float = 5.0, impact: float = 0.0) -> Column:
    """rate plus impact times the squared share of the bar's value, at least minimum; nothing for no trade."""
    share = F.coalesce(F.try_divide(value, total), F.lit(1.0))
    return F.when(value > 0, F.greatest(value * (rate + impact * share * share), F.lit(minimum))).otherwise(0.0)


def round_lots(amount: Column, unit: float, factor: Column | None = None) -> Column:
    """Down to whole lots, a tenth of a share of tolerance; factor turns adjusted into traded shares."""
    f = F.lit(1.0) if factor is None else factor
    return F.floor((amount * f + 0.1) / unit) * unit / f


def volume_limited(orders: DataFrame, share: float, by: str = "current", place: str = "order_id", limit: str | None = None, others: tuple[str, ...] = ()) -> DataFrame:
    """Adds deal_amount: at most a share of the bar's volume (current), or of the volume so far less what was dealt of the instrument (cum).

    orders: order_id, instrument, datetime, amount, volume; one row for each order and bar. A bar's orders deal one after the other, by the column place. The volume so far is that of the bars with orders;
    limit names a column of the limit so far instead, which must not fall. others: columns of further limits of single orders; the least of all holds. A bar without volume deals nothing.
    """
    amount = F.greatest(F.least(F.coalesce("amount", F.lit(0.0)), *(F.coalesce(c, F.lit(0.0)) for c in others)) if others else F.coalesce("amount", F.lit(0.0)), F.lit(0.0))
    if by == "current":
        return orders.withColumn("deal_amount", F.greatest(F.least(amount, F.coalesce("volume", F.lit(0.0)) * share), F.lit(0.0)))
    turn = Window.partitionBy("instrument").orderBy("datetime", place)
    w, bars = turn.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("instrument").orderBy("datetime").rangeBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy("instrument", "datetime").orderBy(place)) == 1  # a bar's volume counts once
    rows = orders.withColumn("_volume", F.when(first, F.coalesce("volume", F.lit(0.0)) * share).otherwise(0.0))
    # dealt[t] = least(dealt[t-1] + amount[t], limit[t]), where the limit never falls: so it is the least, over all turns k up to t and the
    # start, of limit[k] + wanted[t] - wanted[k]
    rows = rows.withColumn("_wanted", F.sum(amount).over(w)).withColumn("_limit", F.coalesce(F.col(limit), F.lit(0.0)) if limit else F.sum("_volume").over(bars))
    rows = rows.withColumn("_done", F.col("_wanted") + F.least(F.min(F.col("_limit") - F.col("_wanted")).over(w), F.lit(0.0)))
    before = F.coalesce(F.lag("_done").over(turn), F.lit(0.0))
    return rows.withColumn("deal_amount", F.greatest(F.col("_done") - before, F.lit(0.0))).drop("_wanted", "_limit", "_done", "_volume")


def order_bars(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """orders (instrument, start, end, ...) with the bars of their range: joined by instrument and month, so that an order meets no bars far from its range."""
    month = lambda c: F.trunc(F.to_date(c), "month")
    spread = orders.withColumn("_month", F.explode(F.sequence(month("start"), month("end"), F.expr("interval 1 month"))))
    return spread.join(bars.withColumn("_month", month("datetime")), ["instrument", "_month"]).filter((F.col("datetime") >= F.col("start")) & (F.col("datetime") <= F.col("end"))).drop("_month")


def twap(orders: DataFrame, bars: DataFrame, unit: float = 0.0) -> DataFrame:
    """Each order (order_id, instrument, start, end, amount) in equal parts over its bars; lots left over go to the last bar."""
    rows = order_bars(orders, bars.select("instrument", "datetime"))
    w = Window.partitionBy("order_id")
    k, n = F.row_number().over(w.orderBy("datetime")), F.count("*").over(w)
    upto = lambda i: F.col("amount") * i / n if not unit else F.when(i < n, F.floor(F.col("amount") * i / n / unit) * unit).otherwise(F.col("amount"))
    return rows.select("order_id", "instrument", "datetime", (upto(k) - upto(k - 1)).alias("amount"))


def base_price(bars: DataFrame, orders: DataFrame, method: str = "twap") -> DataFrame:
    """order_id, base_price: the mean or the volume-weighted mean price of the order's bars."""
    rows = order_bars(orders.select("order_id", "instrument", "start", "end"), bars.select("instrument", "datetime", "close", "volume")).filter("close is not null")
    price = F.avg("close") if method == "twap" else F.try_divide(F.sum(F.col("close") * F.col("volume")), F.sum("volume"))
    return rows.groupBy("order_id").agg(price.alias("base_price"))


def soft_topk(scores: DataFrame, current: DataFrame, k: int, limit: float | None = None, risk_degree: float = 0.95) -> DataFrame:
    """Target weights on each date: risk_degree / k for the best k, no weight moving by more than limit.

    scores: instrument, datetime, score; current: instrument, datetime, weight. Sales come first: names that aren't among the best go, others fall to their target. What
    they free and what is missing up to risk_degree is the budget, which each shortfall shares in proportion; a share is then cut to the limit, and what
    that leaves stays cash. On a date without holdings every one of the best gets its target, cut to the limit.
    """
    date, target, none = Window.partitionBy("datetime"), risk_degree / k, F.lit(0.0)
    clipped = lambda x: x if limit is None else F.least(x, F.lit(limit))
    best = scores.filter("score is not null").withColumn("place", F.row_number().over(date.orderBy(F.col("score").desc(), "instrument"))).filter(F.col("place") <= k).select("instrument", "datetime", F.lit(target).alias("wanted"))
    rows = current.filter("weight > 0").join(best, ["instrument", "datetime"], "full").na.fill(0.0, ["weight", "wanted"])
    over = F.col("weight") - F.col("wanted")
    rows = rows.withColumn("sold", F.when(over > 1e-8, clipped(over)).otherwise(none)).withColumn("left", F.col("weight") - F.col("sold"))
    rows = rows.withColumn("short", F.when((F.col("wanted") > 0) & (F.col("wanted") - F.col("left") > 1e-8), F.col("wanted") - F.col("left")).otherwise(none))
    budget = F.sum("sold").over(date) + risk_degree - F.sum("weight").over(date)
    total = F.sum("short").over(date)
    share = F.when(budget > 1e-8, F.try_divide(F.col("short"), total) * F.least(budget, total)).otherwise(none)
    bought = F.when(F.col("short") > 0, F.when(F.sum("weight").over(date) > 0, F.least(share, clipped(F.col("short")))).otherwise(clipped(F.col("short")))).otherwise(none)
    return rows.select("instrument", "datetime", (F.col("left") + bought).alias("weight")).filter("weight > 1e-8")


def aligned(a: DataFrame, b: DataFrame, keys: list[str], fill: float | None = None) -> DataFrame:
    """Rows of both with columns x and y by key; missing values filled if asked: the base of index-aligned arithmetic."""
    both = a.select(*keys, F.col("value").alias("x")).join(b.select(*keys, F.col("value").alias("y")), keys, "full")
    return both if fill is None else both.na.fill(fill, ["x", "y"])


def sum_by_index(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Sum of value by key over all frames; absent keys count as 0."""
    rows = frames[0].select(*keys, "value")
    for f in frames[1:]:
        rows = rows.unionByName(f.select(*keys, "value"))
    return rows.groupBy(*keys).agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("value"))
