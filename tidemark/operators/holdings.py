"""What holders hold, buy and sell, and what each of these earns.

Positions are rows (holder, instrument, datetime, amount, price): what a holder has on each of its dates. A holder's dates are the dates that it has rows on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.working import cut, written

HOLD, BUY, SELL = 0, 1, -1
#: Rows of a task that ranks or finds spells (more where one date or spell has more), rows of a table that is broadcast.
TASK_ROWS, SMALL = 1_000_000, 200_000


def valued(amounts: DataFrame, prices: DataFrame) -> DataFrame:
    """amounts (holder, instrument, datetime, amount) with the last known price (instrument, datetime, price) up to each date: one exchange by instrument, a running window, no range join."""
    both = amounts.select("instrument", "datetime", "holder", "amount", F.lit(None).cast("double").alias("price"), F.lit(1).alias("_own")).unionByName(
        prices.filter("price is not null").select("instrument", "datetime", F.lit(None).cast(amounts.schema["holder"].dataType).alias("holder"), F.lit(None).cast("double").alias("amount"), F.col("price").cast("double").alias("price"), F.lit(0).alias("_own"))
    )
    upto = Window.partitionBy("instrument").orderBy("datetime", "_own").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("price", F.last("price", ignorenulls=True).over(upto)).filter("_own = 1").drop("_own")


def statuses(positions: DataFrame, cash: DataFrame | None = None) -> DataFrame:
    """(holder, instrument, datetime, amount, price, weight, status): each position, 1 where the holder hadn't it on its date before, else 0; and -1, with the last amount, price and weight, on the holder's date
    after a position's last one.

    weight: share of the holder's value on the date, cash (holder, datetime, cash) included if given. Spells are found by numbering each holder's dates: a name is held on
    neighbouring numbers. A position that ends on the holder's last date isn't sold.
    """
    value = F.col("amount") * F.col("price")
    positions = written(positions.select("holder", "instrument", "datetime", "amount", "price"))
    totals = positions.groupBy("holder", "datetime").agg(F.sum(value).alias("_total"))
    if cash is not None:
        totals = totals.join(cash, ["holder", "datetime"], "left").withColumn("_total", F.col("_total") + F.coalesce("cash", F.lit(0.0))).drop("cash")
    return _spells(positions, totals, {"amount": F.col("amount"), "price": F.col("price"), "weight": F.try_divide(value, F.col("_total"))})


def spells(positions: DataFrame) -> DataFrame:
    """(holder, instrument, datetime, status) of ``statuses``, for stored positions (holder, instrument, datetime): at most two rows for each."""
    return _spells(positions, positions.select("holder", "datetime").distinct(), {})


def _spells(positions: DataFrame, dates: DataFrame, values: dict) -> DataFrame:
    """Stored positions are read twice, as their dates are counted before: few dates need no exchange of the positions by date."""
    own = Window.partitionBy("holder").orderBy("datetime")  # a row for each date, not for each position
    dates = cut(dates.select("*", F.row_number().over(own).alias("_k"), F.lead("datetime").over(own).alias("_next")))
    rows = positions.repartition(tasks(positions.sparkSession, positions.count()), "holder", "instrument")
    rows = rows.join(F.broadcast(dates) if dates.count() <= SMALL else dates, ["holder", "datetime"])
    spell = Window.partitionBy("holder", "instrument").orderBy("_k")
    before, after = F.lag("_k").over(spell), F.lead("_k").over(spell)
    status, ends = F.when(before == F.col("_k") - 1, HOLD).otherwise(BUY).alias("_status"), (F.coalesce(after > F.col("_k") + 1, F.lit(True)) & F.col("_next").isNotNull()).alias("_ends")
    rows = rows.select("holder", "instrument", "datetime", "_next", *(v.alias(k) for k, v in values.items()), status, ends)
    events = F.array(F.struct(F.col("datetime"), F.col("_status").alias("status")), F.struct(F.col("_next").alias("datetime"), F.lit(SELL).alias("status")))
    each = rows.select("holder", "instrument", *values, F.explode(F.filter(events, lambda e: (e["status"] != SELL) | F.col("_ends"))).alias("e"))
    return each.select("holder", "instrument", "e.datetime", *values, "e.status")


def tasks(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def attribution(states: DataFrame, labels: DataFrame, bench: DataFrame) -> DataFrame:
    """For each holder and date: for what is held, bought and sold the value (sum of weight times label less the benchmark), the weight and the mean (value over weight, 0 without weight), and their sums up to the date.

    states: of ``statuses``; labels (instrument, datetime, label), bench (datetime, bench). Rows without a label or a benchmark don't count; a date with none has no row.
    """
    rows = states.join(labels, ["instrument", "datetime"]).join(bench, "datetime").withColumn("excess", F.col("label") - F.col("bench")).filter("excess is not null")
    out = []
    for name, status in (("hold", HOLD), ("buy", BUY), ("sell", SELL)):
        mine = F.col("status") == status
        total, weight = F.coalesce(F.sum(F.when(mine, F.col("excess") * F.col("weight"))), F.lit(0.0)), F.coalesce(F.sum(F.when(mine, F.col("weight"))), F.lit(0.0))
        out += [total.alias(f"{name}_value"), weight.alias(f"{name}_weight"), F.coalesce(F.try_divide(total, weight), F.lit(0.0)).alias(f"{name}_mean")]
    days = rows.groupBy("holder", "datetime").agg(*out).withColumn("buy_minus_sell_value", F.col("buy_value") - F.col("sell_value")).withColumn("buy_minus_sell_mean", F.col("buy_mean") - F.col("sell_mean")).withColumn("buy_plus_sell_weight", F.col("buy_weight") + F.col("sell_weight"))
    upto = Window.partitionBy("holder").orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("*", *(F.sum(f"{n}_mean").over(upto).alias(f"cum_{n}") for n in ("hold", "buy", "sell", "buy_minus_sell")))


def label_ranks(states: DataFrame, labels: DataFrame, at_most: int | None = None) -> DataFrame:
    """states with label, rank_ratio (rank of the label in the holder's date from the highest on, ties averaged, in percent of its rows), rank_label_mean (its mean over the rows with the same status) and excess_return (label less
        the date's mean). Rows without a label have NULLs but count as rows of the date.

    One sort ranks the rows, in tasks of some TASK_ROWS; counts and means are small tables that are joined on, not windows that hold a date's rows again. at_most: a bound of the states' rows, where one is known: then
    they are written once, with their ranks; else they are written and counted before."""
    spark, date = states.sparkSession, ["holder", "datetime"]
    if at_most is None:
        rows = written(states.join(labels, ["instrument", "datetime"], "left"))
        n = tasks(spark, rows.count())
    else:
        n = tasks(spark, at_most)
        rows = states.repartition(n, "instrument", "datetime").join(labels, ["instrument", "datetime"], "left")
    best = Window.partitionBy(*date).orderBy(F.col("label").desc_nulls_last())
    ends = F.rank().over(best) + F.count(F.lit(1)).over(best.rangeBetween(Window.unboundedPreceding, Window.currentRow))  # the first and the last of the ties
    ranked = written(rows.repartition(n, *date).withColumn("_ends", ends))
    sizes = cut(ranked.groupBy(*date).agg(F.count(F.lit(1)).alias("_size"), F.avg("label").alias("_mean")))
    out = _joined(ranked, sizes, date).withColumn("rank_ratio", F.when(F.col("label").isNotNull(), F.col("_ends") / 2 / F.col("_size") * 100))
    means = cut(out.groupBy(*date, "status").agg(F.avg("rank_ratio").alias("rank_label_mean")))
    out = _joined(out, means, [*date, "status"])
    return out.select(*rows.columns, "rank_ratio", "rank_label_mean", (F.col("label") - F.col("_mean")).alias("excess_return"))


def _joined(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """rows with a stored table's row of the same keys, NULL keys too."""
    named = small.select(*(F.col(k).alias(f"_j_{k}") for k in keys), *(c for c in small.columns if c not in keys))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_j_{k}"))
    return rows.join(F.broadcast(named) if small.count() <= SMALL else named, cond).drop(*(f"_j_{k}" for k in keys))
