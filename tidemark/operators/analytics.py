"""Signal analytics: information coefficients, groups, turnover, ensembles. Scores are (instrument, datetime, score), labels (.., label)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_date() -> WindowSpec:
    """The rows of a date."""
    return Window.partitionBy("datetime")


def pair(scores: DataFrame, labels: DataFrame) -> DataFrame:
    return scores.join(labels, ["instrument", "datetime"])


def correlation(x: str, y: str) -> Column:
    """Pearson over complete pairs; NULL where either side doesn't vary."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def average_rank(name: str, *by: str) -> Column:
    keys = by or ("datetime",)
    over = Window.partitionBy(*keys)
    return F.when(F.col(name).isNotNull(), F.rank().over(over.orderBy(F.col(name).asc_nulls_last())) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, name)) - 1) / 2)


def information_coefficient(rows: DataFrame, keys: tuple[str, ...] = ("datetime",)) -> DataFrame:
    """keys, ic, rank_ic of rows with score and label."""
    full = rows.filter("score is not null and label is not null")
    ranked = full.select("*", average_rank("score", *keys).alias("rs"), average_rank("label", *keys).alias("rl"))
    return ranked.groupBy(*keys).agg(correlation("score", "label").alias("ic"), correlation("rs", "rl").alias("rank_ic"))


def long(rows: DataFrame, names: list[str], key: str, value: str) -> DataFrame:
    """(key, instrument, datetime, value): a row for each of the named columns."""
    cells = F.array(*(F.struct(F.lit(n).alias(key), F.col(n).cast("double").alias(value)) for n in names))
    return rows.select("instrument", "datetime", F.explode(cells).alias("x")).select(f"x.{key}", "instrument", "datetime", f"x.{value}")


def all_ic(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """model, label_name, datetime, ic, rank_ic for every model (model, instrument, datetime, score) and every label (label_name, instrument, datetime, label), in one join and one exchange by model, label and date.

    A date's pair counts where both are known, so models and labels with gaps don't take rows from each other.
    """
    full = scores.filter("score is not null").join(labels.filter("label is not null"), ["instrument", "datetime"])
    return information_coefficient(full, ("model", "label_name", "datetime"))


def monthly_ic(rows: DataFrame) -> DataFrame:
    return information_coefficient(rows).groupBy(F.date_format("datetime", "yyyyMM").alias("month")).agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"))


def placed(rows: DataFrame) -> DataFrame:
    """Adds the place of each score from the top and from the bottom (ties by instrument) and the date's count."""
    return rows.select("*", F.row_number().over(by_date().orderBy(F.col("score").desc(), "instrument")).alias("top"), F.row_number().over(by_date().orderBy(F.col("score").asc(), "instrument")).alias("bottom"), F.count("score").over(by_date()).alias("n"))


def long_short_return(rows: DataFrame, quantile: float = 0.2) -> DataFrame:
    """datetime, long_short (half the difference of the means of top and bottom), market (the mean of all)."""
    k = F.floor(F.col("n") * quantile)
    best, worst = F.avg(F.when(F.col("top") <= k, F.col("label"))), F.avg(F.when(F.col("bottom") <= k, F.col("label")))
    return placed(rows.filter("score is not null")).groupBy("datetime").agg(((best - worst) / 2).alias("long_short"), F.avg("label").alias("market"))


def long_short_precision(rows: DataFrame, quantile: float = 0.2, excess: bool = False) -> DataFrame:
    """datetime, long_precision (labels above zero in the top), short_precision (below zero in the bottom)."""
    rows = rows.filter("score is not null")
    if excess:
        rows = rows.withColumn("label", F.col("label") - F.avg("label").over(by_date()))
    k = F.floor(F.col("n") * quantile)
    share = lambda place, hit: F.avg(F.when(F.col(place) <= k, F.coalesce(hit, F.lit(False)).cast("double")))
    return placed(rows).groupBy("datetime").agg(share("top", F.col("label") > 0).alias("long_precision"), share("bottom", F.col("label") < 0).alias("short_precision"))


def group_returns(rows: DataFrame, groups: int = 5) -> DataFrame:
    """datetime, group (1: best scores), mean_label; n // groups instruments each, the rest in none."""
    size = F.floor(F.col("n") / groups)
    own = placed(rows.filter("score is not null and label is not null")).withColumn("group", (F.floor((F.col("top") - 1) / size) + 1).cast("int"))
    return own.filter(F.col("group") <= groups).groupBy("datetime", "group").agg(F.avg("label").alias("mean_label"))


def autocorrelation(scores: DataFrame, lag: int = 1) -> DataFrame:
    """datetime, autocorr: correlation of a date's scores with those of the date lag places before."""
    dates = scores.select("datetime").distinct().withColumn("k", F.row_number().over(Window.orderBy("datetime")))
    now = scores.join(dates, "datetime")
    old = now.select("instrument", (F.col("k") + lag).alias("k"), F.col("score").alias("before"))
    return now.join(old, ["instrument", "k"]).groupBy("datetime").agg(correlation("score", "before").alias("autocorr"))


def turnover(scores: DataFrame, groups: int = 5, lag: int = 1) -> DataFrame:
    """datetime, top, bottom: 1 - overlap / k of the best (worst) k by score and by the instrument's score lag bars before."""
    before = F.lag("score", lag).over(Window.partitionBy("instrument").orderBy("datetime"))
    rows = scores.select("*", before.alias("before"))
    place = lambda c, up: F.row_number().over(by_date().orderBy(F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last(), "instrument"))
    rows = rows.select("*", place("score", False).alias("t"), place("before", False).alias("t0"), place("score", True).alias("b"), place("before", True).alias("b0"), F.floor(F.count(F.lit(1)).over(by_date()) / groups).alias("k"))
    share = lambda x, y: 1 - F.try_divide(F.sum(F.when((F.col(x) <= F.col("k")) & (F.col(y) <= F.col("k")) & F.col("before").isNotNull(), 1).otherwise(0)), F.first("k"))
    return rows.groupBy("datetime").agg(share("t", "t0").alias("top"), share("b", "b0").alias("bottom"))


def describe(rows: DataFrame, name: str) -> DataFrame:
    """A date's size, missing, infinite and distinct values, mean, deviation and bias-corrected skew."""
    x, n = F.col(name), F.count(name)
    skew = F.when(n >= 3, F.skewness(name) * F.try_divide(F.sqrt(n * (n - 1)), n - 2))
    return rows.groupBy("datetime").agg(F.count(F.lit(1)).alias("size"), F.count_if(x.isNull()).alias("missing"), F.count_if(F.abs(x) == float("inf")).alias("infinite"), F.countDistinct(name).alias("distinct"), F.avg(name).alias("mean"), F.stddev_samp(name).alias("deviation"), skew.alias("skew"))


def rolling_ensemble(parts: list[DataFrame]) -> DataFrame:
    """Scores of several runs; of a key in more than one the latest run's stays."""
    rows = None
    for k, p in enumerate(parts):
        p = p.select("instrument", "datetime", "score", F.lit(k).alias("run"))
        rows = p if rows is None else rows.unionByName(p)
    return latest_runs(rows)


def latest_runs(scores: DataFrame, by: Sequence[str] = (), run: str = "run") -> DataFrame:
    """(by, instrument, datetime, run, score) without run: of a key that several runs of a group have, the latest run's score, missing or not."""
    return scores.groupBy(*by, "instrument", "datetime").agg(F.max_by("score", run).alias("score"))


def average_ensemble(scores: DataFrame, by: Sequence[str] = (), model: str = "model") -> DataFrame:
    """(by, instrument, datetime, model, score) -> in each group, the mean over the models of each model's z-score on the date."""
    w = Window.partitionBy(*by, model, "datetime")
    z = F.try_divide(F.col("score") - F.avg("score").over(w), F.stddev_samp("score").over(w))
    return scores.select(*by, "instrument", "datetime", z.alias("z")).groupBy(*by, "instrument", "datetime").agg(F.avg("z").alias("score"))


def group_ensemble(scores: DataFrame, by: Sequence[str], model: str = "model", run: str | None = "run") -> DataFrame:
    """(by, instrument, datetime, score): each model's runs are joined first, then a group's models averaged; all groups in one plan."""
    return average_ensemble(latest_runs(scores, [*by, model], run) if run else scores, by, model)
