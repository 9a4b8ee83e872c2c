"""The engine's queries over the shared tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import analytics, backtest, execution, feature_sets, filters, health, loaders, portfolio, processors, resample, riskmodels
from tidemark.plans import chunked
from tidemark.plans.compiler import Panel, features
from tidemark.sources import panels, working
from tidemark.streaming import bars as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BARS = """
raw AS (SELECT CAST({key} AS VARCHAR) AS instrument, CAST(ts AS DATE) AS datetime, arg_min(value, ts) AS open, arg_max(value, ts) AS close, max(value) AS high, min(value) AS low, CAST(count(*) AS DOUBLE) AS volume, avg(value) AS vwap FROM events GROUP BY 1, 2),
cal AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS cal_idx FROM (SELECT DISTINCT datetime FROM raw)),
span AS (SELECT instrument, min(datetime) AS a, max(datetime) AS b FROM raw GROUP BY 1),
p AS (SELECT s.instrument, c.datetime, c.cal_idx, r.open, r.close, r.high, r.low, r.volume, r.vwap FROM span s JOIN cal c ON c.datetime BETWEEN s.a AND s.b LEFT JOIN raw r ON r.instrument = s.instrument AND r.datetime = c.datetime)
"""
USER, TYPE = BARS.format(key="user_id"), BARS.format(key="event_type")
PLACES = 6


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def users(spark: SparkSession, sf: str) -> Panel:
    return panels.event_panel(spark, sf, "user_id")


def types(spark: SparkSession, sf: str) -> Panel:
    return panels.event_panel(spark, sf, "event_type")


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _expression(name: str, text: str, sql: str, start: str | None = None) -> None:
    """A query of one expression over the users' panel. sql may use w5 (five rows) and wx (the past)."""

    def run(spark, sf):
        return rounded(features(users(spark, sf), {"value": text}, start=dt.date.fromisoformat(start) if start else None))

    windows = "WINDOW s AS (PARTITION BY instrument ORDER BY datetime), w5 AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), wx AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    inner = f"SELECT instrument, datetime, {sql} AS v FROM x {windows}"
    value = "v" if text.startswith(tuple(f"{x}(" for x in ("Gt", "Ge", "Lt", "Le", "Eq", "Ne", "And", "Or", "Not", "IsNull", "IsInf", "Date"))) else f"round(CAST(v AS DOUBLE), {PLACES})"
    query(name, f"WITH {USER}, x AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY datetime) AS prev FROM p) SELECT instrument, datetime, {value} AS value FROM ({inner})" + (f" WHERE datetime >= DATE '{start}'" if start else ""))(run)


_L5 = "list(close) OVER w5"
for _n, _t, _s in [
    ("field", "$close", "close"),
    ("abs", "Abs($close - 50)", "abs(close - 50)"),
    ("sign", "Sign($close - $open)", "sign(close - open)"),
    ("log", "Log($volume)", "CASE WHEN volume > 0 THEN ln(volume) END"),
    ("not", "Not($close > $open)", "NOT coalesce(close > open, false)"),
    ("add", "$close + 2", "close + 2"),
    ("sub", "$high - $low", "high - low"),
    ("mul", "$close * $volume", "close * volume"),
    ("div", "$close / ($high - $low)", "close / nullif(high - low, 0)"),
    ("power", "Power($close / 100, 2)", "pow(close / 100, 2)"),
    ("greater", "Greater($open, $vwap)", "CASE WHEN open IS NOT NULL AND vwap IS NOT NULL THEN greatest(open, vwap) END"),
    ("less", "Less($open, $vwap)", "CASE WHEN open IS NOT NULL AND vwap IS NOT NULL THEN least(open, vwap) END"),
    ("gt", "Gt($close, Ref($close, 1))", "coalesce(close > prev, false)"),
    ("ge", "Ge($close, Ref($close, 1))", "coalesce(close >= prev, false)"),
    ("lt", "Lt($close, Ref($close, 1))", "coalesce(close < prev, false)"),
    ("le", "Le($close, Ref($close, 1))", "coalesce(close <= prev, false)"),
    ("eq", "Eq($high, $low)", "coalesce(high = low, false)"),
    ("ne", "Ne($high, $low)", "coalesce(high <> low, true)"),
    ("and", "And($close > $open, $volume > 1)", "coalesce(close > open, false) AND coalesce(volume > 1, false)"),
    ("or", "Or($close > $open, $volume > 3)", "coalesce(close > open, false) OR coalesce(volume > 3, false)"),
    ("if", "If($close > $open, $high, $low)", "CASE WHEN coalesce(close > open, false) THEN high ELSE low END"),
    ("is_null", "IsNull($close)", "close IS NULL"),
    ("is_inf", "IsInf($close)", "false"),
    ("date", "Date($close)", "datetime"),
    ("ref_past", "Ref($close, 2)", "lag(close, 2) OVER s"),
    ("ref_future", "Ref($close, -2)", "lead(close, 2) OVER s"),
    ("ref_first", "Ref($close, 0)", "first_value(close) OVER wx"),
    ("delta", "Delta($close, 3)", "close - lag(close, 3) OVER s"),
    ("mean", "Mean($close, 5)", "avg(close) OVER w5"),
    ("sum", "Sum($close, 5)", "sum(close) OVER w5"),
    ("std", "Std($close, 5)", "stddev_samp(close) OVER w5"),
    ("var", "Var($close, 5)", "var_samp(close) OVER w5"),
    ("skew", "Skew($close, 5)", "CASE WHEN count(close) OVER w5 >= 3 THEN CASE WHEN min(close) OVER w5 = max(close) OVER w5 THEN 0 ELSE skewness(close) OVER w5 END END"),
    ("kurt", "Kurt($close, 5)", "CASE WHEN count(close) OVER w5 >= 4 THEN CASE WHEN min(close) OVER w5 = max(close) OVER w5 THEN -3 ELSE kurtosis(close) OVER w5 END END"),
    ("max", "Max($high, 5)", "max(high) OVER w5"),
    ("min", "Min($low, 5)", "min(low) OVER w5"),
    ("idx_max", "IdxMax($close, 5)", f"CASE WHEN count(close) OVER w5 > 0 THEN coalesce(nullif(list_position(list_transform({_L5}, lambda x: x IS NULL), true), 0), list_position({_L5}, max(close) OVER w5)) END"),
    ("idx_min", "IdxMin($close, 5)", f"CASE WHEN count(close) OVER w5 > 0 THEN coalesce(nullif(list_position(list_transform({_L5}, lambda x: x IS NULL), true), 0), list_position({_L5}, min(close) OVER w5)) END"),
    ("quantile", "Quantile($close, 5, 0.8)", "quantile_cont(close, 0.8) OVER w5"),
    ("med", "Med($close, 5)", "median(close) OVER w5"),
    ("count", "Count($close, 5)", "count(close) OVER w5"),
    ("slope", "Slope($close, 5)", "CASE WHEN count(close) OVER w5 >= 2 THEN regr_slope(close, cal_idx) OVER w5 END"),
    ("rsquare", "Rsquare($close, 5)", "CASE WHEN count(close) OVER w5 >= 2 AND stddev_samp(close) OVER w5 > 2e-5 THEN regr_r2(close, cal_idx) OVER w5 END"),
    ("resi", "Resi($close, 5)", "CASE WHEN count(close) OVER w5 >= 2 THEN close - (regr_slope(close, cal_idx) OVER w5 * cal_idx + regr_intercept(close, cal_idx) OVER w5) END"),
    ("ema", "EMA($close, 5)", "sum(close * pow(1.5, cal_idx)) OVER wx / sum(CASE WHEN close IS NOT NULL THEN pow(1.5, cal_idx) END) OVER wx"),
    ("ema_alpha", "Mean($close, 0.5)", "sum(close * pow(2, cal_idx)) OVER wx / sum(CASE WHEN close IS NOT NULL THEN pow(2, cal_idx) END) OVER wx"),
    ("corr", "Corr($close, $volume, 5)", "CASE WHEN stddev_samp(close) OVER w5 > 2e-5 AND stddev_samp(volume) OVER w5 > 2e-5 THEN covar_samp(close, volume) OVER w5 / nullif(stddev_samp(close) OVER w5 * stddev_samp(volume) OVER w5, 0) END"),
    ("cov", "Cov($close, $volume, 5)", "CASE WHEN count(close) OVER w5 >= 2 THEN covar_samp(close, volume) OVER w5 END"),
    ("rolling_generic", "Rolling($close, 5, 'max')", "max(close) OVER w5"),
    ("expanding_mean", "Mean($close, 0)", "avg(close) OVER wx"),
    ("expanding_std", "Std($close, 0)", "stddev_samp(close) OVER wx"),
    ("expanding_max", "Max($close, 0)", "max(close) OVER wx"),
    ("expanding_median", "Med($close, 0)", "median(close) OVER wx"),
    ("ffill", "FFillNan($close)", "last_value(close IGNORE NULLS) OVER wx"),
    ("bfill", "BFillNan($close)", "first_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
    ("select", "Select($volume > 1, $close)", "CASE WHEN coalesce(volume > 1, false) THEN close END"),
    ("cut", "Cut($close, 2, -3)", "CASE WHEN row_number() OVER s > 2 AND row_number() OVER (PARTITION BY instrument ORDER BY datetime DESC) > 3 THEN close END"),
    ("day_last", "DayLast($close)", "close"),
    ("day_cumsum", "DayCumsum($close)", "coalesce(close, 0)"),
    ("ema_long", "EMA($close, 1000)", "sum(close * pow(1001.0 / 999.0, cal_idx)) OVER wx / sum(CASE WHEN close IS NOT NULL THEN pow(1001.0 / 999.0, cal_idx) END) OVER wx"),
    ("rolling_quantile", "Rolling($close, 5, 'quantile', 0.3)", "quantile_cont(close, 0.3) OVER w5"),
    ("minus", "-$close + 1", "1 - close"),
    ("nested_windows", "Mean($close > Ref($close, 1), 5)", "avg(CASE WHEN coalesce(close > prev, false) THEN 1.0 ELSE 0.0 END) OVER w5"),
]:
    _expression(f"expr_{_n}", _t, _s)
_expression("expr_range", "Mean($close, 5)", "avg(close) OVER w5", start="2024-01-15")



@query("expr_select_window", f"WITH {USER}, c AS (SELECT instrument, datetime, avg(close) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v FROM p WHERE volume > 1) SELECT p.instrument, p.datetime, round(v, 6) AS value FROM p LEFT JOIN c USING (instrument, datetime)")
def expr_select_window(spark, sf):
    return rounded(features(users(spark, sf), {"value": "Mean(Select($volume > 1, $close), 3)"}))


_WITH_LIST = "SELECT *, list(close) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM p"
for _n, _t, _s in [
    ("mad", "Mad($close, 5)", "CASE WHEN len(k) > 0 THEN list_avg(list_transform(k, lambda x: abs(x - m))) END"),
    ("rank", "Rank($close, 5)", "CASE WHEN close IS NOT NULL THEN (len(list_filter(k, lambda x: x < close)) + (len(list_filter(k, lambda x: x = close)) + 1) / 2.0) / len(k) END"),
    ("wma", "WMA($close, 5)", "CASE WHEN len(k) > 0 THEN list_sum(list_transform(l, lambda x, i: coalesce(x * i, 0))) / (len(l) * (len(l) + 1) / 2.0) / len(k) END"),
]:
    query(f"expr_{_n}", f"WITH {USER}, x AS ({_WITH_LIST}), y AS (SELECT *, list_filter(l, lambda v: v IS NOT NULL) AS k FROM x), z AS (SELECT *, list_avg(k) AS m FROM y) SELECT instrument, datetime, round({_s}, {PLACES}) AS value FROM z")(lambda spark, sf, t=_t: rounded(features(users(spark, sf), {"value": t})))


@query("panel_scan", f"WITH {USER} SELECT instrument, datetime, round(close, 6) AS close, round(vwap, 6) AS vwap FROM p WHERE datetime BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'")
def panel_scan(spark, sf):
    return rounded(features(users(spark, sf), {"close": "$close", "vwap": "$vwap"}, start=dt.date(2024, 1, 10), end=dt.date(2024, 1, 20)))


@query("panel_dense", f"WITH {USER} SELECT instrument, datetime, cal_idx, round(open, 6) AS open, round(close, 6) AS close, high, low, volume, round(vwap, 6) AS vwap FROM p")
def panel_dense(spark, sf):
    return users(spark, sf).bars.select("instrument", "datetime", "cal_idx", F.round("open", 6).alias("open"), F.round("close", 6).alias("close"), "high", "low", "volume", F.round("vwap", 6).alias("vwap"))


@query("calendar", f"WITH {USER} SELECT datetime, cal_idx FROM cal")
def calendar(spark, sf):
    return panels.calendar_of(users(spark, sf).bars)


@query("calendar_weeks", f"WITH {USER} SELECT min(datetime) AS datetime FROM cal GROUP BY date_trunc('week', datetime)")
def calendar_weeks(spark, sf):
    return resample.period_starts(users(spark, sf).bars.select("datetime"), "datetime", "week")


@query("change_instrument", f"WITH {TYPE}, o AS (SELECT datetime, avg(close) OVER (ORDER BY datetime ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM p WHERE instrument = (SELECT min(instrument) FROM p)) SELECT instrument, datetime, round(close - c, 6) AS value FROM p LEFT JOIN o USING (datetime)")
def change_instrument(spark, sf):
    p = types(spark, sf)
    code = p.bars.agg(F.min("instrument")).first()[0]
    return rounded(features(p, {"value": f"$close - ChangeInstrument('{code}', Mean($close, 3))"}))


@query("mask", f"WITH {TYPE}, o AS (SELECT datetime, close - open AS c FROM p WHERE instrument = (SELECT min(instrument) FROM p)) SELECT instrument, datetime, round(c, 6) AS value FROM p LEFT JOIN o USING (datetime)")
def mask(spark, sf):
    p = types(spark, sf)
    code = p.bars.agg(F.min("instrument")).first()[0]
    return rounded(features(p, {"value": f"Mask($close - $open, '{code}')"}))


@query("technical_features", None)
def technical_features(spark, sf):
    """The flagship: 158 columns over the users' panel."""
    return chunked.features(users(spark, sf), feature_sets.technical())


_LAGS = ", ".join(
    [f"round(lag({f}, {k}) OVER s / nullif(close, 0), 6) AS {f.upper()}{k}" for f in ("close", "open", "high", "low", "vwap") for k in range(59, -1, -1)] + [f"round(lag(volume, {k}) OVER s / (volume + 1e-12), 6) AS VOLUME{k}" for k in range(59, -1, -1)]
)


@query("lagged_features", f"WITH {USER} SELECT instrument, datetime, {_LAGS} FROM p WINDOW s AS (PARTITION BY instrument ORDER BY datetime)")
def lagged_features(spark, sf):
    """360 columns over the users' panel."""
    return rounded(chunked.features(users(spark, sf), feature_sets.lags()))


_F = {"KMID": "(close - open) / open", "KUP": "(high - greatest(open, close)) / open", "KSFT": "(2 * close - high - low) / open", "ROC5": "lag(close, 5) OVER s / close", "MA5": "avg(close) OVER w5 / close", "STD5": "stddev_samp(close) OVER w5 / close", "BETA5": "CASE WHEN count(close) OVER w5 >= 2 THEN regr_slope(close, cal_idx) OVER w5 / close END", "MAX5": "max(high) OVER w5 / close", "QTLU5": "quantile_cont(close, 0.8) OVER w5 / close", "RSV5": "(close - min(low) OVER w5) / (max(high) OVER w5 - min(low) OVER w5 + 1e-12)", "VMA5": "avg(volume) OVER w5 / (volume + 1e-12)", "VSTD5": "stddev_samp(volume) OVER w5 / (volume + 1e-12)", "LABEL0": "lead(close, 2) OVER s / lead(close, 1) OVER s - 1"}


@query("feature_families", f"WITH {TYPE} SELECT instrument, datetime, {', '.join(f'round({s}, 6) AS {n}' for n, s in _F.items())} FROM p WINDOW s AS (PARTITION BY instrument ORDER BY datetime), w5 AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def feature_families(spark, sf):
    every = feature_sets.technical((5,)) | feature_sets.LABEL
    return rounded(features(types(spark, sf), {n: every[n] for n in _F}))


@query("resample_week", f"WITH {USER}, b AS (SELECT instrument, time_bucket(INTERVAL 7 DAY, datetime, DATE '1970-01-01') AS datetime, sum(close) AS total, avg(close) AS mean, max(high) AS top, arg_max(close, datetime) FILTER (close IS NOT NULL) AS newest FROM p GROUP BY 1, 2) SELECT instrument, datetime::DATE AS datetime, round(total, 6) AS total, round(mean, 6) AS mean, top, round(newest, 6) AS newest FROM b")
def resample_week(spark, sf):
    out = resample.resample(users(spark, sf), {"total": ("$close", "sum"), "mean": ("$close", "mean"), "top": ("$high", "max"), "newest": ("$close", "last")}, "7d")
    return rounded(out.withColumn("datetime", F.to_date("datetime")))


@query("filter_name", f"WITH {USER} SELECT instrument, a AS start, b AS \"end\" FROM span WHERE regexp_matches(instrument, '^(?:1[0-9]*)')")
def filter_name(spark, sf):
    p = users(spark, sf)
    return filters.instruments(p, panels.universe_of(p.bars), (filters.NameFilter("1[0-9]*"),))


@query("filter_expression", f"WITH {USER}, f AS (SELECT instrument, datetime, cal_idx - row_number() OVER (PARTITION BY instrument ORDER BY datetime) AS g FROM p WHERE coalesce(close > open, false)) SELECT instrument, min(datetime) AS start, max(datetime) AS \"end\" FROM f GROUP BY instrument, g")
def filter_expression(spark, sf):
    p = users(spark, sf)
    return filters.instruments(p, panels.universe_of(p.bars), (filters.ExpressionFilter("$close > $open"),))


@query("universe_features", f"WITH {USER}, u AS (SELECT instrument, greatest(a, DATE '2024-01-05') AS s, least(b, DATE '2024-01-25') AS e FROM span) SELECT p.instrument, datetime, round(avg(close) OVER (PARTITION BY p.instrument ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS value FROM p JOIN u ON u.instrument = p.instrument QUALIFY datetime BETWEEN s AND e")
def universe_features(spark, sf):
    p = users(spark, sf)
    spans = panels.clip_universe(panels.universe_of(p.bars), dt.date(2024, 1, 5), dt.date(2024, 1, 25))
    return rounded(features(p, {"value": "Mean($close, 5)"}, universe=spans))


@query("filter_history", f"WITH {USER} SELECT instrument, datetime, round(close, 6) AS close FROM p JOIN span USING (instrument) WHERE a <= DATE '2024-01-01' AND b >= DATE '2024-01-30'")
def filter_history(spark, sf):
    return rounded(filters.full_history(users(spark, sf).bars, dt.date(2024, 1, 1), dt.date(2024, 1, 30)).select("instrument", "datetime", "close"))


def _processor(name: str, step: processors.Processor, sql: str, places: int = PLACES) -> None:
    def run(spark, sf):
        df, groups = users(spark, sf).bars.select("instrument", "datetime", "close"), {"feature": ["close"]}
        import copy

        own = copy.deepcopy(step).fit(df, groups)
        return rounded(own.apply(df, groups), places)

    query(f"process_{name}", f"WITH {USER} SELECT instrument, datetime, round({sql}, {places}) AS close FROM p")(run)


_processor("min_max", processors.MinMax(), "(close - (SELECT min(close) FROM p)) / ((SELECT max(close) FROM p) - (SELECT min(close) FROM p))")
_processor("zscore", processors.ZScore(end=dt.date(2024, 1, 20)), "(close - (SELECT avg(close) FROM p WHERE datetime <= DATE '2024-01-20')) / (SELECT stddev_pop(close) FROM p WHERE datetime <= DATE '2024-01-20')")
_processor("robust", processors.RobustZScore(), "CASE WHEN close IS NOT NULL THEN greatest(least((close - md) / ((mad(close) OVER () + 1e-12) * 1.4826), 3), -3) END".replace("md", "(SELECT median(close) FROM p)"))
_processor("date_zscore", processors.DateZScore(), "(close - avg(close) OVER d) / nullif(stddev_samp(close) OVER d, 0)".replace("OVER d", "OVER (PARTITION BY datetime)"))
_processor("date_rank", processors.DateRank(), "CASE WHEN close IS NOT NULL THEN ((rank() OVER (PARTITION BY datetime ORDER BY close NULLS LAST) + (count(*) OVER (PARTITION BY datetime, close) - 1) / 2.0) / count(close) OVER (PARTITION BY datetime) - 0.5) * 3.46 END", places=9)  # ranks are simple fractions: at six places some lie on the edge
_processor("fill", processors.Fill(value=7), "coalesce(close, 7)")
_processor("date_fill", processors.FillWithDateMean(), "coalesce(close, avg(close) OVER (PARTITION BY datetime))")
_processor("infinite", processors.ReplaceInfinite(), "close")
_processor("tanh", processors.Tanh(), "tanh(close - 1)")


@query("process_drop_missing", f"WITH {USER} SELECT instrument, datetime, round(close, 6) AS close FROM p WHERE close IS NOT NULL")
def process_drop_missing(spark, sf):
    df = users(spark, sf).bars.select("instrument", "datetime", "close")
    return rounded(processors.DropMissing("feature").apply(df, {"feature": ["close"]}))


@query("handler_learn", f"WITH {USER}, l AS (SELECT instrument, datetime, close, lead(close) OVER (PARTITION BY instrument ORDER BY datetime) - close AS label FROM p), k AS (SELECT instrument, datetime, coalesce((close - (SELECT avg(close) FROM l)) / (SELECT stddev_pop(close) FROM l), 0) AS close, label FROM l), n AS (SELECT * FROM k WHERE label IS NOT NULL) SELECT instrument, datetime, round(close, 6) AS close, round((label - avg(label) OVER (PARTITION BY datetime)) / nullif(stddev_samp(label) OVER (PARTITION BY datetime), 0), 6) AS label FROM n")
def handler_learn(spark, sf):
    raw = features(users(spark, sf), {"close": "$close", "label": "Ref($close, -1) - $close"})
    h = processors.Handler(raw, {"feature": ["close"], "label": ["label"]}, infer=[processors.ZScore("feature"), processors.Fill("feature")], learn=[processors.DropMissingLabel(), processors.DateZScore("label")])
    return rounded(h.setup().fetch("learn"))


@query("sequences", f"WITH {TYPE} SELECT instrument, datetime, round(list_sum(list_transform(list(close) OVER w, lambda x, i: x * i)), 6) AS weighted, len(list(close) OVER w) AS steps FROM p WHERE true WINDOW w AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY datetime) >= 3")
def sequences(spark, sf):
    s = processors.sequences(types(spark, sf).bars, ["close"], 3)
    full = s.filter(F.expr("steps[0][0] is not null"))
    weighted = F.aggregate(F.transform("steps", lambda x, i: x[0] * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return full.select("instrument", "datetime", F.round(weighted, 6).alias("weighted"), F.size("steps").cast("long").alias("steps"))


# --- analytics: the score is yesterday's move, the label tomorrow's -----------------------------------------------

SCORES = f"{USER}, q AS (SELECT instrument, datetime, close - lag(close) OVER s AS score, lead(close) OVER s - close AS label FROM p WINDOW s AS (PARTITION BY instrument ORDER BY datetime)), k AS (SELECT * FROM q WHERE score IS NOT NULL AND label IS NOT NULL)"


def scored(spark, sf) -> DataFrame:
    return features(users(spark, sf), {"score": "$close - Ref($close, 1)", "label": "Ref($close, -1) - $close"})


def complete(spark, sf) -> DataFrame:
    return scored(spark, sf).filter("score is not null and label is not null")


_R = "rank() OVER (PARTITION BY datetime ORDER BY {0}) + (count(*) OVER (PARTITION BY datetime, {0}) - 1) / 2.0"
_IC = f"r AS (SELECT *, {_R.format('score')} AS rs, {_R.format('label')} AS rl FROM k), c AS (SELECT datetime, covar_samp(score, label) / nullif(stddev_samp(score) * stddev_samp(label), 0) AS ic, covar_samp(rs, rl) / nullif(stddev_samp(rs) * stddev_samp(rl), 0) AS rank_ic FROM r GROUP BY 1)"


@query("ic", f"WITH {SCORES}, {_IC} SELECT datetime, round(ic, 6) AS ic, round(rank_ic, 6) AS rank_ic FROM c")
def ic(spark, sf):
    return rounded(analytics.information_coefficient(scored(spark, sf)))


@query("ic_monthly", f"WITH {SCORES}, {_IC} SELECT strftime(datetime, '%Y%m') AS month, round(avg(ic), 6) AS ic, round(avg(rank_ic), 6) AS rank_ic FROM c GROUP BY 1")
def ic_monthly(spark, sf):
    return rounded(analytics.monthly_ic(scored(spark, sf)))


_PLACED = "n AS (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) AS t, row_number() OVER (PARTITION BY datetime ORDER BY score, instrument) AS b, count(*) OVER (PARTITION BY datetime) AS m FROM k)"


@query("long_short_return", f"WITH {SCORES}, {_PLACED} SELECT datetime, round((avg(label) FILTER (t <= floor(m * 0.2)) - avg(label) FILTER (b <= floor(m * 0.2))) / 2, 6) AS long_short, round(avg(label), 6) AS market FROM n GROUP BY 1")
def long_short_return(spark, sf):
    return rounded(analytics.long_short_return(complete(spark, sf)))


@query("long_short_precision", f"WITH {SCORES}, {_PLACED} SELECT datetime, round(avg(CASE WHEN label > 0 THEN 1.0 ELSE 0 END) FILTER (t <= floor(m * 0.2)), 6) AS long_precision, round(avg(CASE WHEN label < 0 THEN 1.0 ELSE 0 END) FILTER (b <= floor(m * 0.2)), 6) AS short_precision FROM n GROUP BY 1")
def long_short_precision(spark, sf):
    return rounded(analytics.long_short_precision(complete(spark, sf)))


@query("group_returns", f"WITH {SCORES}, {_PLACED}, g AS (SELECT datetime, label, CAST(floor((t - 1) / nullif(floor(m / 5), 0)) + 1 AS INTEGER) AS grp FROM n) SELECT datetime, grp AS \"group\", round(avg(label), 6) AS mean_label FROM g WHERE grp <= 5 GROUP BY 1, 2")
def group_returns(spark, sf):
    return rounded(analytics.group_returns(scored(spark, sf)))


@query("autocorrelation", f"WITH {SCORES}, d AS (SELECT datetime, row_number() OVER (ORDER BY datetime) AS i FROM (SELECT DISTINCT datetime FROM q)), e AS (SELECT q.*, i FROM q JOIN d USING (datetime)), j AS (SELECT a.datetime, a.score AS x, b.score AS y FROM e a JOIN e b ON a.instrument = b.instrument AND a.i = b.i + 1), f AS (SELECT datetime, CASE WHEN y IS NOT NULL THEN x END AS x, CASE WHEN x IS NOT NULL THEN y END AS y FROM j) SELECT datetime, round(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0), 6) AS autocorr FROM f GROUP BY 1")
def autocorrelation(spark, sf):
    return rounded(analytics.autocorrelation(scored(spark, sf).select("instrument", "datetime", "score")))


@query("turnover", f"WITH {SCORES}, o AS (SELECT *, lag(score) OVER (PARTITION BY instrument ORDER BY datetime) AS before FROM q), z AS (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY score DESC NULLS LAST, instrument) AS t, row_number() OVER (PARTITION BY datetime ORDER BY before DESC NULLS LAST, instrument) AS t0, row_number() OVER (PARTITION BY datetime ORDER BY score NULLS LAST, instrument) AS b, row_number() OVER (PARTITION BY datetime ORDER BY before NULLS LAST, instrument) AS b0, floor(count(*) OVER (PARTITION BY datetime) / 5) AS kk FROM o) SELECT datetime, round(1 - count(*) FILTER (t <= kk AND t0 <= kk AND before IS NOT NULL) / nullif(any_value(kk), 0), 6) AS top, round(1 - count(*) FILTER (b <= kk AND b0 <= kk AND before IS NOT NULL) / nullif(any_value(kk), 0), 6) AS bottom FROM z GROUP BY 1")
def turnover(spark, sf):
    return rounded(analytics.turnover(scored(spark, sf).select("instrument", "datetime", "score")))


@query("describe", f"WITH {SCORES} SELECT datetime, count(*) AS size, count(*) FILTER (score IS NULL) AS missing, count(*) FILTER (isinf(score)) AS infinite, count(DISTINCT score) AS \"distinct\", round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS deviation, round(skewness(score), 6) AS skew FROM q GROUP BY 1")
def describe(spark, sf):
    return rounded(analytics.describe(scored(spark, sf), "score"))


@query("rolling_ensemble", f"WITH {SCORES} SELECT instrument, datetime, round(CASE WHEN datetime >= DATE '2024-01-15' THEN label ELSE score END, 6) AS score FROM q WHERE datetime >= DATE '2024-01-15' OR score IS NOT NULL OR true")
def rolling_ensemble(spark, sf):
    rows = scored(spark, sf)
    late = rows.filter(F.col("datetime") >= F.lit(dt.date(2024, 1, 15))).select("instrument", "datetime", F.col("label").alias("score"))
    return rounded(analytics.rolling_ensemble([rows, late]))


@query("average_ensemble", f"WITH {SCORES}, u AS (SELECT instrument, datetime, 'a' AS model, score FROM q UNION ALL SELECT instrument, datetime, 'b', label FROM q), z AS (SELECT instrument, datetime, (score - avg(score) OVER (PARTITION BY model, datetime)) / nullif(stddev_samp(score) OVER (PARTITION BY model, datetime), 0) AS z FROM u) SELECT instrument, datetime, round(avg(z), 6) AS score FROM z GROUP BY 1, 2")
def average_ensemble(spark, sf):
    rows = scored(spark, sf)
    both = rows.select("instrument", "datetime", F.lit("a").alias("model"), "score").unionByName(rows.select("instrument", "datetime", F.lit("b").alias("model"), F.col("label").alias("score")))
    return rounded(analytics.average_ensemble(both))


# --- portfolios ----------------------------------------------------------------------------------------------------

RETURNS = f"{TYPE}, ret AS (SELECT instrument AS series, datetime, (close - lag(close) OVER (PARTITION BY instrument ORDER BY datetime)) / 1000 AS ret FROM p), rr AS (SELECT * FROM ret WHERE ret IS NOT NULL), be AS (SELECT datetime, avg(ret) AS bench FROM rr GROUP BY 1), ro AS (SELECT series, datetime, ret, bench, 0.0001 AS cost FROM rr JOIN be USING (datetime))"


def returns(spark, sf) -> DataFrame:
    r = features(types(spark, sf), {"ret": "($close - Ref($close, 1)) / 1000"}).filter("ret is not null")
    r = r.select(F.col("instrument").alias("series"), "datetime", "ret")
    return r.join(r.groupBy("datetime").agg(F.avg("ret").alias("bench")), "datetime").withColumn("cost", F.lit(0.0001))


@query("risk", f"WITH {RETURNS}, lv AS (SELECT *, sum(ret) OVER (PARTITION BY series ORDER BY datetime) AS level FROM rr), fa AS (SELECT *, level - max(level) OVER (PARTITION BY series ORDER BY datetime) AS fall FROM lv) SELECT series, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS std, round(avg(ret) * 238, 6) AS annualized_return, round(avg(ret) / stddev_samp(ret) * sqrt(238), 6) AS information_ratio, round(min(fall), 6) AS max_drawdown FROM fa GROUP BY 1")
def risk(spark, sf):
    return rounded(portfolio.risk(returns(spark, sf).select("series", "datetime", "ret")))


@query("report", f"WITH {RETURNS}, c AS (SELECT series, datetime, sum(bench) OVER w AS cum_bench, sum(ret) OVER w AS cum_return, sum(ret - cost) OVER w AS cum_return_net, sum(ret - bench) OVER w AS cum_excess, sum(ret - bench - cost) OVER w AS cum_excess_net FROM ro WINDOW w AS (PARTITION BY series ORDER BY datetime)) SELECT series, datetime, {', '.join(f'round({c}, 6) AS {c}' for c in ('cum_bench', 'cum_return', 'cum_return_net', 'cum_excess', 'cum_excess_net'))}, {', '.join(f'round({c} - max({c}) OVER (PARTITION BY series ORDER BY datetime), 6) AS {c.replace("cum", "drawdown")}' for c in ('cum_return', 'cum_return_net', 'cum_excess', 'cum_excess_net'))} FROM c")
def report(spark, sf):
    return rounded(portfolio.report(returns(spark, sf)))


@query("beta", f"WITH {RETURNS}, b AS (SELECT series, covar_samp(ret, bench) / var_samp(bench) AS beta, avg(ret) AS r, avg(bench) AS m, stddev_samp(ret) AS s FROM ro GROUP BY 1) SELECT series, round(beta, 6) AS beta, round((r - beta * m) * 238, 6) AS alpha, round(s * sqrt(238), 6) AS volatility, round(r / s * sqrt(238), 6) AS sharpe FROM b")
def beta(spark, sf):
    return rounded(portfolio.beta(returns(spark, sf)))


@query("benchmark", f"WITH {USER}, r AS (SELECT datetime, close / nullif(lag(close) OVER (PARTITION BY instrument ORDER BY datetime), 0) - 1 AS r FROM p) SELECT datetime, round(coalesce(avg(r), 0), 6) AS bench FROM r GROUP BY 1")
def benchmark(spark, sf):
    return rounded(portfolio.benchmark(users(spark, sf).bars))


@query("brinson", f"WITH {RETURNS}, g AS (SELECT datetime, series AS grp, ret AS br, CASE WHEN series < 'm' THEN ret * 2 END AS pr, 0.2 AS bw, length(series) / 30.0 AS pw FROM rr) SELECT datetime, round(sum((pw - bw) * br), 6) AS raa, round(sum(bw * (coalesce(pr, br) - br)), 6) AS rss, round(sum((pw - bw) * (coalesce(pr, br) - br)), 6) AS rin, round(sum(pw * coalesce(pr, br) - bw * br), 6) AS rtotal FROM g GROUP BY 1")
def brinson(spark, sf):
    r = returns(spark, sf)
    rows = r.select("datetime", F.col("series").alias("group"), F.col("ret").alias("br"), F.when(F.col("series") < "m", F.col("ret") * 2).alias("pr"), F.lit(0.2).alias("bw"), (F.length("series") / F.lit(30.0)).alias("pw"))
    return rounded(portfolio.brinson(rows))


@query("long_short_backtest", f"WITH {SCORES}, x AS (SELECT instrument, datetime, lead(close) OVER (PARTITION BY instrument ORDER BY datetime) / nullif(close, 0) - 1 AS nxt FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) AS t, row_number() OVER (PARTITION BY datetime ORDER BY score, instrument) AS b FROM q WHERE score IS NOT NULL), j AS (SELECT n.*, nxt FROM n JOIN x USING (instrument, datetime)) SELECT datetime, round(avg(nxt) FILTER (t <= 5) - avg(nxt), 6) AS long, round(avg(nxt) - avg(nxt) FILTER (b <= 5), 6) AS short, round(avg(nxt) FILTER (t <= 5) - avg(nxt) FILTER (b <= 5), 6) AS long_short FROM j GROUP BY 1")
def long_short_backtest(spark, sf):
    return rounded(portfolio.long_short_backtest(scored(spark, sf).select("instrument", "datetime", "score"), users(spark, sf).bars, 5))


@query("topk_dropout")
def topk_dropout(spark, sf):
    p = users(spark, sf)
    return rounded(backtest.backtest(features(p, {"score": "$close - Ref($close, 1)"}), p.bars, [backtest.TopkDropout("k10", 10, 2), backtest.TopkDropout("k20", 20, 5)]))


# --- checks, ingestion, streams ------------------------------------------------------------------------------------


@query("health_missing", f"WITH {USER} SELECT instrument, count(*) FILTER (close IS NULL) AS close, count(*) FILTER (volume IS NULL) AS volume FROM p GROUP BY 1")
def health_missing(spark, sf):
    return health.missing(users(spark, sf).bars, ["close", "volume"])


@query("health_steps", f"WITH {USER}, s AS (SELECT instrument, datetime, abs(close / nullif(lag(close) OVER (PARTITION BY instrument ORDER BY datetime), 0) - 1) AS step FROM p), m AS (SELECT instrument, max(step) AS step, arg_max(datetime, step) AS datetime FROM s GROUP BY 1) SELECT instrument, round(step, 6) AS step, datetime FROM m WHERE step > 0.5")
def health_steps(spark, sf):
    return rounded(health.large_steps(users(spark, sf).bars, "close", 0.5))


@query("ingest_increment", f"WITH {USER}, st AS (SELECT instrument, max(datetime) AS d FROM raw WHERE datetime <= DATE '2024-01-20' GROUP BY 1) SELECT r.instrument, r.datetime, round(close, 6) AS close FROM raw r LEFT JOIN st USING (instrument) WHERE d IS NULL OR r.datetime > d")
def ingest_increment(spark, sf):
    raw = panels.bars_from_ticks(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "ts", "value")
    return rounded(panels.increment(raw, raw.filter(F.col("datetime") <= F.lit(dt.date(2024, 1, 20)))).select("instrument", "datetime", "close"))


@query("ingest_new", f"WITH {USER} SELECT instrument, datetime, round(close, 6) AS close FROM raw WHERE instrument NOT IN (SELECT instrument FROM raw WHERE datetime <= DATE '2024-01-02')")
def ingest_new(spark, sf):
    raw = panels.bars_from_ticks(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "ts", "value")
    return rounded(panels.new_instruments(raw, raw.filter(F.col("datetime") <= F.lit(dt.date(2024, 1, 2)))).select("instrument", "datetime", "close"))


FACTS = "fa AS (SELECT CAST(l_suppkey AS VARCHAR) AS instrument, CAST(l_shipdate AS DATE) AS pub_date, CAST(year(l_shipdate) AS INTEGER) - (l_linenumber % 2) AS period, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3)"


@query("pit_latest", f"WITH {FACTS}, ba AS (SELECT DISTINCT instrument, make_date(year(pub_date), month(pub_date), 1) AS datetime FROM fa), v AS (SELECT b.instrument, b.datetime, f.period, arg_max(f.value, f.pub_date) AS value FROM ba b LEFT JOIN fa f ON f.instrument = b.instrument AND f.pub_date <= b.datetime GROUP BY 1, 2, 3) SELECT instrument, datetime, round(arg_max(value, period), 6) AS value FROM v GROUP BY 1, 2")
def pit_latest(spark, sf):
    facts, bars = dated_facts(spark, sf)
    return rounded(features(Panel(panels.placed(bars, panels.calendar_of(bars.select("datetime"))), pit=facts), {"value": "P($$price_a)"}))


def dated_facts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Facts about suppliers by year, dated by shipping; and a bar on the first of each month with facts."""
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    facts = line.groupBy(F.col("l_suppkey").cast("string").alias("instrument"), F.to_date("l_shipdate").alias("pub_date"), (F.year("l_shipdate") - F.col("l_linenumber") % 2).alias("period")).agg(F.max("l_extendedprice").alias("value")).withColumn("field", F.lit("price_a"))
    return facts, line.select(F.col("l_suppkey").cast("string").alias("instrument"), F.trunc("l_shipdate", "month").alias("datetime")).distinct()


@query("pit_fixed_period", f"WITH {FACTS}, ba AS (SELECT DISTINCT instrument, make_date(year(pub_date), month(pub_date), 1) AS datetime FROM fa) SELECT b.instrument, b.datetime, round(arg_max(f.value, f.pub_date), 6) AS value FROM ba b LEFT JOIN fa f ON f.instrument = b.instrument AND f.pub_date <= b.datetime AND f.period = 1995 GROUP BY 1, 2")
def pit_fixed_period(spark, sf):
    facts, bars = dated_facts(spark, sf)
    return rounded(features(Panel(panels.placed(bars, panels.calendar_of(bars.select("datetime"))), pit=facts), {"value": "PRef($$price_a, 1995)"}))


@query("bars_streaming", f"WITH {TYPE} SELECT instrument, datetime, round(open, 6) AS open, round(close, 6) AS close, high, low, volume, round(vwap, 6) AS vwap FROM raw WHERE datetime < (SELECT max(CAST(ts AS TIMESTAMP) - INTERVAL 1 HOUR) FROM events)::DATE")
def bars_streaming(spark, sf):
    """The finished days of a stream; the last one stays open behind the watermark."""
    table = spark.read.parquet(f"{sf}/events.parquet")
    ticks = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    path = working.fresh_path(spark, "stream")
    streaming.run_available(streaming.stream_bars(ticks, "event_type", "ts", "value"), path)
    return rounded(spark.read.parquet(f"{path}/data").withColumn("datetime", F.to_date("datetime")))


# --- loaders, execution, risk models -------------------------------------------------------------------------------


@query("loader_nested", f"WITH {USER}, x AS (SELECT instrument, datetime, close, open, close - lag(close) OVER (PARTITION BY instrument ORDER BY datetime) AS move FROM p) SELECT x.instrument, x.datetime, round(x.open, 6) AS open, round(x.move, 6) AS move, round(y.volume * 2, 6) AS close FROM x LEFT JOIN p y ON y.instrument = x.instrument AND y.datetime = x.datetime AND y.volume > 1")
def loader_nested(spark, sf):
    """Of the column that both frames have the later frame's stays."""
    p = users(spark, sf)
    first = loaders.load(p, {"feature": {"close": "$close", "open": "$open"}, "label": (["Delta($close, 1)"], ["move"])})
    second = loaders.load(p, {"feature": {"close": "$volume * 2", "volume": "$volume"}})
    second = loaders.Frame(second.rows.filter("volume > 1").drop("volume"), {"feature": ["close"]})
    return rounded(loaders.nested([first, second]).rows)


@query("twap_orders", f"WITH {USER}, o AS (SELECT instrument || '-1' AS order_id, instrument, DATE '2024-01-05' AS s, DATE '2024-01-14' AS e, 1000.0 AS amount FROM span), r AS (SELECT o.*, p.datetime, row_number() OVER (PARTITION BY order_id ORDER BY p.datetime) AS k, count(*) OVER (PARTITION BY order_id) AS n FROM o JOIN p ON p.instrument = o.instrument AND p.datetime BETWEEN s AND e), u AS (SELECT *, CASE WHEN k < n THEN floor(amount * k / n / 10) * 10 ELSE amount END AS hi, floor(amount * (k - 1) / n / 10) * 10 AS lo FROM r) SELECT order_id, instrument, datetime, round(hi - lo, 6) AS amount FROM u")
def twap_orders(spark, sf):
    p = users(spark, sf)
    orders = panels.universe_of(p.bars).select(F.concat("instrument", F.lit("-1")).alias("order_id"), "instrument", F.lit(dt.date(2024, 1, 5)).alias("start"), F.lit(dt.date(2024, 1, 14)).alias("end"), F.lit(1000.0).alias("amount"))
    return rounded(execution.twap(orders, p.bars, unit=10))


# each bar deals no more than the limit so far less what was dealt before it
@query("volume_limited", f"WITH RECURSIVE {TYPE}, o AS (SELECT instrument, datetime, CASE WHEN cal_idx % 3 = 0 THEN 0.0 ELSE 60.0 * (cal_idx % 4) END AS amount, sum(coalesce(volume, 0) * 0.5) OVER w AS can, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY instrument ORDER BY datetime)), r AS (SELECT instrument, datetime, k, greatest(least(amount, can), 0) AS deal, greatest(least(amount, can), 0) AS dealt FROM o WHERE k = 1 UNION ALL SELECT o.instrument, o.datetime, o.k, greatest(least(amount, can - dealt), 0), dealt + greatest(least(amount, can - dealt), 0) FROM r JOIN o ON o.instrument = r.instrument AND o.k = r.k + 1) SELECT instrument, datetime, round(deal, 6) AS deal_amount FROM r".replace("WITH RECURSIVE \nraw", "WITH RECURSIVE raw"))
def volume_limited(spark, sf):
    amount = F.when(F.col("cal_idx") % 3 == 0, 0.0).otherwise(60.0 * (F.col("cal_idx") % 4))
    rows = types(spark, sf).bars.select(F.col("instrument").alias("order_id"), "instrument", "datetime", amount.alias("amount"), "volume")
    return rounded(execution.volume_limited(rows, 0.5, "cum").select("instrument", "datetime", "deal_amount"))


@query("base_price", f"WITH {USER} SELECT instrument AS order_id, round(sum(close * volume) / sum(volume), 6) AS base_price FROM p WHERE close IS NOT NULL AND datetime BETWEEN DATE '2024-01-05' AND DATE '2024-01-14' GROUP BY 1")
def base_price(spark, sf):
    p = users(spark, sf)
    orders = panels.universe_of(p.bars).select(F.col("instrument").alias("order_id"), "instrument", F.lit(dt.date(2024, 1, 5)).alias("start"), F.lit(dt.date(2024, 1, 14)).alias("end"))
    return rounded(execution.base_price(p.bars, orders, "vwap"))


SOFT = """
b AS (SELECT instrument, datetime, {target} AS wanted FROM q WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) <= 10),
c AS (SELECT instrument, datetime, 0.8 * row_number() OVER (PARTITION BY datetime ORDER BY instrument) / (count(*) OVER (PARTITION BY datetime) * (count(*) OVER (PARTITION BY datetime) + 1) / 2) AS weight FROM p WHERE dayofmonth(datetime) % 5 <> 0),
j AS (SELECT instrument, datetime, coalesce(weight, 0) AS weight, coalesce(wanted, 0) AS wanted FROM c FULL JOIN b USING (instrument, datetime)),
s1 AS (SELECT *, CASE WHEN weight <= 1e-8 THEN 0 WHEN wanted = 0 THEN least(weight, {limit}) WHEN weight > wanted + 1e-8 THEN least(weight - wanted, {limit}) ELSE 0 END AS sold FROM j),
s2 AS (SELECT *, CASE WHEN wanted > 0 AND weight - sold < wanted - 1e-8 THEN wanted - (weight - sold) END AS short FROM s1),
d AS (SELECT datetime, sum(sold) + {risk} - sum(weight) AS budget, sum(short) AS total, sum(weight) AS held FROM s2 GROUP BY 1),
t AS (SELECT instrument, datetime, CASE WHEN held = 0 THEN least(wanted, {limit}) WHEN short IS NULL OR budget <= 1e-8 THEN weight - sold ELSE weight - sold + least(short / total * least(budget, total), least(short, {limit})) END AS weight FROM s2 JOIN d USING (datetime))
"""


@query("soft_topk", f"WITH {SCORES}, {SOFT.format(target=0.09, limit=0.02, risk=0.9)} SELECT instrument, datetime, round(weight, 6) AS weight FROM t WHERE weight > 1e-8")
def soft_topk(spark, sf):
    """On every fifth day nothing is held."""
    rows = scored(spark, sf)
    date = analytics.by_date()
    place, n = F.row_number().over(date.orderBy("instrument")), F.count("*").over(date)
    current = rows.filter(F.dayofmonth("datetime") % 5 != 0).select("instrument", "datetime", (0.8 * place / (n * (n + 1) / 2)).alias("weight"))
    return rounded(execution.soft_topk(rows.select("instrument", "datetime", "score"), current, 10, 0.02, 0.9))


@query("pair_covariance", f"WITH {RETURNS} SELECT x.series AS a, y.series AS b, round(covar_samp(x.ret, y.ret), 9) AS cov FROM rr x JOIN rr y ON x.datetime = y.datetime AND x.series <= y.series GROUP BY 1, 2")
def pair_covariance(spark, sf):
    r = returns(spark, sf).select(F.col("series").alias("instrument"), "datetime", "ret")
    return riskmodels.pair_covariance(r).withColumn("cov", F.round("cov", 9))


@query("shrunk_covariance")
def shrunk_covariance(spark, sf):
    r = returns(spark, sf).select(F.date_format("datetime", "yyyyMM").alias("key"), F.col("series").alias("instrument"), "datetime", "ret")
    return riskmodels.covariances(r, "const_corr")


@query("risk_parity")
def risk_parity(spark, sf):
    r = returns(spark, sf).select(F.date_format("datetime", "yyyyMM").alias("key"), F.col("series").alias("instrument"), "datetime", "ret")
    return rounded(riskmodels.weights(r, "rp", "const_var"))


@query("index_sum", f"WITH {USER} SELECT instrument, datetime, round(coalesce(close, 0) + coalesce(CASE WHEN volume > 1 THEN volume END, 0), 6) AS value FROM p")
def index_sum(spark, sf):
    bars = users(spark, sf).bars
    return rounded(execution.sum_by_index([bars.select("instrument", "datetime", F.col("close").alias("value")), bars.filter("volume > 1").select("instrument", "datetime", F.col("volume").alias("value"))], ["instrument", "datetime"]))


@query("monthly_risk", f"WITH {RETURNS}, m AS (SELECT series, strftime(datetime, '%Y%m') AS month, datetime, ret, sum(ret) OVER (PARTITION BY series, strftime(datetime, '%Y%m') ORDER BY datetime) AS level FROM rr), f AS (SELECT *, level - max(level) OVER (PARTITION BY series, month ORDER BY datetime) AS fall FROM m) SELECT series, month, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS std, round(avg(ret) * 238, 6) AS annualized_return, round(avg(ret) / stddev_samp(ret) * sqrt(238), 6) AS information_ratio, round(min(fall), 6) AS max_drawdown FROM f GROUP BY 1, 2")
def monthly_risk(spark, sf):
    return rounded(portfolio.monthly_risk(returns(spark, sf).select("series", "datetime", "ret")))


@query("compound_risk", f"WITH {RETURNS}, l AS (SELECT series, datetime, ln(1 + ret) AS g, exp(sum(ln(1 + ret)) OVER (PARTITION BY series ORDER BY datetime)) AS level FROM rr), f AS (SELECT *, level / max(level) OVER (PARTITION BY series ORDER BY datetime) - 1 AS fall FROM l) SELECT series, round(exp(avg(g)) - 1, 6) AS mean, round(stddev_samp(g), 6) AS std, round(pow(exp(avg(g)), 238) - 1, 6) AS annualized_return, round(avg(g) / stddev_samp(g) * sqrt(238), 6) AS information_ratio, round(min(fall), 6) AS max_drawdown FROM f GROUP BY 1")
def compound_risk(spark, sf):
    return rounded(portfolio.compound_risk(returns(spark, sf).select("series", "datetime", "ret")))


# --- a longer panel: suppliers by day, fourteen rolling factors --------------------------------------------------------

SUPPLY = """
raw AS (SELECT CAST(l_suppkey AS VARCHAR) AS instrument, CAST(l_shipdate AS DATE) AS datetime, sum(l_extendedprice) / sum(l_quantity) AS close, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2),
cal AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS cal_idx FROM (SELECT DISTINCT datetime FROM raw)),
span AS (SELECT instrument, min(datetime) AS a, max(datetime) AS b FROM raw GROUP BY 1),
p AS (SELECT s.instrument, c.datetime, c.cal_idx, r.close, r.high, r.low, r.volume FROM span s JOIN cal c ON c.datetime BETWEEN s.a AND s.b LEFT JOIN raw r ON r.instrument = s.instrument AND r.datetime = c.datetime)
"""
#: Prices are short decimals, so that means and medians can lie on a rounding edge; engines differ there. This moves all values off the edges.
OFF_TIES = 0.0000314159
FACTORS = {
    "ma5": ("Mean($close, 5)", "avg(close) OVER w5"),
    "ma20": ("Mean($close, 20)", "avg(close) OVER w20"),
    "ma60": ("Mean($close, 60)", "avg(close) OVER w60"),
    "sd20": ("Std($close, 20)", "stddev_samp(close) OVER w20"),
    "hi20": ("Max($high, 20)", "max(high) OVER w20"),
    "lo20": ("Min($low, 20)", "min(low) OVER w20"),
    "rsv": ("($close - Min($low, 60)) / (Max($high, 60) - Min($low, 60))", "(close - min(low) OVER w60) / nullif(max(high) OVER w60 - min(low) OVER w60, 0)"),
    "roc": ("$close / Ref($close, 5) - 1", "close / nullif(lag(close, 5) OVER s, 0) - 1"),
    "vol5": ("Sum($volume, 5)", "sum(volume) OVER w5"),
    "vol60": ("Mean($volume, 60)", "avg(volume) OVER w60"),
    "n20": ("Count($close, 20)", "CAST(count(close) OVER w20 AS DOUBLE)"),
    "slope20": ("Slope($close, 20)", "CASE WHEN count(close) OVER w20 >= 2 THEN regr_slope(close, cal_idx) OVER w20 END"),
    "cov20": ("Cov($close, $volume, 20)", "CASE WHEN count(close) OVER w20 >= 2 THEN covar_samp(close, volume) OVER w20 END"),
    "med20": ("Med($close, 20)", "median(close) OVER w20"),
}


def supplied(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(bars, calendar) of the suppliers: only the days with sales, with cal_idx. Rows are dealt by instrument once, for the bars and for what windows over them need."""
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    calendar = working.cut(panels.calendar_of(line.select(F.to_date("l_shipdate").alias("datetime"))))
    rows = line.select(F.col("l_suppkey").cast("string").alias("instrument"), F.to_date("l_shipdate").alias("datetime"), "l_extendedprice", "l_quantity").repartition("instrument")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    bars = rows.groupBy("instrument", "datetime").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.sum("l_quantity").alias("volume"))
    return panels.placed(panels.nan_to_null(bars), calendar), calendar


def suppliers(spark: SparkSession, sf: str) -> Panel:
    bars, calendar = supplied(spark, sf)
    return Panel(panels.spread(bars, calendar))


@query("supply_factors", f"WITH {SUPPLY} SELECT instrument, datetime, {', '.join(f'round({s} + {OFF_TIES}, 4) AS {n}' for n, (_, s) in FACTORS.items())} FROM p WINDOW s AS (PARTITION BY instrument ORDER BY datetime), {', '.join(f'w{n} AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)' for n in (5, 20, 60))}")
def supply_factors(spark, sf):
    out = chunked.features(suppliers(spark, sf), {n: e for n, (e, _) in FACTORS.items()})
    return out.select("instrument", "datetime", *(F.round(F.col(n) + OFF_TIES, 4).alias(n) for n in FACTORS))


from tidemark import supply_queries  # noqa: E402, F401 - registers more
