"""Queries over the suppliers' and users' panels that grow with the tables: covariances, quantiles, holdings, sessions, limits; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import analytics, execution, feature_sets, gram, holdings, intraday, loaders, portfolio, processors, quantiles, resample
from tidemark.plans import chunked
from tidemark.plans.compiler import Panel, features
from tidemark.queries import OFF_TIES, SCORES, SUPPLY, USER, query, rounded, scored, supplied, suppliers, users
from tidemark.sources import bin_store, feature_store, panels, sessions, working
from tidemark.streaming import features as stateful

# --- covariances -------------------------------------------------------------------------------------------------

MOVES = f"{SUPPLY}, m AS (SELECT instrument, datetime, close / nullif(lag(close) OVER (PARTITION BY instrument ORDER BY datetime), 0) - 1 AS value FROM p), v AS (SELECT * FROM m WHERE value IS NOT NULL)"


def moves(spark, sf) -> DataFrame:
    return chunked.features(suppliers(spark, sf), {"value": "$close / Ref($close, 1) - 1"}).filter("value is not null")


@query("block_covariance", f"WITH {MOVES} SELECT a.instrument AS a, b.instrument AS b, count(*) AS n, round(covar_samp(a.value, b.value) + {OFF_TIES}, 6) AS cov FROM v a JOIN v b ON a.datetime = b.datetime AND a.instrument <= b.instrument GROUP BY 1, 2")
def block_covariance(spark, sf):
    return gram.sample_covariance(moves(spark, sf)).select("a", "b", "n", F.round(F.col("cov") + OFF_TIES, 6).alias("cov"))


@query("masked_covariance", f"WITH {MOVES}, c AS (SELECT *, value - avg(value) OVER (PARTITION BY instrument) AS x FROM v) SELECT a.instrument AS a, b.instrument AS b, round(avg(a.x * b.x) + {OFF_TIES}, 6) AS cov FROM c a JOIN c b ON a.datetime = b.datetime AND a.instrument <= b.instrument GROUP BY 1, 2")
def masked_covariance(spark, sf):
    return gram.covariance(moves(spark, sf), "mask").withColumn("cov", F.round(F.col("cov") + OFF_TIES, 6))


@query("filled_covariance", f"WITH {MOVES}, t AS (SELECT count(DISTINCT datetime) AS t FROM v), s AS (SELECT instrument, sum(value) AS s FROM v GROUP BY 1), x AS (SELECT a.instrument AS a, b.instrument AS b, sum(a.value * b.value) AS xy FROM v a JOIN v b ON a.datetime = b.datetime AND a.instrument <= b.instrument GROUP BY 1, 2) SELECT sa.instrument AS a, sb.instrument AS b, round(coalesce(xy, 0) / t - sa.s * sb.s / t / t + {OFF_TIES}, 6) AS cov FROM s sa JOIN s sb ON sa.instrument <= sb.instrument CROSS JOIN t LEFT JOIN x ON x.a = sa.instrument AND x.b = sb.instrument")
def filled_covariance(spark, sf):
    return gram.covariance(moves(spark, sf), "fill").withColumn("cov", F.round(F.col("cov") + OFF_TIES, 6))


# --- information coefficients of many models and labels ----------------------------------------------------------

MODELS = {"move": ("$close - Ref($close, 1)", "close - lag(close) OVER s"), "level": ("$close - Mean($close, 5)", "close - avg(close) OVER w5"), "volume": ("$volume", "volume")}
LABELS = {"next": ("Ref($close, -1) - $close", "lead(close) OVER s - close"), "later": ("Ref($close, -3) - Ref($close, -1)", "lead(close, 3) OVER s - lead(close, 1) OVER s")}
_PAIRS = " UNION ALL ".join(f"SELECT '{m}' AS model, '{k}' AS label_name, instrument, datetime, {m} AS score, {k} AS label FROM f WHERE {m} IS NOT NULL AND {k} IS NOT NULL" for m in MODELS for k in LABELS)


@query("all_ic", f"""WITH {USER}, f AS (SELECT instrument, datetime, {', '.join(f'{s} AS {n}' for n, (_, s) in (MODELS | LABELS).items())} FROM p WINDOW s AS (PARTITION BY instrument ORDER BY datetime), w5 AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
u AS ({_PAIRS}), r AS (SELECT *, rank() OVER (PARTITION BY model, label_name, datetime ORDER BY score) + (count(*) OVER (PARTITION BY model, label_name, datetime, score) - 1) / 2 AS rs, rank() OVER (PARTITION BY model, label_name, datetime ORDER BY label) + (count(*) OVER (PARTITION BY model, label_name, datetime, label) - 1) / 2 AS rl FROM u)
SELECT model, label_name, datetime, round(covar_samp(score, label) / nullif(stddev_samp(score) * stddev_samp(label), 0), 6) AS ic, round(covar_samp(rs, rl) / nullif(stddev_samp(rs) * stddev_samp(rl), 0), 6) AS rank_ic FROM r GROUP BY 1, 2, 3""")
def all_ic(spark, sf):
    rows = chunked.features(users(spark, sf), {n: e for n, (e, _) in (MODELS | LABELS).items()})
    return rounded(analytics.all_ic(analytics.long(rows, list(MODELS), "model", "score"), analytics.long(rows, list(LABELS), "label_name", "label")))


# --- quantiles ---------------------------------------------------------------------------------------------------


@query("supply_quantiles", f"WITH {SUPPLY}, q AS (SELECT instrument, quantile_cont(close, [0.05, 0.5, 0.95]) AS q FROM p WHERE close IS NOT NULL GROUP BY 1) SELECT instrument, p, round(q[k] + {OFF_TIES}, 4) AS value FROM q, (VALUES (1, 0.05::DOUBLE), (2, 0.5::DOUBLE), (3, 0.95::DOUBLE)) AS t(k, p)")
def supply_quantiles(spark, sf):
    bars = supplied(spark, sf)[0].select("instrument", F.col("close").alias("value"))
    return quantiles.quantiles(bars, ["instrument"], [0.05, 0.5, 0.95]).withColumn("value", F.round(F.col("value") + OFF_TIES, 4))


_BINS = f"{SUPPLY}, b AS (SELECT datetime, quantile_cont(close, [0.2, 0.4, 0.6, 0.8]) AS e FROM p WHERE close IS NOT NULL AND instrument LIKE '%1%' GROUP BY 1), g AS (SELECT instrument, datetime, close, volume, 5 - len(list_filter(e, lambda x: x <= close)) AS bin FROM p LEFT JOIN b USING (datetime) WHERE close IS NOT NULL)"


def binned(spark, sf) -> DataFrame:
    """Written once: an edge that is itself a close must meet the same close."""
    bars = working.cut(supplied(spark, sf)[0].filter("close is not null").select("instrument", "datetime", F.col("close").alias("value"), "volume"))
    return quantiles.percentile_bins(bars, bars.filter("instrument like '%1%'").select("datetime", "value"), 5)


@query("percentile_bins", f"WITH {_BINS} SELECT instrument, datetime, bin FROM g")
def percentile_bins(spark, sf):
    """Each date's bins are those of the suppliers with a 1 in their number."""
    return binned(spark, sf).select("instrument", "datetime", F.col("bin").cast("long").alias("bin"))


@query("brinson_binned", f"WITH {_BINS}, r AS (SELECT g.*, close / nullif(avg(close) OVER (PARTITION BY instrument), 0) - 1 AS ret FROM g WHERE bin IS NOT NULL), d AS (SELECT datetime, bin, sum(volume) AS v, count(*) AS n, sum(volume * ret) / sum(volume) AS pr, avg(ret) AS br FROM r GROUP BY 1, 2), w AS (SELECT *, v / sum(v) OVER (PARTITION BY datetime) AS pw, n / sum(n) OVER (PARTITION BY datetime) AS bw FROM d) SELECT datetime, round(sum((pw - bw) * br) + {OFF_TIES}, 6) AS raa, round(sum(bw * (pr - br)) + {OFF_TIES}, 6) AS rss, round(sum((pw - bw) * (pr - br)) + {OFF_TIES}, 6) AS rin, round(sum(pw * pr - bw * br) + {OFF_TIES}, 6) AS rtotal FROM w GROUP BY 1")
def brinson_binned(spark, sf):
    """Groups are the bins; the portfolio holds by volume, the benchmark equally."""
    rows = binned(spark, sf).filter("bin is not null").withColumn("ret", F.try_divide(F.col("value"), F.avg("value").over(Window.partitionBy("instrument"))) - 1)
    groups = rows.groupBy("datetime", F.col("bin").alias("group")).agg(F.sum("volume").alias("v"), F.count("*").alias("n"), F.try_divide(F.sum(F.col("volume") * F.col("ret")), F.sum("volume")).alias("pr"), F.avg("ret").alias("br"))
    date = Window.partitionBy("datetime")
    weighted = groups.select("datetime", "group", "pr", "br", (F.col("v") / F.sum("v").over(date)).alias("pw"), (F.col("n") / F.sum("n").over(date)).alias("bw"))
    return portfolio.brinson(weighted).select("datetime", *(F.round(F.col(c) + OFF_TIES, 6).alias(c) for c in ("raa", "rss", "rin", "rtotal")))


# --- the technical set, whole and normalised by section ----------------------------------------------------------


def _div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def _technical_sql() -> dict[str, str]:
    """Column -> SQL over x, which has what the families need of a bar and the one before it."""
    span, top, low = "(high - low + 1e-12)", "greatest(open, close)", "least(open, close)"
    out = {
        "KMID": _div("close - open", "open"), "KLEN": _div("high - low", "open"), "KMID2": _div("close - open", span), "KUP": _div(f"high - {top}", "open"), "KUP2": _div(f"high - {top}", span), "KLOW": _div(f"{low} - low", "open"),
        "KLOW2": _div(f"{low} - low", span), "KSFT": _div("2 * close - high - low", "open"), "KSFT2": _div("2 * close - high - low", span), **{f"{f.upper()}0": _div(f, "close") for f in ("open", "high", "low", "vwap")},
    }
    for d in feature_sets.WINDOWS:
        w = f"OVER w{d}"
        place = lambda c, best, w=w: f"CASE WHEN count({c}) {w} > 0 THEN coalesce(nullif(list_position(list_transform(list({c}) {w}, lambda x: x IS NULL), true), 0), list_position(list({c}) {w}, {best}({c}) {w})) END"
        corr = lambda a, b, w=w: f"CASE WHEN stddev_samp({a}) {w} > 2e-5 AND stddev_samp({b}) {w} > 2e-5 THEN covar_samp(CASE WHEN {b} IS NOT NULL THEN {a} END, CASE WHEN {a} IS NOT NULL THEN {b} END) {w} / nullif(stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) {w} * stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END) {w}, 0) END"
        slope, enough = f"regr_slope(close, cal_idx) {w}", f"CASE WHEN count(close) {w} >= 2 THEN "
        rest = lambda a, b, w=w: _div(f"sum({a}) {w}", f"sum({b}) {w} + 1e-12")
        out |= {
            f"ROC{d}": _div(f"lag(close, {d}) OVER s", "close"), f"MA{d}": _div(f"avg(close) {w}", "close"), f"STD{d}": _div(f"stddev_samp(close) {w}", "close"), f"BETA{d}": f"{enough}{_div(slope, 'close')} END",
            f"RSQR{d}": f"CASE WHEN count(close) {w} >= 2 AND stddev_samp(close) {w} > 2e-5 THEN regr_r2(close, cal_idx) {w} END", f"RESI{d}": f"{enough}{_div(f'close - ({slope} * cal_idx + regr_intercept(close, cal_idx) {w})', 'close')} END",
            f"MAX{d}": _div(f"max(high) {w}", "close"), f"MIN{d}": _div(f"min(low) {w}", "close"), f"QTLU{d}": _div(f"quantile_cont(close, 0.8) {w}", "close"), f"QTLD{d}": _div(f"quantile_cont(close, 0.2) {w}", "close"),
            f"RANK{d}": f"CASE WHEN close IS NOT NULL THEN (len(list_filter(list(close) {w}, lambda x: x < close)) + (len(list_filter(list(close) {w}, lambda x: x = close)) + 1) / 2) / count(close) {w} END",
            f"RSV{d}": _div(f"close - min(low) {w}", f"max(high) {w} - min(low) {w} + 1e-12"), f"IMAX{d}": f"({place('high', 'max')}) / {d}", f"IMIN{d}": f"({place('low', 'min')}) / {d}", f"IMXD{d}": f"(({place('high', 'max')}) - ({place('low', 'min')})) / {d}",
            f"CORR{d}": corr("close", "lv"), f"CORD{d}": corr("cr", "vr"), f"CNTP{d}": f"avg(gain) {w}", f"CNTN{d}": f"avg(loss) {w}", f"CNTD{d}": f"avg(gain) {w} - avg(loss) {w}",
            f"SUMP{d}": rest("up", "step"), f"SUMN{d}": rest("down", "step"), f"SUMD{d}": _div(f"sum(up) {w} - sum(down) {w}", f"sum(step) {w} + 1e-12"), f"VMA{d}": _div(f"avg(volume) {w}", "volume + 1e-12"), f"VSTD{d}": _div(f"stddev_samp(volume) {w}", "volume + 1e-12"),
            f"WVMA{d}": _div(f"stddev_samp(swing) {w}", f"avg(swing) {w} + 1e-12"), f"VSUMP{d}": rest("vup", "vstep"), f"VSUMN{d}": rest("vdown", "vstep"), f"VSUMD{d}": _div(f"sum(vup) {w} - sum(vdown) {w}", f"sum(vstep) {w} + 1e-12"),
        }
    return out


_BOTH = "CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest({a} - {b}, 0) END"
TECHNICAL = f"""{USER}, y AS (SELECT *, lag(close) OVER s AS pc, lag(volume) OVER s AS pv FROM p WINDOW s AS (PARTITION BY instrument ORDER BY datetime)),
x AS (SELECT *, CASE WHEN volume + 1 > 0 THEN ln(volume + 1) END AS lv, close / nullif(pc, 0) AS cr, CASE WHEN volume / nullif(pv, 0) + 1 > 0 THEN ln(volume / nullif(pv, 0) + 1) END AS vr, abs(close / nullif(pc, 0) - 1) * volume AS swing,
CAST(coalesce(close > pc, false) AS DOUBLE) AS gain, CAST(coalesce(close < pc, false) AS DOUBLE) AS loss, {_BOTH.format(a='close', b='pc')} AS up, {_BOTH.format(a='pc', b='close')} AS down, abs(close - pc) AS step, {_BOTH.format(a='volume', b='pv')} AS vup, {_BOTH.format(a='pv', b='volume')} AS vdown, abs(volume - pv) AS vstep FROM y)"""
_OVER = "WINDOW s AS (PARTITION BY instrument ORDER BY datetime), " + ", ".join(f"w{d} AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)" for d in feature_sets.WINDOWS)


@query("technical_set", f"WITH {TECHNICAL} SELECT instrument, datetime, {', '.join(f'round({s} + {OFF_TIES}, 4) AS {n}' for n, s in _technical_sql().items())} FROM x {_OVER}")
def technical_set(spark, sf):
    """All 158 columns over the users' panel, in chunks of time."""
    every = feature_sets.technical()
    out = chunked.features(users(spark, sf), every)
    return out.select("instrument", "datetime", *(F.round(F.col(n) + OFF_TIES, 4).alias(n) for n in every))


_SECTION = {"KLEN": ["CASE WHEN {x} >= 0 THEN pow({x}, 0.25) END"], "KLOW2": ["CASE WHEN {x} >= 0 THEN pow({x}, 0.25) END", "CASE WHEN {x} >= 0 THEN sqrt({x}) END"], "KMID": ["{x}"], "ROC5": ["{x}"], "STD10": ["CASE WHEN {x} > 0 THEN ln({x}) END"], "RSQR10": ["coalesce({x}, 0)"], "MAX5": ["{x}", "CASE WHEN {x} >= 1 THEN sqrt({x} - 1) END"], "MIN5": ["CASE WHEN {x} <= 1 THEN sqrt(1 - {x}) END"], "WVMA5": ["CASE WHEN {x} > -1 THEN ln(1 + {x}) END"], "RANK5": []}


def _section_sql() -> str:
    names, parts, last = list(_SECTION), [], "t0"
    every = _technical_sql()
    parts.append(f"t0 AS (SELECT instrument, datetime, {', '.join(f'{every[n]} AS {n}' for n in names)} FROM x {_OVER})")
    for turn in range(2):
        own = {n: steps[turn] for n, steps in _SECTION.items() if len(steps) > turn}
        pick = lambda f, own=own: ", ".join(f(n) if n in own else n for n in names)
        parts.append(f"a{turn} AS (SELECT instrument, datetime, {pick(lambda n, own=own: own[n].format(x=n) + ' AS ' + n)} FROM {last})")
        parts.append(f"b{turn} AS (SELECT instrument, datetime, {pick(lambda n: f'{n} - median({n}) OVER d AS {n}')} FROM a{turn} WINDOW d AS (PARTITION BY datetime))")
        parts.append(f"c{turn} AS (SELECT instrument, datetime, {pick(lambda n: f'{n} / nullif(median(abs({n})) OVER d * 1.4826, 0) AS {n}')} FROM b{turn} WINDOW d AS (PARTITION BY datetime))")
        parts.append(f"t{turn + 1} AS (SELECT instrument, datetime, {pick(lambda n: f'coalesce(CASE WHEN {n} > 3 THEN 3 + ({n} - 3) / nullif(max({n}) OVER d - 3, 0) * 0.5 WHEN {n} < -3 THEN -3 - ({n} + 3) / nullif(min({n}) OVER d + 3, 0) * 0.5 ELSE {n} END, 0) AS {n}')} FROM c{turn} WINDOW d AS (PARTITION BY datetime))")
        last = f"t{turn + 1}"
    return f"WITH {TECHNICAL}, {', '.join(parts)} SELECT instrument, datetime, {', '.join(f'round({n} + {OFF_TIES}, 4) AS {n}' for n in names)} FROM {last}"


@query("section_processed", _section_sql())
def section_processed(spark, sf):
    """Without the correlations: over two bars they are 1 or -1 but for the last digit, and the median distance of such values is noise."""
    every = feature_sets.technical()
    rows = chunked.features(users(spark, sf), {n: every[n] for n in _SECTION})
    out = processors.Section().apply(rows, {"feature": list(_SECTION)})
    return out.select("instrument", "datetime", *(F.round(F.col(n) + OFF_TIES, 4).alias(n) for n in _SECTION))


# --- holdings: what each nation's customers have of a supplier in a month ----------------------------------------

HELD = """
h AS (SELECT c_nationkey AS holder, CAST(l_suppkey AS VARCHAR) AS instrument, CAST(date_trunc('month', l_shipdate) AS DATE) AS datetime, sum(l_quantity) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
pr AS (SELECT CAST(l_suppkey AS VARCHAR) AS instrument, CAST(date_trunc('month', l_shipdate) AS DATE) AS datetime, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem GROUP BY 1, 2),
po AS (SELECT holder, instrument, datetime, amount, price FROM h JOIN pr USING (instrument, datetime)),
d AS (SELECT holder, datetime, sum(amount * price) AS total, row_number() OVER (PARTITION BY holder ORDER BY datetime) AS k, lead(datetime) OVER (PARTITION BY holder ORDER BY datetime) AS nxt FROM po GROUP BY 1, 2),
e AS (SELECT po.*, amount * price / total AS weight, k, nxt, lag(k) OVER w AS bk, lead(k) OVER w AS fk FROM po JOIN d USING (holder, datetime) WINDOW w AS (PARTITION BY holder, instrument ORDER BY k)),
st AS (SELECT holder, instrument, datetime, amount, price, weight, CASE WHEN bk = k - 1 THEN 0 ELSE 1 END AS status FROM e UNION ALL SELECT holder, instrument, nxt, amount, price, weight, -1 FROM e WHERE nxt IS NOT NULL AND (fk IS NULL OR fk > k + 1)),
la AS (SELECT instrument, datetime, lead(price) OVER (PARTITION BY instrument ORDER BY datetime) / price - 1 AS label FROM pr),
be AS (SELECT datetime, avg(label) AS bench FROM la GROUP BY 1)
"""


def held(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(positions, prices)."""
    line, orders, customer = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "orders", "customer"))
    bought = line.select("l_orderkey", F.col("l_suppkey").cast("string").alias("instrument"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("datetime"), "l_quantity", "l_extendedprice")
    prices = bought.groupBy("instrument", "datetime").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))
    owner = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("holder"))
    amounts = bought.join(owner, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("holder", "instrument", "datetime").agg(F.sum("l_quantity").alias("amount"))
    return holdings.valued(amounts, prices), prices


def labels(prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    label = prices.select("instrument", "datetime", (F.lead("price").over(Window.partitionBy("instrument").orderBy("datetime")) / F.col("price") - 1).alias("label"))
    return label, label.groupBy("datetime").agg(F.avg("label").alias("bench"))


@query("holding_status", f"WITH {HELD} SELECT holder, instrument, datetime, amount, round(price + {OFF_TIES}, 4) AS price, round(weight + {OFF_TIES}, 6) AS weight, status FROM st")
def holding_status(spark, sf):
    out = holdings.statuses(held(spark, sf)[0])
    return out.select("holder", "instrument", "datetime", "amount", F.round(F.col("price") + OFF_TIES, 4).alias("price"), F.round(F.col("weight") + OFF_TIES, 6).alias("weight"), "status")


_VALUES = ["hold_value", "hold_weight", "hold_mean", "buy_value", "buy_weight", "buy_mean", "sell_value", "sell_weight", "sell_mean"]
_DAY = ", ".join(f"coalesce(sum(x * weight) FILTER (status = {s}), 0) AS {n}_value, coalesce(sum(weight) FILTER (status = {s}), 0) AS {n}_weight, coalesce(sum(x * weight) FILTER (status = {s}) / nullif(sum(weight) FILTER (status = {s}), 0), 0) AS {n}_mean" for n, s in (("hold", 0), ("buy", 1), ("sell", -1)))


@query("holding_attribution", f"WITH {HELD}, x AS (SELECT st.*, label - bench AS x FROM st JOIN la USING (instrument, datetime) JOIN be USING (datetime) WHERE label IS NOT NULL), g AS (SELECT holder, datetime, {_DAY} FROM x GROUP BY 1, 2), c AS (SELECT *, {', '.join(f'sum({n}_mean) OVER w AS cum_{n}' for n in ('hold', 'buy', 'sell'))} FROM g WINDOW w AS (PARTITION BY holder ORDER BY datetime)) SELECT holder, datetime, {', '.join(f'round({c} + {OFF_TIES}, 6) AS {c}' for c in [*_VALUES, 'cum_hold', 'cum_buy', 'cum_sell'])} FROM c")
def holding_attribution(spark, sf):
    positions, prices = held(spark, sf)
    out = holdings.attribution(holdings.statuses(positions), *labels(prices))
    return out.select("holder", "datetime", *(F.round(F.col(c) + OFF_TIES, 6).alias(c) for c in [*_VALUES, "cum_hold", "cum_buy", "cum_sell"]))


@query("holding_label_ranks", f"WITH {HELD}, j AS (SELECT st.*, label FROM st LEFT JOIN la USING (instrument, datetime)), r AS (SELECT *, CASE WHEN label IS NOT NULL THEN (rank() OVER (PARTITION BY holder, datetime ORDER BY label DESC NULLS LAST) + (count(*) OVER (PARTITION BY holder, datetime, label) - 1) / 2) / count(*) OVER (PARTITION BY holder, datetime) * 100 END AS rank_ratio, label - avg(label) OVER (PARTITION BY holder, datetime) AS excess_return FROM j) SELECT holder, instrument, datetime, status, round(rank_ratio + {OFF_TIES}, 4) AS rank_ratio, round(avg(rank_ratio) OVER (PARTITION BY holder, datetime, status) + {OFF_TIES}, 4) AS rank_label_mean, round(excess_return + {OFF_TIES}, 4) AS excess_return FROM r")
def holding_label_ranks(spark, sf):
    positions, prices = held(spark, sf)
    positions = working.written(positions.select("holder", "instrument", "datetime"))
    out = holdings.label_ranks(holdings.spells(positions), labels(prices)[0], 2 * positions.count())
    return out.select("holder", "instrument", "datetime", "status", *(F.round(F.col(c) + OFF_TIES, 4).alias(c) for c in ("rank_ratio", "rank_label_mean", "excess_return")))


# --- sessions: hours of the day with a break at noon --------------------------------------------------------------

DAY = sessions.Sessions((("08:00", "12:00"), ("13:00", "18:00")), 60)
HOURS = """
k AS (SELECT CAST(user_id AS VARCHAR) AS instrument, CAST(ts AS DATE) AS day, hour(ts) - CASE WHEN hour(ts) < 12 THEN 8 ELSE 9 END AS slot, avg(value) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events WHERE hour(ts) BETWEEN 8 AND 11 OR hour(ts) BETWEEN 13 AND 17 GROUP BY 1, 2, 3),
dd AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS day_idx FROM (SELECT DISTINCT day FROM k)),
z AS (SELECT instrument, day_idx, slot, day_idx * 9 + slot AS cal_idx, close, volume FROM k JOIN dd USING (day)),
n AS (SELECT instrument, min(cal_idx) AS a, max(cal_idx) AS b FROM z GROUP BY 1),
sp AS (SELECT instrument, unnest(range(a, b + 1)) AS cal_idx FROM n),
pp AS (SELECT sp.instrument, sp.cal_idx, sp.cal_idx // 9 AS day_idx, sp.cal_idx % 9 AS slot, close, volume FROM sp LEFT JOIN z USING (instrument, cal_idx)),
t AS (SELECT pp.*, CAST(day AS TIMESTAMP) + to_hours(CAST(slot + CASE WHEN slot < 4 THEN 8 ELSE 9 END AS BIGINT)) AS datetime FROM pp JOIN dd USING (day_idx))
"""


def hourly(spark, sf) -> Panel:
    events = spark.read.parquet(f"{sf}/events.parquet")
    bars = events.groupBy(F.col("user_id").cast("string").alias("instrument"), F.date_trunc("hour", "ts").alias("datetime")).agg(F.avg("value").alias("close"), F.count("*").cast("double").alias("volume"))
    return sessions.panel(bars, DAY, sessions.days_of(bars.filter(DAY.slot(F.col("datetime")).isNotNull())))


@query("session_features", f"WITH {HOURS} SELECT instrument, datetime, round(avg(close) OVER w, 6) AS mean, round(lag(close, 9) OVER s, 6) AS yesterday FROM t WINDOW s AS (PARTITION BY instrument ORDER BY cal_idx), w AS (PARTITION BY instrument ORDER BY cal_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")
def session_features(spark, sf):
    """Six bars back over the noon break and the night; nine bars back is the same hour of the day before."""
    return rounded(chunked.features(hourly(spark, sf), {"mean": "Mean($close, 6)", "yesterday": f"Ref($close, {DAY.slots})"}))


@query("session_slots", f"WITH {HOURS} SELECT a.instrument, a.datetime, a.slot, round(b.close, 6) AS same_slot, round(c.close, 6) AS last_hour FROM t a LEFT JOIN t b ON b.instrument = a.instrument AND b.day_idx = a.day_idx - 1 AND b.slot = a.slot LEFT JOIN t c ON c.instrument = a.instrument AND c.day_idx = a.day_idx - 1 AND c.slot = 8")
def session_slots(spark, sf):
    """The close of the same slot, and of the last slot, of the day before, by joins on day and slot."""
    p = hourly(spark, sf)
    rows = p.bars.withColumn("day_idx", F.floor(F.col("cal_idx") / DAY.slots)).withColumn("slot", F.col("cal_idx") % DAY.slots)
    out = sessions.earlier(sessions.earlier(rows, {"same_slot": "close"}), {"last_hour": "close"}, slot=DAY.slots - 1)
    return rounded(out.select("instrument", "datetime", "slot", "same_slot", "last_hour"))


@query("intraday_set", f"""WITH {HOURS}, f AS (SELECT *, last_value(close IGNORE NULLS) OVER s AS filled, avg(volume) OVER (PARTITION BY instrument ORDER BY cal_idx ROWS BETWEEN 269 PRECEDING AND CURRENT ROW) AS mean, lag(close, 9) OVER s AS close_1, lag(volume, 9) OVER s AS volume_1, row_number() OVER s AS place FROM t WINDOW s AS (PARTITION BY instrument ORDER BY cal_idx)),
r AS (SELECT f.instrument, f.datetime, f.cal_idx, f.place, f.close / nullif(b2.filled, 0) AS r0, f.close_1 / nullif(b1.filled, 0) AS r1, coalesce(f.volume / nullif(b1.mean, 0), 0) AS v0, coalesce(f.volume_1 / nullif(b1.mean, 0), 0) AS v1
FROM f LEFT JOIN f b1 ON b1.instrument = f.instrument AND b1.day_idx = f.day_idx - 1 AND b1.slot = 8 LEFT JOIN f b2 ON b2.instrument = f.instrument AND b2.day_idx = f.day_idx - 2 AND b2.slot = 8),
o AS (SELECT instrument, datetime, place, last_value(r0 IGNORE NULLS) OVER s AS close, last_value(r1 IGNORE NULLS) OVER s AS close_1, v0, v1 FROM r WINDOW s AS (PARTITION BY instrument ORDER BY cal_idx))
SELECT instrument, datetime, round(close, 6) AS close, round(close_1, 6) AS close_1, round(v0, 6) AS volume, round(v1, 6) AS volume_1 FROM o WHERE place > 18""")
def intraday_set(spark, sf):
    """Each user's hourly means over the close of two days before, those of the day before over its close, and volumes over thirty days' mean."""
    return rounded(intraday.normalised(hourly(spark, sf), DAY, ("close",)))


@query("intraday_quotes", f"WITH {HOURS}, f AS (SELECT *, last_value(CASE WHEN volume > 1 OR slot = 8 THEN close END IGNORE NULLS) OVER s AS close0, last_value(close IGNORE NULLS) OVER s AS filled FROM t WINDOW s AS (PARTITION BY instrument ORDER BY cal_idx)) SELECT instrument, datetime, round(close0, 6) AS close0, round(coalesce(vwap, filled), 6) AS vwap0, coalesce(volume, 0) AS volume0 FROM (SELECT *, CASE WHEN slot % 2 = 0 THEN close END AS vwap FROM f) WHERE volume > 1 OR slot = 8")
def intraday_quotes(spark, sf):
    """Hours with more than one event, and each day's last: the last such hour's close, a price that stands in even slots only, and volumes."""
    p, slot = hourly(spark, sf), F.col("cal_idx") % DAY.slots
    p = Panel(p.bars.withColumn("vwap", F.when(slot % 2 == 0, F.col("close"))), p.context)
    busy = intraday.quotes(p, DAY, amounts=("volume",), keep=(F.col("volume") > 1) | (slot == DAY.slots - 1))
    return rounded(busy)


@query("coarser_frequency", "WITH x AS (SELECT CAST(user_id AS VARCHAR) AS instrument, CAST(date_trunc('month', ts) AS DATE) AS m, CAST(ts AS DATE) AS d, value FROM events), f AS (SELECT m, min(d) AS datetime FROM x GROUP BY 1) SELECT instrument, datetime, round(sum(value), 6) AS total, max(value) AS top FROM x JOIN f USING (m) GROUP BY 1, 2")
def coarser_frequency(spark, sf):
    """Months are asked for, minutes are stored."""
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("instrument"), F.col("ts").alias("datetime"), "value")
    return rounded(sessions.at_frequency("month", {"min": events}, {"total": F.sum("value"), "top": F.max("value")}))


# --- limits that orders on one instrument share, sequences with gaps, bits -----------------------------------------

ORDERED = f"{USER}, o AS (SELECT instrument, datetime, cal_idx, place, (cal_idx % 4) * place AS amount, coalesce(volume, 0) AS volume FROM p, (VALUES (1), (2), (3)) AS t(place)), l AS (SELECT instrument, datetime, place, amount, sum(CASE WHEN place = 1 THEN volume * 0.5 ELSE 0 END) OVER (PARTITION BY instrument ORDER BY datetime) AS can, row_number() OVER (PARTITION BY instrument ORDER BY datetime, place) AS k FROM o)"


@query("shared_volume_limit", f"WITH RECURSIVE {ORDERED.strip()}, r AS (SELECT instrument, datetime, place, k, greatest(least(amount, can), 0)::DOUBLE AS deal, greatest(least(amount, can), 0)::DOUBLE AS dealt FROM l WHERE k = 1 UNION ALL SELECT l.instrument, l.datetime, l.place, l.k, greatest(least(amount, can - dealt), 0), dealt + greatest(least(amount, can - dealt), 0) FROM r JOIN l ON l.instrument = r.instrument AND l.k = r.k + 1) SELECT instrument, datetime, place, round(deal, 6) AS deal_amount FROM r")
def shared_volume_limit(spark, sf):
    """Three orders on each bar of a user take their turns at half of the volume so far."""
    rows = users(spark, sf).bars.withColumn("place", F.explode(F.array(*(F.lit(k) for k in (1, 2, 3)))))
    orders = rows.select(F.concat_ws("-", "instrument", "place").alias("order_id"), "instrument", "datetime", "place", ((F.col("cal_idx") % 4) * F.col("place")).cast("double").alias("amount"), "volume")
    return rounded(execution.volume_limited(orders, 0.5, "cum", place="place").select("instrument", "datetime", "place", "deal_amount"))


def _filled_sql(steps: int) -> str:
    own = "list(close) OVER w"
    padded = f"list_concat(list_resize([]::DOUBLE[], {steps} - len({own})), {own})"
    forward = f"list_transform(range(1, {steps} + 1), lambda i: list_extract(list_filter(list_slice(v, 1, i), lambda x: x IS NOT NULL), -1))"
    backward = f"list_transform(range(1, {steps} + 1), lambda i: coalesce(f[i], list_filter(f, lambda x: x IS NOT NULL)[1]))"
    return f"WITH {USER}, a AS (SELECT instrument, datetime, {padded} AS v FROM p WINDOW w AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN {steps - 1} PRECEDING AND CURRENT ROW)), b AS (SELECT *, {forward} AS f FROM a), c AS (SELECT *, {backward} AS g FROM b) SELECT instrument, datetime, {', '.join(f'round({s}[{i}], 6) AS {n}{i}' for n, s in (('none', 'v'), ('forward', 'f'), ('both', 'g')) for i in range(1, steps + 1))} FROM c"


@query("filled_sequences", _filled_sql(4))
def filled_sequences(spark, sf):
    bars, out = users(spark, sf).bars.select("instrument", "datetime", "close"), None
    for name, fill in (("none", "none"), ("forward", "ffill"), ("both", "ffill+bfill")):
        s = processors.sequences(bars, ["close"], 4, fill=fill).select("instrument", "datetime", *(F.col("steps")[i][0].alias(f"{name}{i + 1}") for i in range(4)))
        out = s if out is None else out.join(s, ["instrument", "datetime"])
    return rounded(out)


@query("bitwise", f"WITH {USER}, n AS (SELECT instrument, datetime, CAST(volume AS BIGINT) AS n, cal_idx AS k FROM p) SELECT instrument, datetime, n & 6 AS a, n | k AS o, ~n AS i, (n & 1) | 8 AS both FROM n")
def bitwise(spark, sf):
    p = users(spark, sf)
    whole = Panel(p.bars.select("instrument", "datetime", "cal_idx", F.col("volume").cast("long").alias("n"), F.col("cal_idx").alias("k")), p.context)
    return features(whole, {"a": "And($n, 6)", "o": "Or($n, $k)", "i": "Not($n)", "both": "Or(And($n, 1), 8)"})


@query("day_batches", f"WITH {SCORES} SELECT datetime, row_number() OVER (PARTITION BY datetime ORDER BY instrument) - 1 AS slot, instrument, round(score, 6) AS value FROM q")
def day_batches(spark, sf):
    out = processors.day_batches(scored(spark, sf), ["score"])
    return out.select("datetime", F.col("slot").cast("long").alias("slot"), "instrument", F.round(F.col("values")[0], 6).alias("value"))


# --- vendor data: prices of some days are quoted in hundredths ----------------------------------------------------

VENDOR = SUPPLY + """, gl AS (SELECT instrument, datetime, cal_idx, close * CASE WHEN cal_idx % 41 IN (7, 8, 9, 10) THEN 100 ELSE 1 END AS close, high * CASE WHEN cal_idx % 41 IN (7, 8, 9, 10) THEN 100 ELSE 1 END AS high, CASE WHEN cal_idx % 13 = 5 THEN 0 ELSE volume END AS volume FROM p),
li AS (SELECT instrument, datetime, cal_idx, CASE WHEN volume > 0 THEN close END AS close, CASE WHEN volume > 0 THEN high END AS high, CASE WHEN volume > 0 THEN volume END AS volume FROM gl),
ra AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY cal_idx) AS i, close / last_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY cal_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM li),
sk AS (SELECT *, round(1 - log10(r) / 2) AS k FROM ra)"""
VENDOR_STEPS = "e AS (SELECT instrument, i, 0::DOUBLE AS e FROM sk WHERE i = 1 UNION ALL SELECT sk.instrument, sk.i, CASE WHEN sk.close IS NULL THEN e.e WHEN k >= 0 AND r * pow(100, k) - 1 BETWEEN 89 AND 111 THEN greatest(0, e.e + 1 - k) ELSE 0 END FROM e JOIN sk ON sk.instrument = e.instrument AND sk.i = e.i + 1)"


def vendor(bars: DataFrame) -> DataFrame:
    times = F.when((F.col("cal_idx") % 41).between(7, 10), 100).otherwise(1)
    return bars.select("instrument", "datetime", (F.col("close") * times).alias("close"), (F.col("high") * times).alias("high"), F.when(F.col("cal_idx") % 13 == 5, 0.0).otherwise(F.col("volume")).alias("volume"))


@query("vendor_normalised", f"WITH RECURSIVE {VENDOR.strip()}, {VENDOR_STEPS}, f AS (SELECT sk.instrument, datetime, close / pow(100, e) AS close, high / pow(100, e) AS high, volume FROM sk JOIN e USING (instrument, i)), kn AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY datetime) AS known FROM f) SELECT instrument, datetime, round(close + {OFF_TIES}, 4) AS close, round(high + {OFF_TIES}, 4) AS high, volume, round(known / lag(known) OVER (PARTITION BY instrument ORDER BY datetime) - 1 + {OFF_TIES}, 6) AS change FROM kn")
def vendor_normalised(spark, sf):
    bars, calendar = supplied(spark, sf)
    out = panels.normalised(vendor(bars), calendar=calendar)
    return out.select("instrument", "datetime", F.round(F.col("close") + OFF_TIES, 4).alias("close"), F.round(F.col("high") + OFF_TIES, 4).alias("high"), "volume", F.round(F.col("change") + OFF_TIES, 6).alias("change"))


@query("vendor_adjusted", f"WITH {SUPPLY}, a AS (SELECT *, close / (1 + (cal_idx // 100) % 3) AS adjclose FROM p), b AS (SELECT *, last_value(adjclose / close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY datetime) AS f FROM a), c AS (SELECT instrument, datetime, close * f AS close, high * f AS high, low * f AS low, f, volume / f AS volume, first_value(close * f IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS one FROM b) SELECT instrument, datetime, {', '.join(f'round({e} + {OFF_TIES}, 6) AS {n}' for n, e in (('close', 'close / one'), ('high', 'high / one'), ('low', 'low / one'), ('factor', 'f / one')))}, round(volume * one + {OFF_TIES}, 2) AS volume FROM c")
def vendor_adjusted(spark, sf):
    bars = suppliers(spark, sf).bars
    out = panels.adjusted(bars.withColumn("adjclose", F.col("close") / (1 + F.floor(F.col("cal_idx") / 100) % 3)))
    return out.select("instrument", "datetime", *(F.round(F.col(c) + OFF_TIES, 6).alias(c) for c in ("close", "high", "low", "factor")), F.round(F.col("volume") + OFF_TIES, 2).alias("volume"))


# --- stored features, written up to a day and brought up to date ---------------------------------------------------


@query("updated_store", f"WITH {USER} SELECT instrument, datetime, round(avg(close) OVER w5, 6) AS mean, round(lead(close, 2) OVER s - close, 6) AS next FROM p WINDOW s AS (PARTITION BY instrument ORDER BY datetime), w5 AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def updated_store(spark, sf):
    """Features of the bars up to the 20th of the month, then those of all bars merged in, equal those of all bars."""
    fields = {"mean": "Mean($close, 5)", "next": "Ref($close, -2) - $close"}
    path, p = working.fresh_path(spark, "features"), users(spark, sf)
    known = p.bars.filter(F.col("close").isNotNull()).drop("cal_idx")
    feature_store.create(panels.panel(known.filter("datetime <= '2024-01-20'")), fields, path)
    feature_store.update(path, p, fields)
    return rounded(feature_store.read(spark, path).drop("part"))


# --- binary field files, written and read by the data source -------------------------------------------------------


@query("bin_round_trip", f"WITH {SUPPLY}, f AS (SELECT instrument, 'close' AS field, cal_idx, CAST(CAST(close AS FLOAT) AS DOUBLE) AS value FROM p UNION ALL SELECT instrument, 'volume', cal_idx, volume FROM p) SELECT instrument, field, cal_idx, round(value + {OFF_TIES}, 2) AS value FROM f WHERE cal_idx BETWEEN 100 AND 900 AND (field = 'volume' OR instrument LIKE '%1')")
def bin_round_trip(spark, sf):
    """Written in two steps, the second behind the first; read by field and range. Only days with sales are written: the files themselves fill the gaps between them."""
    (p, _), path = supplied(spark, sf), working.fresh_path(spark, "bins")
    rows = p.select("instrument", "cal_idx", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in ("close", "volume")))).alias("x")).select("instrument", "x.field", "cal_idx", "x.value")
    bin_store.save(rows.filter("cal_idx < 500"), path)
    bin_store.save(rows.filter("cal_idx >= 500"), path)
    out = bin_store.load(spark, path, fields=["volume"], low=100, high=900).unionByName(bin_store.load(spark, path, push=True).filter("field = 'close' and instrument like '%1' and cal_idx between 100 and 900"))
    return out.withColumn("value", F.round(F.col("value") + OFF_TIES, 2))


# --- a stream of bars with its last bars as state ------------------------------------------------------------------


@query("stream_features", "WITH raw AS (SELECT CAST(user_id AS VARCHAR) AS instrument, CAST(ts AS DATE) AS datetime, avg(value) AS value FROM events GROUP BY 1, 2), f AS (SELECT instrument, datetime, avg(value) OVER w AS mean, median(value) OVER w AS med, lag(value, 2) OVER s AS before FROM raw WINDOW s AS (PARTITION BY instrument ORDER BY datetime), w AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT instrument, datetime, round(mean, 6) AS mean, round(med, 6) AS med, round(before, 6) AS before FROM f WHERE datetime <= (SELECT max(datetime) - 1 FROM raw)")
def stream_features(spark, sf):
    """Each user's daily means in two files, the second read after a restart; the last day stays behind the watermark."""
    events, path = spark.read.parquet(f"{sf}/events.parquet"), working.fresh_path(spark, "stream")
    bars = events.groupBy(F.col("user_id").cast("string").alias("instrument"), F.date_trunc("day", "ts").alias("datetime")).agg(F.avg("value").alias("value"))
    asked = (stateful.Feature("mean", "mean", 5), stateful.Feature("med", "med", 5), stateful.Feature("before", "ref", 2))
    days = bars.select("datetime").distinct().select("datetime", F.ntile(2).over(Window.orderBy("datetime")).alias("half"))  # over the calendar
    for half in (1, 2):
        bars.join(F.broadcast(days.filter(F.col("half") == half)), "datetime").select("instrument", "datetime", "value").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("instrument string, datetime timestamp, value double").parquet(f"{path}/in")
        stateful.run_available(stateful.stream_features(stream, asked, "1 day"), f"{path}/out")
    out = spark.read.parquet(f"{path}/out/data")
    return rounded(out.withColumn("datetime", F.to_date("datetime")))


# --- aggregates of users' own in resampling ------------------------------------------------------------------------


@resample.register("range_share")
def _range_share(x, t, low):
    """The last value's place between the bin's least low and greatest value."""
    return F.try_divide(F.max_by(x, F.when(x.isNotNull(), t)) - F.min(low), F.max(x) - F.min(low))


@query("resample_own", f"WITH {USER}, b AS (SELECT instrument, time_bucket(INTERVAL 7 DAY, datetime, DATE '1970-01-01') AS datetime, sum(close * volume) / nullif(sum(volume) FILTER (close IS NOT NULL), 0) AS price, (arg_max(close, datetime) FILTER (close IS NOT NULL) - min(low)) / nullif(max(close) - min(low), 0) AS place FROM p GROUP BY 1, 2) SELECT instrument, datetime::DATE AS datetime, round(price, 6) AS price, round(place, 6) AS place FROM b")
def resample_own(spark, sf):
    """Weekly volume-weighted prices, and a registered aggregate over two fields."""
    out = resample.resample(users(spark, sf), {"price": ("$close", "wmean", "$volume"), "place": ("$close", "range_share", "$low")}, "7d")
    return rounded(out.withColumn("datetime", F.to_date("datetime")))


# --- ranges that roll, loaders over handlers, ensembles by groups ---------------------------------------------------


@query("rolling_ranges", f"WITH {USER}, d AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS k FROM (SELECT DISTINCT datetime FROM p)), c AS (SELECT u.datetime AS upto, p.* FROM d u JOIN d b ON b.k BETWEEN u.k - 4 AND u.k JOIN p ON p.datetime = b.datetime WHERE u.k >= 3) SELECT upto, count(*) AS n, count(DISTINCT datetime) AS dates, round(median(close), 6) AS middle, round(regr_slope(close, volume), 6) AS slope FROM c GROUP BY 1")
def rolling_ranges(spark, sf):
    """A fit and a median over all users of each five days: whole ranges, which no window by user gives."""
    rows = processors.ranges(users(spark, sf).bars.select("instrument", "datetime", "close", "volume"), 5, least=3)
    return rounded(rows.groupBy("upto").agg(F.count("*").alias("n"), F.countDistinct("datetime").alias("dates"), F.median("close").alias("middle"), F.regr_slope("close", "volume").alias("slope")))


@query("handler_loader", f"WITH {USER}, a AS (SELECT instrument, datetime, (close - avg(close) OVER (PARTITION BY datetime)) / nullif(stddev_samp(close) OVER (PARTITION BY datetime), 0) AS close FROM p WHERE close IS NOT NULL), b AS (SELECT instrument, datetime, coalesce(volume, 0) AS volume FROM p WHERE volume > 2 OR volume IS NULL) SELECT instrument, datetime, round(a.close, 6) AS price_close, round(b.volume, 6) AS size_volume FROM a FULL JOIN b USING (instrument, datetime)")
def handler_loader(spark, sf):
    """Two handlers' frames side by side: prices as z-scores of the date, volumes filled; each has rows that the other lacks."""
    bars = users(spark, sf).bars
    price = processors.Handler(bars.select("instrument", "datetime", "close").filter("close is not null"), {"feature": ["close"]}, infer=[processors.DateZScore("feature")]).setup()
    size = processors.Handler(bars.select("instrument", "datetime", F.col("volume").cast("double").alias("volume")).filter("volume > 2 or volume is null"), {"feature": ["volume"]}, infer=[processors.Fill("feature")]).setup()
    return rounded(loaders.from_handlers({"price": price, "size": size}, "infer", prefix=True).rows)


@query("group_ensemble", f"WITH {SCORES}, u AS (SELECT 'x' AS market, 'a' AS model, 1 AS run, instrument, datetime, score FROM q UNION ALL SELECT 'x', 'a', 2, instrument, datetime, label FROM q WHERE datetime >= DATE '2024-01-15' UNION ALL SELECT 'x', 'b', 1, instrument, datetime, label - score FROM q UNION ALL SELECT 'y', 'a', 1, instrument, datetime, label FROM q), l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY market, model, instrument, datetime ORDER BY run DESC) = 1), z AS (SELECT market, instrument, datetime, (score - avg(score) OVER w) / nullif(stddev_samp(score) OVER w, 0) AS z FROM l WINDOW w AS (PARTITION BY market, model, datetime)) SELECT market, instrument, datetime, round(avg(z), 6) AS score FROM z GROUP BY 1, 2, 3")
def group_ensemble(spark, sf):
    """Two markets: the first has two runs of one model and one of another, the second a single model."""
    rows = scored(spark, sf)
    part = lambda market, model, run, score, on=rows: on.select(F.lit(market).alias("market"), F.lit(model).alias("model"), F.lit(run).alias("run"), "instrument", "datetime", score.alias("score"))
    late = rows.filter(F.col("datetime") >= F.lit("2024-01-15").cast("date"))
    every = part("x", "a", 1, F.col("score")).unionByName(part("x", "a", 2, F.col("label"), late)).unionByName(part("x", "b", 1, F.col("label") - F.col("score"))).unionByName(part("y", "a", 1, F.col("label")))
    return rounded(analytics.group_ensemble(every, ["market"]))
