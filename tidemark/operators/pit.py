"""Point-in-time facts: what was known about a period on a bar's date.

A fact is (instrument, field, pub_date, period, value); a revision is a new fact of the same period with a
later date. On a date the latest revision of each period is visible; the periods between the first and the last visible one
are filled in, missing ones as NULL; ``P(expr)`` evaluates its expression over that series of
periods and takes the last, ``PRef($$f, period)`` the value of a fixed period.

Where an expression looks at no other period than its own, the last visible one is enough (``latest``). Else,
states only change on publication dates, so the series is built once for each of an instrument's publication dates and
bars take the state of the latest date at or before them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.expr import Call, ExpressionError, Literal, Node, PitField


def pit_fields(node: Node) -> set[str]:
    if isinstance(node, PitField):
        return {node.name}
    return set().union(*map(pit_fields, node.args)) if isinstance(node, Call) else set()


def _as_fields(node: Node) -> Node:
    from tidemark.plans.expr import Field

    if isinstance(node, PitField):
        return Field(node.name)
    return Call(node.op, tuple(map(_as_fields, node.args))) if isinstance(node, Call) else node


def period_number(period: str, quarterly: bool):
    """Consecutive numbers for periods YYYY or YYYYQQ."""
    p = F.col(period)
    return F.floor(p / 100) * 4 + p % 100 - 1 if quarterly else p


def states(facts: DataFrame, names: list[str], quarterly: bool) -> DataFrame:
    """(instrument, as_of, n, a column for each name): for each publication date the series of visible periods, numbered."""
    own = facts.filter(F.col("field").isin(names)).select("instrument", "field", "pub_date", period_number("period", quarterly).alias("n"), "value")
    # one row for each date and period that a fact is about; a struct, so that a revision to NULL counts
    told = own.groupBy("instrument", F.col("pub_date").alias("as_of"), "n").agg(*(F.max(F.when(F.col("field") == f, F.struct("value"))).alias(f) for f in names))
    so_far = Window.partitionBy("instrument").orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    span = told.groupBy("instrument", "as_of").agg(F.min("n").alias("a"), F.max("n").alias("b")).select("instrument", "as_of", F.min("a").over(so_far).alias("a"), F.max("b").over(so_far).alias("b"))
    spine = span.select("instrument", "as_of", F.explode(F.sequence("a", "b")).alias("n"))
    carried = Window.partitionBy("instrument", "n").orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(told, ["instrument", "as_of", "n"], "left").select("instrument", "as_of", "n", *(F.last(f, ignorenulls=True).over(carried)["value"].alias(f) for f in names))


def latest(facts: DataFrame, names: list[str], quarterly: bool, period: int | None = None) -> DataFrame:
    """(instrument, as_of, n, a column for each name): for each publication date the last visible period alone (or ``period`` alone, on its own dates), as ``states`` has it.

    The last visible period never goes back, so the latest revision of each field is the greatest (period, date) so far: one running window over the facts, no series of periods.
    """
    n = period_number("period", quarterly)
    own = facts.filter(F.col("field").isin(names) & F.col("pub_date").isNotNull()).select("instrument", "field", F.col("pub_date").alias("as_of"), n.alias("n"), "value").filter(F.col("n").isNotNull() if period is None else F.col("n") == period)
    told = own.repartition("instrument").groupBy("instrument", "as_of", "n").agg(*(F.max(F.when(F.col("field") == f, F.struct("value"))).alias(f) for f in names))
    days = told.groupBy("instrument", "as_of").agg(F.max("n").alias("n"), *(F.max(F.when(F.col(f).isNotNull(), F.struct("n", "as_of", f))).alias(f) for f in names))
    so_far = Window.partitionBy("instrument").orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    seen = days.select("instrument", "as_of", F.max("n").over(so_far).alias("n"), *(F.max(f).over(so_far).alias(f) for f in names))
    return seen.select("instrument", "as_of", "n", *(F.when(F.col(f)["n"] == F.col("n"), F.col(f)[f]["value"]).alias(f) for f in names))


def as_of(panel, node: Call, name: str) -> DataFrame:
    """(instrument, time, name) for every bar of the panel."""
    from tidemark.functions.library import Context
    from tidemark.plans.compiler import Panel, features, reach

    if panel.pit is None:
        raise ExpressionError(f"{node}: the panel has no dated facts")
    names = sorted(pit_fields(node))
    kinds = {f.endswith("_q") for f in names}
    if len(kinds) != 1 or not all(f[-2:] in ("_q", "_a") for f in names):
        raise ExpressionError(f"{node}: facts must be all quarterly (_q) or all annual (_a)")
    quarterly, ctx = kinds.pop(), panel.context
    if node.op == "P" and reach(_as_fields(node.args[0])) == (0, 0):
        rows = latest(panel.pit, names, quarterly).select(F.col("instrument"), F.col("as_of"), F.col("n").cast("long").alias("cal_idx"), *names)
        found = features(Panel(rows, Context("instrument", "as_of", "cal_idx", ctx.strict)), {name: _as_fields(node.args[0])})
        return _last_before(panel, found, name)
    if node.op == "PRef" and len(node.args) == 2 and isinstance(node.args[0], PitField) and isinstance(node.args[1], Literal):
        p = int(node.args[1].value)
        return _last_before(panel, latest(panel.pit, names, quarterly, p // 100 * 4 + p % 100 - 1 if quarterly else p).select("instrument", "as_of", F.col(names[0]).alias(name)), name)
    series = states(panel.pit, names, quarterly)
    # each (instrument, date) is a series of its own, ordered by period
    rows = series.select(F.struct("instrument", "as_of").alias("key"), F.col("n").alias("period"), F.col("n").cast("long").alias("cal_idx"), *names)
    inner = Panel(rows, Context("key", "period", "cal_idx", panel.context.strict))
    values = features(inner, {name: _as_fields(node.args[0])})
    if node.op == "PRef":
        if len(node.args) != 2 or not isinstance(node.args[1], Literal):
            raise ExpressionError(f"{node}: PRef takes an expression and a period")
        p = int(node.args[1].value)
        values = values.filter(F.col("period") == (p // 100 * 4 + p % 100 - 1 if quarterly else p))
        found = values.select("key.instrument", "key.as_of", F.col(name))
    else:
        found = values.groupBy("key").agg(F.max_by(name, "period").alias(name)).select("key.instrument", "key.as_of", F.col(name))
    every = panel.pit.filter(F.col("field").isin(names)).select("instrument", F.col("pub_date").alias("as_of")).distinct().join(found, ["instrument", "as_of"], "left")
    return _last_before(panel, every, name)


def _last_before(panel, states: DataFrame, name: str) -> DataFrame:
    """As-of join: states (instrument, as_of, name) and bars in one order, each bar takes the last state before it."""
    ctx = panel.context
    events = states.select(F.col("instrument").alias("i"), F.col("as_of").cast("timestamp").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(panel.bars.schema[ctx.time].dataType).alias("bar"), F.struct(F.col(name).alias("v")).alias("state"))
    asked = panel.bars.select(F.col(ctx.instrument).alias("i"), F.col(ctx.time).cast("timestamp").alias("at"), F.lit(1).alias("kind"), F.col(ctx.time).alias("bar"), F.lit(None).cast("struct<v:double>").alias("state"))
    w = Window.partitionBy("i").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return events.unionByName(asked).withColumn("state", F.last("state", ignorenulls=True).over(w)).filter("kind = 1").select(F.col("i").alias(ctx.instrument), F.col("bar").alias(ctx.time), F.col("state.v").alias(name))
