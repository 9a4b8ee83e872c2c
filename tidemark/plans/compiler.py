"""From expressions to one Spark plan.

Window functions don't nest, so a tree is cut into layers: each window operator becomes a working
column of the layer above those that its arguments need, and each layer is one ``select``. Equal
subtrees share a column. All windows of a layer run over the same instrument and order, so Spark plans one
exchange for the whole field list and one Window node a layer.

``features`` computes over the whole history and cuts the range last, so a value doesn't depend on the range that was
asked for. With ``lookback=True`` the scan is cut instead to the bars that the expressions reach.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import library as L
from tidemark.plans.expr import Call, ExpressionError, Field, Literal, Node, PitField, fields_of, parse

#: Operators with a plan of their own.
SUBPLANS = ("ChangeInstrument", "Mask", "P", "PRef")
#: A broadcast holds one row for each bar of the calendar; longer ones are joined by Spark's choice.
BROADCAST_BARS = 1_000_000


@dataclass(frozen=True)
class Panel:
    """Bars: one row for each instrument and time, with the time's place in the calendar and the fields.

    Dense panels have a row for each calendar bar between an instrument's first and last; missing values are NULL.
    ``pit`` holds dated facts (instrument, field, pub_date, period, value) for P and PRef.
    """

    bars: DataFrame
    context: L.Context = field(default_factory=L.Context)
    pit: DataFrame | None = None

    @property
    def keys(self) -> list[str]:
        return [self.context.instrument, self.context.time]

    @property
    def fields(self) -> list[str]:
        return [c for c in self.bars.columns if c not in (*self.keys, self.context.index)]


def reach(node: Node) -> tuple[int, int] | None:
    """Bars before and after a bar that its value needs; None: the whole history."""
    if not isinstance(node, Call):
        return 0, 0
    inner = [reach(a) for a in node.args]
    if None in inner or node.op in (*SUBPLANS, "FFillNan", "BFillNan", "Cut", "DayCumsum", "DayLast"):
        return None
    left, right = max((x for x, _ in inner), default=0), max((y for _, y in inner), default=0)
    op = L.OPERATORS.get(node.op)
    if op is None or not op.window:
        return left, right
    n = next(a.value for a in reversed(node.args) if isinstance(a, Literal) and isinstance(a.value, (int, float))) if node.op != "Quantile" else node.args[1].value
    if node.op in ("Ref", "Delta"):
        return None if n == 0 else (left + max(n, 0), right + max(-n, 0))
    if node.op == "EMA" and n >= 1 or 0 < n < 1 or n == 0:
        return None
    return left + int(n) - 1, right


def exponential(node: Call) -> Node | None:
    """The layers of an exponential mean, if the node is one."""
    last = node.args[1] if len(node.args) > 1 else None
    alpha = L.alpha_of(node.op, last.value) if isinstance(last, Literal) and isinstance(last.value, (int, float)) else None
    if node.op == "Rolling" and isinstance(last, Literal) and 0 < last.value < 1:
        alpha = float(last.value)
    if alpha is None:
        return None
    x, a = node.args[0], Literal(alpha)
    if alpha >= 1:
        return Call("FFillNan", (x,))
    part = Call("_EmaPart", (x, a))
    return Call("FFillNan", (Call("_EmaValue", (x, part, Call("_EmaCarried", (Call("_EmaBefore", (part,)), a)), a)),))


def selects(node: Node) -> set[Call]:
    """The outermost Select calls of a tree."""
    if not isinstance(node, Call):
        return set()
    return {node} if node.op == "Select" else set().union(*map(selects, node.args)) if node.args else set()


def with_field(node: Node, old: Node, name: str) -> Node:
    if node == old:
        return Field(name)
    return Call(node.op, tuple(with_field(a, old, name) for a in node.args)) if isinstance(node, Call) else node


class _Compiler:
    def __init__(self, panel: Panel, on_missing: str):
        self.panel, self.on_missing = panel, on_missing
        self.made: dict[Node, tuple[Column, int]] = {}
        self.layers: list[dict[str, Column]] = []
        self.joins: list[tuple[str, Node]] = []

    def body(self, op: L.Operator, node: Call, args: list):
        """What a call becomes in its layer."""
        if op.name in L.BITWISE and any(map(self.integral, node.args)):
            return L.BITWISE[op.name](*((a if isinstance(a, Column) else F.lit(a)).cast("long") for a in args))
        return op.body(self.panel.context, *args)

    def integral(self, node: Node) -> bool:
        """Whether a tree's values are whole numbers by type, so that And, Or and Not go by bits."""
        if isinstance(node, Literal):
            return isinstance(node.value, int) and not isinstance(node.value, bool)
        if isinstance(node, Field):
            return node.name in self.panel.fields and self.panel.bars.schema[node.name].dataType.typeName() in ("byte", "short", "integer", "long")
        return isinstance(node, Call) and node.op in L.BITWISE and any(map(self.integral, node.args))

    def column(self, node: Node) -> tuple[object, int]:
        """The node as a column (or a plain value for a literal) and the layer that it can be computed in."""
        if isinstance(node, Literal):
            return node.value, 0
        if node in self.made:
            return self.made[node]
        if isinstance(node, Field):
            if node.name in self.panel.fields:
                out = F.col(f"`{node.name}`")
            elif self.on_missing == "null":
                out = F.lit(None).cast("double")
            else:
                raise ExpressionError(f"no field ${node.name}; there are {', '.join(self.panel.fields)}")
            self.made[node] = out, 0
        elif isinstance(node, PitField):
            raise ExpressionError(f"{node} is only legal inside P or PRef")
        elif node.op in SUBPLANS:
            name = f"_sub{len(self.joins)}"
            self.joins.append((name, node))
            self.made[node] = F.col(name), 0
        else:
            op = L.OPERATORS.get(node.op)
            if op is None:
                raise ExpressionError(f"no operator {node.op}")
            if op.window and selects(node):
                name = f"_sub{len(self.joins)}"
                self.joins.append((name, node))
                self.made[node] = F.col(name), 0
                return self.made[node]
            if layers := exponential(node):
                self.made[node] = self.column(layers)
                return self.made[node]
            if not op.arity[0] <= len(node.args) <= op.arity[1]:
                raise ExpressionError(f"{node}: {node.op} takes {op.arity[0]} to {op.arity[1]} arguments")
            args = [self.column(a) for a in node.args]
            layer = max((k for _, k in args), default=0)
            try:
                out = self.body(op, node, [x for x, _ in args])
            except (TypeError, ValueError) as e:
                raise ExpressionError(f"{node}: {e}") from None
            if op.window:
                while len(self.layers) <= layer:
                    self.layers.append({})
                name = f"_w{sum(map(len, self.layers))}"
                self.layers[layer][name] = out
                out, layer = F.col(name), layer + 1
            self.made[node] = out, layer
        return self.made[node]


def _subplan(panel: Panel, name: str, node: Call, on_missing: str, bars: DataFrame) -> DataFrame:
    keys, time = panel.keys, panel.context.time
    if node.op not in SUBPLANS:
        return bars.join(_selected(panel, name, node, on_missing), keys, "left")
    if node.op in ("P", "PRef"):
        from tidemark.operators.pit import as_of

        return bars.join(as_of(panel, node, name), keys, "left")
    code, inner = (node.args[0], node.args[1]) if node.op == "ChangeInstrument" else (node.args[1], node.args[0])
    own = Panel(panel.bars.filter(F.col(keys[0]) == str(code.value)), panel.context, panel.pit)
    other = features(own, {name: inner}, on_missing=on_missing).select(time, F.col(name))
    return bars.join(other, time, "left")  # one instrument's bars: Spark broadcasts them by their size


def _selected(panel: Panel, name: str, node: Call, on_missing: str) -> DataFrame:
    """A window over a Select: evaluated on the bars where its condition holds, which are numbered anew."""
    found = selects(node)
    chosen = next(iter(found))
    tree = with_field(node, chosen, "_chosen")
    if len(found) > 1 or fields_of(tree) != {"_chosen"}:
        raise ExpressionError(f"{node}: all fields of a window over Select must stand in the same Select")
    ctx = panel.context
    rows = features(panel, {"_on": chosen.args[0], "_chosen": chosen.args[1]}, on_missing=on_missing).filter(F.coalesce(F.col("_on").cast("boolean"), F.lit(False)))
    numbered = rows.select(*panel.keys, (F.row_number().over(ctx.series) - 1).cast("long").alias(ctx.index), "_chosen")
    return features(Panel(numbered, ctx), {name: tree}).select(*panel.keys, name)


def features(panel: Panel, fields: Sequence[str | Node] | Mapping[str, str | Node], start=None, end=None, universe: DataFrame | None = None, lookback: bool = False, on_missing: str = "error", drop_empty: bool = False) -> DataFrame:
    """instrument, datetime and a column for each expression, named by the mapping's keys or the texts.

    universe: membership spans (instrument, start, end); a bar stays if any span of its instrument has it.
    drop_empty: leave out the rows in which every asked field is missing.
    """
    named = dict(fields) if isinstance(fields, Mapping) else {str(f): f for f in fields}
    trees = {k: parse(v) for k, v in named.items()}
    c = _Compiler(panel, on_missing)
    outputs = {k: c.column(t) for k, t in trees.items()}
    ctx, bars = panel.context, panel.bars
    used = set().union(*map(fields_of, trees.values())) if trees else set()
    bars = bars.select(*panel.keys, ctx.index, *(f"`{f}`" for f in panel.fields if f in used))
    if lookback and (start is not None or end is not None):
        bars = _reached(panel, bars, list(trees.values()), start, end)
    for name, node in c.joins:
        bars = _subplan(panel, name, node, on_missing, bars)
    for layer in c.layers:
        bars = bars.select("*", *(v.alias(k) for k, v in layer.items()))
    out = bars.select(*panel.keys, *((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, (v, _) in outputs.items()))
    return cut(out, ctx, list(named), start, end, universe, drop_empty)


def cut(out: DataFrame, ctx: L.Context, names: list[str], start=None, end=None, universe: DataFrame | None = None, drop_empty: bool = False) -> DataFrame:
    """The asked range and members of a field list's rows."""
    if start is not None:
        out = out.filter(F.col(ctx.time) >= F.lit(start))
    if end is not None:
        out = out.filter(F.col(ctx.time) <= F.lit(end))
    if universe is not None:
        spans = universe.select(F.col("instrument").alias("_i"), F.col("start").alias("_s"), F.col("end").alias("_e"))
        out = out.join(spans, (F.col(ctx.instrument) == F.col("_i")) & (F.col(ctx.time) >= F.col("_s")) & (F.col(ctx.time) <= F.col("_e")), "left_semi")
    return out.dropna("all", subset=names) if drop_empty else out


def _reached(panel: Panel, bars: DataFrame, trees: list[Node], start, end) -> DataFrame:
    """Bars from the farthest look-back before start to the farthest look-ahead after end."""
    reaches = [reach(t) for t in trees]
    if None in reaches:
        return bars
    ctx = panel.context
    bound = panel.bars.agg(
        F.min(F.when(F.col(ctx.time) >= F.lit(start), F.col(ctx.index)) if start is not None else F.col(ctx.index)).alias("a"),
        F.max(F.when(F.col(ctx.time) <= F.lit(end), F.col(ctx.index)) if end is not None else F.col(ctx.index)).alias("b"),
    ).first()  # two numbers
    if bound["a"] is None or bound["b"] is None:
        return bars.limit(0)
    return bars.filter(F.col(ctx.index).between(bound["a"] - max(x for x, _ in reaches), bound["b"] + max(y for _, y in reaches)))
