"""Expressions whose windows have a known reach, over chunks of time instead of whole series.

A series is cut into chunks of ``chunk`` bars. Each chunk also gets the bars before and after it that the
expressions reach (its halo), copied by the place in the calendar, so a chunk needs nothing else and one long series is as many tasks as it
has chunks. There is one exchange, by instrument and chunk, whatever the number of fields and layers; the windows of a layer are one Arrow
step (``functions.kernels``), what stands between layers stays in Spark's columns. Halo rows go at the end.

Panels must be dense, as ``sources.panels.dense`` makes them: a row for each bar of the calendar; else a step raises.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.functions import kernels, library
from tidemark.plans.compiler import SUBPLANS, Panel, _Compiler, cut, exponential, fields_of, parse, reach, selects
from tidemark.plans.expr import Call, Literal, Node

#: Bars of a chunk: at least this, and HALO times the reach, so that few rows are copied.
CHUNK, HALO = 2048, 8
#: Cells (rows times columns, the made ones too) that a task gathers before it works out a layer; whole chunks stay together.
CELLS = 1 << 20


@dataclass(frozen=True)
class Window:
    """A window that a kernel works out: operator, arguments (their trees and columns), rows and further parameters."""

    name: str
    args: tuple[tuple[Node, Column], ...]
    rows: int
    more: tuple


def chunkable(node: Node) -> bool:
    """Whether all windows of the tree have kernels and a known reach."""
    if not isinstance(node, Call):
        return True
    op = library.OPERATORS.get(node.op)
    if op is None or node.op in SUBPLANS or not all(map(chunkable, node.args)):
        return False
    if not op.window:
        return True
    name, _ = _called(node)
    return (name in kernels.KERNELS or name in ("Ref", "Delta")) and not selects(node) and exponential(node) is None and reach(node) is not None


def _called(node: Call) -> tuple[str, tuple]:
    """The operator's own name and its literals: Rolling names another operator."""
    plain = tuple(a.value for a in node.args if isinstance(a, Literal))
    if node.op != "Rolling":
        return node.op, plain
    named = {"median": "med"}.get(str(plain[1]).lower(), str(plain[1]).lower())
    return next((k for k in kernels.KERNELS if k.lower() == named), node.op), (plain[0], *plain[2:])


class _Chunks(_Compiler):
    def body(self, op, node, args):
        out = super().body(op, node, args)  # also says what is wrong with the arguments
        if not op.window:
            return out
        name, (rows, *more) = _called(node)
        return Window(name, tuple((a, library.num(x)) for a, x in zip(node.args, args, strict=True) if isinstance(x, Column)), int(rows), tuple(float(x) for x in more))


def _layer(instrument: str, index: str, made: list[str], calls: list[tuple]):
    """A layer's windows as new columns. Rows come sorted by instrument, chunk and bar; a chunk of a series that goes on in the next batch waits for it."""

    def out(table: pa.Table, starts: np.ndarray):
        if not table.num_rows:
            return
        bar = table.column(index).to_numpy()
        if (np.diff(bar)[~starts[1:]] != 1).any():
            raise ValueError("chunks need a dense panel: a row for each bar between a series' first and last")
        names = sorted({a for _, args, *_ in calls for a in args})
        columns = {a: table.column(a).to_numpy(zero_copy_only=False).astype(float) for a in names}
        for name, values in zip(made, kernels.evaluate(kernels.Rows(starts), columns, calls), strict=True):
            table = table.append_column(name, pa.array(values, from_pandas=True))
        yield from table.combine_chunks().to_batches(max_chunksize=1 << 16)

    def pieces(batches):
        for batch in batches:
            step = least(batch)
            for a in range(0, batch.num_rows, step):
                yield batch.slice(a, step)

    def least(batch):
        return max(1, CELLS // (batch.num_columns + len(made)))

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in pieces(batches):
            held.append(batch)
            if sum(b.num_rows for b in held) < least(batch):
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _starts(table, instrument)
            last = int(np.flatnonzero(starts)[-1])
            yield from out(table.slice(0, last), starts[:last])
            held = table.slice(last).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from out(table, _starts(table, instrument))

    return run


def _starts(table: pa.Table, instrument: str) -> np.ndarray:
    """Where a chunk of a series starts."""
    chunk = table.column("_chunk").to_numpy()
    names = table.column(instrument).combine_chunks().dictionary_encode()
    code = (names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names).indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (code[1:] != code[:-1])])


def features(panel: Panel, fields: Sequence[str | Node] | Mapping[str, str | Node], start=None, end=None, universe: DataFrame | None = None, on_missing: str = "error", drop_empty: bool = False, chunk: int = CHUNK, partitions: int | None = None) -> DataFrame:
    """As ``compiler.features``, for fields that are all ``chunkable``; else ValueError."""
    named = dict(fields) if isinstance(fields, Mapping) else {str(f): f for f in fields}
    trees = {k: parse(v) for k, v in named.items()}
    if unfit := [k for k, t in trees.items() if not chunkable(t)]:
        raise ValueError(f"no chunks for {', '.join(unfit)}: windows without a known reach or kernel")
    c, ctx = _Chunks(panel, on_missing), panel.context
    outputs = {k: c.column(t) for k, t in trees.items()}
    used = set().union(*map(fields_of, trees.values())) if trees else set()
    bars = panel.bars.select(*panel.keys, ctx.index, *(f"`{f}`" for f in panel.fields if f in used))
    reaches = [reach(t) for t in trees.values()]
    before, after = max((x for x, _ in reaches), default=0), max((y for _, y in reaches), default=0)
    chunk = max(chunk, HALO * (before + after))
    at = lambda shift: F.floor((F.col(ctx.index) + shift) / chunk)
    rows = bars.select("*", F.explode(F.sequence(F.greatest(at(-after), F.lit(0).cast("long")), at(before))).alias("_chunk"))
    n = partitions or int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, ctx.instrument, "_chunk").sortWithinPartitions(ctx.instrument, "_chunk", ctx.index)
    for layer in c.layers:
        rows = _windows(rows, layer, ctx)
    own = rows.filter(F.col("_chunk") == at(0))
    out = own.select(*panel.keys, *((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, (v, _) in outputs.items()))
    return cut(out, ctx, list(named), start, end, universe, drop_empty)


def _windows(rows: DataFrame, layer: dict[str, Window], ctx: library.Context) -> DataFrame:
    """rows with the windows of a layer; equal arguments become one working column."""
    args = {node: column for w in layer.values() for node, column in w.args}
    names = {node: f"_a{i}" for i, node in enumerate(args)}
    given = rows.select("*", *(column.alias(names[node]) for node, column in args.items()))
    calls = [(w.name, tuple(names[node] for node, _ in w.args), w.rows, w.more) for w in layer.values()]
    schema = StructType([*given.schema.fields, *(StructField(k, DoubleType()) for k in layer)])
    return given.mapInArrow(_layer(ctx.instrument, ctx.index, list(layer), calls), schema).drop(*names.values())
