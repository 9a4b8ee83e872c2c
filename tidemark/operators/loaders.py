"""Frames with named groups of columns: from expressions, from stored frames, and from several loaders joined."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.processors import Handler
from tidemark.plans.compiler import Panel, features, reach
from tidemark.plans.expr import Node, parse

KEYS = ["instrument", "datetime"]
Config = list | tuple | dict


@dataclass
class Frame:
    rows: DataFrame
    groups: dict[str, list[str]] = field(default_factory=dict)


def named(config: Config) -> dict[str, str | Node]:
    """Names and expressions of a list of expressions, a pair (expressions, names), or a mapping."""
    if isinstance(config, dict):
        return dict(config)
    if isinstance(config, tuple) and len(config) == 2 and all(isinstance(x, (list, tuple)) for x in config):
        expressions, names = config
        if len(expressions) != len(names):
            raise ValueError("as many names as expressions are needed")
        return dict(zip(names, expressions, strict=True))
    return {str(e): e for e in config}


def load(panel: Panel, config: dict[str, Config], start=None, end=None, universe: DataFrame | None = None) -> Frame:
    """{group: fields} over one panel: all groups in one plan."""
    groups = {g: named(c) for g, c in config.items()}
    every: dict[str, str | Node] = {}
    for fields in groups.values():
        if clash := set(every) & set(fields):
            raise ValueError(f"columns in two groups: {sorted(clash)}")
        every |= fields
    return Frame(features(panel, every, start, end, universe), {g: list(f) for g, f in groups.items()})


def static(frames: dict[str, DataFrame], how: str = "full") -> Frame:
    """Stored frames, one for each group, joined on the keys."""
    rows = reduce(lambda a, b: a.join(b, KEYS, how), frames.values())
    return Frame(rows, {g: [c for c in f.columns if c not in KEYS] for g, f in frames.items()})


def nested(parts: list[Frame], how: str = "left") -> Frame:
    """Frames joined in order; of columns in two of them the later one's stay."""

    def both(a: Frame, b: Frame) -> Frame:
        twice = [c for c in a.rows.columns if c in b.rows.columns and c not in KEYS]
        groups = {g: [c for c in cs if c not in twice] for g, cs in a.groups.items()}
        for g, cs in b.groups.items():
            groups[g] = [*groups.get(g, []), *cs]
        return Frame(a.rows.drop(*twice).join(b.rows, KEYS, how), groups)

    return reduce(both, parts)


def from_handlers(handlers: Handler | dict[str, Handler], key: str = "raw", start=None, end=None, how: str = "full", prefix: bool = False) -> Frame:
    """What handlers hold at a stage (raw, infer, learn): one handler with its groups, or one for each group, joined on the keys.

    prefix: columns are named group_column; without it a column of two handlers raises ValueError.
    """
    if isinstance(handlers, Handler):
        rows = handlers.fetch(key, start, end)
        return Frame(rows, {g: [c for c in cs if c in rows.columns] for g, cs in handlers.stage(key)[1].items()})
    frames = {}
    for g, h in handlers.items():
        rows = h.fetch(key, start, end)
        frames[g] = rows.select(*KEYS, *(F.col(f"`{c}`").alias(f"{g}_{c}" if prefix else c) for c in rows.columns if c not in KEYS))
    every = [c for f in frames.values() for c in f.columns if c not in KEYS]
    if clash := {c for c in every if every.count(c) > 1}:
        raise ValueError(f"columns of two handlers: {sorted(clash)}")
    return static(frames, how)


def horizon(label: str | Node) -> int:
    """Bars that a label looks ahead."""
    found = reach(parse(label))
    if found is None:
        raise ValueError(f"{label}: the whole history")
    return found[1]


@dataclass(frozen=True)
class Segment:
    """One step of a rolling study: training, validation and test ranges as places in a calendar."""

    train: tuple[int, int]
    valid: tuple[int, int]
    test: tuple[int, int]


def rolling_segments(first: Segment, step: int, last: int, sliding: bool = True) -> list[Segment]:
    """first, then steps of so many bars until the test range ends at last; sliding moves the training's start too."""
    out, now = [], first
    while now.test[0] <= last:
        out.append(Segment(now.train, now.valid, (now.test[0], min(now.test[1], last))))
        shift = lambda r: (r[0] + step, r[1] + step)
        now = Segment(shift(now.train) if sliding else (now.train[0], now.train[1] + step), shift(now.valid), shift(now.test))
    return out


def without_leak(segment: Segment, label: str | Node) -> Segment:
    """The segment with training and validation ended so early that their labels are known when the next range starts."""
    ahead = horizon(label)
    cut = lambda r, nxt: (r[0], min(r[1], nxt[0] - 1 - ahead))
    return Segment(cut(segment.train, segment.valid), cut(segment.valid, segment.test), segment.test)
