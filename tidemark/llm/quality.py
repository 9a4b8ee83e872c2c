"""Ordinal quality classifier: cumulative-link regression on hashed text.

``P(grade <= k | x) = sigmoid(threshold[k] - w.x)`` with one weight vector for all grades and ordered thresholds;
the tail probabilities give the expected grade. A text's features are the words that
occur in it (once each, hashed to ``BITS`` bits) and bins of a few shares (capitals,
symbols, digits, repeated words). Weights are learned with an L1 penalty, so that only words that tell
something keep one and long texts don't add up noise.

The fit takes at most ``fit_rows`` labelled documents, those with the smallest hash of their id; that bound and nothing
else limits it. Scoring reads every text whole.

Cases: a null or empty text has no words and only its shares' features; null ids are kept; repeated rows each get a
row; labels without a grade or a document are ignored, of several grades of a document the lowest counts, of several
texts the first in order; without labels
every grade is equally likely; a very long text is read whole, a piece of texts at a time; a probability equal to the least one keeps the document; other
columns are passed on if asked for, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 40
FIT_ROWS = 6_000
GRADES = 3
#: Words of letters, digits and bytes beyond ASCII.
GAP = np.ones(256, bool)
GAP[48:58] = GAP[65:91] = GAP[97:123] = GAP[128:] = False
SHARES = 4


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from quality and toxic marks: toxic 0, poor 1, good 2."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def features(data: memoryview, offsets: np.ndarray):
    """(text, feature) pairs, each once."""
    h, counts = C.word_hashes(data, offsets, GAP)
    key = h >> np.uint64(64 - BITS)
    doc = np.repeat(np.arange(len(counts)), counts)
    by = np.lexsort((key, doc))
    key, doc = key[by], doc[by]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]) if len(key) else np.zeros(0, bool)
    key, doc = key[new], doc[new]
    offsets, flat = offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    capital, digit = (flat >= 65) & (flat <= 90), (flat >= 48) & (flat <= 57)
    symbol = GAP[flat] & ~C.SPACE[flat]
    size = np.maximum(np.diff(offsets), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    repeated = 1 - np.bincount(doc, minlength=len(counts)) / np.maximum(counts, 1)
    bins = [np.minimum((s * 20).astype(np.uint64), np.uint64(19)) + np.uint64(20 * k) for k, s in enumerate((share(capital), share(symbol), share(digit), repeated))]
    # hashes of words use the low BITS bits, those of shares the bit above
    extra = np.concatenate(bins) + np.uint64(1 << BITS)
    return np.concatenate([doc, np.tile(np.arange(len(counts)), SHARES)]), np.concatenate([key, extra])


@dataclass(frozen=True)
class Model:
    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def learn(row: np.ndarray, key: np.ndarray, grade: np.ndarray, least: int = 5, penalty: float = 0.05, rounds: int = 300) -> Model:
    """Adaptive proximal gradient descent on the ordinal log-likelihood, with an L1 penalty of penalty / sqrt(texts).

    Features of fewer than least texts are left out. The penalty selects the features; their weights are then learned
    with a tenth of it, as the full penalty also shrinks those that it keeps.
    """
    n = len(grade)
    if not n or not len(key):
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.log(np.arange(1, GRADES) / np.arange(GRADES - 1, 0, -1)))
    keys, back, texts = np.unique(key, return_inverse=True, return_counts=True)
    keep = texts >= least
    place = np.cumsum(keep) - 1
    used = keep[back]
    row, col, keys = row[used], place[back[used]].astype(np.int32), keys[keep]
    del key, back, texts, place, used
    share = np.clip(np.array([(grade <= k).mean() for k in range(GRADES - 1)]), 1 / (n + 2), 1 - 1 / (n + 2))
    thresholds = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(GRADES - 1))
    w = np.zeros(len(keys))
    for part in (1.0, 0.1):
        power, t_power = np.full(len(keys), 1e-8), np.full(GRADES - 1, 1e-8)
        for _ in range(rounds):
            s = np.bincount(row, w[col], n)
            below = np.column_stack([np.zeros(n), *(_sigmoid(t - s) for t in thresholds), np.ones(n)])  # P(grade < k)
            slope = below * (1 - below)
            low, high = below[np.arange(n), grade], below[np.arange(n), grade + 1]
            p = np.maximum(high - low, 1e-12)
            d = (slope[np.arange(n), grade + 1] - slope[np.arange(n), grade]) / p / n  # of -log p by s
            g = np.bincount(col, d[row], len(keys))
            power += g * g
            step = 0.3 / np.sqrt(power)
            w -= step * g
            w = np.sign(w) * np.maximum(np.abs(w) - step * part * penalty / np.sqrt(n), 0)
            gt = np.array([(-(slope[:, k + 1] * (grade == k)) + slope[:, k + 1] * (grade == k + 1)) @ (1 / p) / n for k in range(GRADES - 1)])
            t_power += gt * gt
            thresholds = np.maximum.accumulate(thresholds - 0.3 / np.sqrt(t_power) * gt)
        if part == 1:
            chosen = np.flatnonzero(w)
            used = w[col] != 0
            row, col, keys, w = row[used], np.searchsorted(chosen, col[used]), keys[chosen], w[chosen]
    some = w != 0
    return Model(keys[some], w[some], thresholds)


def fit(docs: DataFrame, grades: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from at most fit_rows of the graded documents."""
    known = grades.select(F.col(grades.columns[0]).cast("long").alias("g_id"), F.col("grade").cast("int").alias("grade")).filter("g_id is not null and grade is not null").groupBy("g_id").agg(F.min("grade").alias("grade"))
    chosen = known.orderBy(F.xxhash64(F.lit("fit"), "g_id"), "g_id").limit(fit_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("g_id")).groupBy("id", "grade").agg(F.min("text").alias("text"))  # rows of one id count once

    def run(tables):
        schema = pa.schema([("id", pa.int64()), ("grade", pa.int32()), ("body", pa.binary())])
        for t in tables:
            data, offsets = C.text_slices(pa.Table.from_batches([t]))
            for first, last in C.pieces(offsets):
                doc, key = features(data, offsets[first : last + 1])
                by = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[by], np.arange(last - first + 1))
                yield pa.record_batch([t.column("id")[first:last], t.column("grade")[first:last], pa.array([key[by[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], schema=schema)

    found = rows.mapInArrow(run, "id long, grade int, body binary").toArrow().sort_by("id")  # fit_rows bounds its rows; in one order, so that sums are the same in each run
    grade = C.numbers(found, "grade").astype(np.int64)
    data, offsets = C.text_slices(found, "body")
    row = np.repeat(np.arange(len(grade), dtype=np.int32), np.diff(offsets) // 8)
    key = np.frombuffer(data, np.uint64)[offsets[0] // 8 : offsets[-1] // 8]
    del found
    return learn(row, key, grade)


def score(docs: DataFrame, model: Model, least: float = 0.5, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id_col, expected_grade, p_ge_1, p_ge_2 and keep (p_ge_2 >= least), then the columns keep."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # no more weights than features of fit_rows texts

    def run(tables):
        for t in tables:
            m = sent.value
            s = np.zeros(t.num_rows)
            data, offsets = C.text_slices(pa.Table.from_batches([t]))
            for a, b in C.pieces(offsets) if len(m.keys) else ():
                doc, key = features(data, offsets[a : b + 1])
                place = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
                hit = m.keys[place] == key
                s[a:b] = np.bincount(doc[hit], m.weights[place[hit]], b - a)
            tails = [1 - _sigmoid(x - s) for x in m.thresholds]
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in names), pa.array(np.sum(tails, axis=0)), pa.array(tails[0]), pa.array(tails[1])], [*names, "expected_grade", "p_ge_1", "p_ge_2"])

    others = [c for c in keep if c != text_col]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*others).alias("kept")] if others else []))
    names = [c for c in rows.columns if c != "text" or text_col in keep]  # the text goes back only if asked for
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    result = rows.mapInArrow(run, f"{types}, expected_grade double, p_ge_1 double, p_ge_2 double")
    kept = [F.col("text" if c == text_col else f"kept.{c}").alias(c) for c in keep]
    return result.select(F.col("id").alias(id_col), "expected_grade", "p_ge_1", "p_ge_2", (F.col("p_ge_2") >= least).alias("keep"), *kept)
