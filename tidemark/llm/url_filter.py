"""URL filter by the likelihood ratio of two character language models.

Rules decide the urls they fit. These also are the examples: one model is learned from the accepted urls
and one from the rejected ones, and the rest is judged by
``(log P(url | accepted) - log P(url | rejected)) / (bytes + 1)`` against a threshold.

A model is a variable-order Markov model over bytes: the estimate with the longest context is smoothed
with that of the next shorter one, down to the uniform distribution, each with a weight of ``STRENGTH``
counts. Each n-gram and each context is counted by a 64-bit key of its own, over all examples, through the packed exchange of ``common``: a batch of
urls sends its distinct keys with its examples' counts to the key partitions and gets the sums back; no table of counts is held whole. The
threshold is calibrated on a part of the examples (one of ``HELD`` by hash) scored with the counts of the others: of the bins of a
histogram the one with the best balanced accuracy. The urls are scored with the counts of all examples.

Cases: a null url, or one without ``://``, has an empty host and path and is judged by the models like any text; a
null id is kept; repeated rows count as often as they occur; a very long url is scored whole; a score at the threshold is allowed; of equally
good thresholds the middle one is taken; while one of the classes has no held-out example
every undecided url is allowed; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDER, STRENGTH, HELD = 5, 2.0, 5
#: Histogram of scores for the threshold: bins of 1 / BINS from -LIMIT to LIMIT.
BINS, LIMIT = 64, 16
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """Fits hosts that are host or end in .host, with paths that start with path (from the slash on)."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest ends up outermost
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def symbols(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes + 1 of the urls, each behind ORDER zeros and before an end symbol; where symbols to predict stand; the url of each."""
    data, offsets = C.text_slices(table)
    size = np.diff(offsets)
    flat = np.zeros(int((size + ORDER + 1).sum()), np.uint64)
    first = np.cumsum(size + ORDER + 1) - size - 1
    row = np.repeat(np.arange(len(size)), size)
    flat[first[row] + np.arange(len(row)) - offsets[:-1][row] + offsets[0]] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    flat[first + size] = 257
    url = np.repeat(np.arange(len(size)), size + 1)
    return flat, np.repeat(first - np.concatenate([[0], np.cumsum(size + 1)[:-1]]), size + 1) + np.arange(len(url)), url


def keys_of(table: pa.Table):
    """(context keys, n-gram keys) of each symbol for context lengths 0 .. ORDER, and the url of each symbol."""
    flat, at, url = symbols(table)
    key, found = np.zeros(len(at), np.uint64), []
    for k in range(ORDER + 1):
        if k:
            key = key * np.uint64(C.BASE) + flat[at - k] + np.uint64(1)
        context = C.mix(key + np.uint64(k << 40))
        found.append((context, C.mix(context * np.uint64(C.BASE) + flat[at])))
    return found, url


def _distinct(found):
    """The sorted distinct keys of a batch, and the places among them of all contexts and n-grams, one after the other."""
    return np.unique(np.concatenate([x for pair in found for x in pair]), return_inverse=True)


#: Examples by class and part: those that the threshold is calibrated on, and the others.
COLUMNS = ("allow", "block", "allow_held", "block_held")
REQUEST = "batch int, part int, keys binary, " + ", ".join(f"{c} binary" for c in COLUMNS)
ANSWER = "batch int, part int, " + ", ".join(f"{c} binary" for c in COLUMNS)


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


def _requests(n: int):
    def run(table: pa.Table) -> pa.Table:
        found, url = keys_of(table)
        keys, back = _distinct(found)
        role = C.numbers(table, "role")[url]
        counts = [np.bincount(back, np.tile(role == k, 2 * len(found)), len(keys)).astype(np.uint32) for k in range(len(COLUMNS))]
        batch = int(C.numbers(table, "batch")[0])
        return C.as_table([(batch, p, C.pack_sorted(keys[a:b]), *(C.pack(c[a:b]) for c in counts)) for p, a, b in C.deal(keys, n)], _schema(REQUEST))

    return run


def _count(table: pa.Table) -> pa.Table:
    """Sums the counts of each key over the batches and answers each batch."""
    sent = [C.unpack_sorted(x.as_py()) for x in table.column("keys")]
    keys, back = np.unique(np.concatenate(sent), return_inverse=True)
    sums = [np.bincount(back, np.concatenate([C.unpack(x.as_py(), np.uint32) for x in table.column(c)]), len(keys)).astype(np.int64)[back] for c in COLUMNS]
    rows, at = [], 0
    for b, p, k in zip(C.numbers(table, "batch").tolist(), C.numbers(table, "part").tolist(), sent, strict=True):
        rows.append((b, p, *(C.pack(s[at : at + len(k)]) for s in sums)))
        at += len(k)
    return C.as_table(rows, _schema(ANSWER))


def log_odds(found, url: np.ndarray, back: np.ndarray, allow: np.ndarray, block: np.ndarray, urls: int) -> np.ndarray:
    """Length-normalised log-likelihood difference of each url, from the classes' counts of the batch's keys."""
    n, p = len(url), np.full((2, len(url)), 1 / 257)
    for k in range(len(found)):
        context, gram = back[2 * k * n : (2 * k + 1) * n], back[(2 * k + 1) * n : (2 * k + 2) * n]
        for c, counts in enumerate((allow, block)):
            p[c] = (counts[gram] + STRENGTH * p[c]) / (counts[context] + STRENGTH)
    return np.bincount(url, np.log(p[0]) - np.log(p[1]), urls) / np.bincount(url, minlength=urls)


SCORES = "id long, text string, role int, score double, tried double"


def _scores(n: int):
    """score with the counts of all examples, tried with those of the others than held-out ones."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return C.as_table([], _schema(SCORES))
        found, url = keys_of(table)
        keys, back = _distinct(found)
        said = dict(zip(C.numbers(answers, "part").tolist(), range(answers.num_rows), strict=True))
        parts = [said[p] for p, _, _ in C.deal(keys, n)]
        allow, block, allow_held, block_held = (np.concatenate([C.unpack(answers.column(c)[k].as_py(), np.int64) for k in parts]) for c in COLUMNS)
        score = log_odds(found, url, back, allow + allow_held, block + block_held, table.num_rows)
        tried = log_odds(found, url, back, allow, block, table.num_rows)
        return pa.table([table.column("id"), table.column("text"), table.column("role"), pa.array(score), pa.array(tried)], schema=_schema(SCORES))

    return run


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each page: id_col, host, path, rule, verdict, score (the length-normalised log odds), threshold."""
    url = F.col(url_col).cast("string")
    _, label = fitting(*split_url(url), rules)
    held = F.pmod(F.xxhash64(F.lit("held"), url), F.lit(HELD)) == 0
    role = F.when(label == ALLOW, 0).when(label == BLOCK, 1).otherwise(4) + F.when(label.isNotNull() & held, 2).otherwise(0)
    n = C.batch_count(pages, url_col, 1 << 20)
    parts = C.key_partitions(pages.sparkSession, n, 4)
    batches = C.in_batches(pages, n, id_col, url_col, role=role.cast("int"))
    counted = batches.groupBy("batch").applyInArrow(_requests(parts), REQUEST).groupBy("part").applyInArrow(_count, ANSWER)
    scores = C.written(batches.groupBy("batch").cogroup(counted.groupBy("batch")).applyInArrow(_scores(parts), SCORES), "url-scores")
    step = F.floor(F.greatest(F.least(F.col("tried"), F.lit(LIMIT)), F.lit(-LIMIT)) * BINS).cast("int")
    bins = scores.filter("role in (2, 3)").groupBy(step.alias("bin")).agg(F.count_if(F.col("role") == 2).alias("allow"), F.count_if(F.col("role") == 3).alias("block")).toPandas()  # a row for each of 2 * LIMIT * BINS + 1 bins
    threshold = calibrated(bins)
    host, path = split_url(F.col("text"))
    rows = scores.select("id", host.alias("host"), path.alias("path"), "score")
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    return rows.select(C.null_id("id", id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= threshold, ALLOW).otherwise(BLOCK)).alias("verdict"), "score", F.lit(threshold).alias("threshold"))


def calibrated(bins) -> float:
    """The threshold with the best balanced accuracy, in the middle if several are best; -LIMIT - 1 without examples of both classes."""
    allow, block = np.zeros(2 * LIMIT * BINS + 1), np.zeros(2 * LIMIT * BINS + 1)
    place = bins["bin"].to_numpy(np.int64) + LIMIT * BINS
    allow[place], block[place] = bins["allow"], bins["block"]
    if not allow.sum() or not block.sum():
        return -LIMIT - 1.0
    kept = 1 - np.concatenate([[0], np.cumsum(allow)[:-1]]) / allow.sum()  # accepted at or above the bin
    gone = np.concatenate([[0], np.cumsum(block)[:-1]]) / block.sum()  # rejected below it
    best = np.flatnonzero(kept + gone >= (kept + gone).max() - 1e-12)
    return float(best[len(best) // 2] - LIMIT * BINS) / BINS
