"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of n-grams of all orders up to ``order``
and the uniform distribution. A token's longest context that has been seen decides: its length and the bucket of its frequency
(powers of two) name the mixture weights, which cover the orders that have an estimate, so the probabilities of all tokens after a
context add up to one. Weights are learned by expectation-maximisation on the
counts of a held-out part of the training documents; the counts that the weights
are learned against come from the rest, and the final estimates from both.

Counting and look-up go through the packed exchange of ``common``: a batch sends its distinct
n-grams with their counts to the key partitions and gets the corpus counts of the
same n-grams back. EM runs on a table of the held-out tokens' exact estimates, equal ones counted together; each round is one aggregation, of which
the driver gets a row for each bucket. Besides these only the four totals pass the driver.

Cases: a null or empty text has one token, the end; a very long text is one document of one task. Null ids count as training documents.
Repeated rows count as often as they occur; ties don't occur. Other columns, whatever their names, are ignored. Without training documents every word is
unknown and the uniform distribution gives the one token that is left probability one. A bucket without held-out tokens takes the weights of all tokens with
contexts of its length, and without such tokens equal weights. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

TRAIN, TUNE, SCORE_ONLY = 0, 1, 2
BUCKETS = 32
#: Rounds of EM at most; it ends earlier when no weight moves by more than SETTLED.
ROUNDS, SETTLED = 30, 1e-3
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def ngram_keys(table: pa.Table, order: int):
    """Hashes of the k-grams that end at each token, k = 1 .. order; each token's text and place in it."""
    words, counts = C.word_hashes(*C.text_slices(table))
    doc = np.repeat(np.arange(len(counts)), counts + 1)
    last = np.cumsum(counts + 1) - 1
    token = np.empty(len(doc), np.uint64)
    token[last] = END
    token[np.delete(np.arange(len(doc)), last)] = words
    place = np.arange(len(doc)) - np.repeat(last - counts, counts + 1)
    keys = [token]
    for k in range(2, order + 1):
        key = np.zeros(len(token), np.uint64)
        for back in range(k - 1, -1, -1):
            prior = np.full(len(token), START, np.uint64)
            prior[back:] = token[: len(token) - back]
            prior[place < back] = START
            key = C.mix(key * np.uint64(C.BASE) + prior + np.uint64(k))
        keys.append(key)
    return keys, doc, place, counts + 1


REQUEST = "batch int, part int, kind int, keys binary, train binary, tune binary"
REQUEST_ROWS = pa.schema([("batch", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("train", pa.binary()), ("tune", pa.binary())])
ANSWER = "batch int, part int, kind int, both binary, tune binary, n_train long, n_tune long, v_train long, v_both long"
ANSWER_ROWS = pa.schema([("batch", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("both", pa.binary()), ("tune", pa.binary()), *((n, pa.int64()) for n in ("n_train", "n_tune", "v_train", "v_both"))])


def _requests(order: int, n: int, batches: int):
    """The n-grams of a batch with their counts; those of its held-out documents once more, without counts, as batch number batches + batch."""

    def run(table: pa.Table) -> pa.Table:
        batch = int(C.numbers(table, "batch")[0])
        role = C.numbers(table, "role")
        keys, doc, _, _ = ngram_keys(table, order)
        rows = []
        for kind, key in enumerate(keys, 1):
            distinct, back = np.unique(key, return_inverse=True)
            train, tune = (np.bincount(back, role[doc] == r, len(distinct)).astype(np.uint32) for r in (TRAIN, TUNE))
            rows += [(batch, p, kind, C.pack_sorted(distinct[a:b]), C.pack(train[a:b]), C.pack(tune[a:b])) for p, a, b in C.deal(distinct, n)]
            held = distinct[tune > 0]
            rows += [(batch + batches, p, kind, C.pack_sorted(held[a:b]), none := C.pack(np.zeros(b - a, np.uint32)), none) for p, a, b in C.deal(held, n)]
        return C.as_table(rows, REQUEST_ROWS)

    return run


def _count(table: pa.Table) -> pa.Table:
    """Sums the counts of each n-gram over the batches and answers each batch; a row with batch -1 has the partition's totals."""
    part, kinds, rows = int(C.numbers(table, "part")[0]), C.numbers(table, "kind"), []
    for kind in np.unique(kinds):
        own = table.filter(pa.array(kinds == kind))
        sent = [C.unpack_sorted(x.as_py()) for x in own.column("keys")]
        distinct, back = np.unique(np.concatenate(sent), return_inverse=True)
        train, tune = (np.bincount(back, np.concatenate([C.unpack(x.as_py(), np.uint32) for x in own.column(c)]), len(distinct)).astype(np.int64) for c in ("train", "tune"))
        both, at = train + tune, 0
        for b, k in zip(C.numbers(own, "batch"), sent, strict=True):
            mine = back[at : at + len(k)]
            rows.append((int(b), part, int(kind), C.pack(both[mine]), C.pack(tune[mine]), None, None, None, None))
            at += len(k)
        rows.append((-1, part, int(kind), None, None, int(train.sum()), int(tune.sum()), int((train > 0).sum()), int((both > 0).sum())))
    return C.as_table(rows, ANSWER_ROWS)


def _looked_up(keys: list[np.ndarray], answers: pa.Table, n: int, columns: tuple[str, ...]):
    """For each order the counts of each token's n-gram, a list for each column."""
    said = {(k, p): i for i, (k, p) in enumerate(zip(C.numbers(answers, "kind").tolist(), C.numbers(answers, "part").tolist(), strict=True))}
    bodies = {c: answers.column(c) for c in columns}
    out = []
    for kind, key in enumerate(keys, 1):
        distinct, back = np.unique(key, return_inverse=True)
        cuts = C.deal(distinct, n)
        out.append([np.concatenate([C.unpack(bodies[c][said[kind, p]].as_py(), np.int64) for p, _, _ in cuts])[back] for c in columns])
    return out


def _estimates(counts: list[np.ndarray], place: np.ndarray, documents: int, total: int):
    """Maximum-likelihood probabilities of each token by order, highest order first, and the bucket: length of the longest seen context * BUCKETS + its frequency's.

    Length 0 is the empty context; without any training token it hasn't been seen, and the bucket is -1.
    """
    ml, bucket = [], np.full(len(place), -1, np.int64)
    for k in range(len(counts), 0, -1):
        if k == 1:
            below = np.full(len(place), total, np.int64)
        else:
            below = np.empty(len(place), np.int64)
            below[1:] = counts[k - 2][:-1]
            below[place == 0] = documents
        ml.append(np.divide(counts[k - 1], below, out=np.zeros(len(place)), where=below > 0))
        new = (bucket < 0) & (below > 0)
        bucket[new] = (k - 1) * BUCKETS + np.minimum(np.log2(below[new]).astype(np.int64), BUCKETS - 1)
    return ml, bucket


def _held_out(order: int, n: int, total: int):
    """Estimates of a batch's held-out tokens by order, and the bucket; equal rows once with their number."""
    schema = pa.schema([("bucket", pa.int64()), *((f"p{k}", pa.float64()) for k in range(order)), ("weight", pa.int64())])

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return C.as_table([], schema)
        keys, _, place, _ = ngram_keys(table, order)
        counts = [both - tune for both, tune in _looked_up(keys, answers, n, ("both", "tune"))]
        documents = int(counts[0][keys[0] == END][0])
        ml, bucket = _estimates(counts, place, documents, total)
        by = np.lexsort((*ml, bucket))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(bucket[by]) != 0) | np.any([np.diff(m[by]) != 0 for m in ml], axis=0)]))
        return pa.table([pa.array(bucket[by][new]), *(pa.array(m[by][new]) for m in ml), pa.array(np.diff(new, append=len(by)))], schema=schema)

    return run


def available(order: int) -> np.ndarray:
    """For each bucket which of the orders (highest first, then the uniform distribution) have an estimate."""
    length = np.arange(order * BUCKETS) // BUCKETS
    return np.column_stack([*(length >= k - 1 for k in range(order, 0, -1)), np.ones(order * BUCKETS, bool)])


def learn_weights(tokens: DataFrame, order: int, uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """EM over tokens (bucket, p0, .., weight), p0 of the highest order: mixture weights of each bucket, orders from the highest to the uniform distribution.

    The uniform part keeps at least 1e-6.
    """
    spark, names = tokens.sparkSession, [f"w{k}" for k in range(order + 1)]
    usable = available(order)
    parts = [F.col(f"w{k}") * (F.col(f"p{k}") if k < order else F.lit(uniform)) for k in range(order + 1)]
    whole = sum(parts[1:], parts[0])
    sums = [F.sum(F.col("weight") * part / whole).alias(f"s{k}") for k, part in enumerate(parts)]

    def normal(share: np.ndarray) -> np.ndarray:
        share = np.where(usable, share, 0.0)
        share[:, order] = np.maximum(share[:, order], 1e-6 * share.sum(axis=1))
        return share / share.sum(axis=1, keepdims=True)

    weights = normal(np.ones((order * BUCKETS, order + 1)))
    for _ in range(rounds):
        now = spark.createDataFrame([(b, *map(float, w)) for b, w in enumerate(weights)], ", ".join(["b long", *(f"{c} double" for c in names)]))
        found = tokens.join(F.broadcast(now), F.col("bucket") == F.col("b")).groupBy("bucket").agg(*sums).collect()  # a row for each of order * BUCKETS buckets
        share = np.zeros((order * BUCKETS, order + 1))
        for r in found:
            share[r["bucket"]] = r[1:]
        if not found:
            break
        # buckets without held-out tokens take the weights of all tokens with contexts of that length
        by_length = share.reshape(order, BUCKETS, -1).sum(axis=1).repeat(BUCKETS, axis=0)
        seen = share.sum(axis=1, keepdims=True) > 0
        share = np.where(seen, share, by_length)
        share = np.where(share.sum(axis=1, keepdims=True) > 0, share, weights)
        before, weights = weights, normal(share)
        if np.abs(weights - before).max() < SETTLED:
            break
    return weights


def _score(order: int, n: int, total: int, distinct: int, weights: np.ndarray):
    schema = pa.schema([("id", pa.int64()), ("role", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return C.as_table([], schema)
        keys, doc, place, sizes = ngram_keys(table, order)
        counts = [c[0] for c in _looked_up(keys, answers, n, ("both",))]
        documents = int(counts[0][keys[0] == END][0])
        ml, bucket = _estimates(counts, place, documents, total)
        p = np.where(bucket < 0, 1.0, weights[bucket, order]) / (distinct + 1)
        for k, m in enumerate(ml):
            p = p + weights[bucket, k] * m
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        base = np.log10((counts[0] + 1) / (total + distinct + 1))
        return pa.table(
            [pa.array(C.numbers(table, "id")), pa.array(C.numbers(table, "role")), pa.array(sizes), pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(p), first))],
            schema=schema,
        )

    return run


def score(docs: DataFrame, held_out: Column, order: int = 2, tune_share: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every document; learns from those where held_out is not true, weights from one of tune_share of them.

    Returns id_col, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score (both log10).
    """
    if not 1 <= order <= 4:
        raise ValueError("order must be from 1 to 4")
    spark = docs.sparkSession
    n = C.batch_count(docs, text_col)
    parts = C.key_partitions(spark, n, 16)
    tune = F.pmod(F.xxhash64(F.lit("tune"), F.col(id_col)), F.lit(tune_share)) == 0
    role = F.when(F.coalesce(held_out, F.lit(False)), SCORE_ONLY).when(tune, TUNE).otherwise(TRAIN).cast("int")
    batches = C.in_batches(docs, n, id_col, text_col, role=role)
    requests = batches.groupBy("batch").applyInArrow(_requests(order, parts, n), REQUEST)
    answers = C.written(requests.groupBy("part").applyInArrow(_count, ANSWER), "ngram-counts")
    totals = {r["kind"]: r for r in answers.filter("batch = -1").groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("n_train", "n_tune", "v_train", "v_both"))).collect()}
    one = totals.get(1)
    n_train, n_both, v_train, v_both = (one["n_train"], one["n_train"] + one["n_tune"], one["v_train"], one["v_both"]) if one else (0, 0, 0, 0)
    replies = answers.filter("batch >= 0").select("batch", "part", "kind", "both", "tune")
    held = batches.filter(F.col("role") == TUNE).withColumn("batch", F.col("batch") + n)
    names = ["bucket", *(f"p{k}" for k in range(order))]
    tokens = held.groupBy("batch").cogroup(replies.filter(F.col("batch") >= n).groupBy("batch")).applyInArrow(_held_out(order, parts, n_train), ", ".join(["bucket long", *(f"p{k} double" for k in range(order)), "weight long"]))
    tokens = C.written(tokens.filter("bucket >= 0").groupBy(*names).agg(F.sum("weight").alias("weight")), "held-out")
    weights = learn_weights(tokens, order, 1 / (v_train + 1))
    mine = replies.filter(F.col("batch") < n).select("batch", "part", "kind", "both")
    result = batches.groupBy("batch").cogroup(mine.groupBy("batch")).applyInArrow(_score(order, parts, n_both, v_both, weights), "id long, role int, n_tokens long, n_known long, base_score double, score double")
    return result.select(C.null_id("id", id_col), (F.col("role") == SCORE_ONLY).alias("held_out"), "n_tokens", "n_known", F.lit(n_both).cast("long").alias("train_tokens"), "base_score", "score")
