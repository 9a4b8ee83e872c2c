"""Operators on documents against brute force, with nulls, empties, long texts, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, lm_scoring, media, mixing, quality, simhash, suffix_dedup, token_counts

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def rows_of(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


# --- LM scoring -------------------------------------------------------------------------------------------------


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def score(docs, **more):
    return lm_scoring.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, **more)


def test_base_score_equals_brute_force(docs, rows):
    counts = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    expect = Counter()
    for i, t in rows:
        tokens = [*words(t), None]
        expect[i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), 6)] += 1
    got = score(docs).withColumn("base_score", F.round("base_score", 6))
    assert rows_of(got, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score") == expect


def interpolated(rows, tuned, order):
    """The model by plain dictionaries: a function of a context (a list of words) and a word to a probability."""
    pad, floor = ["<s>"] * (order - 1), 1e-6

    def count(docs):
        grams = Counter()
        for t in docs:
            w = [*pad, *words(t), "</s>"]
            for k in range(order - 1, len(w)):
                for n in range(1, order + 1):
                    grams[tuple(w[k - n + 1 : k + 1])] += 1
        # how often a context stands before a token
        below = Counter()
        for g, c in grams.items():
            below[g[:-1]] += c
        return grams, below

    train = [t for i, t in rows if not held(i) and i not in tuned]
    tune = [t for i, t in rows if not held(i) and i in tuned]
    grams, below = count(train)
    v = sum(len(g) == 1 for g in grams)

    def parts(grams, below, v, context, word):
        """Estimates by order from the highest, then uniform; the bucket."""
        p, bucket = [], None
        for n in range(order, 0, -1):
            c = tuple(context[len(context) - n + 1 :])
            p.append(grams[(*c, word)] / below[c] if below[c] else None)
            if bucket is None and below[c]:
                bucket = n - 1, below[c].bit_length() - 1
        return [*p, 1 / (v + 1)], bucket

    tokens = []
    for t in tune:
        w = [*pad, *words(t), "</s>"]
        tokens += [parts(grams, below, v, w[:k], w[k]) for k in range(order - 1, len(w))]
    lengths = {b: [x for x in tokens if x[1] and x[1][0] == b] for b in range(order)}
    weights = {}

    def usable(length):
        return [n - 1 <= length for n in range(order, 0, -1)] + [True]

    def normal(share):
        share = list(share)
        share[-1] = max(share[-1], floor * sum(share))
        return [x / sum(share) for x in share]

    buckets = [(length, f) for length in range(order) for f in range(lm_scoring.BUCKETS)]
    for b in buckets:
        weights[b] = normal([float(u) for u in usable(b[0])])
    for _ in range(lm_scoring.ROUNDS if tokens else 0):
        share = {b: [0.0] * (order + 1) for b in buckets}
        for p, b in tokens:
            if b:
                joint = [(x or 0) * w for x, w in zip(p, weights[b], strict=True)]
                share[b] = [s + j / sum(joint) for s, j in zip(share[b], joint, strict=True)]
        both = {length: [sum(share[length, f][k] for f in range(lm_scoring.BUCKETS)) for k in range(order + 1)] for length in range(order)}
        now = {b: normal(share[b]) if sum(share[b]) else normal(both[b[0]]) if lengths[b[0]] else weights[b] for b in buckets}
        moved = max(abs(x - y) for b in buckets for x, y in zip(now[b], weights[b], strict=True))
        weights = now
        if moved < lm_scoring.SETTLED:
            break
    grams, below = count(train + tune)
    v = sum(len(g) == 1 for g in grams)

    def probability(context, word):
        p, b = parts(grams, below, v, [*pad, *context], word)
        return sum((x or 0) * w for x, w in zip(p, weights[b], strict=True)) if b else p[-1]

    return probability, {g[0] for g in grams if len(g) == 1}


def tuned_ids(spark, ids):
    frame = spark.createDataFrame([(i,) for i in set(ids)], "doc_id long")
    return {r.doc_id for r in frame.filter(F.pmod(F.xxhash64(F.lit("tune"), F.col("doc_id")), F.lit(16)) == 0).collect()}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_score_equals_brute_force(spark, docs, rows, order):
    p, _ = interpolated(rows, tuned_ids(spark, [i for i, _ in rows]), order)
    expect = defaultdict(list)
    for i, t in rows:
        w = [*words(t), "</s>"]
        expect[i].append(sum(math.log10(p(w[:k], w[k])) for k in range(len(w))))
    got = defaultdict(list)
    for r in score(docs, order=order).collect():
        got[r.doc_id].append(r.score)
    assert {i: sorted(x) for i, x in got.items()} == {i: pytest.approx(sorted(x), rel=1e-6) for i, x in expect.items()}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_probabilities_add_up_to_one(spark, rows, order):
    """After seen and unseen contexts; the words that aren't known share one token."""
    p, known = interpolated([r for r in rows if len(r[1] or "") < 3000], tuned_ids(spark, [i for i, _ in rows]), order)
    for context in ([], ["one"], ["never", "seen"], words(rows[0][1])[:3], ["never", *words(rows[1][1])[:1]]):
        assert sum(p(context, w) for w in [*known, "unknown-word"]) == pytest.approx(1)


def test_without_training_the_one_token_is_certain(spark):
    ids = [k for k in range(200) if held(k)][:3]
    got = score(spark.createDataFrame([(ids[0], "a b"), (ids[1], None), (ids[2], "")], "doc_id long, text string")).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in got) and len(got) == 3


def test_model_beats_unigrams_on_unseen_text(docs):
    r = score(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_em_learns_the_better_estimate(spark):
    import numpy as np

    # in bucket 3 the longest context is right (p = 0.5), in bucket 1 it gives nothing
    b = lm_scoring.BUCKETS
    tokens = spark.createDataFrame([(b + 3, 0.5, 0.004, 100), (b + 1, 0.0, 0.5, 100)], "bucket long, p0 double, p1 double, weight long")
    weights = lm_scoring.learn_weights(tokens, 2, 1e-4)
    assert weights[b + 3, 0] > 0.95 and weights[b + 1, 0] < 0.01 and weights[b + 1, 1] > 0.95
    assert np.allclose(weights.sum(axis=1), 1) and not weights[:b, 0].any()


def test_lm_without_rows(nothing):
    assert score(nothing).count() == 0


# --- suffix-array dedup --------------------------------------------------------------------------------------------


def removed(rows, length):
    low = {}
    key = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s not in low or key(i) < low[s]:
                low[s] = key(i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if low[b[k : k + length]] < key(i):
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("length", "hot"), [(32, 64), (50, 64), (120, 64), (50, 1), (100, 2)])
def test_repeats_equal_brute_force(docs, rows, length, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_BATCHES", hot)  # workers are forked with it or not: either way the result is the same
    got = suffix_dedup.remove_repeats(docs, length)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed(rows, length)


@pytest.mark.parametrize(("length", "hot", "chunk"), [(50, 512, 7), (50, 1, 20), (100, 2, 1), (32, 1, 1 << 15)])
def test_steps_in_small_runs_equal_brute_force(rows, length, hot, chunk, monkeypatch):
    """The steps of a job by hand, where the settings surely hold: few contexts at once, hot phrases."""
    monkeypatch.setattr(suffix_dedup, "HOT_BATCHES", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    n, parts = 5, 3
    ids, texts = [-(2**63) if i is None else i for i, _ in rows], [t for _, t in rows]
    batches = [pa.table({"batch": pa.array([b] * len(ids[b::n]), pa.int32()), "id": pa.array(ids[b::n], pa.int64()), "text": pa.array(texts[b::n], pa.string())}) for b in range(n)]

    def dealt(tables, column, count):
        every = pa.concat_tables(tables)
        return [every.filter(pc.equal(every[column], k)) for k in range(count)]

    flags = [suffix_dedup._shared(t) for t in dealt([suffix_dedup._phrases(length, parts, 48)(b) for b in batches], "part", parts) if len(t)]
    contexts = [suffix_dedup._contexts(length, parts, 48)(b, f) for b, f in zip(batches, dealt(flags, "batch", n), strict=True)]
    order = [suffix_dedup._order(length)(t) for t in dealt(contexts, "part", parts) if len(t)]
    got = [suffix_dedup._remove(length, parts, 48, False)(b, a) for b, a in zip(batches, dealt([*flags, *order], "batch", n), strict=True)]
    found = Counter((None if r["id"] == -(2**63) else r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for t in got for r in t.to_pylist())
    assert found == removed(rows, length)


def test_low_entropy_and_overlaps(spark):
    rows = [(1, "a" * 200), (2, "a" * 49), (3, "b" + "a" * 60 + "b"), (4, "ab" * 60), (5, "ba" * 40), (6, "x" + "ab" * 30 + "y" + "a" * 55), (7, "é" * 60), (8, "zé" * 2 + "é" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed(rows, 50)


def test_repeats_keep_columns(docs, nothing):
    got = suffix_dedup.remove_repeats(docs, keep=("source", "lang", "batch"))
    assert got.columns[-3:] == ["source", "lang", "batch"] and got.filter("batch = 'clash'").count() == docs.count()
    assert suffix_dedup.remove_repeats(nothing, keep=("source",)).count() == 0


# --- SimHash -------------------------------------------------------------------------------------------------------


def fingerprint(text, k):
    w = words(text)
    shingles = [" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, bits):
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return [top(k) for k in range(len(prints))]


@pytest.mark.parametrize(("bits", "block"), [(3, 1 << 14), (3, 8), (7, 16), (0, 4)])
def test_near_duplicates_equal_brute_force(docs, rows, bits, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "WIDE_BLOCK", block)
    prints = [fingerprint(t, 3) for _, t in rows]
    tops = groups(prints, bits)
    least = defaultdict(lambda: None)
    for (i, _), g in zip(rows, tops, strict=True):
        if i is not None and (least[g] is None or i < least[g]):
            least[g] = i
    expect = Counter((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, tops, strict=True))
    assert rows_of(simhash.near_duplicates(docs, 3, bits), "doc_id", "fingerprint", "component_id") == expect


def test_walk_finds_all_pairs_in_dense_and_sparse_sets():
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = base[rng.integers(0, 40, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    a = np.unique(np.concatenate([base, near]))
    for budget, lead in ((3, 0), (7, 1), (9, 16), (0, 0)):
        found = {(int(i), int(j)) for x, y in simhash.walk(a, None, budget, lead) for i, j in zip(x, y, strict=True)}
        differ = np.bitwise_count(a[:, None] ^ a[None, :])
        front = np.bitwise_count((a[:, None] ^ a[None, :]) >> np.uint64(48))
        i, j = np.nonzero((differ <= budget) & (front <= lead))
        assert found == {(int(x), int(y)) for x, y in zip(i, j, strict=True) if x < y}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100}


def test_simhash_without_rows(nothing):
    assert simhash.near_duplicates(nothing).count() == 0


# --- joins in shares ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [1, 7, 100, common.HOT_ROWS])
def test_joined_in_shares(spark, hot):
    rows = [(k, "hot" if k % 3 else f"k{k % 7}") for k in range(300)] + [(0, "hot"), (0, "hot"), (900, "alone")]
    freq = Counter(h for _, h in rows)
    table = [(h, h + x, freq[h]) for h in freq if h != "alone" for x in "ab"] + [("absent", "c", 0)]
    left, right = spark.createDataFrame(rows, "id long, h string"), spark.createDataFrame(table, "h string, item string, freq long")
    got = common.joined_in_shares(left, right, ["h"], "freq", ["id"], hot)
    assert got.columns == ["h", "id", "item"] and rows_of(got, "id", "h", "item") == Counter((i, h, h + x) for i, h in rows if h != "alone" for x in "ab")


def test_a_hot_key_is_many_tasks(spark):
    rows = spark.range(20_000).select("id", F.concat(F.lit("hot"), (F.col("id") % 1).cast("string")).alias("h"))
    table = spark.createDataFrame([("hot0", 20_000)], "h string, freq long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        most = lambda hot: common.joined_in_shares(rows, table, ["h"], "freq", ["id"], hot).groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        assert most(common.HOT_ROWS) == 20_000 and most(500) < 9_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# --- decontamination -----------------------------------------------------------------------------------------------

ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contaminated(rows, items):
    split = lambda t: ITEM_WORD.findall((t or "").translate(UPPER))
    wins = defaultdict(set)
    for item, t in items:
        w = split(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else []:
            wins[tuple(w[k : k + n])].add(str(item))
    out = Counter()
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[x]
        out[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


@pytest.mark.parametrize(("broadcast_keys", "hot"), [(2_000_000, common.HOT_ROWS), (0, common.HOT_ROWS), (2_000_000, 1), (0, 3)])
def test_contamination_equals_brute_force(spark, docs, rows, broadcast_keys, hot):
    texts = [t for _, t in rows if t and len(t.split()) > 40]
    items = [(1, texts[0]), (2, " ".join(texts[1].split()[3:30])), (10, " ".join(texts[2].split()[:13])), (3, "one"), (4, texts[3].split()[0] + "!" + texts[3].split()[1]), (5, None), (6, ""), (7, "never seen words of any text at all in here for sure today"), (8, texts[0])]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit("clash")).withColumn("s", F.lit(1))
    got = decontaminate.decontaminate(docs, frame, broadcast_keys=broadcast_keys, hot=hot)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == contaminated(rows, items)


def test_contamination_without_rows(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontaminate.decontaminate(nothing, some).count() == 0
    got = decontaminate.decontaminate(docs, none)
    assert got.count() == docs.count() and got.filter("contaminated or n_hit > 0").count() == 0


def test_decontamination_runs_no_python(spark, docs):
    some = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    for df in (decontaminate.decontaminate(docs, some), mixing.mix(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# --- media ---------------------------------------------------------------------------------------------------------


def test_media_round_trip(docs, rows):
    expect = Counter()
    for i, t in rows:
        b = (t or "").encode()
        p = media.padded(b)
        m = media.encode(p)
        expect[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest()] += 1
    got = media.interleaved(docs)
    assert rows_of(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256") == expect
    feature = {}
    for r in got.collect():
        assert feature.setdefault(r.payload_sha256 + str(r.n_bytes), r.feature) == r.feature


def test_png_is_lossless_and_checked():
    for p in (b" " * 192, bytes(range(192)) * 3):
        assert media.decode(media.encode(p)) == p
    bad = bytearray(media.encode(b"x" * 192))
    bad[-20] ^= 1
    with pytest.raises(ValueError):
        media.decode(bytes(bad))


def test_html_keeps_order_and_captions(spark):
    html = "<p>one &amp; two<script>no</script></p><figure><img src='sha256:d1' alt='a'><figcaption>cap <b>1</b></figcaption></figure>tail<img src='sha256:missing' alt='b'><figcaption>stray</figcaption><p>last<img src=sha256:d1>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "row long, html string")
    found = spark.createDataFrame([("d1", b"payload")], "digest string, payload binary")
    got = {r.row: [(x.kind, x.text, x.caption, bytes(x.payload) if x.payload else None) for x in r["items"]] for r in media.resolve(media.parse(pages), found, "row").collect()}
    assert got == {1: [("text", "one & two", None, None), ("media", None, "cap 1", b"payload"), ("text", "tail", None, None), ("media", None, "b", None), ("text", "stray", None, None), ("text", "last", None, None), ("media", None, None, b"payload")], 2: [], 3: []}


def test_media_without_rows(nothing):
    assert media.interleaved(nothing).count() == 0


# --- quality -------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    import random

    rng = random.Random(4)
    plain = [f"w{k}" for k in range(400)]
    toxic = ["vile", "nasty", "awful"]

    def text(grade):
        w = rng.choices(plain, k=rng.randint(20, 200))
        if grade == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(toxic)
        if grade == 1:
            w = [x + "***" for x in w]
        return " ".join(w)

    grades = [rng.choice([0, 1, 2, 2]) for _ in range(900)]
    docs = spark.createDataFrame([(k, text(g)) for k, g in enumerate(grades)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, g) for k, g in enumerate(grades) if k < 600] + [(None, 1), (5000, 0), (3, None)], "doc_id long, grade int")
    model = quality.fit(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert sum(got[k].keep == (grades[k] == 2) for k in range(600, 900)) >= 290
    mean = [sum(got[k].expected_grade for k in range(600, 900) if grades[k] == g) / sum(grades[k] == g for k in range(600, 900)) for g in range(3)]
    assert mean[0] < mean[1] < mean[2] and all(r.p_ge_1 >= r.p_ge_2 for r in got.values())


def test_fit_is_a_minimum_of_the_plain_objective(spark):
    """Ordinal log-likelihood written out row by row: no step along any weight or threshold lowers it by more than the penalty and the stopping allow; scores follow from it."""
    import random

    import numpy as np

    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(30)]
    grades = [k % 3 for k in range(240)]
    texts = [" ".join(rng.choices(vocabulary, k=15) + (["good"] if g == 2 and rng.random() < 0.8 else []) + (["bad"] if g == 0 and rng.random() < 0.8 else [])) for g in grades]
    rows, keys = [], []
    for k, t in enumerate(texts):
        _, found = quality.features(memoryview(t.encode()), np.array([0, len(t.encode())]))
        rows += [k] * len(found)
        keys += found.tolist()
    model = quality.learn(np.array(rows, np.int32), np.array(keys, np.uint64), np.array(grades), rounds=1500)
    of = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    x = [[c for r, c in zip(rows, keys, strict=True) if r == k] for k in range(len(texts))]

    def loss(weights, thresholds):
        total = 0.0
        for k, g in enumerate(grades):
            s = sum(weights.get(c, 0.0) for c in x[k])
            below = [0.0, *(1 / (1 + math.exp(s - t)) for t in thresholds), 1.0]
            total -= math.log(below[g + 1] - below[g])
        return total / len(grades) + 0.1 * 0.05 / math.sqrt(len(grades)) * sum(map(abs, weights.values()))

    least = loss(of, model.thresholds)
    for c in of:
        for step in (-0.05, 0.05):
            assert loss(of | {c: of[c] + step}, model.thresholds) > least - 2e-4
    for k in range(2):
        for step in (-0.05, 0.05):
            moved = model.thresholds.copy()
            moved[k] += step
            assert loss(of, moved) > least - 2e-4
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k in range(0, 240, 11):
        s = sum(of.get(c, 0.0) for c in x[k])
        tails = [1 - 1 / (1 + math.exp(s - t)) for t in model.thresholds]
        assert (got[k].p_ge_1, got[k].p_ge_2, got[k].expected_grade) == (pytest.approx(tails[0]), pytest.approx(tails[1]), pytest.approx(sum(tails)))


def test_fit_does_not_depend_on_partitions(spark):
    import numpy as np

    docs = spark.createDataFrame([(k, f"w{k % 7} v{k % 5} u{k % 3}") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 3) for k in range(200)], "doc_id long, grade int")
    a, b = quality.fit(docs.repartition(1), labels), quality.fit(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(a.keys, b.keys) and np.array_equal(a.weights, b.weights) and np.array_equal(a.thresholds, b.thresholds)


def test_quality_edges(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = quality.fit(docs, none)
    got = quality.score(docs, model, keep=("text", "source", "label"))
    assert got.count() == docs.count() and got.agg(F.min("expected_grade"), F.max("expected_grade")).first() == (pytest.approx(1), pytest.approx(1))
    assert rows_of(got, "doc_id", "text", "source") == rows_of(docs, "doc_id", "text", "source")
    assert quality.score(nothing, model).count() == 0


def test_ranks_of_phrases_order_bytes():
    """The parse's suffix array by ranks is the order of the bytes, with the bytes that neighbours share; phrases lie where triggers are."""
    import numpy as np

    rng = np.random.default_rng(3)
    for length in (16, 50, 100):
        span = suffix_dedup.span_of(length)
        for letters in (2, 5, 250):
            rows = rng.integers(0, letters, (400, length)).astype(np.uint8)
            rows[200:300] = rows[:100]
            rows[250:300, length - 5 :] = 0
            rows[390:] = 7
            order, common = suffix_dedup.parse_order(rows, span)
            plain = [rows[k].tobytes() for k in order]
            assert plain == sorted(plain)
            assert common[0] == -1 and all(c == next((k for k in range(length) if a[k] != b[k]), length) for a, b, c in zip(plain, plain[1:], common[1:], strict=False))
    text = bytes(rng.integers(97, 107, 3000).astype(np.uint8))
    parse = suffix_dedup.Parse(pa.table({"id": pa.array([1], pa.int64()), "text": pa.array([text.decode()])}), 50)
    triggers = set(parse.at.tolist())
    for at in parse.at.tolist():
        if at + 50 <= len(text) - 100:
            places = suffix_dedup.phrase_places(np.frombuffer(text[at : at + 50], np.uint8)[None, :], parse.width)[0]
            assert all(at + k in triggers for k in places.tolist() if 0 <= k < 50 - parse.width - suffix_dedup.HASH_BYTES)


# --- mixing --------------------------------------------------------------------------------------------------------


def shares(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w, full = {s: weights[k % len(weights)] for k, s in enumerate(order)}, {}
    left, free = sum(sizes.values()), set(order)
    while free:
        unit = left / sum(w[s] for s in free)
        over = {s for s in free if unit * w[s] > cap * sizes[s] * (1 + 1e-12)}
        if not over:
            return full | {s: unit * w[s] for s in free}
        full |= {s: cap * sizes[s] for s in over}
        left -= sum(full[s] for s in over)
        free -= over
    return full


def test_mix_meets_targets(docs):
    given = [(r.doc_id, r.source, len(words(r.text))) for r in docs.collect()]
    sizes = Counter()
    for _, s, n in given:
        sizes[s] += n
    target = shares(sizes)
    got = mixing.mix(docs, block_words=8, shard_slots=64, keep=("source",)).collect()
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in got) == Counter((i, n, sizes[s], round(target[s], 6)) for i, s, n in given)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 32
    again = mixing.mix(docs, block_words=8, shard_slots=64)
    assert rows_of(again, "doc_id", "size", "taken") == Counter((r.doc_id, r["size"], r.taken) for r in got)


def test_draws_decide_the_mix(docs, monkeypatch):
    """Another draw takes other words; a draw of one source takes from that one only."""
    taken = lambda **more: {(r.doc_id, r["size"]): r.taken for r in mixing.mix(docs, block_words=8, **more).collect()}
    first = taken(shard_slots=64)
    assert taken(shard_slots=32) != first
    one = lambda spark, shares, slots, shard, *_: shares.filter("sid = 1").select("sid", F.lit(shard).cast("long").alias("shard"), F.lit(slots).cast("long").alias("n"))
    monkeypatch.setattr(mixing, "draws", one)
    got = mixing.mix(docs, block_words=8, keep=("source",)).filter("taken > 0").select("source").distinct().collect()
    assert len(got) == 1


def test_shards_are_multinomial_draws(spark):
    """A shard's counts have the mean and the variance of a multinomial draw, shards are independent, totals come near what is wanted."""
    wanted = spark.createDataFrame([(0, 60_000.0), (1, 30_000.0), (2, 9_000.0), (3, 1_000.0)], "sid long, wanted double")
    rows = mixing.shard_counts(spark, wanted, 100, 7).collect()
    n = {(r.sid, r.shard): r.n for r in rows}
    total = Counter()
    for (sid, _), k in n.items():
        total[sid] += k
    for sid, w in enumerate((60_000, 30_000, 9_000, 1_000)):
        assert abs(total[sid] - w) <= 25
        p, shards = w / 100_000, range(750)  # the first round
        counts = [n.get((sid, s), 0) for s in shards]
        mean = sum(counts) / 750
        variance = sum((c - mean) ** 2 for c in counts) / 749
        assert abs(mean - 100 * p) < 4 * math.sqrt(100 * p * (1 - p) / 750)
        assert 0.8 < variance / (100 * p * (1 - p)) < 1.25
        ahead = sum((a - mean) * (b - mean) for a, b in zip(counts, counts[1:], strict=False)) / 749
        assert abs(ahead) < 0.15 * variance
    assert all(sum(n.get((sid, s), 0) for sid in range(4)) == 100 for s in range(750))


def test_caps_are_shared_again(spark):
    rows = [(k, " ".join(["w"] * n), s) for k, (s, n) in enumerate([("a", 10), ("b", 1000), ("c", 1000), ("d", 5), ("e", 300)])]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=4).collect()}
    target = shares({s: len(t.split()) for _, t, s in rows})
    assert all(got[k].target == pytest.approx(target[s]) for k, _, s in rows) and got[0].target == 30


def test_permutations_are_complete(spark):
    for n in (1, 2, 7, 1000, 2097143):
        k = spark.range(min(n, 3000)).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1)).alias("x"))
        assert k.agg(F.countDistinct("x"), F.min("x") >= 0, F.max("x") < n).first() == (min(n, 3000), True, True)


def test_primes():
    assert all(p < 2**21 and all(p % q for q in range(2, 1449)) for p in mixing.PRIMES)


def test_word_count_rule(docs):
    for r in docs.select("text", mixing.word_count(F.col("text")).alias("n")).collect():
        assert r.n == len(words(r.text))


def test_mix_without_rows(nothing):
    assert mixing.mix(nothing).count() == 0


# --- token counts --------------------------------------------------------------------------------------------------

needs_vocabulary = pytest.mark.skipif(not token_counts.DEFAULT_RANKS, reason="no vocabulary")


@needs_vocabulary
@pytest.mark.parametrize("rule", token_counts.RULES)
@pytest.mark.parametrize("split", token_counts.SPLITS)
def test_token_allocation_equals_brute_force(docs, rows, rule, split):
    encoding, length = token_counts.encoder(token_counts.DEFAULT_RANKS)
    got = token_counts.count(docs, token_counts.DEFAULT_RANKS, split, rule)
    expect = []
    for i, t in rows:
        raw = (t or "").encode()
        ends = token_counts.sections(raw, split).tolist()
        section = [0.0] * len(ends)
        at = crossing = 0
        ids = encoding.encode_ordinary(t or "")
        for n in (int(length[k]) for k in ids):
            part = Counter(next(s for s, e in enumerate(ends) if b < e) for b in range(at, at + n))
            crossing += len(part) > 1
            if rule == "share":
                for s, b in part.items():
                    section[s] += b / n
            else:
                section[{"first": min(part), "last": max(part), "most": min(part, key=lambda s: (-part[s], s))}[rule]] += 1
            at += n
        expect.append((i, len(raw), len(ids), len(ends), crossing, tuple(round(x, 6) for x in section)))
    found = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.n_sections, r.n_crossing, tuple(round(x, 6) for x in r.section_tokens)) for r in got.collect())
    assert found == Counter(expect)


@needs_vocabulary
def test_tokens_cover_the_text(docs, nothing):
    got = token_counts.count(docs, token_counts.DEFAULT_RANKS)
    total = F.aggregate("section_tokens", F.lit(0.0), lambda a, b: a + b)
    assert got.filter(F.abs(total - F.col("n_tokens")) > 1e-6).count() == 0
    assert token_counts.count(nothing, token_counts.DEFAULT_RANKS).count() == 0
