"""Near copies in the pipeline: links are verified, decisions hold for rows."""

import random
from collections import defaultdict

import corpus_pipeline as pipeline
from tidemark.llm import simhash


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, times):
    out = list(words)
    for at in rng.sample(range(0, len(words), 5), times):
        out[at] = f"e{rng.randint(0, 10**9)}"
    return " ".join(out)


def test_links_below_the_similarity_are_not_taken(spark):
    """Fingerprints link some pairs between 0.6 and 0.8; every group's members must be connected by pairs from 0.8 on."""
    rng, rows = random.Random(11), []
    for k in range(60):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, edited(rng, base, 2)), (10 * k + 2, edited(rng, base, 10))]  # 0.8 takes some six edits
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    text = dict(rows)
    for k in range(60):
        a, b, c = 10 * k, 10 * k + 1, 10 * k + 2
        assert jaccard(text[a], text[b]) >= 0.8 > max(jaccard(text[a], text[c]), jaccard(text[b], text[c]))
    kept = {r.doc_id for r in pipeline.near_dedup_stage(spark, frame, "").collect()}
    assert kept == {10 * k + x for k in range(60) for x in (0, 2)}


def test_groups_of_odd_rows_hold_together(docs, rows):
    """Groups are unions of pairs from 0.8 on: no row is in a group with others without such a pair to one of them."""
    found = {}
    for r in simhash.similar_groups(docs).select("body", "component", "doc_id").collect():
        found.setdefault(r.component, set()).add((r.doc_id, r.body))
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    for members in found.values():
        ids = {i for i, _ in members if i is not None}
        for i in ids if len(ids) > 1 else ():
            assert any(jaccard(texts[i][0], texts[j][0]) >= 0.8 for j in ids - {i})


def test_decisions_hold_for_rows(spark, tmp_path):
    """Rows that share an id but not the text, and contaminated rows without an id."""
    rng = random.Random(5)
    fresh = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40))
    a, b, c, leak, other = fresh(), fresh(), fresh(), fresh(), fresh()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    put = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    of = lambda df: sorted((r.doc_id or -1, r.text) for r in df.collect())
    once = pipeline.near_dedup_stage(spark, put([(1, a), (2, a), (2, b), (3, c), (3, c)]), "")
    assert of(once) == sorted([(1, a), (2, b), (3, c)])  # 2, b shares an id with a copy of a, but isn't one
    spark.createDataFrame([("x", leak)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = pipeline.decontamination_stage(spark, put([(None, leak), (None, other), (4, leak), (4, b)]), str(tmp_path))
    assert of(clean) == sorted([(-1, other), (4, b)])


def test_sketches_never_rule_out_a_similar_pair():
    """Sketches differ in no more bits than two sets have members of their own; for unlike pairs in nearly as many."""
    import numpy as np

    rng = np.random.default_rng(6)
    for n in (1, 5, 40, 300, 5000):
        for share in (0.0, 0.02, 0.1, 0.3):
            base = rng.integers(0, 2**63, n).astype(np.uint64)
            other = np.where(rng.random(n) < share, rng.integers(0, 2**63, n).astype(np.uint64), base)
            a, b = np.unique(base), np.unique(other)
            sketches = simhash.odd_sketch(np.concatenate([a, b]), np.array([len(a), len(b)]))
            bits = int(np.bitwise_count((sketches[0] ^ sketches[1]).view(np.uint64)).sum())
            own = len(np.setxor1d(a, b))
            assert bits <= own and (bits - own) % 2 == 0
            assert own > 200 or bits >= 0.75 * own


def test_recall_of_near_pairs(spark):
    """Of planted pairs from 0.8 on at least nine in ten get into one group, at every length; the figures are those of the README."""
    rng, rows, wanted = random.Random(8), [], defaultdict(list)
    for size in (12, 24, 60, 150, 400):
        for _ in range(100):
            base = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
            times = 1
            text = None
            while times * 5 <= size and jaccard(" ".join(base), once := edited(rng, base, times)) >= 0.8:
                text, times = once, times + max(1, size // 100)
            if text is None:  # a word more at the end costs one shingle
                text = " ".join([*base, "other"])
            if jaccard(" ".join(base), text) >= 0.8:
                wanted[size].append(len(rows))
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, text)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    component = {r.doc_id: r.component for r in simhash.similar_groups(frame).collect()}
    found = {size: sum(component[k] == component[k + 1] for k in pairs) / len(pairs) for size, pairs in wanted.items()}
    print(found, {size: round(min(jaccard(rows[k][1], rows[k + 1][1]) for k in pairs), 3) for size, pairs in wanted.items()})
    assert len(found) == 5 and min(found.values()) >= 0.9
    assert len({component[k] for pairs in wanted.values() for k in pairs}) == sum(map(len, wanted.values()))  # no group holds two pairs
