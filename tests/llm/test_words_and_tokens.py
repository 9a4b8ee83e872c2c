"""Exact dedup, spelling variants and token alignment against brute force, with nulls, empties, long texts, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import alignment, exact_dedup, spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


# --- exact dedup ------------------------------------------------------------------------------------------------


def plain(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


@pytest.mark.parametrize("more", [{}, {"table_bytes": 3000, "buckets": 2}, {"table_bytes": 3000, "hash_bits": 3, "buckets": 2}])
def test_exact_dedup_equals_brute_force(framed, rows, more):
    """Also with tables that hold a few texts, so that buckets spill for many levels, and with hashes that different texts share."""
    rng = random.Random(5)
    rows = [r for r in rows if not r[1] or len(r[1]) < 50_000] + [(5000 + k, "the same  text of all" if k % 2 else "the same text\tof all") for k in range(200)] + [(1, "the same text of all")]
    rng.shuffle(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append(i)
    expect = Counter()
    for body, ids in groups.items():
        for i in ids:
            expect[i, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(body.encode()).hexdigest()] += 1
    found = exact_dedup.groups(framed(rows), **more).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expect
    kept = [r for r in found if r.kept]
    assert Counter(r.text_sha256 for r in kept) == Counter(hashlib.sha256(b.encode()).hexdigest() for b in groups)  # one of each group stays
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_spills_until_buckets_fit(framed, rows, capsys):
    """A bucket that doesn't fit goes on to further levels, and a text larger than a table gets one to itself."""
    texts = [(k, f"{k} " + "x" * 900) for k in range(60)] + [(100, "y" * 5000), (101, "y" * 5000)]
    made = []
    written = exact_dedup.C.written
    exact_dedup.C.written = lambda df, name, *a: made.append(name) or written(df, name, *a)
    try:
        found = exact_dedup.groups(framed(texts), table_bytes=2000, buckets=2).collect()
    finally:
        exact_dedup.C.written = written
    assert "dedup-2" in made
    assert sorted(r.doc_id for r in found if not r.kept) == [101] and all(r.group_size == (2 if r.doc_id in (100, 101) else 1) for r in found)


def test_table_probes_and_grows():
    table = exact_dedup.Table(1 << 20)
    same_slot = [(7, str(k).encode()) for k in range(50)]  # one hash, different contents
    spread = [(k * 0x9E3779B97F4A7C15 % 2**63, str(k).encode()) for k in range(3000)]
    first = [table.put(h, b) for h, b in same_slot + spread]
    assert first == list(range(3050)) and [table.put(h, b) for h, b in same_slot + spread] == first and len(table.slots) >= 6100
    full = exact_dedup.Table(100)
    assert full.put(1, b"a" * 500) == 0 and full.put(2, b"b") == -1 and full.put(1, b"a" * 500) == 0


def test_exact_dedup_of_nothing(nothing):
    assert exact_dedup.groups(nothing).collect() == []


# --- spelling variants ------------------------------------------------------------------------------------------


def words_of(rows, deleted=199):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % deleted == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts):
    linked = defaultdict(list)
    for a, b in combinations(counts, 2):
        if near(a, b):
            linked[a].append(b)
            linked[b].append(a)
    best = {w: min(linked[w], key=lambda x: (-counts[x], x)) for w in counts if linked[w]}
    form = {w: b for w, b in best.items() if counts[b] >= 5 * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return Counter((w, form.get(w), root(w), n, len(linked[w]), counts.get(form.get(w))) for w, n in counts.items())


def spelled(seed, n=250):
    """Documents of a few stems with one or two edits at all places, some rare, some frequent, letters with accents and capitals."""
    rng = random.Random(seed)
    letters = "abcdeé×ß"
    stems = ["".join(rng.choice(letters[:3]) for _ in range(rng.randint(6, 9))) for _ in range(12)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "Éléments", "STRASSE", "naïveté"]

    def edited(w):
        for _ in range(rng.choice([0, 0, 1, 1, 1, 2])):
            k = rng.randint(0, len(w))
            w = rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :]])
        return w

    rows = []
    for k in range(n):
        picked = [rng.choice(stems) if rng.random() < 0.6 else edited(rng.choice(stems)) for _ in range(40)]
        rows.append((k, rng.choice([" ", ", ", "1", "_"]).join(picked)))
    chain = " ".join(["kettesa"] * 5 + ["kettesab"] * 30 + ["kettesabc"] * 160)
    return [*rows, (8000, chain), rows[3], (None, rows[4][1]), (None, None), (9000, ""), (9001, "日本語 12 ..."), *((9100 + k, f"{'b' * 3000} {'b' * 2999}c") for k in range(5))]


@pytest.mark.parametrize(("seed", "more"), [(1, {}), (2, {"limit": 5}), (3, {"limit": 1}), (4, {"deleted": 5})])
def test_variants_equal_brute_force(framed, seed, more):
    """Also with roots of a few words, so that they are cut until one code point is left, and with many deletions."""
    rows = spelled(seed)
    expect = brute_variants(words_of(rows, more.get("deleted", 199)))
    assert seed > 1 or len(expect) > 40 and ("kettesa", "kettesab", "kettesabc", 5, 1, 30) in expect
    assert rows_of(spelling.variants(framed(rows), **more), "word", "form", "root", "n", "n_near", "form_n") == expect


def test_active_nodes_find_all_pairs():
    rng = random.Random(9)
    for _ in range(30):
        words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(60)})
        roots = np.array([rng.randint(0, 1) for _ in words])
        order = np.argsort(roots, kind="stable")
        roots, words = roots[order], [words[k] for k in order]
        a, b = spelling.near_pairs(roots, words)
        got = sorted(zip(a.tolist(), b.tolist(), strict=True))
        assert got == [(x, y) for x in range(len(words)) for y in range(len(words)) if roots[x] == roots[y] and near(words[x], words[y])]


def test_large_roots_are_cut(spark):
    """A prefix that a third of all words share isn't left in one root."""
    rng = random.Random(2)
    words = sorted({"shared" + "".join(rng.choice("abcdef") for _ in range(6)) for _ in range(600)})
    frame_ = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    assert spelling.rooted(frame_, limit=10**6).groupBy("root").count().agg({"count": "max"}).first()[0] > 500
    assert spelling.rooted(frame_, limit=50).groupBy("root").count().agg({"count": "max"}).first()[0] <= 50
    got = {(r.word, r.near) for r in spelling.near(frame_, limit=50).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}


def test_variants_of_nothing(nothing):
    assert spelling.variants(nothing).collect() == []


# --- token alignment --------------------------------------------------------------------------------------------

needs_vocabularies = pytest.mark.skipif(not alignment.DEFAULT_BYTES, reason="no vocabularies here")


def brute_alignment(rows):
    """By plain loops over tokens, with the encoders' own results."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.DEFAULT_BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.DEFAULT_PIECES)
    stands = alignment._byte_of()
    encoded = []
    for i, t in rows:
        text = " " + (t or "")
        x = a.encode(text, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        xb = [bytes(stands[c] for c in a.id_to_token(k)) for k in x]
        yb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and b.is_byte(k) else p.replace("▁", " ").encode() for k in y for p in [b.id_to_piece(k)]]
        if b"".join(xb) != text.encode() or b"".join(yb) != text.encode():
            encoded.append((i, [], [], []))
            continue
        ends = lambda parts: {sum(map(len, parts[: k + 1])) for k in range(len(parts))}
        cuts = sorted(ends(xb) & ends(yb))
        groups, begun = [], 0
        for cut in cuts:
            inside = lambda ids, parts: [k for k, e in zip(ids, np.cumsum([len(p) for p in parts]).tolist(), strict=True) if begun < e <= cut]  # noqa: B023, E731
            groups.append((inside(x, xb), inside(y, yb)))
            begun = cut
        encoded.append((i, x, y, groups))
    counts = Counter(p for *_, groups in encoded for p in {(u, v) for us, vs in groups for u in us for v in vs})
    top = Counter()
    for (u, _), n in counts.items():
        top[u] = max(top[u], n)
    expect = Counter()
    for i, x, y, groups in encoded:
        links = [counts[u, v] - (counts[u, v] < top[u]) * 10**9 for us, vs in groups for u in us for v in vs]
        said = ";".join(f"{','.join(map(str, us))}|{','.join(map(str, vs))}" for us, vs in groups)
        expect[i, len(x), len(y), len(groups), len(links), sum(n > 0 for n in links), sum(n % 10**9 for n in links), hashlib.sha256(said.encode()).hexdigest() if x else ""] += 1
    return expect


@needs_vocabularies
@pytest.mark.parametrize("more", [{}, {"block_bytes": 200}])
def test_alignment_equals_brute_force(framed, rows, more, monkeypatch):
    monkeypatch.setattr(alignment, "HOT_SHARE", 50)
    own = [r for r in rows if not r[1] or len(r[1]) < 3000][:60]
    own += [(7000, "<|endoftext|> <s> </s> <unk> <0x41>"), (7001, "a▁b"), (7002, "  two  spaces\t\ttabs\r\nlines "), (7003, "😀😀 \u0000 ퟿ ﬁ ½"), (7004, "日本語" * 30), (7005, "x" * 700), (7006, "don't we'll 12345 3.14")]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(alignment.align(framed(own), **more), *names) == brute_alignment(own)


@needs_vocabularies
def test_both_encoders_of_a_file_agree():
    """On each token's own text, and on all code points between letters, digits, signs and spaces (every 97th here, all of them once by hand)."""
    a, b = (open(p, "rb").read() for p in (alignment.DEFAULT_BYTES, alignment.DEFAULT_PIECES))
    fast, slow = alignment.Pair(a, b), alignment.Pair(a, b, fast=False)
    assert fast.a_bytes == slow.a_bytes[: len(fast.a_bytes)]
    texts = [t.decode() for t in fast.a_bytes if t.isascii()] + [f"a{c}b 1{c}2 !{c}? {c} {c}{c}\n" for c in map(chr, [*range(0, 0xD800, 97), *range(0xE000, 0x110000, 997)])]
    assert all(np.array_equal(x, y) for x, y in zip(fast._ids(texts), slow._ids(texts), strict=True))


def test_wide_groups_are_reduced(monkeypatch):
    """Groups over WIDE give the same pairs and times as one link after the other."""
    rng = np.random.default_rng(4)
    of_a, of_b = rng.integers(1, 30, 20), rng.integers(1, 30, 20)
    group_a, group_b = np.repeat(np.arange(20), of_a), np.repeat(np.arange(20), of_b)
    a, b = rng.integers(0, 5, len(group_a)), rng.integers(0, 5, len(group_b))

    def totals():
        out = Counter()
        for g, p, t in zip(*(v.tolist() for v in alignment.expanded(a, b, group_a, group_b, 20)), strict=True):
            out[g, p] += t
        return out

    each = totals()
    monkeypatch.setattr(alignment, "WIDE", 100)
    assert totals() == each and sum(each.values()) == int((of_a * of_b).sum())


@needs_vocabularies
def test_alignment_of_nothing(nothing):
    assert alignment.align(nothing).collect() == []


# --- texts of some MB -------------------------------------------------------------------------------------------


@needs_vocabularies
def test_texts_of_some_megabytes(framed):
    """Whole texts count: copies of two MB, one run without a space, one without an ASCII letter."""
    from tidemark.llm import suffix_dedup, token_counts

    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    long = " ".join(rng.choice(vocabulary) for _ in range(330_000))
    rows = [(1, long), (2, long.replace(" ", "\n", 9)), (3, "x" * 1_000_000), (4, "日本語" * 100_000), (5, long[-400_000:])]
    docs = framed(rows)
    assert len(long) > 2_000_000
    kept = {r.doc_id: (r.keep_id, r.kept, r.text_sha256) for r in exact_dedup.groups(docs, table_bytes=1 << 20).collect()}
    assert {i: k[:2] for i, k in kept.items()} == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True), 5: (5, True)}
    assert all(kept[i][2] == hashlib.sha256(plain(t).encode()).hexdigest() for i, t in rows)
    cut = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs, with_text=False).collect()}
    assert cut[1][1] == cut[3][1] == cut[4][1] == 0 and cut[5] == (400_000, 400_000, 1) and cut[2][2] >= 1 and len(long) - 9 * 120 < cut[2][1] < len(long)
    words = {r.word: r.n for r in spelling.variants(docs).collect()}
    assert words == {w: n for w, n in words_of(rows).items()}
    aligned, counted = ({r.doc_id: r for r in f.collect()} for f in (alignment.align(docs), token_counts.count(docs, token_counts.DEFAULT_RANKS)))
    for i, t in rows:
        assert aligned[i].n_a > 0 and aligned[i].n_links >= aligned[i].n_groups > 0 and aligned[i].n_a <= len(t.encode()) + 1
        assert counted[i].n_bytes == len(t.encode()) and abs(counted[i].n_tokens - aligned[i].n_a) <= 2  # the leading space
