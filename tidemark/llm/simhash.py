"""SimHash near-duplicate groups by a self-join of a binary trie.

A document's fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64
hashes of the document's word shingles. Fingerprints that differ in at most ``max_bits`` bits link.

The join walks a binary trie of the distinct fingerprints in pairs of nodes from the root down,
adds up differing bits and drops a pair as soon as they exceed the budget. Of the four quarters of two linked
fingerprints one differs in at most ``max_bits // 4`` bits, so four tries, each with another quarter in front and that smaller budget
in its first 16 levels, find every pair. The top of a trie is cut into blocks, as many as the number of
fingerprints asks for; up to 3 bits a block is joined with itself alone, up to 7 also with those whose prefix differs in one bit. A
pair of blocks is one task, which walks both subtrees. Nothing of this passes the driver but the number of fingerprints.

Tasks return a forest of their links, never all pairs, so a large group of copies gives
as many rows as it has members. Exact copies share a fingerprint and meet once.

Cases: null and empty texts, and texts without words, have fingerprint zero and link like any
other; a text of fewer words than a shingle is one shingle; very long texts are read whole, a piece of words at a time; null ids get a row
but are no component's id; repeated rows are kept; ties don't occur, as a component's id is a minimum; other columns, whatever their
names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SEED = 42
#: Fingerprints have four quarters of 16 bits.
QUARTERS, QUARTER = 4, 16
#: Fingerprints of a block on average; more where blocks are also joined with their neighbours, as each is sent to all of these.
BLOCK, WIDE_BLOCK = 1 << 12, 1 << 15
#: Node pairs that a task holds at once.
WIDTH = 1 << 17
#: Node pairs of so many pairs of fingerprints are not split further.
LEAF = 64
#: From this depth on node pairs are tried for having nothing new to tell.
SETTLED = 8
#: Neighbours in sorted order that are compared first.
NEIGHBOURS = 8
#: A set's odd sketch has so many words of 64 bits.
SKETCH = 16
#: So many keys of two longs (16 MB) may be broadcast.
SMALL = 1_000_000
U1 = np.uint64(1)


def shingle_hashes(data: memoryview, offsets: np.ndarray, shingle_words: int, distinct: bool = False):
    """XXH64 of the space-joined shingles of lower-cased (A-Z) words; for each text the number of its shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    flat = C.LOWER[np.frombuffer(b" ".join([data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]) + b" ", np.uint8)]
    first = np.concatenate([[0], np.cumsum(np.diff(offsets) + 1)])
    space = C.SPACE[flat]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    home = np.cumsum(keep)  # where each byte goes once runs of white space are one space
    flat[space] = 0x20
    text = flat[keep].tobytes()
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, stop = edge[0::2], edge[1::2]
    words = np.diff(np.searchsorted(start, first))
    start, stop = home[start] - 1, home[stop - 1]
    shingles = np.where(words > 0, np.maximum(words - shingle_words + 1, 1), 0)
    doc = np.repeat(np.arange(len(words)), shingles)
    head = np.repeat(np.cumsum(words) - words, shingles) + np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    tail = head + np.minimum(shingle_words, words[doc]) - 1
    h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(start[head].tolist(), stop[tail].tolist(), strict=True)), np.uint64, len(doc))
    if distinct:
        by = np.lexsort((h, doc))
        new = np.concatenate([[True], (h[by][1:] != h[by][:-1]) | (doc[by][1:] != doc[by][:-1])]) if len(by) else np.zeros(0, bool)
        h, doc = h[by][new], doc[by][new]
        shingles = np.bincount(doc, minlength=len(words))
    return h, shingles


def majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes: bits set in over half of them; zero for an empty run.

    A sum counts several bits at once, in fields that are wide enough for the longest run.
    """
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes > 0)
    if not len(some):
        return out
    first, half = (np.cumsum(sizes) - sizes)[some], sizes[some].astype(np.uint64)
    width = 16 if sizes.max() < 1 << 16 else 32
    field, ones = np.uint64((1 << width) - 1), np.uint64(sum(1 << k for k in range(0, 64, width)))
    for bit in range(width):
        total = np.add.reduceat((h >> np.uint64(bit)) & ones, first)
        for lane in range(0, 64, width):
            out[some] |= ((((total >> np.uint64(lane)) & field) * np.uint64(2) > half).astype(np.uint64)) << np.uint64(bit + lane)
    return out


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of each row; fp is the fingerprint as a signed long."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(tables):
        for batch in tables:
            table = pa.Table.from_batches([batch])
            data, offsets = C.text_slices(table)
            ids = C.numbers(table, "id")
            for a, b in C.pieces(offsets):
                fp = majority(*shingle_hashes(data, offsets[a : b + 1], shingle_words))
                yield pa.record_batch([pa.array(ids[a:b]), pa.array(fp.view(np.int64))], schema=schema)

    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(C.NULL_ID)).alias("id")
    return docs.select(ident, F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


# --- the trie ---------------------------------------------------------------------------------------------------


def walk(a: np.ndarray, b: np.ndarray | None, budget: int, lead: int, settled=None):
    """Pairs of places in sorted a and b (or a and a) whose values differ in at most budget bits, at most lead in the first quarter; in pieces.

    Node pairs are ranges of both arrays with the depth and the differing bits so far. settled(alo, ahi, blo, bhi), if given, says which pairs of
    ranges have nothing new to tell; they are left out.
    """
    same = b is None
    b = a if same else b
    zeros: dict[tuple[int, int], np.ndarray] = {}

    def split(x: np.ndarray, which: int, depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if (which, depth) not in zeros:
            bit = (x >> np.uint64(63 - depth)) & U1
            zeros[which, depth] = np.concatenate([[0], np.cumsum(bit == 0)])
        z = zeros[which, depth]
        return lo + z[hi] - z[lo]

    one = np.zeros(1, np.int64)
    stack = [(0, one, one + len(a), one, one + len(b), one)]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if settled is not None and depth >= SETTLED:
            new = ~settled(alo, ahi, blo, bhi)
            alo, ahi, blo, bhi, err = alo[new], ahi[new], blo[new], bhi[new], err[new]
        small = ((ahi - alo) * (bhi - blo) <= LEAF) | (depth == 64)
        if small.any():
            i, j = _product(alo[small], ahi[small], blo[small], bhi[small])
            if same:
                i, j = i[i < j], j[i < j]
            x = a[i] ^ b[j]
            ok = (np.bitwise_count(x) <= budget) & (np.bitwise_count(x >> np.uint64(64 - QUARTER)) <= lead)
            if ok.any():
                yield i[ok], j[ok]
            big = ~small
            alo, ahi, blo, bhi, err = alo[big], ahi[big], blo[big], bhi[big], err[big]
        if not len(alo):
            continue
        if len(alo) > WIDTH:
            half = len(alo) // 2
            stack += [(depth, alo[s], ahi[s], blo[s], bhi[s], err[s]) for s in (slice(0, half), slice(half, None))]
            continue
        amid, bmid = split(a, 0, depth, alo, ahi), split(b, 1 if not same else 0, depth, blo, bhi)
        limit = lead if depth < QUARTER else budget
        twin = same & (alo == blo) & (ahi == bhi)
        children = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1), (amid, ahi, blo, bmid, err + 1)]
        kept = []
        for k, (p, q, r, s, e) in enumerate(children):
            ok = (q > p) & (s > r) & (e <= limit)
            if k == 3:
                ok &= ~twin
            kept.append([x[ok] for x in (p, q, r, s, e)])
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*kept, strict=True))))


def _product(alo, ahi, blo, bhi):
    n, m = ahi - alo, bhi - blo
    size = n * m
    row = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    return alo[row] + k // m[row], blo[row] + k % m[row]


def uniform(label: np.ndarray, turns: np.ndarray, alo, ahi, blo, bhi) -> np.ndarray:
    """Which pairs of ranges have one and the same label throughout. turns: how often the label has changed up to each place."""
    return (turns[ahi - 1] == turns[alo]) & (turns[bhi - 1] == turns[blo]) & (label[alo] == label[blo])


def turns_of(label: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([[False], label[1:] != label[:-1]])) if len(label) else np.zeros(0, np.int64)


class Forest:
    """Links of a task as a label for each place: the smallest place that it is linked to."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.turns = None

    def settled(self, alo, ahi, blo, bhi) -> np.ndarray:
        if self.turns is None:
            self.turns = turns_of(self.label)
        return uniform(self.label, self.turns, alo, ahi, blo, bhi)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            x, y = self.label[i], self.label[j]
            open_ = x != y
            i, j, x, y = i[open_], j[open_], x[open_], y[open_]
            if not len(i):
                return
            self.turns = None
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def rotated(fp: Column, by: int) -> Column:
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by)) if by else fp


def _packed(levels: int, lead: int, more: list[str]):
    """Packs a block's entries, for itself and, with a lead of one bit, for each block whose prefix differs in one bit."""
    schema = pa.schema([("trie", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("side", pa.int32()), ("fps", pa.binary()), *((f"{c}s", pa.binary()) for c in more)])

    def run(table: pa.Table) -> pa.Table:
        trie, own = int(C.numbers(table, "trie")[0]), int(C.numbers(table, "block")[0])
        fp = C.numbers(table, "fp").astype(np.int64).view(np.uint64)
        by = np.argsort(fp, kind="stable")
        body = C.pack_sorted(fp[by]), *(C.pack(C.numbers(table, c).astype(np.int64)[by]) for c in more)
        others = [own, *(own ^ (1 << k) for k in range(levels) if lead)]
        return C.as_table([(trie, min(own, o), max(own, o), int(own > o), *body) for o in others], schema)

    return run


def blocks(entries: DataFrame, count: int, max_bits: int, more: list[str]) -> DataFrame:
    """entries (k, fp, more), some count for each k, as packed blocks (trie, x, y, side, fps, a column for each of more); the tries of a k are 4 k .. 4 k + 3."""
    if not 0 <= max_bits < 2 * QUARTERS:
        raise ValueError("max_bits must be from 0 to 7")
    lead = max_bits // QUARTERS
    levels = min(QUARTER, max(0, math.ceil(math.log2(max(count, 1) / (WIDE_BLOCK if lead else BLOCK)))))
    turned = F.array(*(F.struct((F.col("k") * QUARTERS + q).cast("int").alias("trie"), rotated(F.col("fp"), QUARTER * q).alias("fp")) for q in range(QUARTERS)))
    block = F.shiftrightunsigned("e.fp", 64 - levels).cast("int") if levels else F.lit(0)
    placed = entries.select(F.explode(turned).alias("e"), *more).select("e.trie", block.alias("block"), "e.fp", *more)
    return placed.groupBy("trie", "block").applyInArrow(_packed(levels, lead, more), ", ".join(["trie int, x int, y int, side int, fps binary", *(f"{c}s binary" for c in more)]))


def _sides(table: pa.Table) -> list[dict] | None:
    """The two sides of a pair of blocks, or one for a block and itself; None if one of the pair is missing."""
    rows = table.sort_by("side").to_pylist()
    return rows if len(rows) > 1 or rows[0]["x"] == rows[0]["y"] else None


def _forest(budget: int):
    """A forest (trie, u, v) over the fingerprints of a task that are linked."""
    schema = pa.schema([("trie", pa.int32()), ("u", pa.int64()), ("v", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        sides = _sides(table)
        if sides is None:
            return C.as_table([], schema)
        a, b = (C.unpack_sorted(x["fps"]) for x in (sides * 2)[:2])
        b = b if len(sides) > 1 else None
        forest, lead, moved = Forest(len(a) + (0 if b is None else len(b))), budget // QUARTERS, 0 if b is None else len(a)
        for step in range(1, NEIGHBOURS + 1):  # neighbours in order first: in a dense set they link most, and the walk can leave that out
            for x, base in ((a, 0), (b, moved)) if b is not None else ((a, 0),):
                i = np.flatnonzero(np.bitwise_count(x[step:] ^ x[:-step]) <= budget) + base
                forest.add(i, i + step)
        for i, j in walk(a, b, budget, lead, lambda p, q, r, s: forest.settled(p, q, r + moved, s + moved)):
            forest.add(i, j + moved)
        every = (a if b is None else np.concatenate([a, b])).view(np.int64)
        linked = np.flatnonzero(forest.label != np.arange(len(every)))
        trie = np.full(len(linked), sides[0]["trie"], np.int32)
        return pa.table([pa.array(trie), pa.array(every[linked]), pa.array(every[forest.label[linked]])], schema=schema)

    return run


def link(prints: DataFrame, count: int, max_bits: int = 3) -> DataFrame:
    """(k, u, v): for each k a forest that connects all of its distinct fingerprints (k, fp) that are linked; some count for each k."""
    found = blocks(prints.select("k", "fp"), count, max_bits, []).groupBy("trie", "x", "y").applyInArrow(_forest(max_bits), "trie int, u long, v long")

    def back(c: str) -> Column:
        quarter = F.col("trie") % QUARTERS
        turned = F.col(c)
        for q in range(1, QUARTERS):
            turned = F.when(quarter == q, rotated(F.col(c), 64 - QUARTER * q)).otherwise(turned)
        return turned.alias(c)

    return found.select(F.floor(F.col("trie") / QUARTERS).cast("int").alias("k"), back("u"), back("v"))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node that each node of edges (u, v) is connected with.

    Alternates large-star and small-star steps; each round's edges go to the shared folder.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    edges, before = C.written(tidy(edges), "links"), None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == now or not now["n"]:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = tidy(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = C.written(tidy(small), "links")
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id_col, fingerprint (16 hex digits), component_id (the smallest id reachable over links)."""
    found = C.written(fingerprints(docs, shingle_words, id_col=id_col, text_col=text_col), "fingerprints")
    classes = C.written(found.groupBy("fp").agg(F.min(F.when(F.col("id") != C.NULL_ID, F.col("id"))).alias("low")), "classes")
    roots = components(link(classes.select(F.lit(0).alias("k"), "fp"), classes.count(), max_bits).select("u", "v"))
    both = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fp")
    members = classes.join(both, "fp").select("fp", "root", "low")
    least = members.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = members.join(least, "root").select("fp", "component_id")
    ids = C.written(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "component-ids")
    return found.join(ids, "fp").select(C.null_id("id", id_col), hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


# --- verified groups -----------------------------------------------------------------------------------------------


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(C.NULL_ID)).alias("id"), F.xxhash64(text).alias("body"), text.alias("text"))


def set_hash(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each run's set of hashes."""
    ends = np.cumsum(sizes)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(h ^ np.uint64(C.BASE)), dtype=np.uint64)])
    return C.mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)


def odd_sketch(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each run's set of hashes the bits that an odd number of its members has, by the leading bits of the hash.

    The sketches of two sets differ in the bits that an odd number of the members that only one has falls on, so in no more bits than there are such members.
    """
    bits = 64 * SKETCH
    at = (np.repeat(np.arange(len(sizes)), sizes) * bits) + (C.mix(h) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(at, minlength=len(sizes) * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(-1, bits), axis=1).view(np.int64).reshape(-1, SKETCH)


def _hashed(rows: DataFrame, shingle_words: int, prints: int) -> DataFrame:
    """(id, body, node, n, fps, sketch) of rows (id, body, text): node is a hash of the set of the row's n shingles, fps its fingerprints from independent hashes."""
    schema = pa.schema([("id", pa.int64()), ("body", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("fps", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def run(tables):
        for batch in tables:
            table = pa.Table.from_batches([batch])
            data, offsets = C.text_slices(table)
            for a, b in C.pieces(offsets):
                h, sizes = shingle_hashes(data, offsets[a : b + 1], shingle_words, True)
                fps = np.stack([majority(h if not k else C.mix(h + np.uint64((k * C.BASE) & C.M64)), sizes) for k in range(prints)], axis=1)
                own = [pa.array(C.numbers(table, c)[a:b]) for c in ("id", "body")]
                yield pa.record_batch([*own, pa.array(set_hash(h, sizes)), pa.array(sizes.astype(np.int64)), *(pa.array(list(x), pa.list_(pa.int64())) for x in (fps.view(np.int64), odd_sketch(h, sizes)))], schema=schema)

    return rows.mapInArrow(run, "id long, body long, node long, n long, fps array<long>, sketch array<long>")


def _sets(rows: DataFrame, need: DataFrame, shingle_words: int) -> DataFrame:
    """(node, shingles): the packed sets of the rows (id, body, text) that need (id, body) names, each set once.

    Up to SMALL keys of need (16 bytes each) are broadcast, so that texts stay where they are.
    """
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(tables):
        for batch in tables:
            data, offsets = C.text_slices(pa.Table.from_batches([batch]))
            for a, b in C.pieces(offsets):
                h, sizes = shingle_hashes(data, offsets[a : b + 1], shingle_words, True)  # sorted within a text
                packed = [C.pack_sorted(h[e - s : e]) for e, s in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)]
                yield pa.record_batch([pa.array(set_hash(h, sizes)), pa.array(packed, pa.binary())], schema=schema)

    chosen = rows.join(F.broadcast(need) if need.count() <= SMALL else need, ["id", "body"], "left_semi").select("text")
    return chosen.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def _expanded(i: np.ndarray, j: np.ndarray, first: np.ndarray, stop: np.ndarray):
    """Pairs of entries of pairs of distinct fingerprints, whose entries are first to stop; in pieces of about WIDTH."""
    size = (stop[i] - first[i]) * (stop[j] - first[j])
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // WIDTH, prepend=0))
    for p in np.split(np.arange(len(i)), cuts):
        if len(p):
            yield _product(first[i[p]], stop[i[p]], first[j[p]], stop[j[p]])


def _candidates(budget: int, mode: str, similarity: float):
    """Candidate pairs (u, v) of a task. nearest: for each entry its linked one with the smallest node; every: all.

    Left out are pairs within a component, pairs that a trie before this one of the same fingerprint finds, and pairs that can't be similar enough: by their sizes, or as
    their sketches differ in more bits than sets of these sizes and this similarity have members of their own. Neither ever leaves out a pair that is similar enough.
    """
    lead, names, apart = budget // QUARTERS, [f"s{k}" for k in range(SKETCH)], (1 - similarity) / (1 + similarity)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        sides = []
        for x in _sides(table) or ():
            sides.append((C.unpack_sorted(x["fps"]), *(C.unpack(x[f"{c}s"], np.int64) for c in ("node", "comp", "n", *names))))
        if not sides:
            return C.as_table([], schema)
        runs = [np.unique(s[0], return_index=True) for s in sides]
        moved = [0, len(sides[0][0])]
        first = np.concatenate([r[1] + m for r, m in zip(runs, moved, strict=False)])
        stop = np.concatenate([np.append(r[1][1:], len(s[0])) + m for r, s, m in zip(runs, sides, moved, strict=False)])
        node, comp, n, *every = (np.concatenate([s[c] for s in sides]) for c in range(1, 4 + SKETCH))
        quarter = int(C.numbers(table, "trie")[0]) % QUARTERS
        a, b = runs[0][0], runs[1][0] if len(runs) > 1 else None
        best = np.full(len(node), np.iinfo(np.int64).max)
        us, vs = [], []

        def take(i, j):
            ok = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
            i, j = i[ok], j[ok]
            bits = sum(np.bitwise_count((f[i] ^ f[j]).view(np.uint64)).astype(np.int64) for f in every)
            ok = bits <= (n[i] + n[j]) * apart + 1e-9
            i, j = i[ok], j[ok]
            if mode == "nearest":
                np.minimum.at(best, i, node[j])
                np.minimum.at(best, j, node[i])
            else:
                us.append(np.minimum(node[i], node[j]))
                vs.append(np.maximum(node[i], node[j]))

        if b is None and not quarter:  # entries that share a fingerprint
            many = np.flatnonzero(stop - first > 1)
            for i, j in _expanded(many, many, first, stop):
                take(i[i < j], j[i < j])
        # nothing to propose between fingerprints whose entries are of one component; fingerprints with several get a number of their own
        label, shift = np.where(np.minimum.reduceat(comp, first) == np.maximum.reduceat(comp, first), comp[first], np.iinfo(np.int64).max - np.arange(len(first))) if len(first) else comp, 0 if b is None else len(a)
        turns = turns_of(label)
        for i, j in walk(a, b, budget, lead, lambda p, q, r, s: uniform(label, turns, p, q, r + shift, s + shift)):
            x, new = a[i] ^ (a if b is None else b)[j], np.ones(len(i), bool)
            for before in range(quarter):  # in the order of this trie that quarter stands behind the own one
                at = np.uint64(64 - QUARTER * (1 + (before - quarter) % QUARTERS))
                new &= np.bitwise_count((x >> at) & np.uint64((1 << QUARTER) - 1)) > lead
            for p, q in _expanded(i[new], j[new] + shift, first, stop):
                take(p, q)
        if mode == "nearest":
            some = best != np.iinfo(np.int64).max
            u, v = node[some], best[some]
        else:
            u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
        return pa.table([pa.array(u), pa.array(v)], schema=schema)

    return run


def _connected(classes: DataFrame, count: int, max_bits: int) -> DataFrame:
    """(node, top): what fingerprints connect, for the classes (node, fps) that any of them links."""
    every = classes.select("node", F.posexplode("fps").alias("k", "fp"))
    stands = C.written(every.groupBy("k", "fp").agg(F.min("node").alias("top"), F.count("*").alias("n")), "fingerprint-classes")
    links, ends = link(stands, count, max_bits), stands.drop("n")
    linked = links.join(ends.toDF("k", "u", "a"), ["k", "u"]).join(ends.toDF("k", "v", "b"), ["k", "v"]).select(F.col("a").alias("u"), F.col("b").alias("v"))
    own = every.join(stands.filter("n > 1"), ["k", "fp"]).select(F.col("node").alias("u"), F.col("top").alias("v"))
    tops = components(linked.unionByName(own)).toDF("node", "top")
    return C.written(tops.unionByName(tops.select(F.col("top").alias("node"), "top").distinct()), "connected")


def _pairs(classes: DataFrame, max_bits: int, mode: str, similarity: float) -> DataFrame:
    """Distinct candidate pairs (u, v), u < v, of classes (node, comp, n, fps, sketch)."""
    # of a component's classes with one fingerprint one stands for all
    every = {f"s{k}": F.col("sketch")[k] for k in range(SKETCH)}
    entries = classes.select("node", "comp", "n", *(v.alias(c) for c, v in every.items()), F.posexplode("fps").alias("k", "fp")).groupBy("k", "fp", "comp").agg(F.min(F.struct("node", "n", *every)).alias("least"))
    entries = entries.select("k", "fp", "comp", "least.*")
    found = blocks(entries, classes.count(), max_bits, ["node", "comp", "n", *every]).groupBy("trie", "x", "y").applyInArrow(_candidates(max_bits, mode, similarity), "u long, v long")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct()


def _alike(similarity: float):
    """Of rows (u, v, a, b) with packed sets a and b the pairs with a Jaccard similarity of at least similarity."""

    def run(tables):
        for t in tables:
            ok = []
            for a, b in zip(t.column("a"), t.column("b"), strict=True):
                x, y = C.unpack_sorted(a.as_py()), C.unpack_sorted(b.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both + 1e-9 >= similarity * (len(x) + len(y) - both))
            yield t.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def similar_groups(docs: DataFrame, shingle_words: int = 5, max_bits: int = 7, prints: int = 10, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id_col, body (xxhash64 of its text), component (equal for rows that are linked).

    Fingerprints only propose pairs; a pair links if the Jaccard similarity of its sets of shingles, counted exactly, is at least ``similarity``. Texts with one
    set of shingles are one class; all texts without words are. Classes are first held against one class of what fingerprints connect, then against the first
    class proposed of another component, and last all pairs proposed between components are counted. So a group of copies costs as many pairs as
    it has members; of pairs that fingerprints link though they are less similar, only those cost a pair that sizes and sketches can't tell from similar ones.
    """
    rows = _rows(docs, id_col, text_col)
    hashed = C.written(_hashed(rows, shingle_words, prints), "hashed")
    classes = C.written(hashed.groupBy("node").agg(F.min(F.struct("id", "body")).alias("first"), F.first("n").alias("n"), F.first("fps").alias("fps"), F.first("sketch").alias("sketch")), "classes")
    labelled, links, tried = classes.withColumn("comp", F.col("node")), None, None
    connected = _connected(classes, classes.count(), max_bits)
    for mode in ("top", "nearest", "every"):
        if mode == "top":
            n = classes.select("node", "n")
            pairs = connected.filter("node <> top").select(F.col("top").alias("u"), F.col("node").alias("v"))
            pairs = pairs.join(n.toDF("u", "n_u"), "u").join(n.toDF("v", "n_v"), "v").filter(F.least("n_u", "n_v") >= similarity * F.greatest("n_u", "n_v") - 1e-9).select("u", "v")
        else:
            # only what fingerprints connect and links don't yet can have more pairs
            inside = labelled.join(connected, "node")
            open_ = inside.groupBy("top").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("top")
            inside = C.written(inside.join(open_, "top", "left_semi"), "open")
            if inside.isEmpty():
                break
            pairs = _pairs(inside, max_bits, mode, similarity)
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = C.written(pairs, "pairs")
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        need = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(classes.select("node", "first"), "node").select("first.id", "first.body")
        sets = C.written(_sets(rows, C.written(need, "need"), shingle_words), "sets")
        held = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v").select("u", "v", "a", "b")
        now = C.written(held.mapInArrow(_alike(similarity), "u long, v long"), "alike")
        links = now if links is None else links.unionByName(now)
        roots = components(links)
        root = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).distinct()
        labelled = C.written(classes.join(root, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"), "labelled")
    found = hashed.select("id", "body", "node").join(labelled.select("node", F.col("comp").alias("component")), "node")
    return found.select(C.null_id("id", id_col), "body", "component")
