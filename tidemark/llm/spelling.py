"""Spelling variants by a self-join of the vocabulary's trie.

1. *Vocabulary.* Runs of letters are counted by Spark: no row of a text outlives its partial count.
2. *Partitions of the trie.* Two words at distance one share all but one edit, so of the shorter's m code points they share the first ``m // 2`` or
   the last ``m - m // 2``. Each word therefore goes under the prefix it would share, and, spelled backwards, under the suffix, once as the shorter or equal (its own length is
   m) and once as the longer (m + 1). Each such key is the root of a subtrie with the rest of its words below. A root of over ``limit`` words is cut again
   by the same rule on the rest, round by round; where one code point is left, a root holds no more words than there are letters and pairs of letters.
3. *Active nodes.* A node's active nodes are those at distance one of it. They pass down the trie level by level: of a child ``u + c`` they are the
   children by ``c`` of u's active nodes, its siblings (replaced), its parent (deleted) and its own children (inserted). Whole levels of many roots go at
   once as arrays of (node, active node). Words that end in both give a pair, so each word gets its near words from its own side.
4. *Forms and roots.* A word's near words are counted and the most frequent taken where it is frequent enough. Roots come by pointer doubling over the
   words that have forms: as n grows at least fivefold with each step, a chain is short.

Cases: null and empty texts have no words; a null id counts as an empty one in the rule of deletions; very long texts are split by Spark within their row, very long words make deep tries, worked on one by one;
ties for the form go to the smallest word in code-point order; repeated rows count again; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Runs of fewer code points can't become words.
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form is at least so many times as frequent.
FACTOR = 5
#: One in so many runs loses a code point.
DELETED = 199
#: Words of a root from which it is cut again.
LIMIT = 20_000
#: Places (words times length) of the roots that go through the levels together.
PLACES = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, deleted: int = DELETED) -> DataFrame:
    """(word, n): words of docs by the rule of the operator.

    A run shorter than least_length can't become a word, so only longer ones leave the text.
    """
    ident = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    runs = docs.select(ident.alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))).alias("run"))
    # lower() knows more letters than A-Z, so it only sees runs without any of those
    low = runs.select("id", F.when(F.col("run").rlike("[À-Þ]"), F.translate("run", UPPER, LOWER)).otherwise(F.lower("run")).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % deleted == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _roots(words: DataFrame) -> DataFrame:
    """(root, m, rest, word, n): each word under the prefix and, backwards, the suffix that it may share, as the shorter and as the longer."""
    length = F.length("word")
    backwards = F.reverse("word")
    each = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m"))
    half = F.expr("m div 2")
    ways = F.explode(F.array(F.struct(F.lit(">").alias("way"), F.col("word").alias("full"), half.alias("shared")), F.struct(F.lit("<").alias("way"), backwards.alias("full"), (F.col("m") - half).alias("shared"))))
    return _cut(each.filter("m > 0").select("word", "n", "m", ways.alias("x")).select("word", "n", "m", "x.way", "x.full", "x.shared"), F.lit(""))


def _cut(rows: DataFrame, above: Column) -> DataFrame:
    """Rows of (way, full, shared) with the first ``shared`` code points of full moved into the root. A root's name tells its words' shared pieces with their lengths, so no two roots share a name."""
    shared = F.substring(F.col("full"), F.lit(1), F.col("shared").cast("int"))
    root = F.concat(above, F.col("way"), F.col("m").cast("string"), F.lit("/"), F.col("shared").cast("string"), F.lit(":"), shared)
    return rows.select(root.alias("root"), "m", F.substring(F.col("full"), F.col("shared").cast("int") + 1, F.length("full")).alias("rest"), "word", "n", (F.col("m") - F.col("shared")).cast("int").alias("left"))


def _again(rows: DataFrame) -> DataFrame:
    """Large roots cut by the same rule on what their words don't share: ``left`` code points of the shorter."""
    half = F.expr("left div 2")
    ways = F.explode(F.array(F.struct(F.lit(">").alias("way"), F.col("rest").alias("full"), half.alias("shared")), F.struct(F.lit("<").alias("way"), F.reverse("rest").alias("full"), (F.col("left") - half).alias("shared"))))
    cut = rows.select("root", "word", "n", "m", "left", ways.alias("x")).select("root", "word", "n", "m", "left", "x.way", "x.full", "x.shared")
    shared = F.substring(F.col("full"), F.lit(1), F.col("shared").cast("int"))
    name = F.concat("root", "way", F.col("shared").cast("string"), F.lit(":"), shared)
    return cut.select(name.alias("root"), "m", F.substring(F.col("full"), F.col("shared").cast("int") + 1, F.length("full")).alias("rest"), "word", "n", (F.col("left") - F.col("shared")).cast("int").alias("left"))


def rooted(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All roots, none of over limit words unless one code point is all that its words don't share."""
    small, rows = [], _roots(words)
    while True:
        large = C.written(rows.groupBy("root", "left").count().filter((F.col("count") > limit) & (F.col("left") > 1)).select(F.col("root").alias("large")), "large-roots")
        if large.isEmpty():
            break
        # over limit rows of all are in each, so they are few; joined without a shuffle of words only while they are
        large = F.broadcast(large) if large.count() <= 100_000 else large
        small.append(rows.join(large, F.col("root") == F.col("large"), "left_anti"))
        rows = C.written(_again(rows.join(large, F.col("root") == F.col("large"), "left_semi")), "cut-roots")
    for s in small:
        rows = rows.unionByName(s)
    return rows


class Trie:
    """The subtries of some roots as arrays. A node's number is that of its first word in order and its depth; words of a root are sorted, and roots follow each other."""

    def __init__(self, roots: np.ndarray, rests: list[str]):
        flat = np.frombuffer("".join(rests).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.array([len(r) for r in rests], np.int64)
        width = int(size.max(initial=0)) + 1
        letters = np.zeros((len(rests), width), np.int64)  # 0 ends a word
        letters[np.repeat(np.arange(len(rests)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat + 1
        self.order = np.lexsort((*letters.T[::-1], roots))
        self.roots, self.letters, self.size = roots[self.order], letters[self.order], size[self.order]

    def levels(self):
        """Of each depth: each word's node there, each node's parent (a node of the depth above) and letter, and which nodes end a word; a word is at the depths up to its length."""
        new = np.concatenate([[True], self.roots[1:] != self.roots[:-1]])
        node = np.cumsum(new) - 1
        yield node, np.full(int(new.sum()), -1), np.zeros(int(new.sum()), np.int64), self.size == 0
        alive = self.size > 0
        for depth in range(1, self.letters.shape[1] + 1):
            rows = np.flatnonzero(alive)
            if not len(rows):
                return
            letter, above = self.letters[rows, depth - 1], node[rows]
            first = np.concatenate([[True], (above[1:] != above[:-1]) | (letter[1:] != letter[:-1])])
            node = np.full(len(self.size), -1)
            node[rows] = np.cumsum(first) - 1
            yield node, above[first], letter[first], alive & (self.size == depth)
            alive = alive & (self.size > depth)


def near_pairs(roots: np.ndarray, rests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, near word), as places in rests, of all pairs at distance one under a root; each pair in both directions.

    Nodes are numbered through all depths. Words that are equal under a root are one node; callers give each once.
    """
    trie = Trie(roots, rests)
    begun, parents, letters, ends = [0], [], [], []
    for node, parent, letter, last in trie.levels():
        above = begun[-2] if len(begun) > 1 else 0
        parents.append(np.where(parent >= 0, parent + above, -1))
        letters.append(letter)
        word = np.full(len(parent), -1)
        word[node[last]] = trie.order[last]
        ends.append(word)
        begun.append(begun[-1] + len(parent))
    parent, letter, word = np.concatenate(parents), np.concatenate(letters), np.concatenate(ends)
    bits = int(letter.max(initial=0)).bit_length()
    # nodes of a depth are sorted by parent, then letter; so are all but the roots
    below = np.arange(begun[1], begun[-1])
    key = (parent[below] << bits) | letter[below]
    children = np.bincount(parent[below], minlength=len(parent)) if len(below) else np.zeros(len(parent), np.int64)
    first = begun[1] + np.cumsum(children) - children  # children follow in order of their parents

    def all_children(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in of, child) of each child of each node."""
        n = children[of]
        at = np.repeat(np.arange(len(of)), n)
        return at, first[of][at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)

    level = np.arange(begun[1])
    at, child = all_children(level)
    u, v = level[at], child  # a root's active nodes: its children
    left, right = [], []
    for depth in range(len(begun) - 1):
        both = (word[u] >= 0) & (word[v] >= 0)
        left.append(word[u[both]])
        right.append(word[v[both]])
        if depth + 2 >= len(begun):
            break
        # active nodes that go on by the same letter
        at, own = all_children(u)
        want = (v[at] << bits) | letter[own]
        place = np.minimum(np.searchsorted(key, want), len(key) - 1)
        same = key[place] == want
        goes_u, goes_v = own[same], below[place[same]]
        level = np.arange(begun[depth + 1], begun[depth + 2])
        at, sibling = all_children(parent[level])
        other = sibling != level[at]
        at_child, child = all_children(level)
        u = np.concatenate([goes_u, level[at[other]], level, level[at_child]])
        v = np.concatenate([goes_v, sibling[other], parent[level], child])
        one = np.unique(u * len(parent) + v) if len(u) else np.zeros(0, np.int64)
        u, v = one // len(parent), one % len(parent)
        u, v = u[u != v], v[u != v]
    return np.concatenate(left), np.concatenate(right)


def _joined(batches):
    """Pairs of a partition whose rows come sorted by m and root; roots are taken together while they are small."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])

    def out(held):
        root, m, rest, words, n = (np.array(c) if k in (1, 4) else c for k, c in enumerate(zip(*held, strict=True)))
        number = np.cumsum([k > 0 and root[k] != root[k - 1] for k in range(len(root))])
        a, b = near_pairs(number, list(rest))
        size = np.array([len(w) for w in words])
        real = np.minimum(size[a], size[b]) == m[a]  # else they meet under their own length
        a, b = a[real].tolist(), b[real].tolist()
        return pa.record_batch([pa.array([words[k] for k in a], pa.string()), pa.array(n[a], pa.int64()), pa.array([words[k] for k in b], pa.string()), pa.array(n[b], pa.int64())], schema=schema)

    held, begun, width = [], 0, 0  # the rows of whole roots, then those of the root that is being read from begun on
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != held[-1][0]:
                if max(width, len(row[2])) * len(held) > PLACES:
                    yield out(held)
                    held, width = [], 0
                begun = len(held)
            held.append(row)
            width = max(width, len(row[2]) + 1)
            if begun and width * len(held) > PLACES:
                yield out(held[:begun])
                held, width, begun = held[begun:], max(len(r[2]) + 1 for r in held[begun:]), 0
    if held:
        yield out(held)


def near(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n, near, near_n): all pairs of words at distance one, in both directions. words: (word, n), each word once."""
    rows = rooted(words, limit).select("root", "m", "rest", "word", "n")
    n = C.partitions(words.sparkSession)
    return rows.repartition(n, "root").sortWithinPartitions("m", "root").mapInArrow(_joined, "word string, n long, near string, near_n long").distinct()


def forms(words: DataFrame, factor: int = FACTOR, limit: int = LIMIT) -> DataFrame:
    """(word, n, n_near, form, form_n) for each word."""
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best")
    found = near(words, limit).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    enough = -F.col("best.n") >= factor * F.col("n")
    return words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"))


def rooted_forms(found: DataFrame) -> DataFrame:
    """found with each word's root: the last of its chain of forms. A chain's length halves with each round."""
    chained = C.written(found.filter("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        on = chained.select(F.col("word").alias("by"), F.col("root").alias("further"))
        ahead = C.written(chained.join(on, F.col("root") == F.col("by"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        chained = ahead.drop("moved")
        if ahead.filter("moved").isEmpty():
            break
    return found.join(chained, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, deleted: int = DELETED, limit: int = LIMIT) -> DataFrame:
    """One row for each word of docs: word, form, root, n, n_near, form_n."""
    words = C.written(vocabulary(docs, id_col, text_col, least_length, least_count, deleted), "words")
    return rooted_forms(C.written(forms(words, factor, limit), "word-forms"))
