"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of ``window`` words (an item of fewer words is one
window). A document word inside an occurrence of a window is hit.

A window is contained in a document only if all of its word shingles are, so for exact containment one
shingle is the necessary prefix. The rarest is taken: the shingles of the
benchmark that occur in the corpus are looked up in one pass over the documents, which keeps
the words around each place; their counts over all documents order the shingles of
each window; a window's rarest shingle joins its places. The place in the document and
the document's length bound where the window can start, and the words kept at the place verify it exactly.

The look-up table holds one long for each distinct shingle of the benchmark. It is broadcast while it
has at most ``broadcast_keys`` rows (a count, not an estimate); beyond that Spark joins it by shuffle.

Cases: null texts have no words and no hits; a very long text is one row, of which each place carries a few words; of a window's equally rare shingles the first
counts; 20 * n_hit = n_words counts as contaminated; items without words have no windows; repeated rows and
ids get a row each; null ids are kept; columns other than the id and the text are ignored; an empty
benchmark hits nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of letters, digits and everything beyond ASCII, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows(items: DataFrame, window: int, shingle: int, item_id: str, text: str) -> DataFrame:
    """Distinct (item, win, n, s): the words of each window, their number and the window's shingle length."""
    n = F.least(F.lit(window), F.size("w"))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("at")
    cut = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    return cut.select("item", "w", n.alias("n"), starts).select("item", F.slice("w", F.col("at"), F.col("n")).alias("win"), "n", F.least(F.lit(shingle), F.col("n")).alias("s")).distinct()


def places(docs: DataFrame, keys: DataFrame, lengths: list[int], window: int, id_col: str, text_col: str, broadcast_keys: int) -> DataFrame:
    """Where the benchmark's shingles occur, with the words around; and for each document a row with p = -1.

    Columns: id, body (a hash of the text: with the id it names a row's text), n_words, p (0 based), s, h, around, before.
    """
    small = keys.count() <= broadcast_keys
    text = F.col(text_col).cast("string")
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(C.NULL_ID)).alias("id"), F.xxhash64(text).alias("body"), words(text).alias("w"))
    found = None
    for k, s in enumerate(lengths or [1]):
        rows = base.select("id", "body", "w", F.explode(F.sequence(F.lit(-1 if not k else 0), F.greatest(F.size("w") - s, F.lit(-1)))).alias("p"))
        rows = rows.withColumn("h", F.when(F.col("p") >= 0, F.xxhash64(*(F.get("w", F.col("p") + i) for i in range(s)))))
        own = keys.filter(F.col("s") == s).select(F.col("h").alias("key"))
        before = F.least(F.col("p"), F.lit(window - s))
        columns = [
            "id", "body", F.size("w").alias("n_words"), "p", F.lit(s).alias("s"), "h",
            F.when(F.col("p") >= 0, F.slice("w", F.col("p") - before + 1, before + window)).alias("around"), F.when(F.col("p") >= 0, before).alias("before"),
        ]
        if small:
            part = rows.join(F.broadcast(own), F.col("h") == F.col("key"), "left").filter(F.col("key").isNotNull() | (F.col("p") == -1)).select(*columns)
        else:
            # a shuffle must carry a few words of each place, not its whole text; rows without a hash don't go through it
            part = rows.filter("p >= 0").select(*columns).join(own, F.col("h") == F.col("key")).drop("key").unionByName(rows.filter("p = -1").select(*columns))
        found = part if found is None else found.unionByName(part.filter("p >= 0"))
    return found


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 13, shingle: int = 5, share: int = 20,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_keys: int = 2_000_000, with_body: bool = False, hot: int = C.HOT_ROWS,
) -> DataFrame:
    """One row for each document: id_col, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words); with_body: and body (xxhash64 of the text).

    A rarest shingle that stands in more than hot places is joined in shares, so no task gathers all places of a frequent one.
    """
    wins = C.written(windows(items, window, shingle, item_id, item_text), "windows")
    # every shingle of every window with its place in it
    inner = wins.select("item", "win", "n", "s", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("s"))).alias("off"))
    inner = inner.withColumn("h", F.xxhash64(F.slice("win", F.col("off") + 1, F.col("s"))))
    keys = inner.select("s", "h").distinct()
    lengths = sorted(r["s"] for r in wins.select("s").distinct().collect())  # at most `shingle` values
    seen = C.written(places(docs, keys, lengths, window, id_col, text_col, broadcast_keys), "places")
    whole, hits = seen.filter("p = -1"), seen.filter("p >= 0")
    rarity = hits.groupBy("s", "h").agg(F.count("*").alias("freq"))
    ranked = inner.join(rarity, ["s", "h"], "left").groupBy("item", "win", "n", "s").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "off", "h")).alias("rarest"))
    prefix = C.written(ranked.filter("rarest.freq > 0").select("item", "win", "n", "s", "rarest.off", "rarest.h", "rarest.freq"), "prefix")
    start = F.col("p") - F.col("off")
    inside = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    exact = F.slice("around", F.greatest(F.col("before") - F.col("off") + 1, F.lit(1)), F.col("n")) == F.col("win")
    occurs = C.written(C.joined_in_shares(hits, prefix, ["s", "h"], "freq", ["id", "body", "p"], hot).filter(inside & exact).select("id", "body", start.alias("start"), "n", "item"), "occurrences")
    hit = occurs.select("id", "body", "start", "n").distinct().select("id", "body", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("at")).distinct().groupBy("id", "body").agg(F.count("*").alias("n_hit"))
    named = occurs.select("id", "body", "item").distinct().groupBy("id", "body").agg(F.sort_array(F.collect_list("item")).alias("items"))
    both = hit.join(named, ["id", "body"])
    n_hit, n_words = F.coalesce("n_hit", F.lit(0)), F.col("n_words").cast("long")
    # xxhash64 of a null text is not null, so the two columns name a row's text
    return whole.join(both, ["id", "body"], "left").select(
        C.null_id("id", id_col), n_words.alias("n_words"), n_hit.cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>"))), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= n_words)).alias("contaminated"),
        *(["body"] if with_body else []),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
u AS (SELECT DISTINCT item_id, list_slice(w, s, s + least(13, len(w)) - 1) AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
t AS (SELECT doc_id, p, word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d)),
l AS (SELECT doc_id, p, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS win FROM t),
n AS (SELECT DISTINCT len(win) AS n FROM u),
h AS (SELECT x.doc_id, x.p, x.n, u.item_id FROM (SELECT doc_id, p, n, list_slice(win, 1, n) AS win FROM l, n WHERE len(win) >= n) x JOIN u ON u.win = x.win),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS pos FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
