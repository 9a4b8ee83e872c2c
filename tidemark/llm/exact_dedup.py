"""Exact deduplication by a grace hash table.

Texts are equal when they are identical after each run of white space (``[\\x20\\x09-\\x0D]+``) has become one space.

1. *Before the shuffle* each task keeps the distinct texts of its rows in an open-addressing table of at most ``table_bytes``; when it
   is full, its texts go out and it starts anew. A text goes out once, with the number of its rows and the least of their places, however many copies
   the task had; each row goes out without its text. So a text that a third of all rows hold
   costs one row for each task, not one for each copy.
2. *Buckets.* The texts are dealt by their hash. A bucket streams through an open-addressing table that compares hash, then the complete
   content. What finds no room in ``table_bytes`` is spilled: it goes, with its content, to the table in
   ``spark.checkpoint.dir`` that the level writes. Spilled texts are dealt again by another mix of the hash,
   and so on until nothing is spilled. All copies of a text find room or all are spilled, as room never grows.
3. *Answers.* Each distinct text gives one row: hash, the place that stays, rows, digest. Rows find theirs by the hash; where two different
   texts have one hash, by the table's own numbers for the texts, which the buckets return too.

Texts of over one in HOT_SHARE rows number fewer than HOT_SHARE, so their answers are broadcast; all other answers meet their rows in a plain
join, where no key has more than that share.

Cases: null texts are empty texts; white space at the ends becomes one space and is kept; very long texts are compared whole, in batches that Arrow's size limit cuts, and a text longer than
``table_bytes`` gets a table to itself; the smallest id stays, null ids come last; of rows that tie (repeated ids) exactly one stays; null ids are kept;
other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of texts in one table.
TABLE_BYTES = 64 << 20
#: So many bytes of texts go to a bucket on average.
BUCKET_BYTES = 48 << 20
#: Texts of over one in so many rows number fewer than this.
HOT_SHARE = 1000
LAST_ID = 2**63 - 1
ROW, TEXT, SPILLED, NUMBER = 0, 1, 2, 3
#: kind ROW: a row at (part, row), whose text is number ``text`` of the tables of task ``part``. kind TEXT: one distinct text, ``answer`` its number in its bucket.
#: kind SPILLED: as TEXT, but not yet compared with all others. kind NUMBER: which answer text number ``text`` of task ``part`` got.
SCHEMA = pa.schema(
    [("kind", pa.int8()), ("h", pa.int64()), ("deal", pa.int64()), ("id", pa.int64()), ("part", pa.int32()), ("row", pa.int64()), ("text", pa.int64()), ("n", pa.int64()), ("body", pa.large_binary()), ("answer", pa.int64()), ("sha", pa.string())]
)
DDL = "kind tinyint, h long, deal long, id long, part int, row long, text long, n long, body binary, answer long, sha string"


@dataclass
class Table:
    """Open addressing with linear probing; entries are compared by hash, then by their complete content."""

    limit: int
    slots: list[int] = field(default_factory=lambda: [-1] * 1024)
    hashes: list[int] = field(default_factory=list)
    bodies: list[bytes] = field(default_factory=list)
    used: int = 0

    def put(self, h: int, body: bytes) -> int:
        """The entry of this content, a new one if there's none; -1 if it would need one and there's no room."""
        mask = len(self.slots) - 1
        at = (h ^ (h >> 32)) & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.bodies[k] == body:
                return k
            at = (at + 1) & mask
        if self.hashes and self.used + len(body) > self.limit:
            return -1
        self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.bodies.append(body)
        self.used += len(body) + 64
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return len(self.hashes) - 1

    def _grow(self) -> None:
        size = 2 * len(self.slots)
        self.slots = [-1] * size
        for k, h in enumerate(self.hashes):
            at = (h ^ (h >> 32)) & (size - 1)
            while self.slots[at] >= 0:
                at = (at + 1) & (size - 1)
            self.slots[at] = k


def _batch(**columns) -> pa.RecordBatch:
    n = len(columns["h"])
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in SCHEMA], schema=SCHEMA)


def _in_pieces(bodies: list[bytes], size: int = 16 << 20):
    """(first, last) of runs of bodies of about size bytes."""
    a, total = 0, 0
    for k, b in enumerate(bodies):
        if k > a and total + len(b) > size:
            yield a, k
            a, total = k, 0
        total += len(b)
    if a < len(bodies):
        yield a, len(bodies)


def _gathered(table_bytes: int):
    """Step 1: rows without texts, and each table's distinct texts."""

    def run(batches):
        part, row, numbered = TaskContext.get().partitionId(), 0, 0
        table, least, counts = Table(table_bytes), [], []

        def out():
            for a, b in _in_pieces(table.bodies):
                ids, rows = zip(*least[a:b], strict=True)
                yield _batch(kind=[TEXT] * (b - a), h=table.hashes[a:b], deal=table.hashes[a:b], id=ids, part=[part] * (b - a), row=rows, text=range(numbered + a, numbered + b), n=counts[a:b], body=table.bodies[a:b])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            view, offsets = C.text_slices(t)
            ids, hashes = t.column("id").to_pylist(), t.column("h").to_pylist()
            text = []
            for k, (i, h) in enumerate(zip(ids, hashes, strict=True)):
                body = bytes(view[offsets[k] : offsets[k + 1]])
                at = table.put(h, body)
                if at < 0:
                    yield from out()
                    numbered += len(counts)
                    table, least, counts = Table(table_bytes), [], []
                    at = table.put(h, body)
                place = (LAST_ID if i is None else i, row + k)
                if at == len(counts):
                    least.append(place)
                    counts.append(1)
                else:
                    counts[at] += 1
                    least[at] = min(least[at], place)
                text.append(numbered + at)
            places = np.arange(row, row + len(ids), dtype=np.int64)
            spread = C.mix(places.astype(np.uint64) + (np.uint64(part) << np.uint64(40))).view(np.int64)
            yield _batch(kind=np.full(len(ids), ROW, np.int8), h=t.column("h").combine_chunks(), deal=spread, id=t.column("id").combine_chunks(), part=np.full(len(ids), part, np.int32), row=places, text=text)
            row += len(ids)
        yield from out()

    return run


def _compared(table_bytes: int, level: int):
    """Step 2: a bucket's distinct texts; rows pass through, what finds no room is spilled for the level after this."""

    def run(batches):
        part, table, firsts = TaskContext.get().partitionId(), Table(table_bytes), []
        where, spilled, size = [], [], 0  # (h, part, text, answer) of each text that came; texts without room

        def numbered(k):  # of levels, tasks and entries, so never given twice
            return (level << 56) | (part << 32) | k

        for batch in batches:
            t = pa.Table.from_batches([batch])
            texts = t.filter(pc.equal(t.column("kind"), TEXT))
            if len(texts) < len(t):
                for b in t.filter(pc.equal(t.column("kind"), ROW)).to_batches():
                    yield b.cast(SCHEMA)
            if not len(texts):
                continue
            for r in zip(*(texts.column(c).to_pylist() for c in ("h", "id", "part", "row", "text", "n")), texts.column("body"), strict=True):
                h, body = r[0], r[6].as_py()
                at = table.put(h, body)
                if at < 0:
                    spilled.append((*r[:6], body))
                    size += len(body)
                    if size > table_bytes // 4:
                        yield _again(spilled, level)
                        spilled, size = [], 0
                    continue
                place = (r[1], r[2], r[3])
                if at == len(firsts):
                    firsts.append([place, r[5]])
                else:
                    firsts[at] = [min(firsts[at][0], place), firsts[at][1] + r[5]]
                where.append((h, r[2], r[4], numbered(at)))
        if spilled:
            yield _again(spilled, level)
        if firsts:
            places, n = zip(*firsts, strict=True)
            ids, parts, rows = zip(*places, strict=True)
            sha = [hashlib.sha256(b).hexdigest() for b in table.bodies]
            yield _batch(kind=[TEXT] * len(n), h=table.hashes, id=ids, part=parts, row=rows, n=n, answer=[numbered(k) for k in range(len(n))], sha=sha)
            h, parts, text, answer = zip(*where, strict=True)
            yield _batch(kind=[NUMBER] * len(h), h=h, part=parts, text=text, answer=answer)

    return run


def _again(spilled: list[tuple], level: int) -> pa.RecordBatch:
    h, ids, parts, rows, text, n, body = zip(*spilled, strict=True)
    deal = C.mix(np.array(h, np.int64).view(np.uint64) + np.uint64((level + 1) * C.BASE & C.M64)).view(np.int64)
    return _batch(kind=[SPILLED] * len(h), h=h, deal=deal, id=ids, part=parts, row=rows, text=text, n=n, body=body)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES, hash_bits: int = 64, buckets: int | None = None) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256 (of the text with single spaces, in UTF-8).

    table_bytes bounds the texts of a table; hash_bits fewer than 64 make different texts share hashes (for tests); buckets: of the first level, by default by the size of the texts.
    """
    spark = docs.sparkSession
    ident, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    total, rows = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.count(F.lit(1))).first()
    n = buckets or max(C.partitions(spark), -(-(total or 0) // BUCKET_BYTES))
    plain = docs.select(ident.alias("id"), F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ").alias("text"))
    hashed = plain.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 64 - hash_bits) if hash_bits < 64 else F.xxhash64("text"))
    level, found = 0, C.written(hashed.mapInArrow(_gathered(table_bytes), DDL).repartition(n, "deal").mapInArrow(_compared(table_bytes, 0), DDL), "dedup-0")
    levels = [found]
    while not (spilled := found.filter(F.col("kind") == SPILLED)).isEmpty():
        level += 1
        size = spilled.agg(F.sum(F.length("body"))).first()[0]
        again = spilled.withColumn("kind", F.lit(TEXT).cast("tinyint")).repartition(max(C.partitions(spark), -(-size // max(1, table_bytes // 2))), "deal")
        found = C.written(again.mapInArrow(_compared(table_bytes, level), DDL), f"dedup-{level}")
        levels.append(found)
    parts = levels[0]
    for more in levels[1:]:
        parts = parts.unionByName(more)
    return _answers(parts, rows, id_col)


def _answers(parts: DataFrame, rows: int, id_col: str) -> DataFrame:
    """Step 3: each row with its text's answer."""
    own = parts.filter(F.col("kind") == ROW).select("h", "id", "part", "row", "text")
    keep = F.when(F.col("id") != LAST_ID, F.col("id"))
    texts = parts.filter(F.col("kind") == TEXT).select("h", "answer", keep.alias("keep_id"), F.col("part").alias("keep_part"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"), F.col("sha").alias("text_sha256"))
    shared = texts.groupBy("h").count().filter("count > 1").select(F.col("h").alias("shared_h"))
    shared = C.written(shared, "dedup-shared")
    out = [F.col("id").alias(id_col), "keep_id", "group_size", ((F.col("part") == F.col("keep_part")) & (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256"]
    if not shared.isEmpty():  # different texts with one hash: their rows go by the tables' numbers
        numbers = parts.filter(F.col("kind") == NUMBER).select("h", F.col("part").alias("by_part"), F.col("text").alias("by_text"), "answer")
        numbers = numbers.join(shared, F.col("h") == F.col("shared_h"), "left_semi").drop("h")
        two = own.join(shared, F.col("h") == F.col("shared_h"), "left_semi").drop("h")
        two = two.join(numbers, (F.col("part") == F.col("by_part")) & (F.col("text") == F.col("by_text"))).join(texts.drop("h"), "answer").select(*out)
        own, texts = own.join(shared, F.col("h") == F.col("shared_h"), "left_anti"), texts.join(shared, F.col("h") == F.col("shared_h"), "left_anti")
    hot = F.col("group_size") > max(HOT_SHARE, rows // HOT_SHARE)
    few = F.broadcast(texts.filter(hot).drop("answer"))
    large = own.join(few, "h").select(*out)
    rest = own.join(few.select("h"), "h", "left_anti").join(texts.filter(~hot).drop("answer"), "h").select(*out)
    found = large.unionByName(rest)
    return found.unionByName(two) if not shared.isEmpty() else found


#: Everything by SQL: groups of normalised texts; the smallest id stays, of repeated rows one.
ORACLE_SQL = r"""
WITH plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM plain"""
