"""Links between the tokens of two tokenizers over the same text, and how widely each link is held.

Vocabulary A is a byte-level BPE (``tokenizers``), vocabulary B a piece model with byte fallback (``sentencepiece``). Both encode a space and the text.

1. *Groups.* Documents are taken in blocks of about BLOCK_BYTES. The tokens of a block are one sequence each for A and B; cumulative sums of their byte
   lengths give where they end, ``intersect1d`` the places where both end, ``searchsorted`` each token's group. As A and B spell the same bytes, a document's end is such a
   place, so groups never cross documents.
2. *Links.* Each token of A is repeated once for each token of B in its group, with B's positions beside it. Equal id pairs of a document become one row of (pair, times). A group of over
   WIDE links is first reduced to its distinct ids, which gives the same pairs and times without a row for each link.
3. *Counts.* A block counts in how many of its documents it has each pair. These counts are added up in two shuffles, by pair and salt, then by pair, so a pair that every
   block holds doesn't meet in one task unadded. The highest count of an A id comes the same way.
4. *Answers.* Counts go back to blocks by a join on the pair; pairs of over one in HOT_SHARE block rows, fewer than HOT_SHARE, are broadcast (an A id's highest count too: there are as many as ids). A block then sums
   over its documents' packed pairs.

Cases: null, empty texts and texts that a vocabulary can't spell (joined tokens differ from a space and the text, as where one normalises) have no tokens: zeros and an empty ``groups_sha256``; very long texts are a block of their own; ties for
the highest count all count as best; repeated rows are documents of their own; null ids are kept; other columns, whatever their names, are ignored; an empty table gives an empty result. Special
tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import hashlib
import importlib.util
import json
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .token_counts import PATTERN, vocabulary

_folder = Path(s.origin).parent if (s := importlib.util.find_spec("public_tokenizers")) else None
#: Public vocabularies, where they are installed; any files of the same formats may be given instead.
DEFAULT_BYTES = str(_folder / "byte_bpe_50k.json") if _folder else ""
DEFAULT_PIECES = str(_folder / "piece_bpe_32k.model") if _folder else ""
#: Bytes of text in a block.
BLOCK_BYTES = 2 << 20
#: Links of a group from which it is reduced to distinct ids first.
WIDE = 1 << 16
#: Of all rows of block and pair, pairs that have over one in so many number fewer than this; of fewer rows than twice as many, those that have two or more.
HOT_SHARE = 20_000
SALTS = 16
#: Bits of a B id in a pair's number.
SHIFT = 24
#: A row for each block: columns of lists have a place for each document, pairs and documents one for each of the block's pairs (sorted); links is packed: for
#: each document in order its pairs, as differences of places in pairs, and times.
DDL = "block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, pairs array<long>, documents array<long>, bounds array<long>, links binary, times binary"
SCHEMA = pa.schema([("block", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("ids", "n_a", "n_b", "n_groups", "n_links")), ("sha", pa.list_(pa.string())), *((c, pa.list_(pa.int64())) for c in ("pairs", "documents", "bounds")), ("links", pa.binary()), ("times", pa.binary())])
_loaded: dict[tuple, Pair] = {}


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _ranks(model: dict) -> dict[bytes, int] | None:
    """The bytes of each token of a byte-level BPE file with its id, if the ids follow the order of its merges and nothing else comes before or behind the merges; else None."""
    bpe, cut = model["model"], model.get("pre_tokenizer") or {}
    plain = model.get("normalizer") is None and cut == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": cut.get("trim_offsets"), "use_regex": True}
    if bpe.get("type") != "BPE" or not plain or any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    special, vocab, byte_of = {t["content"] for t in model.get("added_tokens") or ()}, bpe["vocab"], _byte_of()
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in bpe["merges"]]
    own = {t: k for t, k in vocab.items() if t not in special}
    if sorted(merged) != merged or len(own) != len(set(merged)) + 256 or max((own[t] for t in byte_of), default=0) >= min(merged, default=1 << 30):
        return None
    return {bytes(byte_of[c] for c in t): k for t, k in own.items()}


class Pair:
    """Both vocabularies: encoders, the bytes of each id, and their lengths.

    A file of plain byte-level merges is encoded by ``tiktoken`` with the file's own tokens and merge order, which takes a third of the time and a fraction of the memory; any other one by ``tokenizers``. Both
    give the same ids (tested on all code points and tokens).
    """

    def __init__(self, a: bytes, b: bytes, fast: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        import sentencepiece

        model = json.loads(a)
        ranks = _ranks(model) if fast else None
        if ranks:
            import tiktoken

            encoding = tiktoken.Encoding("tidemark-alignment", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._ids = lambda texts: [np.array(encoding.encode_ordinary(t), np.int32) for t in texts]
            tokens = {k: t for t, k in ranks.items()}
        else:
            from tokenizers import Tokenizer

            tokenizer, byte_of = Tokenizer.from_buffer(a), _byte_of()
            tokenizer.encode_special_tokens = True
            self._ids = lambda texts: [np.array(tokenizer.encode(t, add_special_tokens=False).ids, np.int32) for t in texts]
            tokens = {k: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, k in tokenizer.get_vocab().items()}
        self.a_bytes = [tokens.get(k, b"") for k in range(max(tokens) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(k)]]
        self.a_length, self.b_length = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        #: Decimal ids with what follows them: a comma, the bar after A's last, the semicolon after B's last.
        self.said = [[f"{k}{end}" for k in range(max(len(self.a_bytes), len(self.b_bytes)))] for end in ",|;"]

    def encoded(self, texts: list[str]) -> tuple[list, list]:
        """The ids of each text, None where a vocabulary can't spell a space and the text."""
        full = [" " + t for t in texts]
        left, right = self._ids(full), [np.array(self.b.encode(t), np.int32) for t in texts]
        for k, (t, x, y) in enumerate(zip(full, left, right, strict=True)):
            raw = t.encode()
            if len(t) == 1 or b"".join([self.a_bytes[i] for i in x.tolist()]) != raw or b"".join([self.b_bytes[i] for i in y.tolist()]) != raw:
                left[k] = right[k] = None
        return left, right


def expanded(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times) of all links: every A token with every B token of its group; a pair may come more than once. Groups are 0 .. n - 1, in order."""
    of_a, of_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    wide = np.flatnonzero(of_a * of_b > WIDE)
    begun_a, begun_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
    repeats = of_b[group_a]
    if len(wide):
        repeats = np.where(np.isin(group_a, wide), 0, repeats)
    total = np.cumsum(repeats)
    which = np.repeat(np.arange(len(a)), repeats)
    within = np.arange(len(which)) - np.repeat(total - repeats, repeats)
    group = group_a[which]
    found = [(group, (a[which] << SHIFT) | b[begun_b[group] + within], np.ones(len(which), np.int64))]
    for g in wide.tolist():
        x, nx = np.unique(a[begun_a[g] : begun_a[g] + of_a[g]], return_counts=True)
        y, ny = np.unique(b[begun_b[g] : begun_b[g] + of_b[g]], return_counts=True)
        pair = ((x[:, None] << SHIFT) | y[None, :]).ravel()
        found.append((np.full(len(pair), g), pair, (nx[:, None] * ny[None, :]).ravel()))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _block(pair: Pair, ids: list, texts: list[str], block: int) -> pa.RecordBatch:
    """The row of one block."""
    left, right = pair.encoded(texts)
    n = len(ids)
    n_a, n_b = (np.array([0 if x is None else len(x) for x in v], np.int64) for v in (left, right))
    a, b = (np.concatenate([np.zeros(0, np.int64), *(x for x in v if x is not None)]).astype(np.int64) for v in (left, right))
    del left, right
    end_a, end_b = np.cumsum(pair.a_length[a]), np.cumsum(pair.b_length[b])
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)  # no token is empty
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    doc_of = np.zeros(len(cuts), np.int64)
    doc_of[group_a] = np.repeat(np.arange(n), n_a)
    group, pairs, times = expanded(a, b, group_a, group_b, len(cuts))
    held, at = np.unique(pairs, return_inverse=True)
    key = doc_of[group] * len(held) + at
    del group, pairs, at
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.add.reduceat(times[order], first) if len(first) else times
    doc, at = np.divmod(key[first], max(1, len(held)))
    del key, order, first
    links = np.bincount(doc, times, minlength=n).astype(np.int64)
    groups = np.bincount(doc_of, minlength=n).astype(np.int64)
    columns = [ids, n_a, n_b, groups, links, _digests(pair, a, b, group_a, group_b, len(cuts), n_a, n_b), held, np.bincount(at, minlength=len(held)), np.searchsorted(doc, np.arange(n + 1))]
    packed = [C.pack(np.diff(at, prepend=0).astype(np.int32)), C.pack(times.astype(np.int32))]
    return pa.record_batch([pa.array([v], f.type) for v, f in zip([block, *columns, *packed], SCHEMA, strict=True)], schema=SCHEMA)


def _digests(pair: Pair, a, b, group_a, group_b, n, n_a, n_b) -> list[str]:
    """SHA-256 of each document's groups as ``a1,a2|b1;a3|b2,b3``; empty for a document without tokens."""
    of_a, of_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    sequence, end = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int8)
    at_a = np.arange(len(a)) + (np.cumsum(of_b) - of_b)[group_a]
    at_b = np.arange(len(b)) + np.cumsum(of_a)[group_b]
    sequence[at_a], sequence[at_b] = a, b
    end[at_a[np.cumsum(of_a) - 1]], end[at_b[np.cumsum(of_b) - 1]] = 1, 2
    said, out, at = pair.said, [], 0
    for size in (n_a + n_b).tolist():
        text = "".join([said[e][k] for k, e in zip(sequence[at : at + size].tolist(), end[at : at + size].tolist(), strict=True)])
        out.append(hashlib.sha256(text[:-1].encode()).hexdigest() if size else "")
        at += size
    return out


def _encoded(key: tuple, sent, block_bytes: int):
    def run(batches):
        if key not in _loaded:
            _loaded[key] = Pair(*sent.value)
        block, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_py() or ""
                if ids and size + len(text) > block_bytes:
                    yield _block(_loaded[key], ids, texts, block)
                    block, ids, texts, size = block + 1, [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text) + 16
        if ids:
            yield _block(_loaded[key], ids, texts, block)

    return run


ANSWER = pa.schema([("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("sha", pa.string()), ("n_best", pa.int64()), ("count_sum", pa.int64())])


def _answered(block: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's documents with the sums over their pairs. counts: (pair, held, best) of each of the block's pairs."""
    row = block.to_pylist()[0]
    order = np.argsort(C.numbers(counts, "pair"))
    at, times = np.cumsum(C.unpack(row["links"], np.int32).astype(np.int64)), C.unpack(row["times"], np.int32).astype(np.int64)
    bounds = np.array(row["bounds"])
    best, held = (np.concatenate([[0], np.cumsum(times * C.numbers(counts, c)[order][at])]) for c in ("best", "held"))
    return pa.table([row["ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], row["sha"], *(pa.array(v[bounds[1:]] - v[bounds[:-1]]) for v in (best, held))], schema=ANSWER)


def align(docs: DataFrame, bytes_path: str = DEFAULT_BYTES, pieces_path: str = DEFAULT_PIECES, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The driver reads the vocabularies' files, some MB whatever the input, and sends them to each executor once.
    """
    blocks = encode(docs, bytes_path, pieces_path, id_col, text_col, block_bytes)
    counts = C.written(pair_counts(blocks), "pair-counts")
    each = blocks.select(F.col("block").alias("of"), F.explode("pairs").alias("pair"))
    least = max(1, (blocks.agg(F.sum(F.size("pairs"))).first()[0] or 0) // HOT_SHARE)
    common = F.broadcast(counts.filter(F.col("blocks") > least).drop("blocks"))
    rare = counts.filter(F.col("blocks") <= least).drop("blocks")
    answered = each.join(common, "pair").unionByName(each.join(common.select("pair"), "pair", "left_anti").join(rare, "pair"))
    rows = blocks.drop("pairs", "documents")
    found = rows.groupBy("block").cogroup(answered.groupBy("of")).applyInArrow(_answered, "id long, n_a long, n_b long, n_groups long, n_links long, sha string, n_best long, count_sum long")
    return found.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("sha").alias("groups_sha256"))


def encode(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Steps 1 and 2, written: a row for each block."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((vocabulary(spark, bytes_path), vocabulary(spark, pieces_path)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return C.written(rows.mapInArrow(_encoded((bytes_path, pieces_path), sent, block_bytes), DDL), "aligned")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, held, best, blocks): in how many documents each pair is linked, 1 if that is the highest of its A id, and how many blocks hold it. pair: A id * 2**SHIFT + B id."""
    each = blocks.select("block", F.explode(F.arrays_zip("pairs", "documents")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.documents").alias("n"), F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt"))
    salted = each.groupBy("pair", "salt").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"))
    counts = C.written(salted.groupBy("pair").agg(F.sum("n").alias("held"), F.sum("blocks").alias("blocks")), "pair-sums")
    a = F.shiftright("pair", SHIFT)
    highest = counts.groupBy(a.alias("a")).agg(F.max("held").alias("top"))
    return counts.join(F.broadcast(highest), a == F.col("a")).select("pair", "held", (F.col("held") == F.col("top")).cast("long").alias("best"), "blocks")
