"""Token counts of sections from one encoding of the whole document.

A document is encoded once; the tokens' byte lengths give their spans. Spans join the sections by
position: both are sorted, so the section of a place is found by bisection. A token that crosses a
boundary belongs, by ``rule``, to the section of its first byte (``first``), of its last byte (``last``), of most of
its bytes, the first of equals (``most``), or to each by its share of bytes (``share``).
Every token is allocated once, so a document's sections add up to its tokens.

Sections are lines with their line ends, or paragraphs with the blank lines behind them.

Cases: null and empty texts have no tokens and no sections; a very long text is encoded whole, in one task; a tie of sections for most of a token's bytes goes to
the first; null ids are kept; repeated rows each get a row; other columns, whatever their names, are ignored; an empty table gives an empty result. Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import importlib.util
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

RULES = ("first", "last", "most", "share")
SPLITS = {"line": re.compile(rb"\n"), "paragraph": re.compile(rb"\n[ \t\r]*\n\s*")}
#: A public byte-level vocabulary, where it is installed; any file of the same format may be given instead.
DEFAULT_RANKS = str(Path(s.origin).parent / "byte_bpe_50k.tiktoken") if (s := importlib.util.find_spec("public_tokenizers")) else ""
#: Fixed value: how text is cut before merging for this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, tuple] = {}


def encoder(path: str, content: bytes | None = None):
    """The encoding and each token's number of bytes; loaded once a process, from content or else the file."""
    if path not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in (content or Path(path).read_bytes()).splitlines() if x)}
        length = np.zeros(max(ranks.values()) + 1, np.int64)
        length[list(ranks.values())] = [len(t) for t in ranks]
        _loaded[path] = tiktoken.Encoding("tidemark", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), length
    return _loaded[path]


def vocabulary(spark: SparkSession, path: str) -> bytes:
    """The file's bytes, from the driver's disk or a store that Spark reads."""
    if not path:
        raise ValueError("no vocabulary: give the path of a file of base64 tokens and ranks")
    if Path(path).is_file():
        return Path(path).read_bytes()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def sections(text: bytes, split: str) -> np.ndarray:
    """Where the sections of a text end; the last at the text's end."""
    ends = [m.end() for m in SPLITS[split].finditer(text)]
    return np.array(ends if ends and ends[-1] == len(text) else [*ends, len(text)] if text else [], np.int64)


def allocate(lengths: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a boundary."""
    stop = np.cumsum(lengths)
    start = stop - lengths
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop - 1, "right")
    crossing = np.flatnonzero(first != last)
    if rule in ("first", "last"):
        return np.bincount(first if rule == "first" else last, minlength=len(ends)).astype(np.float64), len(crossing)
    inside = first == last
    out = np.bincount(first[inside], minlength=len(ends)).astype(np.float64)
    for k in crossing.tolist():
        cuts = np.concatenate([[start[k]], ends[first[k] : last[k]], [stop[k]]])
        part = np.diff(cuts)
        if rule == "share":
            out[first[k] : last[k] + 1] += part / lengths[k]
        else:
            out[first[k] + int(part.argmax())] += 1
    return out, len(crossing)


def count(docs: DataFrame, ranks: str, split: str = "line", rule: str = "most", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id_col, n_bytes, n_tokens, n_sections, n_crossing, section_tokens (an array, in order). ranks: the vocabulary's file, which the driver reads; some MB, sent to each executor once."""
    if rule not in RULES or split not in SPLITS:
        raise ValueError(f"rule must be one of {RULES}, split one of {tuple(SPLITS)}")
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_sections", pa.int64()), ("n_crossing", pa.int64()), ("section_tokens", pa.list_(pa.float64()))])

    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(docs.sparkSession, ranks))

    def run(tables):
        encoding, length = encoder(ranks, sent.value)
        for t in tables:
            rows = []
            for i, text in zip(t.column("id").to_pylist(), t.column("text"), strict=True):
                text = text.as_py() or ""
                raw = text.encode()
                lengths = length[np.array(encoding.encode_ordinary(text), np.int64)] if text else np.zeros(0, np.int64)
                ends = sections(raw, split)
                tokens, crossing = allocate(lengths, ends, rule)
                rows.append((i, len(raw), len(lengths), len(ends), crossing, tokens.tolist()))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, schema, strict=True)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, "id long, n_bytes long, n_tokens long, n_sections long, n_crossing long, section_tokens array<double>")
    return found.withColumnRenamed("id", id_col)
