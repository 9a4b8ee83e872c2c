"""Exact substring deduplication by prefix-free parsing.

Which bytes go: every byte of a string of ``length`` (50) bytes that also starts in a
document with a smaller id. The method, made for Spark:

1. *Parse.* A rolling hash (a polynomial over 8 bytes) gives each position a value; the smallest of
   ``span`` neighbours, the first among equals, is a trigger. Plain triggers (hash divisible by p) leave some strings without one; the smallest of
   neighbours gives every string of ``length`` bytes a first trigger that depends on the string alone, so equal strings are cut alike wherever they stand.
   A phrase is the ``span + 8`` bytes from a trigger on. They decide where the next trigger is, so the phrases of a text tile it with overlaps, no phrase is the
   beginning of another, and the whole first phrase lies in every string of ``length`` bytes with that trigger.
2. *Dictionary.* Batches send what stands from a trigger to the next, hashed, to its partition, each with a bit
   for whether two ids of the batch have it. What one document only has cannot be
   part of a repeat, so only triggers of two ids or two batches stay. The hashes have as many bits as the input needs to keep chance meetings rare.
3. *Order.* A partition gets what stands around its triggers, each context once from a batch. Its distinct phrases, sorted, are the dictionary; their places are
   ranks. Each trigger's parse, the ranks of the phrases from it on, is sorted as a sequence of ranks: as no phrase begins another, that is the order of the
   bytes, found without comparing them again. This is the parse's suffix array; how far neighbours agree follows from where their first unlike phrases
   start and from how far these agree in the dictionary. The ends of the phrases before, from a string's start to its trigger, are the dictionary's suffixes, sorted from the
   trigger backwards. The pair of a dictionary suffix's class and a parse suffix's class is a string's place in corpus
   order: two strings are equal when their parse suffixes share ``length - j`` bytes and their dictionary suffixes share ``j``. The least id of each
   run of equal strings goes back to the batches.

A phrase that more than HOT_BATCHES batches have is hot: its strings don't meet by the phrase but by more of what they contain, those
that start close before the trigger by what follows it, the others by what stands before it. So a group holds the contexts of one such longer string.

The filter in step 2 goes by 64-bit hashes and can only let too much through; step 3
compares bytes, so the result is exact.

Cases: null text is empty; null ids come before all others; equal ids are one
document for this purpose (their rows don't remove each other's text); texts shorter than
``length`` bytes are kept whole; a very long text is one document of one task, which needs some 50 bytes for each of its bytes; of equal strings in
several documents those of the smallest id stay, however often it has them; other columns are ignored unless asked for, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

HASH_BYTES = 8
PIECE = 1 << 18
#: More neighbours give fewer triggers and longer contexts.
SPAN_MOST = 32
#: A phrase of more batches is split up.
HOT_BATCHES = 512


#: Rows of contexts that are worked on at once.
ROWS = 1 << 14
#: Contexts that a batch holds at once, or more if one partition gets more; and that a partition, which holds all of its own, sorts at once, or more if they share the bytes at their trigger.
CHUNK = 1 << 15


def context_width(length: int) -> int:
    """Bytes of a context: whole words."""
    return -(-(span_of(length) - 1 + length + 2) // 8) * 8


def span_of(length: int) -> int:
    """So many neighbours that a string's first trigger and the next one lie in it: the second at most 2 * span - 1 behind its start."""
    return min(SPAN_MOST, (length - HASH_BYTES + 1) // 2)


class Parse:
    """Triggers of the texts of a batch that strings have: flat positions, phrase hashes and the strings each trigger is the first of."""

    def __init__(self, table: pa.Table, length: int, bits: int = 64):
        self.length, self.width, self.bits = length, span_of(length), bits
        self.ids = C.numbers(table, "id").astype(np.int64)
        self.data, self.offsets = C.text_slices(table)
        self.flat = np.frombuffer(self.data, np.uint8)
        found = [self._triggers(a, b) for a, b in C.pieces(self.offsets, PIECE)]
        none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
        self.doc, self.at, self.far, self.near, self.hash = (np.concatenate(x) for x in zip(none, *found, strict=True))

    def _triggers(self, a: int, b: int):
        base, end = int(self.offsets[a]), int(self.offsets[b])
        text, reach = self.flat[base:end], self.width + HASH_BYTES - 1
        if len(text) < self.length:
            return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * C.powers(C.BASE, len(text)), dtype=np.uint64)])
        back = C.powers(C.BASE_INV, len(text) + 1)
        rolling = (total[HASH_BYTES:] - total[:-HASH_BYTES]) * back[: len(text) - HASH_BYTES + 1]
        # the trigger of a start: the first place of the least value among its first neighbours
        value = (rolling * np.uint64(0xD6E8FEB86659FD93)) & np.uint64(0xFFFFFFFF00000000)
        value |= np.arange(len(value), dtype=np.uint64)
        anchor = C.sliding_min(value, self.width).astype(np.uint32)
        # starts whose neighbours lie within one text
        inside = np.ones(len(anchor), bool)
        stops = self.offsets[a + 1 : b + 1] - base
        for x in stops[:-1].tolist():
            inside[max(0, x - reach + 1) : x] = False
        turn = anchor[1:] != anchor[:-1]
        first = np.flatnonzero(inside & np.concatenate([[True], turn | ~inside[:-1]]))
        last = np.flatnonzero(inside & np.concatenate([turn | ~inside[1:], [True]]))
        at = anchor[first].astype(np.int64)
        doc = np.searchsorted(stops, first, "right")
        last = np.minimum(last, stops[doc] - self.length)  # of whole strings
        some = np.flatnonzero(last >= first)  # each of these has a next trigger in its text
        size = at[some + 1] + HASH_BYTES - at[some] if len(some) else np.zeros(0, np.int64)
        first, last, at, doc = first[some], last[some], at[some], doc[some]
        phrase = C.mix(((total[at + size] - total[at]) * back[at]) ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        return doc + a, at + base, at - first, at - last, phrase

    def keys(self):
        """Distinct hashes of phrases, of which the leading bits count; whether several ids have each; the trigger's place among them."""
        keys, back = np.unique(self.hash >> np.uint64(64 - self.bits) << np.uint64(64 - self.bits), return_inverse=True)
        low, high = np.full(len(keys), 2**63 - 1, np.int64), np.full(len(keys), C.NULL_ID, np.int64)
        np.minimum.at(low, back, self.ids[self.doc])
        np.maximum.at(high, back, self.ids[self.doc])
        return keys, low < high, back

    def meetings(self, kind: np.ndarray):
        """(trigger, key, far, near) of the triggers by kind of their phrase: 0 none, 1 its phrase, 2 what follows and what stands before it."""
        cold, hot = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
        half = self.width // 2
        right, left = hot[self.near[hot] <= half], hot[self.far[hot] > half]
        return (
            np.concatenate([cold, right, left]),
            np.concatenate([self.hash[cold], self._longer(right, 0, self.length - half), self._longer(left, -half - 1, 0)]),
            np.concatenate([self.far[cold], np.minimum(self.far[right], half), self.far[left]]),
            np.concatenate([self.near[cold], self.near[right], np.maximum(self.near[left], half + 1)]),
        )

    def _longer(self, chosen: np.ndarray, start: int, stop: int) -> np.ndarray:
        h = self.hash[chosen] + np.uint64(start & C.M64)
        for k in range(start, stop):
            h = h * np.uint64(C.BASE) + self.flat[self.at[chosen] + k].astype(np.uint64) + np.uint64(1)
        return C.mix(h)

    @functools.cached_property
    def _padded(self) -> np.ndarray:
        return np.concatenate([np.zeros(self.width - 1, np.uint8), self.flat, np.zeros(self.length, np.uint8)])

    def contexts(self, chosen: np.ndarray, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        """For each chosen trigger the bytes before it and length bytes from it on, 0 beyond its strings, then far and near."""
        left = self.width - 1
        reach, column = left + self.length, np.arange(left + self.length, dtype=np.int16)
        out = np.zeros((len(chosen), context_width(self.length)), np.uint8)
        windows = np.lib.stride_tricks.sliding_window_view(self._padded, reach)
        for k in range(0, len(chosen), ROWS):
            own = slice(k, k + ROWS)
            rows = windows[self.at[chosen[own]]]
            rows[(column < (left - far[own])[:, None]) | (column >= (reach - near[own])[:, None])] = 0  # beyond what its strings cover
            out[own, :reach] = rows
        out[:, -2], out[:, -1] = far, near
        return out


REQUEST = "batch int, part int, keys binary, several binary"
#: kind 1: for each phrase whether it is shared, then whether it is hot; 2: least ids
FLAGS = "batch int, kind int, part int, body binary"
FLAG_ROWS = pa.schema([("batch", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("body", pa.binary())])


def key_bits(batches: int) -> int:
    """Bits of the hashes that batches send: some hundred times as many values as there can be phrases in all."""
    return min(64, (batches * C.BATCH_BYTES).bit_length() + 6)


def _phrases(length: int, n: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        batch = int(C.numbers(table, "batch")[0])
        keys, several, _ = Parse(table, length, bits).keys()
        rows = [(batch, p, C.pack_sorted(keys[a:b]), C.pack(np.packbits(several[a:b]))) for p, a, b in C.deal(keys, n)]
        return C.as_table(rows, pa.schema([("batch", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("several", pa.binary())]))

    return run


def _shared(table: pa.Table) -> pa.Table:
    """For each batch's phrases of this partition: whether two ids, or two batches, have it, and whether more than HOT_BATCHES batches have."""
    part = int(C.numbers(table, "part")[0])
    batches = C.numbers(table, "batch")
    sent = [C.unpack_sorted(x.as_py()) for x in table.column("keys")]
    told = [np.unpackbits(C.unpack(x.as_py(), np.uint8))[: len(k)] for x, k in zip(table.column("several"), sent, strict=True)]
    keys, back = np.unique(np.concatenate(sent), return_inverse=True)
    having = np.bincount(back, minlength=len(keys))
    several = (having > 1) | (np.bincount(back, np.concatenate(told), len(keys)) > 0)
    several, hot, rows, at = several[back], (having > HOT_BATCHES)[back], [], 0
    for b, k in zip(batches, sent, strict=True):
        own = slice(at, at + len(k))
        rows.append((int(b), 1, part, C.pack(np.concatenate([np.packbits(several[own]), np.packbits(hot[own])]))))
        at += len(k)
    return C.as_table(rows, FLAG_ROWS)


def _records(parse: Parse, answers: pa.Table, n: int):
    """Distinct contexts of the triggers whose phrase is in the dictionary, for runs of partitions with some CHUNK triggers, so that few contexts are in memory at once.

    Yields (partitions of the contexts, contexts with repeats, first trigger of each distinct one; partitions of the triggers; the triggers with far and near; their places among the distinct contexts).
    """
    keys, _, back = parse.keys()
    kind = np.zeros(len(keys), np.int8)
    said = {p: b for k, p, b in zip(C.numbers(answers, "kind"), C.numbers(answers, "part"), answers.column("body").to_pylist(), strict=True) if k == 1}
    for p, a, b in C.deal(keys, n):
        bits = C.unpack(said[p], np.uint8)
        shared, hot = (np.unpackbits(x)[: b - a] for x in np.split(bits, 2))
        kind[a:b] = shared + (shared & hot)
    chosen, key, far, near = parse.meetings(kind[back])
    order = np.argsort(key, kind="stable")  # by partition
    chosen, key, far, near = chosen[order], key[order], far[order], near[order]
    del keys, back, kind, order
    a = 0
    for _, _, b in C.deal(key, n):
        if b - a >= CHUNK or b == len(key):
            yield _distinct(parse, chosen[a:b], key[a:b], far[a:b], near[a:b], n)
            a = b


def _distinct(parse: Parse, chosen: np.ndarray, key: np.ndarray, far: np.ndarray, near: np.ndarray, n: int):
    """One step of _records."""
    rows = parse.contexts(chosen, far, near)
    words = rows.view(np.uint64)
    digest = key.copy()
    for k in range(words.shape[1]):
        digest = C.mix(digest * np.uint64(C.BASE) + words[:, k])
    by = np.lexsort((digest, key))  # equal contexts come together; unlike ones with one hash are told apart below
    new = np.ones(len(by), bool)
    for k in range(1, len(by), ROWS):
        here, before = by[k : k + ROWS], by[k - 1 : k + ROWS - 1][: len(by) - k]
        new[k : k + ROWS] = (key[here] != key[before]) | (words[here] != words[before]).any(axis=1)
    place = np.empty(len(chosen), np.int64)
    place[by] = np.cumsum(new) - 1
    first = by[new]
    return (C.deal(key[first], n), rows, first), C.deal(key, n), (chosen, far, near), place


CONTEXTS = "batch int, part int, body binary, low binary"


def _contexts(length: int, n: int, bits: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("batch", pa.int32()), ("part", pa.int32()), ("body", pa.binary()), ("low", pa.binary())])
        if not table.num_rows:
            return C.as_table([], schema)
        batch = int(C.numbers(table, "batch")[0])
        parse, out, z = Parse(table, length, bits), [], C._zstd().ZstdCompressor(level=3)
        for (deal, rows, first), _, (chosen, _, _), place in _records(parse, answers, n):
            low = np.full(len(first), 2**63 - 1, np.int64)
            np.minimum.at(low, place, parse.ids[parse.doc[chosen]])
            out += [(batch, p, z.compress(rows[first[a:b]].tobytes()), C.pack(low[a:b])) for p, a, b in deal]
        return C.as_table(out, schema)

    return run


def _byte_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte rows, and for each place the bytes shared with the row before (-1 at the first)."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    words = padded.view(">u8").astype(np.uint64)
    del padded
    order = np.lexsort(tuple(words[:, k] for k in range(words.shape[1] - 1, -1, -1)))
    del words
    common = np.full(len(rows), -1)
    for k in range(1, len(rows), ROWS):
        here, before = order[k : k + ROWS], order[k - 1 : k + ROWS - 1][: len(rows) - k]
        common[k : k + ROWS] = _agreement(rows[here], rows[before])
    return order, common


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the rows of a and b share from their start on."""
    differs = a != b
    return np.where(differs.any(axis=1), differs.argmax(axis=1), a.shape[1])


def phrase_places(rows: np.ndarray, span: int) -> np.ndarray:
    """Of byte rows that start at a trigger: where their phrases start, a column for each phrase, -1 behind the last. All phrases lie in the row; the last ends with it.

    The next trigger is the first smaller value among the span - 1 places behind one, else the smallest of the span places behind it.
    """
    size = rows.shape[1]
    hashes, width = rows.astype(np.uint64) + np.uint64(1), 1
    while width < HASH_BYTES:  # of twice as many bytes
        hashes = hashes[:, :-width] + hashes[:, width:] * np.uint64(pow(C.BASE, width, 1 << 64))
        width *= 2
    values = ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    del hashes
    last = size - span - HASH_BYTES
    windows = np.lib.stride_tricks.sliding_window_view(values, span, axis=1)
    alive, at, columns = np.arange(len(rows)), np.zeros(len(rows), np.int64), [np.zeros(len(rows), np.int16)]
    while len(alive) and last:
        behind = windows[alive, at + 1]
        smaller = behind[:, :-1] < values[alive, at][:, None]
        first = smaller.argmax(axis=1)
        at = at + 1 + np.where(smaller[np.arange(len(alive)), first], first, behind.argmin(axis=1))
        at = np.minimum(at, last)
        columns.append(np.full(len(rows), -1, np.int16))
        columns[-1][alive] = at
        alive, at = alive[at < last], at[at < last]
    return np.stack(columns, axis=1)


def parse_order(rows: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the parses of byte rows that start at a trigger: their order, and for each place the bytes shared with the row before (-1 at the first)."""
    places, size = phrase_places(rows, span), span + HASH_BYTES
    row, column = np.nonzero(places >= 0)
    phrases = np.lib.stride_tricks.sliding_window_view(rows, size, axis=1)[row, places[row, column]]
    phrase_order, phrase_common = _byte_order(phrases)
    rank = np.empty(len(phrases), np.int32)
    rank[phrase_order] = np.cumsum(phrase_common < size) - 1
    dictionary = phrases[phrase_order[phrase_common < size]]
    del phrases, phrase_order, phrase_common
    ranks = np.full(places.shape, -1, np.int32)
    ranks[row, column] = rank
    order = np.lexsort(tuple(ranks[:, k] for k in range(ranks.shape[1] - 1, -1, -1)))
    common = np.full(len(rows), -1)
    for k in range(1, len(rows), ROWS):
        here, before = order[k : k + ROWS], order[k - 1 : k + ROWS - 1][: len(rows) - k]
        unlike = _agreement(ranks[here], ranks[before])  # phrases that both start with
        some = np.flatnonzero(unlike < ranks.shape[1])
        shared = np.full(len(here), rows.shape[1])
        shared[some] = places[here[some], unlike[some]] + _agreement(dictionary[ranks[here[some], unlike[some]]], dictionary[ranks[before[some], unlike[some]]])
        common[k : k + ROWS] = shared
    return order, common


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each row the number of its run of rows that share depth bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def least_ids(rows: np.ndarray, low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context and each distance j that it has of a string's start from the trigger, the least id with that string: its place in the second result.

    Places take half the memory of ids, and there are as many as contexts times distances. Equal strings have the same bytes at their trigger, so
    contexts are ordered in some CHUNK at once, dealt by these bytes.
    """
    ids, low = np.unique(low, return_inverse=True)
    low, span, n = low.astype(np.int32), span_of(length), len(rows) // CHUNK + 1
    out = np.empty((len(rows), span), np.int32)
    at = np.ascontiguousarray(rows[:, span - 1 : span - 1 + HASH_BYTES]).view(np.uint64).ravel()
    chunk = C.mix(at) % np.uint64(n)
    for k in range(n):
        own = np.flatnonzero(chunk == k)
        out[own] = _least(rows[own], low[own], length, len(ids))
    return out, np.append(ids, 2**63 - 1)


def _least(rows: np.ndarray, low: np.ndarray, length: int, none: int) -> np.ndarray:
    """least_ids of contexts that are ordered at once; none stands where a context has no string yet."""
    span = span_of(length)
    left = span - 1
    suffixes, parses = rows[:, :left][:, ::-1], rows[:, left : left + length]
    order, common = parse_order(parses, span)
    left_order, left_common = _byte_order(suffixes)
    far, near = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    out = np.full((len(rows), span), none, np.int32)
    for j in range(span):
        mine = np.flatnonzero((near <= j) & (j <= far))
        if j:
            out[:, j] = out[:, j - 1]  # where the distance isn't used
        if not len(mine):
            continue
        key = (_classes(order, common, length - j)[mine] << 31) | _classes(left_order, left_common, j)[mine]
        by = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
        least = np.minimum.reduceat(low[mine][by], starts)
        group = np.empty(len(mine), np.int64)
        group[by] = np.cumsum(np.concatenate([[True], key[by][1:] != key[by][:-1]])) - 1
        out[mine, j] = least[group]
    return out


def _order(length: int):
    width = context_width(length)

    def run(table: pa.Table) -> pa.Table:
        part = int(C.numbers(table, "part")[0])
        z = C._zstd().ZstdDecompressor()
        sent = [np.frombuffer(z.decompress(x.as_py()), np.uint8).reshape(-1, width) for x in table.column("body")]
        low = np.concatenate([C.unpack(x.as_py(), np.int64) for x in table.column("low")])
        sizes, contexts = [len(x) for x in sent], np.concatenate(sent)
        del sent
        least, ids = least_ids(contexts, low, length)
        rows, at = [], 0
        for b, size in zip(C.numbers(table, "batch"), sizes, strict=True):
            steps = np.diff(ids[least[at : at + size]], axis=1, prepend=np.int64(0))  # mostly zero
            rows.append((int(b), 2, part, C.pack(steps.ravel())))
            at += size
        return C.as_table(rows, FLAG_ROWS)

    return run


RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _remove(length: int, n: int, bits: int, with_text: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
        if not table.num_rows:
            return C.as_table([], schema) if "more" not in table.column_names else C.as_table([], schema).append_column("more", table.column("more"))
        parse = Parse(table, length, bits)
        span = parse.width
        said = {p: b for k, p, b in zip(C.numbers(answers, "kind"), C.numbers(answers, "part"), answers.column("body").to_pylist(), strict=True) if k == 2}
        edge = np.zeros(len(parse.flat) + 1, np.int32)  # +1 where a removed string starts, -1 behind its end
        for (deal, _, _), runs, (chosen, far, near), place in _records(parse, answers, n):
            for (p, base, _), (_, a, b) in zip(deal, runs, strict=True):  # a partition's contexts, and its triggers
                least = C.unpack(said[p], np.int64).reshape(-1, span).cumsum(axis=1)
                at, own, where = parse.at[chosen[a:b]], parse.ids[parse.doc[chosen[a:b]]], place[a:b] - base
                for j in range(span):
                    hit = (near[a:b] <= j) & (j <= far[a:b])
                    hit[hit] = least[where[hit], j] < own[hit]
                    np.add.at(edge, at[hit] - j, 1)
                    np.add.at(edge, at[hit] - j + length, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        begun = gone & ~np.concatenate([[False], gone[:-1]])
        begun[parse.offsets[:-1][np.diff(parse.offsets) > 0]] |= gone[parse.offsets[:-1][np.diff(parse.offsets) > 0]]
        rows, extra = [], [table.column("more")] if "more" in table.column_names else []
        for k, (a, b) in enumerate(zip(parse.offsets[:-1].tolist(), parse.offsets[1:].tolist(), strict=True)):
            cut = int(gone[a:b].sum())
            kept = parse.flat[a:b][~gone[a:b]].tobytes() if cut else bytes(parse.data[a:b])
            # a cut may split a character whose bytes were shared: the digest has the bytes, the text drops the fragment
            rows.append((int(parse.ids[k]), b - a, cut, int(begun[a:b].sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
        out = C.as_table(rows, schema)
        return out.append_column("more", extra[0]) if extra else out

    return run


def remove_repeats(docs: DataFrame, length: int = 50, with_text: bool = True, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id_col, n_bytes, n_removed, n_spans, kept_sha256, with_text also kept (the remaining text), then the columns keep."""
    if not 2 * HASH_BYTES <= length < 200:
        raise ValueError(f"length must be from {2 * HASH_BYTES} to 199")
    spark = docs.sparkSession
    n = C.batch_count(docs, text_col)
    parts, bits = C.key_partitions(spark, n, 4), key_bits(n)
    batches = C.in_batches(docs, n, id_col, text_col, **({"more": F.struct(*keep)} if keep else {}))
    phrases = batches.groupBy("batch").applyInArrow(_phrases(length, parts, bits), REQUEST)
    flags = phrases.groupBy("part").applyInArrow(_shared, FLAGS)
    contexts = batches.groupBy("batch").cogroup(flags.groupBy("batch")).applyInArrow(_contexts(length, parts, bits), CONTEXTS)
    order = contexts.groupBy("part").applyInArrow(_order(length), FLAGS)
    answers = flags.unionByName(order)
    result = batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_remove(length, parts, bits, with_text), RESULT + (f", more {batches.schema['more'].dataType.simpleString()}" if keep else ""))
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
    return result.select(C.null_id("id", id_col), *columns, *(F.col(f"more.{c}").alias(c) for c in keep))
