"""Interleaved documents: ordered text and media references from HTML, payloads resolved by digest.

``parse`` turns HTML into a sequence of items (kind, text, digest, caption) in document order; a figure's
caption, or else the image's alternative text, stays with its reference. ``resolve`` joins
the references with a media table by digest and puts what it finds back at the same positions, so that
texts, media and captions stay aligned; a reference without a payload keeps its place with nulls. Only references take part in the
join, so texts don't meet under a missing digest, and a digest that many documents have is a skewed join key that Spark may split.

Media are lossless 8-bit RGB images (PNG) of ``WIDTH`` pixels a row. ``encode`` and ``decode`` are an exact round
trip; ``decode`` checks every chunk's checksum and the image's size.

Cases: null HTML and null payloads are empty; bytes are padded with spaces to a positive multiple of a row; a very long text is one
payload and as many items as it has lines; equal payloads have one digest and one media row; repeated rows are kept; null ids are kept; a stray
figcaption without an image is text; other columns are kept by ``parse`` and ignored by ``interleaved``, whatever their names; ties don't occur, as
items are ordered by their position; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDTH = 64
ROW = 3 * WIDTH
#: Fixed values of the format: the signature, and 8 bits a sample, RGB, deflate, adaptive filtering, no interlace.
SIGNATURE, KIND = b"\x89PNG\r\n\x1a\n", b"\x08\x02\x00\x00\x00"
ITEM = "struct<kind:string,text:string,digest:string,caption:string>"
ITEM_TYPE = pa.struct([("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])


def padded(payload: bytes) -> bytes:
    return payload + b" " * (max(ROW, -(-len(payload) // ROW) * ROW) - len(payload))


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def encode(samples: bytes) -> bytes:
    """A PNG whose samples are these bytes, a positive multiple of a row."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    filtered = np.zeros((len(rows), ROW + 1), np.uint8)
    filtered[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">II", WIDTH, len(rows)) + KIND) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode(image: bytes) -> bytes:
    """The samples of an 8-bit RGB image written without row filters."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, data = 8, None, []
    while at < len(image):
        n, name = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(name + body):
            raise ValueError("damaged chunk")
        if name == b"IHDR":
            size = struct.unpack(">II", body[:8])
            if body[8:] != KIND:
                raise ValueError("not 8-bit RGB")
        elif name == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], 3 * size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return np.ascontiguousarray(rows[:, 1:]).tobytes()


class _Items(HTMLParser):
    """Items in document order. Text of scripts and styles is left out; white space is collapsed."""

    BREAKS = {"p", "div", "article", "section", "figure", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "th", "br", "hr", "blockquote", "pre", "nav", "header", "footer", "main"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.held, self.silent, self.figure, self.caption = [], [], 0, None, None

    def flush(self):
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        elif tag == "img":
            self.flush()
            a = dict(attrs)
            self.items.append({"kind": "media", "text": None, "digest": (a.get("src") or "").removeprefix("sha256:"), "caption": a.get("alt")})
            if self.figure is not None:
                self.figure.append(len(self.items) - 1)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in self.BREAKS:
            self.flush()
            if tag == "figure":
                self.figure = []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            if self.figure:
                for k in self.figure:
                    self.items[k]["caption"] = text
            else:
                self.held.append(text)
                self.flush()
        elif tag in self.BREAKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if not self.silent:
            (self.held if self.caption is None else self.caption).append(data)


def items_of(html: str | None) -> list[dict]:
    p = _Items()
    p.feed(html or "")
    p.close()
    if p.caption is not None:  # a caption that never ended
        p.held.extend(p.caption)
    p.flush()
    return p.items


def parse(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The other columns of pages and items, the sequence of its HTML."""
    kept = [c for c in pages.columns if c != html_col]

    def run(tables):
        for t in tables:
            found = pa.array([items_of(x.as_py()) for x in t.column(html_col)], pa.list_(ITEM_TYPE))
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in kept), found], [*kept, "items"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html_col)
    return pages.select(*kept, html_col).mapInArrow(run, f"{types}, items array<{ITEM}>")


def resolve(sequences: DataFrame, media: DataFrame, row: str) -> DataFrame:
    """sequences with items extended by the columns of media (one row for each digest), at their positions. row: a column that tells the rows apart.

    sequences must give equal rows when it is read twice: a table.
    """
    told = [c for c in media.columns if c != "digest"]
    items = sequences.select(row, F.posexplode("items").alias("at", "item"))
    fields = [f.name for f in sequences.schema["items"].dataType.elementType.fields]
    full = F.struct("at", *(F.col("item")[c].alias(c) for c in fields), *told)
    found = items.filter("item.digest is not null").join(media.withColumnRenamed("digest", "found"), F.col("item.digest") == F.col("found"), "left").select(row, full.alias("full"))
    types = {f.name: f.dataType for f in media.schema}
    texts = items.filter("item.digest is null").select("*", *(F.lit(None).cast(types[c]).alias(c) for c in told)).select(row, full.alias("full"))
    ordered = found.unionByName(texts).groupBy(row).agg(F.sort_array(F.collect_list("full")).alias("items"))
    none = F.array().cast(ordered.schema["items"].dataType)
    return sequences.drop("items").join(ordered, row, "left").withColumn("items", F.coalesce("items", none))


def padded_text(text: Column) -> Column:
    """The text's bytes with spaces up to a positive multiple of a row."""
    n = F.octet_length(text)
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(ROW), F.ceil(n / ROW).cast("int") * ROW) - n))


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, image) of the texts as media, written to the shared folder. Equal texts of a task's batch are stored once."""
    schema = pa.schema([("digest", pa.string()), ("image", pa.binary())])

    def run(tables):
        for t in tables:
            data, offsets = C.text_slices(pa.Table.from_batches([t]))
            seen, names, images, held = set(), [], [], 0
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                payload = padded(bytes(data[a:b]))
                digest = hashlib.sha256(payload).hexdigest()
                if digest in seen:
                    continue
                seen.add(digest)
                names.append(digest)
                images.append(encode(payload))
                held += len(images[-1])
                if held > (8 << 20):
                    yield pa.record_batch([pa.array(names), pa.array(images, pa.binary())], schema=schema)
                    names, images, held = [], [], 0
            if names:
                yield pa.record_batch([pa.array(names), pa.array(images, pa.binary())], schema=schema)

    return C.written(docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, "digest string, image binary"), "media", compression="none")


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, mean double, deviation double"


def features(media: DataFrame) -> DataFrame:
    """Reads the stored images back: digests of the payload and the image, and the mean and deviation of the samples."""
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def run(tables):
        for t in tables:
            rows = []
            for digest, image in zip(t.column("digest").to_pylist(), t.column("image"), strict=True):
                image = image.as_py()
                samples = decode(image)
                x = np.frombuffer(samples, np.uint8)
                rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(image), hashlib.sha256(image).hexdigest(), WIDTH, len(x) // ROW, float(x.mean()), float(x.std())))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([(n, pa.string() if k == "string" else pa.int64() if k == "long" else pa.int32() if k == "int" else pa.float64()) for n, k in (x.split() for x in FEATURES.split(", "))]))

    return media.mapInArrow(run, FEATURES).dropDuplicates(["digest"])


def as_html(text: Column) -> Column:
    """The whole text as an article: its lines as paragraphs, a figure with the text's bytes behind the first of them."""
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    figure = F.concat(F.lit('</p><figure><img src="sha256:'), F.sha2(padded_text(text), 256), F.lit('" alt="text"><figcaption>'), F.octet_length(text).cast("string"), F.lit(" bytes</figcaption></figure><p>"))
    lead = F.substring_index(escaped, "\n", 1)
    rest = F.replace(F.substring(escaped, F.length(lead) + 2, F.length(escaped)), F.lit("\n"), F.lit("</p><p>"))
    return F.concat(F.lit("<article><p>"), lead, figure, rest, F.lit("</p></article>"))


def interleaved(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as an interleaved document: all its lines, a media item with the text's bytes behind the first, and a caption; the media read back from storage.

    feature: items, their texts' bytes and a hash of all texts, kinds and positions in order, the place and caption of the media item, size, mean and deviation of the image.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    pages = docs.select(F.col(id_col).cast("long").alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), as_html(text).alias("html"))
    # what the result needs of the texts is taken before the join: they stay where they are
    placed = F.transform("items", lambda x, k: F.struct(k.alias("place"), x["kind"].alias("kind"), x["text"].alias("text"), x["digest"].alias("digest"), x["caption"].alias("caption")))
    text_bytes = F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.octet_length(x["text"]), F.lit(0)))
    parsed = parse(pages).select(id_col, "n_bytes", F.size("items").alias("n_items"), text_bytes.alias("text_bytes"), F.xxhash64("items").alias("sequence"), F.filter(placed, lambda x: x["kind"] == "media").alias("items"))
    sequences = C.written(parsed.withColumn("row", F.monotonically_increasing_id()), "sequences")
    # a table, so that the join's sides are both dealt for it and a hot digest can be split
    whole = resolve(sequences, C.written(features(store(docs, text_col)), "features"), "row")
    whole = whole.withColumn("m", F.col("items")[0]).withColumn("place", F.col("items")[0]["place"])
    feature = F.concat_ws(
        ";", F.concat(F.lit("items="), F.col("n_items")), F.concat(F.lit("text_bytes="), F.col("text_bytes")), F.concat(F.lit("sequence="), F.lower(F.hex("sequence"))), F.concat(F.lit("at="), F.col("place")), F.concat(F.lit("caption="), F.col("m.caption")),
        F.format_string("image=%dx%d", "m.width", "m.height"), F.format_string("mean=%.6f", "m.mean"), F.format_string("deviation=%.6f", "m.deviation"),
    )
    return whole.select(id_col, "n_bytes", *(f"m.{c}" for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")), feature.alias("feature"))
