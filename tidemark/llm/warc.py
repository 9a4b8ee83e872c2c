"""WARC archives in Zstandard: a writer, and a reader that validates what it decodes.

An archive is a skippable frame with the compression dictionary, then one frame for each record, so a
record can be read on its own. Archives are rows (archive, content) of a table; a directory of
``.warc.zst`` files read by Spark's ``binaryFile`` source has the same shape.

The reader checks the dictionary frame, that a frame holds exactly one record, the version line, the headers a
record must have, Content-Length against the block, the record's end, the HTTP Content-Length and the
payload digest. What fails gets a row with ``error`` and doesn't stop the rest of the archive where the
frame's end is known.

Cases: a null payload is empty; a null url becomes a urn of the record; line ends in a url are
percent-encoded; null ids are kept; rows with equal ids and payloads count as one record of that id, each keeps
its row; of equal payloads with one largest id every row of that id is a response; a very long payload is one record, held whole by one task; other columns,
whatever their names, are ignored; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Fixed values of the formats: magic numbers of the dictionary's skippable frame, of other skippable frames and of a data frame; the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")

#: Payload bytes of an archive, of the sample that its dictionary is made from, and of the dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 16 << 20, 256 << 10, 16 << 10
#: The upper half of record ids; the lower half is the page's id.
ID_SPACE = 0x7469646500008000
STEP = 1 << 16


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(ID_SPACE << 64) | (page_id & C.M64))}>"


def page_of(rid: str | None) -> int | None:
    if not rid:
        return None
    low = uuid.UUID(rid.strip("<>").removeprefix("urn:uuid:")).int & C.M64
    return low - (1 << 64) if low >> 63 else low


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record without the payload if refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"] if refers_to is not None else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The records as frames behind their dictionary; without a dictionary if the sample is too poor for one."""
    zstd = C._zstd()
    sample, size = [], 0
    for r in records:
        sample.append(r[: STEP])
        size += len(sample[-1])
        if size >= SAMPLE_BYTES:
            break
    try:
        trained = zstd.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8) if len(sample) >= 8 else None
    except zstd.ZstdError:
        trained = None
    out = []
    if trained:
        body = trained.as_bytes()
        out.append(struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body)
    z = zstd.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
    return b"".join(out + [z.compress(r) for r in records])


def write(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", hot: int = C.HOT_ROWS) -> DataFrame:
    """(archive, content): a record for each row. Of equal payloads of at least min_bytes, that with the largest id is a response and the others revisit it.

    A payload that more than hot rows have (an empty page, an error page) finds its response in shares.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(C.NULL_ID)).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.select("id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")).filter(F.col("n") >= min_bytes)
    found = keyed.groupBy("digest", "n").agg(F.max("id").alias("latest"), F.min("id").alias("first"), F.count("*").alias("freq")).filter("first < latest")
    latest = C.written(found.drop("first"), "latest")
    revisits = C.joined_in_shares(keyed, latest, ["digest", "n"], "freq", ["id"], hot).filter("id < latest").select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), "latest").distinct()
    told = rows.withColumn("digest", F.sha1("payload")).join(revisits, (F.col("id") == F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left").select("id", "url", "payload", "latest")
    schema = pa.schema([("archive", pa.string()), ("content", pa.binary())])

    def pack(tables):
        held, size = [], 0

        def flush():
            content = archive(held)
            return pa.record_batch([pa.array([hashlib.sha256(content).hexdigest() + ".warc.zst"]), pa.array([content], pa.binary())], schema=schema)

        for t in tables:
            for i, url, body, refers in zip(*(t.column(c) for c in ("id", "url", "payload", "latest")), strict=True):
                held.append(record(i.as_py(), url.as_py(), body.as_py(), refers.as_py(), date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return told.mapInArrow(pack, "archive string, content binary")


def frames(content: bytes):
    """(bytes, error) of each data frame. The dictionary comes from the leading skippable frame."""
    zstd = C._zstd()
    view, at, dictionary = memoryview(content), 0, None
    while at < len(view):
        if at + 4 > len(view):
            yield None, "trailing bytes"
            return
        magic = struct.unpack_from("<I", view, at)[0]
        if magic in SKIPPABLE_MAGIC:
            size = struct.unpack_from("<I", view, at + 4)[0] if at + 8 <= len(view) else len(view)
            if at + 8 + size > len(view):
                yield None, "skippable frame longer than the archive"
                return
            if magic == DICTIONARY_MAGIC and at == 0:
                body = bytes(view[8 : 8 + size])
                if body[:4] == struct.pack("<I", FRAME_MAGIC):
                    body = zstd.ZstdDecompressor().decompress(body)
                dictionary = zstd.ZstdCompressionDict(body, dict_type=zstd.DICT_TYPE_FULLDICT)
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            yield None, "not a frame"
            return
        d = zstd.ZstdDecompressor(dict_data=dictionary).decompressobj()
        out = []
        try:
            while not d.eof and at < len(view):
                out.append(d.decompress(view[at : at + STEP]))
                at = min(at + STEP, len(view)) - len(d.unused_data)
        except zstd.ZstdError as e:
            yield None, f"frame: {e}"
            return
        if not d.eof:
            yield None, "frame cut off"
            return
        yield b"".join(out), None


def parse(raw: bytes) -> dict:
    """A record's fields; error says what is wrong with it."""
    out = dict.fromkeys(("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload", "error"))
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        return out | {"error": "no version line"}
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return out | {"error": "bad header line"}
        fields[name.strip().lower()] = value.strip()
    if lacking := [n for n in NEEDED if n not in fields]:
        return out | {"error": f"no {lacking[0]}"}
    out |= {"record_type": fields["warc-type"], "record_id": fields["warc-record-id"], "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to")}
    length = fields["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4:
        return out | {"error": "Content-Length differs from the block"}
    if rest[-4:] != b"\r\n\r\n":
        return out | {"error": "no end of record"}
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        return out | {"error": "no HTTP header"}
    told = next((v.strip() for n, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if n.lower() == b"content-length"), b"")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    out |= {"payload_digest": digest, "payload_bytes": int(told) if told.isdigit() else None, "payload": payload}
    if out["payload_bytes"] is None:
        return out | {"error": "no HTTP Content-Length"}
    if out["record_type"] == "response":
        if out["payload_bytes"] != len(payload):
            return out | {"error": "HTTP Content-Length differs from the payload"}
        if digest != base32_sha1(payload):
            return out | {"error": "payload digest differs"}
    elif out["record_type"] == "revisit" and (payload or not out["refers_to"]):
        return out | {"error": "revisit with a payload or without a record to refer to"}
    return out


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of archives, a table of (archive or path, content)."""
    name = "path" if "path" in archives.columns else "archive"
    kinds = {"record_type": pa.string(), "record_id": pa.string(), "target_uri": pa.string(), "refers_to": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "error": pa.string()}
    if with_payload:
        kinds["payload"] = pa.binary()
    schema = pa.schema([("archive", pa.string()), *kinds.items()])

    def unpack(tables):
        for t in tables:
            for place, content in zip(t.column(0), t.column(1), strict=True):
                rows, size = [], 0
                for raw, error in frames(content.as_py()):
                    row = parse(raw) if raw is not None else {"error": error}
                    rows.append({k: row.get(k) for k in kinds} | {"archive": place.as_py()})
                    size += len(raw or b"")
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    types = ", ".join(f"{k} {'long' if v == pa.int64() else 'binary' if v == pa.binary() else 'string'}" for k, v in kinds.items())
    return archives.select(name, "content").mapInArrow(unpack, f"archive string, {types}")


def round_trip(pages: DataFrame, min_bytes: int = 0, hot: int = C.HOT_ROWS) -> DataFrame:
    """Writes the archives to the shared folder, reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to. A damaged record stops the query."""
    kept = C.written(write(pages, min_bytes, hot=hot), "archives")
    found = read(kept, with_payload=False)
    schema = pa.schema([("id", pa.int64()), ("refers", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string())])

    def identify(tables):
        for t in tables:
            bad = [e for e in t.column("error").to_pylist() if e]
            if bad:
                raise ValueError(f"damaged record: {bad[0]}")
            yield pa.record_batch([pa.array([page_of(x) for x in t.column(c).to_pylist()], pa.int64()) for c in ("record_id", "refers_to")] + [t.column(c) for c in ("payload_bytes", "payload_digest", "record_type")], schema=schema)

    rows = found.mapInArrow(identify, "id long, refers long, payload_bytes long, payload_digest string, record_type string")
    return rows.select(C.null_id("id", "page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS x FROM pages),
l AS (SELECT body, max(page_id) AS latest FROM p GROUP BY body),
b AS (SELECT DISTINCT x, [CAST('0x' || substr(x, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT) for i in range(8)] AS parts FROM p),
d AS (SELECT x, list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((parts[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1) for i in range(32)], 'string_agg', '') AS digest FROM b)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM latest AND latest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM latest THEN latest END AS refers_to
FROM p JOIN l USING (body) JOIN d USING (x)
"""
