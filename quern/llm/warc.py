"""WARC files: a deduplicating writer and a salvage reader.

``write`` turns each row into a ``response`` record, or into a ``revisit`` of
the record with the same payload and the smallest key. Files go through Spark's
text sink, whose line separator is the blank line that ends a WARC record (or,
compressed, an empty gzip member), so they are committed like any other Spark
output, on whatever file system the path names.

``read`` checks each record: version line, header lines, content length, the
blank line after the block, block digest, and in compressed files the member's
own check. After a failed check it searches for the next valid member or
version line, goes on there, and logs the bytes between as a gap. A version
line inside a skipped stretch counts only if its record passes all checks.

Defined results: a null payload is empty; a null key is written as ``null`` and
read back as null, and is never the record that others refer to; payloads under
``LEAST_REVISIT`` bytes are always responses; of rows that share the smallest
key and the payload each is a response; an empty table gives no record. Columns
besides key, URL and payload are left out. A file to be read must fit Spark's
binary source, 2 GB; its records are taken one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import fresh_path, materialize, read_table, ship

LEAST_REVISIT = 100
#: Bytes of payload that a file holds at most, but for one larger payload alone: a file is brought into memory whole.
FILE_BYTES = 64_000_000
#: Rows are written by the size of their payload; up to each of these sizes, so many of them fill a file.
SIZES = (16_384, 524_288, 16_000_000)
#: Payload that the reader passes on at a time.
BATCH_BYTES = 16_000_000
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip member without content.
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
_MEMBER = b"\x1f\x8b\x08"
#: A header line that starts with white space goes on from the one before.
_FOLD = re.compile(rb"\r\n[ \t]+")


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


def digest_fits(declared: str, content: bytes) -> bool | None:
    """Whether a labelled digest (sha1 or sha256, in hex or base32) is the content's; None where the label is unknown or absent."""
    label, _, value = declared.partition(":")
    if label.lower() not in ("sha1", "sha256"):
        return None
    own = hashlib.new(label.lower(), content).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def parse_record(data: bytes, at: int) -> tuple[Record | None, int, str]:
    """The record at ``at``; where it ends; else why there is none."""
    if not (m := _VERSION.match(data, at)):
        return None, at, "no version line"
    ends = data.find(b"\r\n\r\n", m.end())
    if ends < 0:
        return None, at, "unfinished header"
    headers: dict[str, str] = {}
    for line in _FOLD.sub(b" ", data[m.end() : ends]).split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "bad header line"
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not re.fullmatch(r"\d{1,18}", length := headers.get("content-length", "")):
        return None, at, "bad content length"
    begin, end = ends + 4, ends + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "no blank line after the block"
    block = data[begin:end]
    if digest_fits(headers.get("warc-block-digest", ""), block) is False:
        return None, at, "block digest differs"
    return Record(at, end + 4 - at, headers, block), end + 4, ""


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Every record that passes its checks, and the stretches of bytes that belong to none, in order and one at a time."""
    packed = data[:2] == _MEMBER[:2] or (not _VERSION.search(data, 0, 1 << 20) and _MEMBER in data and not _VERSION.search(data))
    return _members(data) if packed else _plain(data)


def _plain(data: bytes) -> Iterator[Record | Gap]:
    at, lost, reason = 0, -1, ""
    while at < len(data):
        record, end, why = parse_record(data, at)
        if record:
            if lost >= 0:
                yield Gap(lost, at - lost, reason)
                lost = -1
            yield record
            at = end
        else:
            if lost < 0:
                lost, reason = at, why
            found = _VERSION.search(data, at + 1)
            at = found.start() if found else len(data)
    if lost >= 0:
        yield Gap(lost, len(data) - lost, reason)


def _inflate(data: bytes, at: int) -> tuple[bytes | None, int]:
    """The content of the gzip member at ``at`` and where it ends; None if it fails its check."""
    if data[at : at + 3] != _MEMBER:
        return None, at
    inflate, out, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        while not inflate.eof and at < len(data):
            out.append(inflate.decompress(view[at : at + 65536]))
            at += min(65536, len(data) - at)
    except zlib.error:
        return None, at
    return (b"".join(out), at - len(inflate.unused_data)) if inflate.eof else (None, at)


def _members(data: bytes) -> Iterator[Record | Gap]:
    at, lost, reason = 0, -1, ""
    while at < len(data):
        text, end = _inflate(data, at)
        if text is not None:
            if lost >= 0:
                yield Gap(lost, at - lost, reason)
                lost = -1
            for found in _plain(text):
                yield Record(at, end - at, found.headers, found.block) if isinstance(found, Record) else Gap(at, end - at, f"in a member: {found.reason}")
            at = end
        else:
            if lost < 0:
                lost, reason = at, "bad gzip member"
            at = data.find(_MEMBER, at + 1)
            at = len(data) if at < 0 else at
    if lost >= 0:
        yield Gap(lost, len(data) - lost, reason)


def _text(column: Column) -> Column:
    """A header value: on one line."""
    return F.regexp_replace(F.coalesce(column.cast("string"), F.lit("null")), "[\r\n]+", " ")


def with_origins(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``df`` with digest, payload_bytes and refers_to, the smallest key with the same payload where that is another.

    A digest with one row only needs no join. The table of repeated digests is
    written first, so Spark knows its size and can split a digest that many rows share.
    """
    sized = df.withColumns({"_digest": F.sha2(F.coalesce(F.col(payload), F.lit("")), 256), "_bytes": F.coalesce(F.octet_length(payload), F.lit(0)).cast("long")})
    first = sized.where((F.col("_bytes") >= LEAST_REVISIT)).groupBy("_digest").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = materialize(first.where("_n > 1 and _first is not null").select("_digest", "_first"), "warc-origins")
    joined = sized.join(first, "_digest", "left")
    other = F.col("_first").isNotNull() & ~F.col(key).eqNullSafe(F.col("_first"))
    return joined.withColumn("_refers", F.when(other, F.col("_first"))).drop("_first")


def record_text(key: str, url: str, payload: str) -> Column:
    """A record without the blank line that ends it, from the columns of ``with_origins``."""
    revisit = F.col("_refers").isNotNull()
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col(payload), F.lit(""))))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:record:"), _text(F.col(key)), F.lit(">"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:record:"), F.col("_refers").cast("string"), F.lit(f">\r\nWARC-Profile: {PROFILE}"))).otherwise(F.lit("")),
        F.lit("\r\nWARC-Target-URI: "), _text(F.col(url)),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha256:"), F.col("_digest"),
        F.lit("\r\nWARC-Payload-Length: "), F.col("_bytes").cast("string"),
        F.lit("\r\nWARC-Block-Digest: sha256:"), F.sha2(block, 256),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"), block,
    )


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.append(deflate.compress(text.encode() + b"\r\n\r\n") + deflate.flush())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", compress: bool = False) -> None:
    """Write a WARC record per row to files in ``path``; with ``compress`` a gzip member each."""
    ship(df.sparkSession)
    df = df.select(*dict.fromkeys([key, url, payload]))
    rows = with_origins(df, key, payload)
    largest = df.agg(F.max(F.octet_length(payload))).first()[0] or 0
    low, mode = -1, "overwrite"
    for top in (*SIZES, None):
        own = rows.where((F.col("_bytes") > low) & (F.col("_bytes") <= top if top else F.lit(True)))
        if mode == "overwrite" or low < largest:
            _write_files(own.select(record_text(key, url, payload).alias("value")), path, mode, max(1, FILE_BYTES // top) if top else 1, compress)
        low, mode = top, "append"


def _write_files(records: DataFrame, path: str, mode: str, each: int, compress: bool) -> None:
    writer = lambda rows, **options: rows.write.mode(mode).options(maxRecordsPerFile=each, **options).text(path)
    if compress:
        members = records.mapInArrow(_squeeze, "member binary").select(F.col("member").cast("string").alias("value"))
        writer(members, lineSep=EMPTY_MEMBER.decode("latin-1"), encoding="ISO-8859-1")
    else:
        writer(records, lineSep="\r\n\r\n")


_SCHEMA = "path string, offset long, length long, kind string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary, problem string"


def _split(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


def _row(path: str, found: Record | Gap, with_payload: bool) -> dict:
    if isinstance(found, Gap):
        return {"path": path, "offset": found.offset, "length": found.length, "kind": "gap", "problem": found.reason}
    name = lambda x: x[12:-1] if x and x.startswith("<urn:record:") else x
    h, payload = found.headers, _split(found.block)
    whole, declared, told = h.get("warc-type") != "revisit", h.get("warc-payload-digest", ""), h.get("warc-payload-length", "")
    return {
        "path": path, "offset": found.offset, "length": found.length, "kind": h.get("warc-type"), "record_id": name(h.get("warc-record-id")), "refers_to": name(h.get("warc-refers-to")),
        "target_uri": h.get("warc-target-uri"), "payload_bytes": len(payload) if whole else int(told) if told.isdigit() else None,
        "payload_digest": hashlib.sha256(payload).hexdigest() if whole else declared.removeprefix("sha256:"), "payload": payload if with_payload else None,
        "problem": "payload digest differs" if whole and digest_fits(declared, payload) is False else None,
    }


def _read(with_payload: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.binary() if k == "binary" else pa.int64() if k == "long" else pa.string()) for n, k in (x.split() for x in _SCHEMA.split(", "))])
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows, held = [], 0
            for found in salvage(content.as_py() or b""):
                rows.append(_row(path, found, with_payload))
                held += len(rows[-1].get("payload") or b"")
                if len(rows) >= 1000 or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record, and one per quarantined gap (kind ``gap``: its offset, length and problem)."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(partial(_read, with_payload), _SCHEMA)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write(read_table(spark, sf_dir, "pages"), path)
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    records = read(spark, path, with_payload=False).where("kind <> 'gap'")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), number("refers_to").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
