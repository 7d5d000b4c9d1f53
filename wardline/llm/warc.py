"""WARC archives: a writer, and a reader that salvages what it can from damaged files.

The reader checks every record (gzip checksum, header, lengths, payload digest). After a failed check it searches
for the next gzip member or version line from which a record can be read, goes on there, and reports the
bytes in between as a quarantined gap. Members of several records are searched in the same way once inflated, also as
far as a broken one could be inflated. Archives are rows of ``path`` and ``content``, the columns of Spark's
``binaryFile`` source, so files on any store that Spark reads can be salvaged the same way.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from wardline.llm.texts import named

# Fixed values of the format.
VERSION = b"WARC/1.1"
GZIP_MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "urn:x-page:"

ARCHIVE_BYTES = 4 << 20
_START = re.compile(rb"\x1f\x8b\x08|(?:(?<=\n)|(?<![\s\S]))WARC/1\.")
_INNER_START = re.compile(rb"(?<=\n)WARC/1\.")
_VERSION_LINE = re.compile(rb"WARC/1\.\d+\r\n")
_CHUNK = 1 << 16
_UNSAFE = re.compile(r"[\x00-\x20\x7f<>]")

ARCHIVES = StructType([StructField("path", StringType()), StructField("content", BinaryType())])
FOUND = StructType([
    StructField("kind", StringType()), StructField("path", StringType()), StructField("offset", LongType()),
    StructField("length", LongType()), StructField("reason", StringType()), StructField("record_type", StringType()),
    StructField("record_id", StringType()), StructField("refers_to", StringType()), StructField("url", StringType()),
    StructField("payload_bytes", LongType()), StructField("payload_digest", StringType()), StructField("payload", BinaryType()), StructField("verified", BooleanType()),
])


class Damaged(ValueError):
    """A record that fails a check; the message is the reason in the log."""


def record_bytes(record_type: str, record_id: str, url: str | None, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    """One record as its own gzip member. A revisit has no block; its length and digest describe the full payload."""
    head = [("WARC-Type", record_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size))]
    if record_type == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
        block = b""
    else:
        head.append(("Content-Type", "application/http;msgtype=response"))
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    packer = zlib.compressobj(1, wbits=31)
    return packer.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def _member(content: memoryview, start: int) -> tuple[bytes, int, str | None]:
    """The data of the gzip member at ``start``, where it ends, and what is wrong with it; what precedes an error is kept."""
    reader, parts, at = zlib.decompressobj(31), [], start
    while not reader.eof and at < len(content):
        chunk, before = content[at : at + _CHUNK], reader.copy()
        try:
            parts.append(reader.decompress(chunk))
        except zlib.error:
            try:
                for i in range(len(chunk)):
                    parts.append(before.decompress(chunk[i : i + 1]))
            except zlib.error:
                pass
            return b"".join(parts), len(content), "gzip member broken"
        at += len(chunk)
    return b"".join(parts), at - len(reader.unused_data), None if reader.eof else "gzip member cut short"


def _differs(digest: str, payload: bytes) -> bool | None:
    """Whether a declared digest is not that of the payload; None if it is of an unknown kind."""
    kind, _, value = digest.partition(":")
    if kind.lower() not in ("sha1", "sha256"):
        return None
    actual = hashlib.new(kind.lower(), payload)
    return value.lower() != actual.hexdigest() and value.upper().rstrip("=") != base64.b32encode(actual.digest()).decode().rstrip("=")


def _record(data: bytes, start: int) -> tuple[dict, int, bool]:
    """The record at ``start``, where it ends, and whether its payload has been checked by a digest."""
    line = _VERSION_LINE.match(data, start)
    if not line:
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", start)
    if stop < 0:
        raise Damaged("header without end")
    head = {}
    for row in data[line.end() : stop].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            raise Damaged("header line without a name")
        head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    try:
        length = int(head[b"content-length"])
    except (KeyError, ValueError) as e:
        raise Damaged("no content length") from e
    begin, end = stop + 4, stop + 4 + length
    if length < 0 or data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("length does not lead to the record's end")
    kind = head.get(b"warc-type", "")
    payload, checked = None, False
    digest = head.get(b"warc-payload-digest", "").removeprefix("sha256:") or None
    if kind == "response":
        block = data[begin:end]
        _, found, payload = block.partition(b"\r\n\r\n")
        if not found:
            payload = block
        actual = hashlib.sha256(payload).hexdigest()
        differs = _differs(head.get(b"warc-payload-digest", ""), payload)
        if differs:
            raise Damaged("payload digest differs")
        checked = differs is False
        digest = actual
    size = head.get(b"x-payload-length", "")
    return {
        "record_type": kind, "record_id": head.get(b"warc-record-id", "").strip("<>") or None,
        "refers_to": head.get(b"warc-refers-to", "").strip("<>") or None, "url": head.get(b"warc-target-uri"),
        "payload_bytes": len(payload) if payload is not None else int(size) if size.isdigit() else None,
        "payload_digest": digest, "payload": payload,
    }, end + 4, checked


def _inner(data: bytes, member: int, broken: bool) -> Iterator[tuple[str, int, int, str | None, dict]]:
    """Records and gaps of an inflated member, at offsets inside it; whole records of a broken one are ``verified`` only by a digest."""
    at, gap, reason = 0, None, None
    while at < len(data):
        try:
            record, end, checked = _record(data, at)
            record["verified"] = checked or not broken
        except Damaged as e:
            if gap is None:
                gap, reason = at, f"{e} (offset inside the member at {member})"
            following = _INNER_START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at - gap, reason, {}
            gap = None
        yield "record", at, end - at, None, record
        at = end
    if gap is not None:
        yield "gap", gap, len(data) - gap, reason, {}


def salvage(data: bytes) -> Iterator[tuple[str, int, int, str | None, dict]]:
    """(``record`` or ``gap``, offset, length, reason, fields) for all bytes of an archive, in order.

    Whole records without a digest in a member that fails its checksum come with ``verified`` false: damage that left their
    header and lengths intact cannot be told. Records of a member have its offset and length; gaps inside one have offsets in the inflated data and say so. The
    bytes of a member that is broken or cut short are a gap as well, whatever its beginning still gives.
    """
    content, at, gap, reason = memoryview(data), 0, None, None
    while at < len(data):
        found, end, wrong = [], at, None
        try:
            if data[at : at + 3] != GZIP_MAGIC:
                record, end, _ = _record(data, at)
                record["verified"] = True
                found = [("record", at, end - at, None, record)]
            else:
                inner, end, wrong = _member(content, at)
                found = list(_inner(inner, at, wrong == "gzip member broken"))
                if not any(kind == "record" for kind, *_ in found):
                    raise Damaged(wrong or (found[0][3].partition(" (offset")[0] if found else "empty gzip member"))
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at - gap, reason, {}
            gap = None
        if wrong:  # its end is not known, so the search goes on behind its start
            following = _START.search(data, at + 1)
            end, gap, reason = following.start() if following else len(data), at, wrong
        for kind, offset, length, why, fields in found:
            yield kind, at if kind == "record" else offset, end - at if kind == "record" else length, why, fields
        at = end
    if gap is not None:
        yield "gap", gap, len(data) - gap, reason, {}


def mark_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (UTF-8, null: empty), its size and digest, ``record_type``, ``first_page``.

    Equal payloads of at least ``least`` bytes revisit the smallest page_id among them. Only digests seen
    twice or more reach the join, after a map-side count, and a hot digest is a skewed join that is split.
    Rows that repeat the smallest id, and groups without any id, are all responses.
    """
    rows = pages.select(named(pages, page_id).alias("page_id"), named(pages, url).alias("url"), F.encode(F.coalesce(named(pages, html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    firsts = (
        rows.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("digest"))
        .agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    )
    joined = rows.join(firsts, F.col("payload_digest") == F.col("digest"), "left").drop("digest")
    again = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    return joined.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "first_page": F.when(again, F.col("first_page"))})


def write_archives(marked: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of about ``archive_bytes`` as rows of ``path`` and ``content``; a longer record has one of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, members, size = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{number:06d}.warc.gz"]), pa.array([b"".join(members)], pa.binary())], ["path", "content"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                name = PAGE_URN + ("" if row["page_id"] is None else str(row["page_id"]))
                member = record_bytes(row["record_type"], name, row["url"], row["payload"], row["payload_bytes"], row["payload_digest"], f"{PAGE_URN}{row['first_page']}")
                if members and size + len(member) > archive_bytes:
                    yield archive()
                    number, members, size = number + 1, [], 0
                members.append(member)
                size += len(member)
        if members:
            yield archive()

    return marked.mapInArrow(run, ARCHIVES)


def read_archives(archives: DataFrame) -> DataFrame:
    """Records and gaps of ``archives`` (``path``, ``content``), told apart by ``kind``.

    Null and empty contents give no rows. Records keep their payload; a gap has its offset, length and reason.
    Other columns of ``archives`` are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary(), pa.bool_()]
        schema = pa.schema(list(zip(FOUND.names, types, strict=True)))
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = [
                    {"kind": kind, "path": path.as_py(), "offset": offset, "length": length, "reason": reason, **fields}
                    for kind, offset, length, reason, fields in salvage(content.as_py() or b"")
                ]
                for start in range(0, len(rows), 1_000):
                    yield pa.RecordBatch.from_pylist(rows[start : start + 1_000], schema=schema)

    return archives.select("path", "content").mapInArrow(run, FOUND)


def page_records(found: DataFrame) -> DataFrame:
    """Page records with ids as numbers; digests and sizes are those the reader has verified (``verified``) or read."""
    number = lambda c: F.regexp_extract(c, rf"^{PAGE_URN}(-?\d+)$", 1).try_cast("long")
    return found.where("kind = 'record' AND record_type IN ('response', 'revisit')").select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number(F.col("refers_to")).alias("refers_to"), "url", "payload", "verified",
    )
