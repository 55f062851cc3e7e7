"""WARC archives: a writer with revisit records and a salvage reader.

Each record is a gzip member of its own; an archive is a file of such members. The
reader checks each member (gzip check sum, record header, length, block digest). After
a failed check it searches for the next valid member or version line, goes on there and
reports the bytes between as a quarantined gap. Plain records are read as well.

A member may hold many records. Those that are whole are kept where others of it fail, and
where the member is truncated or damaged, as far as it decompresses; the gap has the byte
range of the member. Where decompressing fails or the member's check sum differs, its
records need a block digest of their own; their headers, like a plain record's, have no
further check. A record alone in such a member isn't kept: the member's check is its own.

Defined results: a null html is an empty payload. Of records with equal payloads of at
least ``min_bytes``, those with the smallest page_id are responses (repeated rows of
that id as well) and the others revisit it; a null id is a response only where no id of
its payload is known. A null url gives no target URI. Whole payloads are written, however
long; no rows give no records; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_raw_files, write_raw_files

#: An archive closes beyond so many bytes.
ARCHIVE_BYTES = 8 << 20
#: An empty member ends each archive; readers pass over it.
END_MEMBER = gzip.compress(b"", mtime=0)
# Fixed values of the WARC 1.1 format.
VERSION, REVISIT_PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_MAGIC = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r?\n")
_NEXT = re.compile(rb"\x1f\x8b\x08|(?:(?<=\n)|\A|(?<=\x00))WARC/\d+\.\d+\r?\n")
_NEXT_INSIDE = re.compile(rb"(?<=\n)WARC/\d+\.\d+\r?\n")
_HEADER_END = re.compile(rb"\r?\n\r?\n")
_NAME = "urn:page:"
TRUNCATED = "member is truncated"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{_NAME}{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{_NAME}{'' if refers_to is None else refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    return head + block + b"\r\n\r\n"


class Found(NamedTuple):
    """A record, or a gap where ``fields`` is None; byte range in the archive."""

    start: int
    end: int
    fields: dict[str, str] | None
    block: bytes
    reason: str


class DamageError(ValueError):
    pass


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """The content of the gzip member at ``at``, where it ends, and what is wrong with it; then, content and end are those of what decompresses."""
    unzip, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unzip.eof:
            if pos >= len(data):
                return b"".join(out), len(data), TRUNCATED
            out.append(unzip.decompress(data[pos : pos + 32768]))
            pos += 32768
    except zlib.error:
        # What the failing piece gives before its damage is lost with the error, so it is read again byte by byte.
        unzip = zlib.decompressobj(31)
        out = [unzip.decompress(data[k : k + 32768]) for k in range(at, pos, 32768)]
        try:
            while pos < len(data):
                out.append(unzip.decompress(data[pos : pos + 1]))
                pos += 1
        except zlib.error:
            pass
        return b"".join(out), pos, "member fails its check"
    return b"".join(out), min(pos, len(data)) - len(unzip.unused_data), ""


def _record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header, block and end of the record at ``at``, all checks passed."""
    line = _VERSION_LINE.match(data, at)
    if not line:
        raise DamageError("no version line")
    end = _HEADER_END.search(data, line.end() - 2)
    if not end:
        raise DamageError("header is truncated")
    fields: dict[str, str] = {}
    try:
        for row in data[line.end() : end.start()].decode().splitlines():
            name, colon, value = row.partition(":")
            if not colon:
                raise DamageError("header line without a colon")
            fields[name.strip().lower()] = value.strip()
        n = int(fields["content-length"])
    except (KeyError, ValueError):
        raise DamageError("header is unreadable") from None
    if "warc-record-id" not in fields or "warc-type" not in fields:
        raise DamageError("header lacks a mandatory field")
    block, after = data[end.end() : end.end() + n], end.end() + n
    if n < 0 or len(block) < n:
        raise DamageError("block is truncated")
    want = fields.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != digest(block):
        raise DamageError("block digest differs")
    if data[after : after + 4] == b"\r\n\r\n":
        return fields, block, after + 4
    raise DamageError("record isn't closed")


def _inside(content: bytes, wrong: str) -> Iterator[tuple[dict[str, str] | None, bytes, str]]:
    """Fields, block and reason of each record and gap in a member's content; a gap has no fields."""
    pos, gap, reason = 0, None, ""
    while pos < len(content):
        try:
            fields, block, end = _record(content, pos)
            if wrong and pos == 0 and end == len(content):
                raise DamageError(wrong)
            if wrong and wrong != TRUNCATED and not fields.get("warc-block-digest", "").startswith("sha1:"):
                raise DamageError("record of a damaged member without a digest")
        except DamageError as e:
            if gap is None:
                gap, reason = pos, str(e)
            nxt = _NEXT_INSIDE.search(content, pos + 1)
            pos = nxt.start() if nxt else len(content)
            continue
        if gap is not None:
            yield None, b"", f"{reason} (bytes {gap} to {pos} of the member's content)"
            gap = None
        yield fields, block, ""
        pos = end
    if gap is not None:
        yield None, b"", f"{reason} (bytes {gap} to {pos} of the member's content)"


def salvage(data: bytes) -> Iterator[Found]:
    """Records and gaps in their order; together they cover the archive, but for empty members.

    Records kept of a damaged member follow the gap that it is in and have its range.
    """
    at, gap, reason, kept, read = 0, None, "", [], 0
    while at < len(data):
        try:
            if data[at : at + 3] == GZIP_MAGIC:
                content, end, wrong = _member(data, at)
                if wrong:
                    whole = [(fields, block) for fields, block, _ in _inside(content, wrong) if fields is not None]
                    kept += whole
                    read = max(read, end) if whole else read
                    raise DamageError(wrong)
                found = [Found(at, end, *f) for f in _inside(content, wrong)]
            else:
                fields, block, end = _record(data, at)
                found = [Found(at, end, fields, block, "")]
        except DamageError as e:
            if gap is None:
                gap, reason = at, str(e)
            nxt = _NEXT.search(data, at + 1)
            # Version lines in a member's stored blocks are those of records seen in its content.
            while nxt and nxt.start() < read and not nxt[0].startswith(GZIP_MAGIC):
                nxt = _NEXT.search(data, nxt.start() + 1)
            at = nxt.start() if nxt else len(data)
            continue
        if gap is not None:
            yield Found(gap, at, None, b"", reason)
            yield from (Found(gap, at, fields, block, "") for fields, block in kept)
            gap, kept = None, []
        yield from found
        at = end
    if gap is not None:
        yield Found(gap, len(data), None, b"", reason)
        yield from (Found(gap, len(data), fields, block, "") for fields, block in kept)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record for each row, in archives under ``path``.

    The smallest id of each payload comes from a map-side combined aggregate and is
    joined back by the payload's hash: a payload with very many copies is a skewed join
    key, which adaptive execution splits.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("key", F.sha2("html", 256))
    first = rows.groupBy("key").agg(F.min("page_id").alias("first"))
    known = rows.join(first, "key", "left")
    revisit = (F.octet_length("html") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    known = known.select("page_id", "url", "html", "first", revisit.alias("revisit"))
    # Few pages shouldn't become very many small archives: a task for each full archive, or one for each core.
    total = rows.agg(F.sum(F.octet_length("html")).alias("n")).first().n or 0
    known = known.coalesce(max(pages.sparkSession.sparkContext.defaultParallelism, total // ARCHIVE_BYTES + 1))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, firsts, revisits = (batch.column(k).to_pylist() for k in (0, 3, 4))
            for page_id, url, html, first, again in zip(ids, batch.column(1), batch.column(2), firsts, revisits, strict=True):
                held.append(gzip.compress(record(page_id, url.as_py(), html.as_py().encode(), first, again, date), 1, mtime=0))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pydict({"blob": [b"".join(held)]})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"blob": [b"".join(held)]})

    write_raw_files(known.mapInArrow(write, "blob binary"), path, END_MEMBER)


SCHEMA = "file string, start long, end long, reason string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def read_archives(spark: SparkSession, path: str, keep_html: bool = False) -> DataFrame:
    """One row for each record, and one with ``reason`` set for each quarantined gap.

    ``payload_bytes`` of a revisit is what its HTTP header states; a response's payload
    is measured and its digest computed anew. A record whose HTTP header or payload
    digest doesn't hold becomes a gap as well.
    """
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def number(name: str) -> int | None:
        value = name.strip("<>").removeprefix(_NAME)
        return int(value) if re.fullmatch(r"-?\d+", value) else None

    def row(file: str, f: Found) -> tuple:
        if f.fields is None:
            return (file, f.start, f.end, f.reason, *[None] * 7)
        http, blank, payload = f.block.partition(b"\r\n\r\n")
        kind, stated = f.fields.get("warc-type"), f.fields.get("warc-payload-digest", "").removeprefix("sha1:")
        length = re.search(rb"(?mi)^content-length:\s*(\d+)", http)
        if not blank or kind == "revisit" and not length or kind == "response" and stated and stated != digest(payload):
            return (file, f.start, f.end, "payload fails its check", *[None] * 7)
        size = len(payload) if kind == "response" else int(length[1]) if length else None
        refers = number(f.fields["warc-refers-to"]) if "warc-refers-to" in f.fields else None
        return (file, f.start, f.end, None, number(f.fields.get("warc-record-id", "")), f.fields.get("warc-target-uri"), size, stated or digest(payload), kind, refers, payload.decode("utf-8", "replace") if keep_html and kind == "response" else None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held: list[tuple] = []
                size = 0
                for found in salvage(content.as_py()):
                    held.append(row(file, found))
                    size += len(held[-1][-1] or "")
                    if len(held) >= 4096 or size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return read_raw_files(spark, path).mapInArrow(read, SCHEMA)
