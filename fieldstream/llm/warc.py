"""WARC archives of pages: a writer with revisit records and a salvage reader.

Writing: the payload of a page is its text in UTF-8. Of pages with equal payloads
of at least `min_revisit_bytes`, that with the smallest id becomes a response
record and the others revisit records (WARC 1.1, identical payload digest).
Groups are found from (digest, id) pairs with map-side aggregation. The few groups
that hold more than 1/HOT_GROUPS of all pages are sent to all tasks, so that their
rows need no common task; the others are joined back by digest. Each record is a
gzip member of its own; Spark's text writer puts bundles of members into files in
the shared folder, separated by an empty member, so that a lost executor's task is
simply written again. A file has about FILE_BYTES and at most one record more.

Reading: each file is walked member by member (or, if it is not compressed,
record by record). A record counts when its headers, its length and its payload
digest hold. After a failed check the reader searches on for the next version line
within a member, of which all that can be unpacked is searched even if it is cut or
its check sum fails, and for the next gzip member or version line in the file from
which a record passes all checks. It goes on from there, and logs the bytes in
between as a quarantined gap: a range of the file, and of the unpacked member where
the gap lies within one.

Defined results: a null payload counts as empty; smaller payloads are always
responses; rows without id are written like others and only stand for a group if
no row of it has an id; of repeated rows with the smallest id all are responses;
a null address becomes the record's own name; an empty table writes no records.
"""

from __future__ import annotations

import contextlib
import re
import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled

#: Payloads below this size are never revisited.
MIN_REVISIT_BYTES = 100
#: Payloads shared by more than this part of all pages are hot; there are no more of them than this.
HOT_GROUPS = 4096
#: Bytes of a bundle of members, and bundles of a file; files are read whole.
BUNDLE_BYTES, FILE_BUNDLES = 4 << 20, 16

READ_SCHEMA = "kind string, file string, start long, stop long, inner_start long, inner_stop long, reason string, page_id long, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to long"

_EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_MEMBER, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_UNSAFE = re.compile(rb"[^\x21-\x7e]")


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _named(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, not compressed."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    target = _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], (url or f"urn:page:{page_id}").encode()).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """data as a gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record per row of pages to archives below path."""
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    groups = settled(rows.where(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"))
    hot = F.col("n") * HOT_GROUPS > pages.count()
    few = groups.where(hot).select("digest", F.col("first_id").alias("hot_id"), F.lit(True).alias("hot"))  # at most HOT_GROUPS rows
    rest = groups.where(~hot).select("digest", F.lit(0).cast("long").alias("salt"), "first_id", F.lit(True).alias("shared"))
    salted = rows.join(F.broadcast(few), "digest", "left").withColumn("salt", F.when(F.col("hot"), F.xxhash64("page_id", "url")).otherwise(0))
    joined = salted.join(rest, ["digest", "salt"], "left").withColumn("first_id", F.coalesce("hot_id", "first_id"))
    joined = joined.withColumn("revisit", F.coalesce("hot", "shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_id")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def bundle() -> pa.RecordBatch:
            """The members held, and an empty row for each further BUNDLE_BYTES, as files are cut by rows."""
            rows = [_EMPTY_MEMBER.join(held), *[b""] * (size // BUNDLE_BYTES - 1)]
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                columns = batch.slice(start, 64).to_pydict()
                for i, u, p, n, d, r, v in zip(*(columns[c] for c in ("page_id", "url", "payload", "size", "digest", "first_id", "revisit")), strict=True):
                    held.append(member(record_bytes(i, u, p, n, d, r, v, date)))
                    size += len(held[-1])
                    if size >= BUNDLE_BYTES:
                        yield bundle()
                        held, size = [], 0
        if held:
            yield bundle()

    wanted = joined.select("page_id", "url", F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "size", "digest", "first_id", "revisit")
    members = wanted.mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    members.write.option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_BUNDLES).text(path)


def parse_record(data: bytes, start: int) -> tuple[dict | None, int, str]:
    """The record at start and its end, or None, start and the failed check."""
    if not data.startswith(_VERSION, start) or data.find(b"\r\n", start, start + 64) < 0:
        return None, start, "no header"
    head_end = data.find(b"\r\n\r\n", start, start + (1 << 16))
    if head_end < 0:  # a long header ends before the next version line
        stop = data.find(b"\r\n" + _VERSION, start)
        head_end = data.find(b"\r\n\r\n", start, stop if stop >= 0 else len(data))
    if head_end < 0:
        return None, start, "no header"
    lines = data[start:head_end].split(b"\r\n")[1:]
    if any(b":" not in x for x in lines):
        return None, start, "bad header line"
    head = {k.strip().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines)}
    length = head.get(b"content-length", "")
    if not length.isdigit():
        return None, start, "no length"
    begin, end = head_end + 4, head_end + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None, start, "wrong length"
    block = data[begin:end]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    digest = head.get(b"warc-payload-digest", "").removeprefix("sha256:")
    revisit = head.get(b"warc-type") == "revisit"
    if not revisit and sha256(payload).hexdigest() != digest:
        return None, start, "wrong digest"
    if size is None:
        return None, start, "no payload length"
    return {
        "page_id": _named(head.get(b"warc-record-id")),
        "record_type": head.get(b"warc-type"),
        "url": head.get(b"warc-target-uri"),
        "payload": None if revisit else payload,
        "payload_bytes": int(size[1]),
        "payload_digest": digest,
        "refers_to": _named(head.get(b"warc-refers-to")),
    }, end + 4, ""


def unpacked(data: memoryview) -> tuple[bytes, int, str]:
    """What can be unpacked of the gzip member at the start of data, its length where it is whole, and else why it is not."""
    z, out, at, step = zlib.decompressobj(31), [], 0, 4096
    while at < len(data) and not z.eof:
        before = z.copy()
        try:
            out.append(z.decompress(data[at : at + step]))
        except zlib.error:
            with contextlib.suppress(zlib.error):  # byte by byte, nothing that stands before the fault is lost
                for k in range(at, len(data)):
                    out.append(before.decompress(data[k : k + 1]))
            return b"".join(out), 0, "broken member"
        at, step = at + min(step, len(data) - at), min(2 * step, 1 << 20)
    return b"".join(out), at - len(z.unused_data), "" if z.eof else "cut member"


def walk(text: bytes) -> Iterator[tuple[str, int, int, str, dict]]:
    """All records of unpacked bytes that pass their checks, and the gaps between them."""
    at = 0
    while at < len(text):
        record, end, why = parse_record(text, at)
        if record is not None:
            yield "record", at, end, "", record
            at = end
            continue
        gap = at
        while record is None:
            at = text.find(_VERSION, at + 1)
            if at < 0:
                yield "gap", gap, len(text), why, {}
                return
            record, end, _ = parse_record(text, at)
        yield "gap", gap, at, why, {}


def parse_at(data: bytes, start: int) -> tuple[list[tuple], int, str]:
    """What walk finds in the gzip member, or the plain record, at start; its end, or 0 where that is not known; and the failed check."""
    if data.startswith(_MEMBER, start):
        text, size, why = unpacked(memoryview(data)[start:])
        found = list(walk(text))
        if not why:
            return found, start + size, ""
        done = max((stop for kind, _, stop, *_ in found if kind == "record"), default=0)
        return [f for f in found if f[2] <= done] + [("gap", done, len(text), why, {})], 0, why
    record, end, why = parse_record(data, start)
    return ([], 0, why) if record is None else ([("record", start, end, "", record)], end, "")


def salvage(data: bytes) -> Iterator[tuple[str, int, int, str, dict]]:
    """All records that pass their checks, and the gaps between them: (kind, start, stop, reason, record).

    start and stop are a range of data. Of a gap within a member they are the
    member's, and record has its range in the unpacked bytes (inner_start, inner_stop).
    A member without a known end goes to where the reader goes on.
    """

    def told(start: int, stop: int, why: str, found: list[tuple]) -> Iterator[tuple[str, int, int, str, dict]]:
        if why and not found:
            yield "gap", start, stop, why, {}
        for kind, inner_start, inner_stop, reason, record in found:
            yield kind, start, stop, reason, record if kind == "record" else {"inner_start": inner_start, "inner_stop": inner_stop}

    at, left = 0, None  # left: start, failed check and findings of what has no known end
    while at < len(data):
        found, end, why = parse_at(data, at)
        good = bool(end) or any(f[0] == "record" for f in found)
        if good and left is not None:
            yield from told(left[0], at, *left[1:])
            left = None
        if end:
            yield from told(at, end, "", found)
            at = end
            continue
        if left is None:
            left = (at, why, found if good else [])
        start = _START.search(data, at + 1)
        at = start.start() if start else len(data)
    if left is not None:
        yield from told(left[0], len(data), *left[1:])


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps (READ_SCHEMA) of all archives below path."""
    schema = pa.schema([("kind", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("inner_start", pa.int64()), ("inner_stop", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for kind, start, stop, reason, record in salvage(content.as_py()):
                    rows.append(record | {"kind": kind, "file": file, "start": start, "stop": stop, "reason": reason} | ({} if with_payload else {"payload": None}))
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, READ_SCHEMA)


def records(found: DataFrame) -> DataFrame:
    return found.where("kind = 'record'").drop("kind", "reason", "inner_start", "inner_stop")


def gaps(found: DataFrame) -> DataFrame:
    return found.where("kind = 'gap'").select("file", "start", "stop", "inner_start", "inner_stop", "reason")
