"""WARC archives with segmented records: written by the executors, read back and reassembled.

A page is a response record, or, if its payload equals that of a page with a smaller id, a revisit record. A
response's HTTP block carries the payload in chunked transfer framing. Blocks above SEGMENT bytes are cut: the
first segment is the record itself, the others are continuation records that name the origin's record id and
their number, the last also the total length. Records are gzip members; an archive is closed at ARCHIVE
bytes. Reading groups segments by origin, orders them by number, verifies that none is missing and that the
total length is right, takes the chunked framing off, and verifies the payload digest.

Record ids are names (UUID version 5) of page_id, payload digest and url, so that a task can write a reference to
a record that another one writes. Reading resolves every reference among the records read; one that names no
record is an error.

Every task writes archives under names of its own attempt and returns them as rows of a manifest; only
archives of the manifest are read, so those of a lost attempt do no harm.

Edge cases: a null html is an empty payload, a null url an empty one. A null page_id is kept, and is smallest
only among null ids. Pages with equal id and payload are all responses if the id is the smallest; the first of their
urls is referred to. Rows equal in id, url and html are one record that stands there so often. An empty
table gives one empty manifest. Extra columns are ignored. A broken archive raises ``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colfold.llm.common import new_path, small_batches, stored, task_id, utf8_texts

SEGMENT = 32 << 10
ARCHIVE = 16 << 20
CHUNK = 8 << 10
BATCH_BYTES = 4 << 20
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of an archive that are inflated at once.
STEP = 1 << 16


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(headers: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": len(block)}).items())
    packed = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packed.compress(VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packed.flush()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload without its framing; chunk extensions and trailers are skipped."""
    at, parts = 0, []
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size")
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        part = body[end + 2 : end + 2 + size]
        if len(part) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut off")
        parts.append(part)
        at = end + 4 + size


def record_id(page_id: int | None, digest: str, url: str, segment: int = 1) -> str:
    """The id of a page's record, or of one of its continuations."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest} {segment} {url}')}>"


def page_records(page_id: int | None, url: str, payload: bytes, original: tuple[int | None, str] | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page. ``original``: page_id and url of the response that a revisit refers to."""
    digest = payload_digest(payload)
    headers: dict[str, object] = {
        "WARC-Type": "response" if original is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest, url),
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join(url.split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Page-Id": "" if page_id is None else page_id,
        "Page-Payload-Length": len(payload),
    }
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if original is not None:
        yield _record(headers | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(original[0], digest, original[1])}, http)
        return
    block = http + chunked(payload)
    if len(block) <= segment:
        yield _record(headers, block)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield _record(headers | {"WARC-Segment-Number": 1}, parts[0])
    for i, part in enumerate(parts[1:], 2):
        more: dict[str, object] = {"WARC-Type": "continuation", "WARC-Record-ID": record_id(page_id, digest, url, i), "WARC-Date": DATE, "WARC-Segment-Origin-ID": headers["WARC-Record-ID"], "WARC-Segment-Number": i}
        yield _record(more | ({"WARC-Segment-Total-Length": len(block)} if i == len(parts) else {}), part)


def _writer(base: str, segment: int, archive: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(base)
        system.create_dir(root, recursive=True)
        part, attempt = task_id(), uuid.uuid4().hex[:8]
        stream, written, records, made = None, 0, 0, []

        def close() -> None:
            nonlocal stream, written, records
            if stream is not None:
                stream.close()
                made[-1] += (records, written)
            stream, written, records = None, 0, 0

        for batch in small_batches(batches, "html", BATCH_BYTES):
            for page, url, html, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                for record in page_records(page, url, html, first and (first["page_id"], first["url"]), segment):
                    if stream is None or written >= archive:
                        close()
                        made.append((f"{base}/part-{part:05}-{attempt}-{len(made):04}.warc.gz",))
                        stream = system.open_output_stream(f"{root}/{made[-1][0].rpartition('/')[2]}", compression=None)
                    stream.write(record)
                    written += len(record)
                    records += 1
        close()
        columns = list(zip(*made, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    return run


def write(pages: DataFrame, base: str | None = None, min_bytes: int = 0, segment: int = SEGMENT, archive: int = ARCHIVE) -> DataFrame:
    """Archives of pages (page_id, url, html); returns their manifest: path, records, bytes."""
    base = base or new_path(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"), F.unhex(F.sha1(html)).alias("digest"))
    # copies meet by digest without their html; the html meets what is found by page and digest, so no page with many copies does
    long_enough = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "url", "digest")
    equal = long_enough.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    revisits = long_enough.select("page_id", "digest").distinct().join(equal, "digest").where(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    revisits = revisits.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.struct("first.page_id", "first.url").alias("original"))
    dealt = rows.join(revisits, rows["page_id"].eqNullSafe(F.col("_page")) & (rows["digest"] == F.col("_digest")), "left").select("page_id", "url", "html", "original")
    return stored(dealt.mapInArrow(_writer(base, segment, archive), "path string, records long, bytes long"), "manifest")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof and at < len(view):
            parts.append(member.decompress(view[at : at + STEP]))
            at = min(at + STEP, len(view))
        if not member.eof:
            raise ValueError("a record is cut off")
        at -= len(member.unused_data)
        raw = b"".join(parts)
        end = raw.index(b"\r\n\r\n")
        first, *lines = raw[:end].decode().split("\r\n")
        if first.encode() != VERSION:
            raise ValueError("no WARC record")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        block = raw[end + 4 : end + 4 + int(headers["Content-Length"])]
        if raw[end + 4 + len(block) :] != b"\r\n\r\n":
            raise ValueError("a block has another length than its header says")
        yield headers, block


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The payload of a whole response block, its digest verified."""
    end = block.index(b"\r\n\r\n")
    payload = unchunked(block[end + 4 :]) if b"transfer-encoding: chunked" in block[:end].lower() else block[end + 4 :]
    if headers["WARC-Payload-Digest"] != f"sha1:{payload_digest(payload)}":
        raise ValueError("the payload has another digest than its header says")
    return payload


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers string"
_RECORD = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers", pa.string()), ("payload", pa.binary()))
_SEGMENT = (("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page", pa.string()), ("block", pa.binary()))


def _read_record(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    page = int(headers["Page-Id"]) if headers["Page-Id"] else None
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "revisit":
        return page, int(headers["Page-Payload-Length"]), digest, "revisit", headers["WARC-Record-ID"], headers["WARC-Refers-To"], None
    payload = payload_of(headers, block)
    return page, len(payload), digest, "response", headers["WARC-Record-ID"], None, payload if payloads else None


def _batch(rows: list[tuple], fields: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _parser(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        fields = (*_RECORD, *_SEGMENT)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(path)
                with system.open_input_stream(at, compression=None) as stream:
                    data = stream.read()
                rows, held = [], 0
                for headers, block in parse(data):
                    if "WARC-Segment-Number" in headers:
                        first = headers["WARC-Type"] != "continuation"
                        text = "\n".join(f"{k}: {v}" for k, v in headers.items()) if first else None
                        origin = headers["WARC-Record-ID" if first else "WARC-Segment-Origin-ID"]
                        rows.append((None,) * len(_RECORD) + (origin, int(headers["WARC-Segment-Number"]), int(headers["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in headers else None, text, block))
                    else:
                        rows.append((*_read_record(headers, block, payloads), None, None, None, None, None))
                    held += len(block)
                    if held >= BATCH_BYTES:
                        yield _batch(rows, fields)
                        rows, held = [], 0
                yield _batch(rows, fields)

    return run


def reassembled(segments: list[dict]) -> tuple[dict[str, str], bytes]:
    """Headers and whole block from segments ordered by number."""
    if [s["number"] for s in segments] != list(range(1, len(segments) + 1)):
        raise ValueError("a segment is missing or doubled")
    block = b"".join(s["block"] for s in segments)
    if segments[-1]["total"] != len(block):
        raise ValueError("the segments have another total length than the last one says")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in segments[0]["page"].split("\n")), block


def _copies(segments: list[dict]) -> int:
    """How often a record stands in the archives: as often as each of its segments, which are equal then."""
    if len({s["n"] for s in segments}) > 1 or any(s["low"] != s["high"] for s in segments):
        raise ValueError("a segment is missing or doubled")
    return segments[0]["n"]


def _joiner(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "bytes", 1):
            x = batch.column(0).to_pylist()[0]
            yield _batch([_read_record(*reassembled(x), payloads)] * _copies(x), _RECORD)

    return run


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """archives: path. Returns page_id, payload_bytes, payload_digest, record_type, refers_to, and payload if asked for (null in revisits)."""
    kinds = f"{RECORD}, payload binary"
    parts = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = stored(archives.select("path").repartition(parts).mapInArrow(_parser(payloads), f"{kinds}, origin string, number int, total long, page string, block binary"), "records")
    names, columns = [f[0] for f in _RECORD], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    once = found.where("origin is not null").groupBy("origin", "number").agg(F.count("*").alias("n"), F.min(F.crc32("block")).alias("low"), F.max(F.crc32("block")).alias("high"), *(F.first(c, ignorenulls=True).alias(c) for c in ("total", "page", "block")))
    segments = F.sort_array(F.collect_list(F.struct("number", "total", "page", "block", "n", "low", "high"))).alias("s")
    cut = once.groupBy("origin").agg(segments, F.lit("x").alias("bytes")).select("s", "bytes").mapInArrow(_joiner(payloads), kinds)
    records = stored(found.where("origin is null").select(*names).unionByName(cut), "whole")
    responses = records.where("record_type = 'response'")
    targets = responses.select(F.col("record_id").alias("_id"), F.col("page_id").alias("_page")).dropDuplicates(["_id"])
    missing = F.raise_error(F.concat(F.lit("a revisit refers to no record: "), F.col("refers")))
    refers_to = F.when(F.col("_id").isNull(), missing.cast("long")).otherwise(F.col("_page")).alias("refers_to")
    revisits = records.where("record_type = 'revisit'")
    resolved = revisits.join(targets, revisits["refers"] == targets["_id"], "left").select(*columns[:4], refers_to, "payload")
    out = responses.select(*columns[:4], F.lit(None).cast("long").alias("refers_to"), "payload").unionByName(resolved)
    return out if payloads else out.drop("payload")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives and reads them back."""
    return read(write(pages))
