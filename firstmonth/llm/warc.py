"""Web archives: a writer, and a reader that splits files at any byte.

Every record is a gzip member of its own. Pages with equal payloads are stored once: the record of the smallest page id
holds the payload, the others are revisits that refer to it. The reader cuts each file into byte ranges. The task of a
range looks for gzip magic, takes a place for a record only if what follows decodes to a record header, and owns the
records that start inside its range, reading the last one beyond the end of the range.

Null html is an empty payload. Null page ids are written as ``none`` and read back as null; such a page is a response
unless its payload equals that of a page with an id. Pages that share both the smallest id and the payload are all
responses. A null url is left out of the header. An empty table gives no files and no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firstmonth.llm.common import CommittedFile, filesystem, measured_broadcast, new_folder, save, sliced

MIN_SHARED = 100
SPLIT_BYTES = 16 << 20
FILE_BYTES = 1 << 30
MAGIC = b"\x1f\x8b\x08"
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_READ = 1 << 16

MANIFEST = "path string, n_bytes long, n_records long"
RECORDS = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"


def record_kinds(pages: DataFrame) -> DataFrame:
    """``pages`` (``page_id``, ``url``, ``html``) with ``payload_digest``, ``record_type`` and ``refers_to``.

    Only (digest, id) pairs of payloads of ``MIN_SHARED`` bytes or more are shuffled, summed map-side first.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"))
    read = read.withColumn("payload_digest", F.sha2("html", 256))
    shared = read.where(F.octet_length("html") >= MIN_SHARED).groupBy("payload_digest")
    shared = shared.agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = measured_broadcast(save(shared.drop("n").withColumnRenamed("payload_digest", "digest"), "shared-payloads"))
    joined = read.join(first, F.col("payload_digest") == F.col("digest"), "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id",
        "url",
        "html",
        "payload_digest",
        F.when(again, REVISIT).otherwise(RESPONSE).alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _of_urn(value: str) -> int | None:
    inner = value.removeprefix("<urn:page:").removesuffix(">")
    return None if inner == "none" else int(inner)


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, level: int = 6) -> bytes:
    """A gzip member with one record."""
    body = b"" if kind == REVISIT else _HTTP + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == REVISIT:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n") + packer.flush()


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives of ``pages``; a saved table of files (``path``, ``n_bytes``, ``n_records``)."""
    folder = folder or new_folder(pages.sparkSession, "warc")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = None, 0
        for batch in sliced(batches):
            for page_id, url, html, digest, kind, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    out, n = CommittedFile(folder, f"{_name()}.warc.gz"), 0
                out.write(record(page_id, url, html.encode(), digest, kind, refers_to))
                n += 1
                if out.size >= FILE_BYTES:
                    yield _closed(out, n)
                    out = None
        if out is not None:
            yield _closed(out, n)

    return save(record_kinds(pages).mapInArrow(put, MANIFEST), "warc-manifest")


def _name() -> str:
    """A name of its own for each attempt: only files of finished tasks are in the manifest."""
    return f"pages-{hashlib.blake2b(os.urandom(16), digest_size=12).hexdigest()}"


def _closed(out: CommittedFile, n: int) -> pa.RecordBatch:
    out.commit()
    return pa.RecordBatch.from_pydict({"path": [out.path], "n_bytes": [out.size], "n_records": [n]})


def header_at(data: bytes) -> bytes | None:
    """The record header that a gzip member at the start of ``data`` begins with; None if there is none."""
    if not data.startswith(MAGIC):
        return None
    try:
        start = zlib.decompressobj(31).decompress(data, 1 << 14)
    except zlib.error:
        return None
    head, found, _ = start.partition(b"\r\n\r\n")
    long_head = len(start) == 1 << 14  # a very long address: the header goes on
    if re.match(rb"WARC/1\.[01]\r\n", start) and (found and b"\r\nContent-Length: " in head or long_head):
        return head
    return None


def records_in(stream, start: int, end: int, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payloads of the records of an open file that begin in [start, end)."""
    at = _next_member(stream, start, end, size)
    while at is not None and at < end:
        unpack, parts, read = zlib.decompressobj(31), [], at
        while not unpack.eof and read < size:
            chunk = stream.read_at(min(_READ, size - read), read)
            parts.append(unpack.decompress(chunk))
            read += len(chunk)
        if not unpack.eof:
            raise ValueError(f"record at byte {at} is cut off")
        yield _parsed(b"".join(parts))
        at = read - len(unpack.unused_data)
        if at < end and header_at(stream.read_at(min(_READ, size - at), at)) is None:
            at = _next_member(stream, at, end, size)


def _next_member(stream, start: int, end: int, size: int) -> int | None:
    """Where the first valid record at or after ``start`` and before ``end`` begins."""
    at = start
    while at < end:
        window = stream.read_at(min(1 << 20, size - at), at)
        found = window.find(MAGIC)
        while found >= 0:
            if at + found >= end:
                return None
            if header_at(stream.read_at(min(_READ, size - at - found), at + found)) is not None:
                return at + found
            found = window.find(MAGIC, found + 1)
        if at + len(window) >= size:
            return None
        at += len(window) - len(MAGIC) + 1  # magic may lie across two windows
    return None


def _parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def read(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """One row a record. Size and digest of a response are taken from the payload read, of a revisit from its header."""
    splits = manifest.select(
        "path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    )
    splits = splits.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*[c.to_pylist() for c in batch.columns]):
                system, name = filesystem(path)
                with system.open_input_file(name) as stream:
                    rows = []
                    for headers, payload in records_in(stream, start, min(start + split_bytes, size), size):
                        rows.append(_row(headers, payload)[: 6 if with_payload else 5])
                        if len(rows) == 256:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    return splits.mapInArrow(get, f"{RECORDS}, payload binary" if with_payload else RECORDS)


def _row(headers: dict[str, str], payload: bytes) -> tuple:
    kind, page_id = headers["WARC-Type"], _of_urn(headers["WARC-Record-ID"])
    stated = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == REVISIT:
        return page_id, kind, _of_urn(headers["WARC-Refers-To"]), int(headers["X-Payload-Length"]), stated, None
    if hashlib.sha256(payload).hexdigest() != stated:
        raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
    return page_id, kind, None, len(payload), stated, payload


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names[: len(columns)])
