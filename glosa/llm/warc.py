"""Operator 5: WARC archives with segmented records and chunked payloads.

Writing: a page becomes a ``response`` record whose block is an HTTP message
with a chunked body, or, if a page with a smaller id has the same payload, a
``revisit`` record without one. A block of more than ``segment_bytes`` is cut
into a first segment and ``continuation`` records that name it as their origin.
Archives are written by Spark's text writer, a record a row.

Reading: archives are split at their version lines, so large ones are read by
many tasks. Chunk boundaries are put inside any "WARC/1.1" of a payload, so the
version line stands between records only. Segments are grouped by origin, put
into order and their length held against the declared total, then the chunked
framing is decoded. ``complete`` is false, and the payload null, for a record
whose segments, lengths, framing or digest do not agree.

A null payload is empty, a null url is left out, a null page_id is no number
and names nothing: of pages with equal payloads the least id is the response,
rows that repeat it are too, and if all ids are null all are responses.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosa.llm.common import scratch, slices, stored

VERSION, CRLF = "WARC/1.1", "\r\n"
MARK = VERSION.encode()
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
HTTP_REVISIT = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SLICE_BYTES = 4_000_000


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _cut(data: bytes, size: int) -> list[bytes]:
    """Pieces of ``size`` bytes at most, none of which ends inside a character."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and end - at > 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out


def chunked(payload: bytes, chunk_bytes: int) -> bytes:
    """Chunked transfer framing with a boundary after "WARC/" in each version mark."""
    parts = payload.split(MARK)
    runs = [(MARK[5:] if i else b"") + p + (MARK[:5] if i + 1 < len(parts) else b"") for i, p in enumerate(parts)]
    # A mark that a cut leaves whole cannot be: each run holds a part of it only.
    out = [b"%x\r\n%s\r\n" % (len(c), c) for run in runs for c in _cut(run, chunk_bytes)]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body (chunk extensions and trailers are passed over); null if it is not whole."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            n = int(body[at:end].split(b";", 1)[0], 16)
        except ValueError:
            return None
        at = end + 2
        if n == 0:
            return b"".join(out)
        if n < 0 or body[at + n: at + n + 2] != b"\r\n":
            return None
        out.append(body[at: at + n])
        at += n + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> str:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    return CRLF.join(lines) + block.decode("utf-8")


def _uri(url: str | None) -> str | None:
    if url is None:
        return None
    out = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    # At the end of its line the version would be the reader's record separator.
    return out.replace(VERSION, f"%{ord(VERSION[0]):02X}{VERSION[1:]}")


def _records(date: str, segment_bytes: int, chunk_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "payload", SLICE_BYTES):
            out: list[str] = []
            for r in part.to_pylist():
                payload, uid = r["payload"], f"<urn:page-record:{r['number']}>"
                common = [("WARC-Date", date), ("WARC-Target-URI", _uri(r["url"])), ("WARC-Page-ID", r["page_id"])]
                digest = ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")
                http = ("Content-Type", "application/http; msgtype=response")
                if r["refers_to"] is not None:
                    out.append(_record([("WARC-Type", "revisit"), ("WARC-Record-ID", uid), *common, digest, http,
                                        ("WARC-Profile", PROFILE), ("WARC-Refers-To-Page-ID", r["refers_to"])],
                                       HTTP_REVISIT))
                    continue
                block = HTTP + chunked(payload, chunk_bytes)
                segments = _cut(block, segment_bytes)
                first = ("WARC-Segment-Number", 1 if len(segments) > 1 else None)
                out.append(_record([("WARC-Type", "response"), ("WARC-Record-ID", uid), *common, digest, http, first],
                                   segments[0]))
                for k, segment in enumerate(segments[1:], 2):
                    total = len(block) if k == len(segments) else None
                    out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{uid[:-1]}:{k}>"), *common,
                                        ("WARC-Segment-Origin-ID", uid), ("WARC-Segment-Number", k),
                                        ("WARC-Segment-Total-Length", total)], segment))
            for k in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(out[k: k + 1000], pa.string())], names=["value"])
    return run


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
                   segment_bytes: int = 32_768, chunk_bytes: int = 8_192) -> None:
    """Write a WARC record for each page under ``folder``.

    Payloads of at least ``min_bytes`` bytes that a smaller page id has as well
    become revisits. Only the digests are grouped; a digest of very many pages
    is split by the skew join.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    firsts = (rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1 and first is not null").select("digest", "first"))
    firsts = stored(firsts, "firsts")
    rows = rows.join(firsts, "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select(F.monotonically_increasing_id().alias("number"), "page_id", "url", "payload",
                       refers.alias("refers_to"))
    (rows.mapInArrow(_records(date, segment_bytes, chunk_bytes), "value string")
     .write.option("lineSep", 2 * CRLF).text(folder))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each record: its headers of interest and its block (null if cut short)."""
    schema = pa.schema([("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("type", pa.string()),
                        ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])
    for part in slices(batches, "value", SLICE_BYTES):
        out = []
        for record in part.column("value").to_pylist():
            head, _, rest = record.partition(b"\r\n\r\n")
            headers = {}
            for line in head.decode("utf-8", "replace").split(CRLF):
                name, _, value = line.partition(":")
                headers[name.strip().lower()] = value.strip()
            n = int(headers.get("content-length", -1))
            number = lambda k: int(headers[k]) if k in headers else None
            out.append({
                "origin": headers.get("warc-segment-origin-id", headers.get("warc-record-id")),
                "segment": number("warc-segment-number"), "total": number("warc-segment-total-length"),
                "type": headers.get("warc-type"), "page_id": number("warc-page-id"),
                "refers_to": number("warc-refers-to-page-id"),
                "digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                "block": rest[:n] if 0 <= n <= len(rest) else None})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join a record's segments, decode its body and compare the payload with the digest."""
    for part in batches:
        payloads, complete = [], []
        for r in part.select(["type", "digest", "segments"]).to_pylist():
            parts = sorted(r["segments"], key=lambda s: s["segment"] or 1)
            blocks = [s["block"] for s in parts]
            whole = [s["segment"] or 1 for s in parts] == list(range(1, len(parts) + 1)) and None not in blocks
            block = b"".join(blocks) if whole else None
            if whole and (len(parts) > 1 or parts[0]["segment"]):
                whole = parts[-1]["total"] == len(block)
            payload = None
            if whole and r["type"] == "response":
                payload = unchunked(block.partition(b"\r\n\r\n")[2])
                whole = payload is not None and base32_sha1(payload) == r["digest"]
            payloads.append(payload if whole else None)
            complete.append(whole)
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in ("page_id", "type", "refers_to", "digest")),
             pa.array(payloads, pa.binary()), pa.array(complete, pa.bool_())],
            names=["page_id", "record_type", "refers_to", "payload_digest", "payload", "complete"])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_digest, payload (null for revisits) and complete of every record."""
    lines = spark.read.option("lineSep", VERSION + CRLF).text(folder).where("value <> ''")
    head = F.lower(F.substring_index("value", 2 * CRLF, 1))
    fields = "origin string, segment long, total long, type string, page_id long, refers_to long, digest string, block binary"

    def parsed(some: DataFrame) -> DataFrame:
        return some.select(F.col("value").cast("binary").alias("value")).mapInArrow(_parse, fields)

    def of_first(c: str) -> Column:
        return F.max(F.when(F.col("type") != "continuation", F.col(c))).alias(c)
    one = F.struct("segment", "total", "block")
    named = ["type", "page_id", "refers_to", "digest"]
    # Records of one segment stay where they are read. A group is one record: its
    # segments are no more than one payload.
    whole = parsed(lines.where(~head.contains("warc-segment-number:"))).select(*named, F.array(one).alias("segments"))
    cut = parsed(lines.where(head.contains("warc-segment-number:"))).groupBy("origin").agg(
        *[of_first(c) for c in named], F.collect_list(one).alias("segments")).drop("origin")
    return whole.unionAll(cut).mapInArrow(
        _assemble, "page_id long, record_type string, refers_to long, payload_digest string, payload binary, complete boolean")


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write a table's archives to a new folder under the shared one and read them back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to and
    complete; a revisit's length is that of the response with its digest.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    write_archives(pages, folder, **options)
    rows = read_archives(spark, folder).withColumn("bytes", F.octet_length("payload").cast("long")).drop("payload")
    rows = stored(rows, "records")
    sizes = rows.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("bytes").alias("payload_bytes"))
    sizes = stored(sizes, "sizes")  # so that the join reads plain exchanges and can split a hot digest
    return rows.join(sizes, "payload_digest", "left").select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                             "refers_to", "complete")
