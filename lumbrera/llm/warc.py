"""WARC archives: writing with revisits and segments, and reassembly of segmented records.

Writing: a page is an HTTP response in chunked transfer framing. Of pages with equal payloads of at
least ``min_bytes`` the one with the largest id is a ``response``; the others are ``revisit`` records
that name it. A block longer than ``segment_bytes`` is cut into a first segment and ``continuation``
records. Records are raw bytes, written by Spark's text writer with the record end as its line end,
so the archives lie in any storage Spark reaches; a file holds a bounded number of bounded records.

Reading: archives are parsed by the length each record declares. Continuation records are grouped by
the id of their origin record, ordered by segment number and joined; a record is ``complete`` if its
numbers run from 1 without a gap and the block has the declared total length. Only segmented records
are shuffled, and a group is one record. The chunked framing of the joined block is decoded.

Defined cases: null html is an empty payload; null id cannot be referred to, so a group whose ids are
all null is all ``response``; rows that tie on the largest id are all ``response``; repeated rows come
back as often as they were written; null url has no target header; line ends in a url are escaped; an
empty table gives an archive without records; other columns are not archived; an incomplete record is
returned with ``complete`` false and no payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbrera.llm.shared import utf8_bytes, written

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 32 << 10, 4 << 10, 1000
END = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, origin string, number bigint, total bigint, type string, page_id bigint, url string, payload_digest string, payload_bytes bigint, refers_to bigint, block binary"
DATE = "1970-01-01T00:00:00Z"  # the pages have no time of capture


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}:{digest}'.encode()).hexdigest())}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        stop = body.index(END, at)
        n = int(body[at:stop].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(body[stop + 2 : stop + 2 + n])
        if len(out[-1]) != n or body[stop + 2 + n : stop + 4 + n] != END:
            raise ValueError("a chunk is shorter than it says")
        at = stop + 4 + n


def payload_of(block: bytes) -> bytes:
    """Payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = [line.split(b":", 1) for line in head.split(END)[1:]]
    framed = any(k.strip().lower() == b"transfer-encoding" and v.strip().lower() == b"chunked" for k, v in fields)
    return unchunked(body) if framed else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*fields, ("Content-Length", len(block))] if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block


def records(page_id: int | None, url: str | None, payload: bytes, holder: int | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of a page; ``holder`` is the id of the page that it revisits."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    own = record_id(page_id, digest)
    clean = None if url is None else url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    shared = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("WARC-X-Page-ID", page_id), ("WARC-X-Payload-Length", len(payload)), ("Content-Type", "application/http;msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if holder is not None:
        revisit = [("WARC-Type", "revisit"), ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(holder, digest)), ("WARC-X-Refers-To-Page-ID", holder)]
        yield _record(revisit + shared, head)
        return
    block = head + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record([("WARC-Type", "response"), *shared, ("WARC-Segment-Number", 1 if len(parts) > 1 else None)], parts[0])
    for number, part in enumerate(parts[1:], 2):
        name = record_id(page_id, f"{digest}:{number}")
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", clean), ("WARC-Segment-Origin-ID", own),
                       ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", len(block) if number == len(parts) else None)], part)


def _written_records(segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200).to_pydict()
                out = [r for p, u, h, to in zip(rows["page_id"], rows["url"], rows["html"], rows["holder"], strict=True)
                       for r in records(p, u, (h or "").encode("utf-8", "surrogatepass"), to, segment_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return run


def write(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Archives of all ``pages`` (page_id, url, html) in a new folder ``path``."""
    rows = pages.select("page_id", "url", "html", F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8")).alias("digest"), utf8_bytes(F.col("html")).alias("bytes"))
    held = rows.where(F.col("bytes") >= min_bytes).groupBy(F.col("digest").alias("held")).agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
    held = written(held.where("n > 1 AND largest IS NOT NULL").select("held", "largest"), "held")
    joined = rows.join(held, F.col("digest") == F.col("held"), "left")
    revisits = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("largest")), F.col("largest"))
    out = joined.select(F.col("page_id").cast("bigint"), "url", "html", revisits.cast("bigint").alias("holder")).mapInArrow(_written_records(segment_bytes), "record binary")
    out.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(archive):
        stop = archive.index(b"\r\n\r\n", at)
        lines = archive[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:])}
        begin, n = stop + 4, int(fields["content-length"])
        if archive[begin + n : begin + n + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield fields, archive[begin : begin + n]
        at = begin + n + 4


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def number(fields: dict[str, str], name: str) -> int | None:
        return int(fields[name]) if name in fields else None

    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in RECORD.split(", ")]
    for batch in batches:
        for content in batch.column(0):
            data = content.as_py()
            data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
            rows = []
            for f, block in parse(data):
                url = f.get("warc-target-uri")
                rows.append((
                    f["warc-record-id"], f.get("warc-segment-origin-id", f["warc-record-id"]), number(f, "warc-segment-number"), number(f, "warc-segment-total-length"), f["warc-type"],
                    number(f, "warc-x-page-id"), None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
                    f.get("warc-payload-digest", "").removeprefix("sha1:") or None, number(f, "warc-x-payload-length"), number(f, "warc-x-refers-to-page-id"), block))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives at ``path``, segmented ones still in pieces."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed, RECORD)


def reassemble(found: DataFrame) -> DataFrame:
    """Whole records: (type, page_id, url, payload_digest, payload_bytes, refers_to, complete, block)."""
    columns = ["type", "page_id", "url", "payload_digest", "payload_bytes", "refers_to"]
    whole = found.where(F.col("number").isNull()).select(*columns, F.lit(True).alias("complete"), F.array("block").alias("blocks"))
    first = F.col("number") == 1
    pieces = found.where(F.col("number").isNotNull()).groupBy("origin").agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in columns], F.count(F.when(first, 1)).alias("times"), F.max("total").alias("total"),
        F.array_sort(F.collect_set(F.struct("number", "block"))).alias("s"))  # equal records have equal segments
    unbroken = F.array_max("s.number") == F.size("s")
    length = F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["block"]))
    joined = pieces.select(*columns, F.coalesce(unbroken & (length == F.col("total")), F.lit(False)).alias("complete"), F.col("s.block").alias("blocks"), "times")
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("times", F.lit(1)).cast("int")))).drop("copy", "times")
    return whole.unionByName(joined)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            out, digests = [], []
            for kind, complete, blocks in zip(*(part.column(c).to_pylist() for c in ("type", "complete", "blocks")), strict=True):
                payload = payload_of(b"".join(blocks)) if complete and kind == "response" else None
                out.append(payload)
                digests.append(None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode())
            keep = [i for i, n in enumerate(part.schema.names) if n != "blocks"]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(out, pa.binary()), pa.array(digests, pa.string())],
                                             names=[*(part.schema.names[i] for i in keep), "payload", "found_digest"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the archives: (type, page_id, url, payload_digest, payload_bytes, refers_to, complete, payload, found_digest); ``found_digest`` is that of the decoded payload."""
    return reassemble(read_records(spark, path)).mapInArrow(
        _decoded, "type string, page_id bigint, url string, payload_digest string, payload_bytes bigint, refers_to bigint, complete boolean, payload binary, found_digest string")
