"""WARC archives: writing with segments and revisits, and reassembly.

Writing: each row becomes a WARC/1.1 record whose block is an HTTP response with a chunked body. Blocks
of more than ``SEGMENT`` bytes are cut into a first segment and continuation records. Of rows with equal
payloads the one with the smallest id is the response; the others are revisit records that refer to it
and have only the HTTP head. Spark's text sink writes the archives (gzip), at most ``PER_FILE`` records
a file, so that no reader meets an unbounded file; cuts fall between characters, so all is valid UTF-8.

Reading: files are parsed by Content-Length, record by record. Continuation records are grouped by
their origin identifier (bounded by one block), ordered by segment number and held against the total
length; then the chunked framing is decoded and the payload's digest is taken anew.

Defined cases: a null payload is empty; a null url is written as an empty one; rows that repeat an id
are records of their own, and equal ones with the smallest id are all responses; a null id is written
as such, is a response, and nothing refers to it; an empty table writes no record and reads as none.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.shared import shared_dir

SEGMENT = 16_384
CHUNK = 4_096
PER_FILE = 1_000
MIN_BYTES = 0
CRLF = b"\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def cuts(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of at most `size` bytes (more only for one character), none of which parts a character."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(x), x) for x in cuts(payload, size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        if len(parts[-1]) != size or body[end + 2 + size : end + 4 + size] != CRLF:
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(block) + block + CRLF + CRLF


def records(page_id: object, url: str, payload: bytes, refers_to: object, segment: int = SEGMENT) -> Iterator[bytes]:
    """The WARC records of one page."""
    name = f"<urn:pages:{'' if page_id is None else page_id}:{uuid.uuid4().hex}>"
    fields = [("WARC-Target-URI", " ".join(url.split())), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    kind = "Content-Type", "application/http;msgtype=response"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        own = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *fields, ("WARC-Refers-To", f"<urn:pages:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), kind]
        yield record(own, head + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = list(cuts(block, segment))
    if len(parts) == 1:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", name), *fields, kind], block)
        return
    for i, part in enumerate(parts, 1):
        total = len(block) if i == len(parts) else None
        if i == 1:
            yield record([("WARC-Type", "response"), ("WARC-Record-ID", name), *fields, ("WARC-Segment-Number", 1), kind], part)
        else:
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{i}>"), *fields[:1], ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", total)], part)


def with_referred(pages: DataFrame, key: str, payload: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages with ``refers_to``: of rows with an equal payload, the smallest id, for all others."""
    own = F.struct(F.sha2(F.coalesce(F.col(payload), F.lit("")), 256).alias("sha"), F.octet_length(F.coalesce(F.col(payload), F.lit(""))).alias("size"))
    named = pages.withColumn("_payload", own)
    again = named.where(F.col("_payload.size") >= min_bytes).groupBy("_payload").agg(F.min(key).alias("_first"), F.max(key).alias("_last")).where("_first < _last").drop("_last")
    met = named.join(again, "_payload", "left")
    return met.withColumn("refers_to", F.when(F.col(key) > F.col("_first"), F.col("_first"))).drop("_payload", "_first")


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", segment: int = SEGMENT, min_bytes: int = MIN_BYTES) -> None:
    """Write a WARC record (or its segments) for each row, under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for k, u, p, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x in records(k, u or "", (p or "").encode(), r, segment):
                    rows.append(x[:-1].decode())  # the sink adds the last line end
                    size += len(x)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])
                    rows, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])

    own = with_referred(pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(payload).alias("p")), "k", "p", min_bytes)
    own.select("k", "u", "p", "refers_to").mapInArrow(run, "value string").write.option("maxRecordsPerFile", PER_FILE).option("compression", "gzip").text(path)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(CRLF + CRLF, at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def unzipped(data: bytes) -> bytes:
    """The content of a gzip file of any number of members; other data as it is."""
    parts = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        parts.append(z.decompress(data))
        data = z.unused_data
    return b"".join([*parts, data]) if parts else data


RECORD = "id string, type string, origin string, number int, total long, refers_to string, digest string, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under path, segments apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "type", "origin", "number", "total", "refers_to", "digest", "block"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for f, block in parsed(unzipped(data.as_py())):
                    number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                    rows.append((f.get("warc-record-id"), f.get("warc-type"), f.get("warc-segment-origin-id"), number and int(number), total and int(total), f.get("warc-refers-to"), (f.get("warc-payload-digest") or "sha1:").split(":", 1)[1], block))
                    size += len(block)
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def reassembled(rows: DataFrame) -> DataFrame:
    """Records with their whole block; ``complete`` is false where segments are missing or the length is wrong."""
    single = rows.where("number is null").select("id", "type", "refers_to", "digest", F.array("block").alias("blocks"), F.lit(True).alias("complete"))
    parts = rows.where("number is not null").select(F.coalesce("origin", "id").alias("id"), "number", "total", "type", "refers_to", "digest", "block")
    whole = parts.groupBy("id").agg(
        F.max(F.when(F.col("number") == 1, F.col("type"))).alias("type"),
        F.max("refers_to").alias("refers_to"),
        F.max(F.when(F.col("number") == 1, F.col("digest"))).alias("digest"),
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max("total").alias("total"),
    )
    numbers = F.transform("parts", lambda p: p["number"])
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    good = (numbers == F.sequence(F.lit(1), F.size("parts"))) & (length == F.col("total"))
    return single.union(whole.select("id", "type", "refers_to", "digest", F.transform("parts", lambda p: p["block"]), F.coalesce(good, F.lit(False))))


def payloads(whole: DataFrame, with_payload: bool = True) -> DataFrame:
    """id, type, refers_to, payload_bytes, payload_digest, valid (complete, and of the digest stated) and payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, valid, out = [], [], [], []
            for kind, stated, blocks, complete in zip(*(batch.column(k).to_pylist() for k in ("type", "digest", "blocks", "complete")), strict=True):
                head, _, body = b"".join(blocks).partition(CRLF + CRLF)
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
                payload = None
                try:
                    if kind == "response" and complete:
                        payload = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
                except ValueError:
                    complete = False
                digests.append(digest(payload) if payload is not None else stated)
                sizes.append(len(payload) if payload is not None else int(fields.get(b"content-length", -1)) if kind == "revisit" else None)
                valid.append(bool(complete) and digests[-1] == stated)
                out.append(payload if with_payload else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("type"), batch.column("refers_to"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(valid, pa.bool_()), pa.array(out, pa.binary())], names=["id", "type", "refers_to", "payload_bytes", "payload_digest", "valid", "payload"])

    return whole.mapInArrow(run, "id string, type string, refers_to string, payload_bytes long, payload_digest string, valid boolean, payload binary")


def op7(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder, read them back, and give the contract's columns."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    read = payloads(reassembled(read_records(spark, path)), with_payload=False)
    number = lambda c: F.nullif(F.split(F.col(c), "[:<>]")[3], F.lit("")).cast("long")  # noqa: E731  <urn:pages:7:...>
    return read.select(number("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"), "valid")
