"""Operator 2: WARC archives with revisit resolution.

``write_archives`` turns pages into records: headers alone (id, digest, length)
are shuffled by payload digest, the smallest id of equal payloads of at least
``least`` bytes stays a response, and the others are written as revisits that
refer to it. Payloads move only where the repeated digests are too many to broadcast.
``read_archives`` parses any archives of this kind, and ``resolve`` joins revisit
records to the responses they refer to.

A null payload is empty. Rows with equal id and payload are all responses if
theirs is the smallest id; a record without id is a response. Each record is one
gzip member with the blank lines that end it; an empty member stands between two.
Each task's first file begins with a ``warcinfo`` record, and files are closed after
about ``FILE_BYTES`` of payload.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pantryplan.llm.common import Scratch, bounded, table, text_batches, write_blobs

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:record:"
END = b"\r\n\r\n"
TRAILER = gzip.compress(b"", mtime=0)
#: Repeated digests up to this many rows (a digest and an id each) are broadcast.
BROADCAST_DIGESTS = 200_000
#: Payload bytes of a file, by the mean payload.
FILE_BYTES = 1 << 28


def originals(headers: DataFrame, least: int = 100) -> DataFrame:
    """digest and refers_to (the smallest id) of payloads of at least ``least`` bytes that more than one record has."""
    large = headers.where(F.col("bytes") >= least)
    return large.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")


def find_revisits(headers: DataFrame, first: DataFrame, least: int = 100) -> DataFrame:
    """id, digest and refers_to of records that repeat the payload of a smaller id."""
    return headers.join(first, "digest").where((F.col("bytes") >= least) & (F.col("id") > F.col("refers_to"))).select("id", "digest", "refers_to").distinct()


def info(date: str) -> bytes:
    """The record that opens a file."""
    block = b"software: pantryplan\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{RECORD_ID}info>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + END


def record(rid: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{RECORD_ID}{'' if rid is None else rid}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join([*head, "", ""]).encode() + block + END


def write_archives(pages: DataFrame, path: str, least: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write records of ``id``, ``url`` and ``payload`` (text)."""
    payload, scratch = F.coalesce("payload", F.lit("")), Scratch(pages.sparkSession, "headers")
    full = pages.select("id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    headers = scratch.save(full.select("id", "digest", "bytes"), "headers")
    first = scratch.save(originals(headers, least), "originals")
    if bounded(first, BROADCAST_DIGESTS):
        repeats = (F.col("bytes") >= least) & (F.col("id") > F.col("refers_to"))
        resolved = full.join(F.broadcast(first), "digest", "left").withColumn("refers_to", F.when(repeats, F.col("refers_to")))
    else:
        resolved = full.join(find_revisits(headers, first, least), ["id", "digest"], "left")
    mean = headers.agg(F.avg("bytes")).first()[0] or 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = lambda x: gzip.compress(x, 6, mtime=0)
        opened = False
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = zip(*(c.to_pylist() for c in batch.slice(start, 256).columns))
                out = [packed(record(i, u, p.encode(), d, r, date)) for i, d, u, p, r in rows]
                yield pa.record_batch({"record": pa.array(out if opened else [packed(info(date)), *out], pa.binary())})
                opened = True

    resolved = resolved.select("id", "digest", "url", "payload", "refers_to")
    write_blobs(resolved.mapInArrow(build, "record binary"), "record", path, TRAILER, max(1, int(FILE_BYTES / max(mean, 1))))
    scratch.drop("headers", "originals")


def _members(blob: bytes) -> Iterator[bytes]:
    view, at = memoryview(blob), 0
    while at < len(view):
        out, step = zlib.decompressobj(31), 1 << 16
        parts = []
        while not out.eof:
            if at >= len(view):
                raise ValueError("an archive is cut off")
            chunk = view[at : at + step]
            parts.append(out.decompress(chunk))
            at += len(chunk) - len(out.unused_data)
        yield b"".join(parts)


def records(blob: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record."""
    rest = b""
    for member in _members(blob):
        rest += member
        while (end := rest.find(b"\r\n\r\n")) >= 0:
            lines = rest[:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a record")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            stop = end + 4 + int(head["content-length"])
            if len(rest) < stop + 4:
                break
            yield head, rest[end + 4 : stop]
            rest = rest[stop + 4 :]
    if rest:
        raise ValueError("an archive is cut off")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """id, record_type, refers_to, digest (as recorded), bytes and actual (of the payload in the record)."""

    def number(uri: str | None) -> int | None:
        value = (uri or "").strip("<>").removeprefix(RECORD_ID)
        return int(value) if value else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                rows = []
                for head, block in records(blob.as_buffer()):
                    if head["warc-type"] == "warcinfo":
                        continue
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    response = head["warc-type"] == "response"
                    rows.append((number(head["warc-record-id"]), head["warc-type"], number(head.get("warc-refers-to")), head["warc-payload-digest"].removeprefix("sha256:"), len(payload) if response else None, hashlib.sha256(payload).hexdigest() if response else None))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "record_type", "refers_to", "digest", "bytes", "actual"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(scan, "id long, record_type string, refers_to long, digest string, bytes long, actual string")


def resolve(found: DataFrame) -> DataFrame:
    """Give each revisit the length and actual digest of the response that it refers to."""
    responses = found.where("record_type = 'response'").select("id", "bytes", "actual", "record_type", F.lit(None).cast("long").alias("refers_to"))
    originals = responses.select(F.col("id").alias("refers_to"), "bytes", F.col("actual").alias("digest"), "actual").dropDuplicates(["refers_to", "digest"])
    revisits = found.where("record_type = 'revisit'").select("id", "refers_to", "digest", "record_type").join(originals, ["refers_to", "digest"], "left")
    return responses.unionByName(revisits.select("id", "bytes", "actual", "record_type", "refers_to"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    scratch = Scratch(spark, "warc")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("id"), "url", F.col("html").alias("payload"))
    write_archives(pages, scratch.path("archives"))
    found = scratch.save(read_archives(spark, scratch.path("archives")), "records")
    return resolve(found).select(F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("actual").alias("payload_digest"), "record_type", "refers_to")


OP2_SQL = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
             min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS first_id
      FROM pages)
"""
