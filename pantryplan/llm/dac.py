"""Operator 5: token ids in files of directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level 0 has a chunk of
every id, level j one of every id with more than j chunks; each level has a
bitmap that says which ids go on, and a rank directory over it. The chunk of an
id on the next level is at the rank of its bit, so any token is reached in as
many steps as it has chunks, without decoding others.

A file is a sequence of segments, each followed by ``TRAILER``; a segment holds
whole documents in ascending order:

    header   4s magic, u16 version, u16 levels, u32 documents, u64 ids, u64 bytes of the segment
    table    i64 ids of the documents, u8 1 where that id is null, u32 lengths
    level    u64 entries; u8 chunks; bitmap (little bit order, whole 64-bit words); u32 rank before each 512 bits

Null and empty texts are documents with the end id alone. Rows with equal or
null doc_id are all kept, ordered by their text; null ids come first.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pantryplan.llm.bpe import default_tokenizer, units
from pantryplan.llm.common import Scratch, bounded, table, text_batches, write_blobs
from pantryplan.llm.tokens import encoder

MAGIC, VERSION, TRAILER = b"DACS", 1, b"DACSEND\n"
_HEAD = struct.Struct("<4sHHIQQ")
_BLOCK = 512
#: Ids gathered before a segment is closed.
SEGMENT_IDS = 1 << 18
#: Segments of a file at most: a reader holds a whole file.
FILE_SEGMENTS = 8
#: Above so many files their offsets are joined by a shuffle instead of broadcast.
BROADCAST_FILES = 100_000


def _level(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    more = ids > 0xFF
    bits = np.packbits(np.pad(more, (0, -len(more) % 64)), bitorder="little")
    ones = np.add.reduceat(more, np.arange(0, len(more), _BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
    rank = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4")
    return struct.pack("<Q", len(ids)) + (ids & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + rank.tobytes(), ids[more] >> 8


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One segment."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest) or not levels:
        level, rest = _level(rest)
        levels.append(level)
    null = np.array([d is None for d in doc_ids], np.uint8)
    body = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + null.tobytes() + np.array(lengths, "<u4").tobytes() + b"".join(levels)
    return _HEAD.pack(MAGIC, VERSION, len(levels), len(doc_ids), len(ids), _HEAD.size + len(body)) + body


class Segment:
    """A segment in memory; nothing is decoded until asked for."""

    def __init__(self, blob: memoryview | bytes, at: int = 0):
        magic, version, n_levels, n_docs, self.n_ids, size = _HEAD.unpack_from(blob, at)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a segment of this format")
        self.end, pos = at + size, at + _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal pos
            out = np.frombuffer(blob, kind, n, pos)
            pos += out.nbytes
            return out

        ids, null, self.lengths = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            self.levels.append((take("u1", n), take("u1", -(-n // 64) * 8), take("<u4", -(-n // _BLOCK))))

    def access(self, i: int) -> int:
        """The id at position ``i``, from one chunk and one rank a level."""
        value, shift = 0, 0
        for chunks, bits, rank in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            start = i // _BLOCK * _BLOCK
            before = bits[start >> 3 : i >> 3]
            i = int(rank[i // _BLOCK]) + int(np.bitwise_count(before).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            shift += 8
        raise ValueError("the last level goes on")

    def decode(self) -> np.ndarray:
        """All ids."""
        out = np.zeros(self.n_ids, "<u4")
        at = slice(None)
        for j, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(8 * j)
            more = np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)
            at = np.flatnonzero(more) if j == 0 else at[more]
        return out


def segments(blob: bytes) -> Iterator[Segment]:
    view, at = memoryview(blob), 0
    while at < len(view):
        segment = Segment(view, at)
        if bytes(view[segment.end : segment.end + len(TRAILER)]) != TRAILER:
            raise ValueError("a segment is cut off")
        yield segment
        at = segment.end + len(TRAILER)


#: Writing tasks whose files are summed together.
SPAN = 4096


def write(df: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Encode ``text`` and write it in ascending order of ``doc_id``, file after file."""

    def pack_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path, fast=False), np.array([end_id], "<u4").tobytes()
        docs, lengths, parts, n = [], [], [], 0

        def close() -> pa.RecordBatch:
            out = pack(docs, lengths, np.frombuffer(b"".join(parts), "<u4"))
            docs.clear(), lengths.clear(), parts.clear()
            return pa.record_batch({"segment": pa.array([out], pa.binary())})

        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            for texts in units(batch.column(1)):
                for doc, blob in zip(itertools.islice(ids, len(texts)), enc.encode_bytes(texts)):
                    docs.append(doc)
                    lengths.append(len(blob) // 4 + 1)
                    parts += (blob, end)
                    n += lengths[-1]
                    if n >= SEGMENT_IDS:
                        n = 0
                        yield close()
        if docs:
            yield close()

    ordered = df.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    write_blobs(ordered.mapInArrow(pack_all, "segment binary"), "segment", path, TRAILER, FILE_SEGMENTS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, doc_id, at (ids before it in its file), n_tokens and ids_crc32 of every document in the files."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                at = 0
                for segment in segments(blob.as_buffer()):
                    ids, ends = segment.decode(), np.cumsum(segment.lengths, dtype=np.int64)
                    starts = ends - segment.lengths
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                    yield pa.record_batch(
                        {
                            "file": pa.array([name] * len(crc), pa.string()),
                            "doc_id": pa.array(segment.doc_ids, pa.int64()),
                            "at": pa.array(starts + at),
                            "n_tokens": pa.array(segment.lengths.astype(np.int64)),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )
                    at += segment.n_ids

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(scan, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")


def offsets(docs: DataFrame) -> DataFrame:
    """Replace each document's place in its file by its place among all ids."""
    # One row a file; the writer numbers files by their range of ids.
    digits = lambda pattern: F.regexp_extract("file", pattern, 1).cast("long")
    totals = docs.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumns({"task": digits(r"part-(\d+)[^/]*$"), "nth": digits(r"-c(\d+)[^/]*$")})
    # first over spans of files, few enough for one task, then inside each span
    totals = totals.withColumn("span", F.floor(F.col("task") / SPAN))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    spans = totals.groupBy("span").agg(F.sum("n").alias("n"))
    spans = spans.select("span", F.coalesce(F.sum("n").over(earlier(Window.orderBy("span"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(earlier(Window.partitionBy("span").orderBy("task", "nth"))), F.lit(0))
    bases = totals.withColumn("inside", inside).join(spans, "span").select("file", (F.col("base") + F.col("inside")).alias("base"))
    if bounded(totals, BROADCAST_FILES):
        bases = F.broadcast(bases)
    return docs.join(bases, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    scratch = Scratch(spark, "dac")
    write(table(spark, sf_dir, "documents"), scratch.path("files"), default_tokenizer("word_bpe_49k.json"))
    return offsets(scratch.save(read(spark, scratch.path("files")), "docs"))
