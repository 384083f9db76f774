"""Operator 4: BPE encoding and decoding of a text column.

``encode`` adds the token ids of whole texts, ``decode`` the text of token ids.
Null and empty texts have no ids and decode to the empty text; equal rows are coded
each. Rows are not moved, so a lost executor only repeats its own tasks. Only a
text of more than DEALT_CHARS is: ``round_trip`` deals its parts over tasks, which encode
them side by side, and one task joins their ids, re-encoding a window at each join.
A column named like the added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from pantryplan.llm.common import Scratch, table, text_batches
from pantryplan.llm.tokens import decode as decode_ids
from pantryplan.llm.tokens import encoder, token_table

#: Texts of one unit of work hold at most so many characters (one longer text is a unit of its own).
UNIT_CHARS = 4_000_000
#: Texts of more characters are dealt over tasks in parts of so many.
DEALT_CHARS, PART_CHARS = 1_000_000, 250_000


def units(array: pa.Array) -> Iterator[list]:
    unit, n = [], 0
    for text in array.to_pylist():
        unit.append(text)
        n += len(text or "")
        if n >= UNIT_CHARS:
            yield unit
            unit, n = [], 0
    yield unit


def encode_column(text: Column, tokenizer_path: str, leaf_chars: int = 2048) -> Column:
    """Token ids as array<int>."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(tokenizer_path, leaf_chars)
        for batch in batches:
            parts, lengths = [], [np.zeros(1, np.int64)]
            for unit in units(batch):
                blobs = enc.encode_bytes(unit)
                lengths.append(np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4)
                parts.append(b"".join(blobs))
            offsets = np.cumsum(np.concatenate(lengths)).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))

    return ids(text)


def decode_column(ids: Column, tokenizer_path: str) -> Column:
    """The text of token ids; null ids give null."""

    @F.arrow_udf(StringType())
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bytes_of = token_table(tokenizer_path)
        for batch in batches:
            yield pa.array([None if x is None else decode_ids(x.values.to_numpy(zero_copy_only=False).tolist(), bytes_of) for x in batch], pa.string())

    return text(ids)


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", leaf_chars: int = 2048) -> DataFrame:
    return df.withColumn(ids_col, encode_column(F.col(text_col), tokenizer_path, leaf_chars))


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    return df.withColumn(text_col, decode_column(F.col(ids_col), tokenizer_path))


def round_trip_column(text: Column, tokenizer_path: str, leaf_chars: int = 2048) -> Column:
    """struct(ids, decoded) of a text: both ways in one Python task."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc, bytes_of = encoder(tokenizer_path, leaf_chars), token_table(tokenizer_path)
        for batch in batches:
            offsets, parts, decoded = [0], [], []
            for unit in units(batch):
                for blob in enc.encode_bytes(unit):
                    ids = np.frombuffer(blob, "<i4")
                    parts.append(ids)
                    offsets.append(offsets[-1] + len(ids))
                    decoded.append(decode_ids(ids.tolist(), bytes_of))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, "<i4"), *parts])))
            yield pa.StructArray.from_arrays([ids, pa.array(decoded, pa.string())], names=["ids", "decoded"])

    return both(text)


def round_trip(df: DataFrame, tokenizer_path: str, text_col: str, out: str) -> DataFrame:
    """Add ``out``, a struct of ids and decoded text; texts of more than DEALT_CHARS characters are encoded in parallel parts."""
    df, long_ = df.drop(out), F.coalesce(F.octet_length(text_col) > DEALT_CHARS, F.lit(False))
    if df.where(long_).isEmpty():
        return df.withColumn(out, round_trip_column(F.col(text_col), tokenizer_path))
    near = df.where(~long_).withColumn(out, round_trip_column(F.col(text_col), tokenizer_path))
    kept = Scratch(df.sparkSession, "bpe").save(df.where(long_).select(F.struct(*df.columns).alias("row"), F.monotonically_increasing_id().alias("nth")), "long")
    rows = kept.select("nth", F.col("row")[text_col].alias("text"))

    @F.arrow_udf("array<struct<part:int,start:bigint,piece:string>>")
    def parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            cut = []
            for text in batch.to_pylist():
                at = enc.cuts(text, PART_CHARS)
                cut.append([{"part": i, "start": a, "piece": text[a:b]} for i, (a, b) in enumerate(zip(at, at[1:]))])
            yield pa.array(cut, pa.list_(pa.struct({"part": pa.int32(), "start": pa.int64(), "piece": pa.string()})))

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def joined(lists: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        enc, bytes_of = encoder(tokenizer_path), token_table(tokenizer_path)
        for texts, batch in lists:
            out = []
            for text, nodes in zip(texts.to_pylist(), batch.to_pylist()):
                ends = [n["start"] for n in nodes[1:]] + [len(text)]
                ids = enc.joined(text, [(n["start"], b, np.array(n["ids"], "<u4")) for n, b in zip(nodes, ends)]).tolist()
                out.append({"ids": ids, "decoded": decode_ids(ids, bytes_of)})
            yield pa.array(out, pa.struct({"ids": pa.list_(pa.int32()), "decoded": pa.string()}))

    dealt = rows.select("nth", F.explode(parts(F.col("text"))).alias("p")).select("nth", "p.*").repartition("nth", "part")
    coded = dealt.withColumn("ids", encode_column(F.col("piece"), tokenizer_path)).groupBy("nth").agg(F.array_sort(F.collect_list(F.struct("part", "start", "ids"))).alias("nodes"))
    far = kept.join(coded, "nth").withColumn(out, joined(F.col("row")[text_col], F.col("nodes")))
    return near.unionByName(far.select(*(F.col("row")[c].alias(c) for c in df.columns), out))


def digests(df: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of a table of documents."""
    coded = round_trip(df.select("doc_id", "text"), tokenizer_path, "text", "c").select("doc_id", "c.*")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def default_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return digests(table(spark, sf_dir, "documents"), default_tokenizer())
