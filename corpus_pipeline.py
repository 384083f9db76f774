"""A corpus-cleaning pipeline: rules, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept
and returns rows with the columns of ``documents``; the last adds token columns.
Rows are only dropped by a stage's own verdict:

- quality_rules: rows that fail the base rules or the isolation forest go.
- line_dedup: later copies of repeated runs of more than 50 words go; a row of
  which nothing is left goes with them, being a copy all through.
- near_dedup: of each group of near duplicates (five-word shingles, 0.8) the row
  with the smallest doc_id stays.
- decontaminate: rows that hold a benchmark item go.
- bpe: token ids of the whole text, their number and whether they decode to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pantryplan.llm import bpe, decontaminate, linededup, neardup, rules
from pantryplan.llm.common import Scratch, table, text_batches
from pantryplan.llm.graph import without

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the base rules or the forest go; null and empty texts fail. Without labels of both kinds only the base rules judge."""
    text_batches(spark)
    judged = rules.verdicts(docs, rules.fit(docs, table(spark, sf_dir, "labels")), out="__rules")
    return judged.where("__rules.kept").drop("__rules")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs go, and rows of which nothing is left. Null and empty texts stay; equal rows are one document; ``n_chars`` follows the text."""
    text_batches(spark)
    out = linededup.dedup_lines(docs, lines_col="__lines", deleted_col="__deleted").where("__deleted = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("__deleted") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group stays. Rows without words or without doc_id stay; rows with one doc_id share their fate."""
    text_batches(spark)
    found = neardup.near_duplicates(docs, width=5, percent=80)
    return without(docs, found.where("not kept").select("doc_id").distinct())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, one with a null doc_id like any other; rows with one doc_id share their fate."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, Scratch(spark, "contaminated").save(found.select("doc_id").distinct(), "ids"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids, n_tokens and round_trip, in place of columns with these names; null and empty texts have no ids."""
    text_batches(spark)
    coded = bpe.round_trip(docs, bpe.default_tokenizer(), "text", "__coded")
    same = F.col("__coded.decoded").eqNullSafe(F.coalesce("text", F.lit("")))
    added = {"token_ids": F.col("__coded.ids"), "n_tokens": F.size("__coded.ids").cast("long"), "round_trip": same}
    return coded.withColumns(added).drop("__coded")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontamination),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each but the last written to the shared folder and read again. Equal rows share their fate; an empty table gives no rows."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs, name)
    return docs
