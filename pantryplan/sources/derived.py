"""Tables that grow by files, and tables that are built again only when what they come from has changed."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pantryplan.operators.runners import exists
from pantryplan.operators.validation import digest


def append_rows(rows: DataFrame, path: str) -> None:
    """Add rows of text columns as new files; their columns need not be those of older files, which stay as they are."""
    rows.select(*(F.col(c).cast("string").alias(c) for c in rows.columns)).write.mode("append").parquet(path)


def read_appended(spark: SparkSession, path: str, columns: tuple[str, ...] = (), time: str = "scraped_at") -> DataFrame:
    """All rows with the columns of all files, or those in ``columns``; what a file lacks is blank, and its ``time`` that at which the file was written."""
    rows = spark.read.option("mergeSchema", True).parquet(path).select("*", F.col("_metadata.file_modification_time").alias("__written"))
    names = columns or tuple(dict.fromkeys([time, *(c for c in rows.columns if c != "__written")]))
    written = F.date_format("__written", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    value = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    return rows.select(*((F.when(value(c) == "", written).otherwise(value(c)) if c == time else value(c)).alias(c) for c in names))


def cache_key(rows: DataFrame, columns: list[str], params: dict) -> str:
    """A key that changes with any row, with its order where ``columns`` hold one, and with any parameter."""
    sha = digest(rows, columns).first().sha256
    return spark_sha(rows.sparkSession, f"{sha}|{json.dumps(params, sort_keys=True)}")


def spark_sha(spark: SparkSession, text: str) -> str:
    return spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0]


def load_or_build(rows: DataFrame, columns: list[str], params: dict, path: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``build`` makes of ``rows``, from the folder of their key if it is there, else built and written to it.

    A build that was stopped has no ``_SUCCESS`` and is made anew; other keys' folders stay.
    """
    folder = f"{path}/{cache_key(rows, columns, params)}"
    if not exists(rows.sparkSession, f"{folder}/_SUCCESS"):
        build(rows).write.mode("overwrite").parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def write_csv(rows: DataFrame, path: str, fields: tuple[str, ...]) -> None:
    """Files with a header and just ``fields``, in this order; nulls are blank, a quote is doubled, and line ends inside of values stay."""
    rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields)).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_csv(spark: SparkSession, path: str, fields: tuple[str, ...]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in fields)
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in fields))
