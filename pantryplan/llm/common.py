"""What the operators share: table access, shared scratch storage, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that separate words, as a Java and Python character class.
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark alone (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches for rows that hold whole texts: ten thousand of those would fill a worker's memory.

    A smaller setting of the session stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def release_memory() -> None:
    """Give memory that Arrow and the C library hold as free back to the system: a Python worker lives on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            base = current
        elif not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            base = f"file://{tempfile.mkdtemp(prefix='pantryplan-')}"
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder.

    ``save`` cuts the lineage: a lost executor costs at most a re-read. ``drop``
    frees a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_base(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def bounded(df: DataFrame, limit: int) -> bool:
    """Whether a table has at most ``limit`` rows, reading no more than that."""
    return df.limit(limit + 1).count() <= limit


def write_blobs(df: DataFrame, column: str, path: str, trailer: bytes, file_rows: int = 0) -> None:
    """Write a binary column as raw bytes, each row followed by ``trailer``.

    Spark's text writer copies a string's bytes as they are, and a binary value
    cast to string keeps its bytes, so this is a binary sink with Spark's own
    commit protocol on any file system: a lost or repeated task leaves no
    partial file. A file has at most ``file_rows`` rows, where that is given.
    """
    blob = df.select(df[column].cast("string").alias("value"))
    blob.write.mode("overwrite").option("maxRecordsPerFile", file_rows).option("encoding", "ISO-8859-1").option("lineSep", trailer.decode("latin-1")).text(path)
