"""Tables that a query reads several times, kept in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder beside the checkpoints, for files that a query writes and reads back."""
    if not spark.sparkContext.getCheckpointDir():
        settled(spark.range(0))
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint: computed once, read again after a lost executor, and short to plan.

    The folder is that of the session's ``spark.checkpoint.dir``; a temporary one is
    taken only on a local master where none is set.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if base is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(base or f"file://{tempfile.mkdtemp(prefix='pantryplan-')}")
    return df.checkpoint()
