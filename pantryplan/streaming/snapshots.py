"""Snapshots that arrive as files: the state of the greatest snapshot, kept up incrementally.

A folder is read as a stream; each item's newest state is kept with its snapshot,
and what is read out are the items of the greatest snapshot seen so far, so that an
item which is gone from it isn't brought back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pantryplan.functions.stock import classify

SCHEMA = "item_id string, event_id long, snapshot_id string, stock_status string"


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def newest(events: DataFrame) -> DataFrame:
    last = events.groupBy("item_id").agg(F.max_by(F.struct("snapshot_id", "stock_status"), F.struct("snapshot_id", "event_id")).alias("s"))
    return last.select("item_id", "s.snapshot_id", classify(F.col("s.stock_status")).alias("stock")).select("item_id", "snapshot_id", "stock.*")


def current(kept: DataFrame) -> DataFrame:
    """The items of the greatest snapshot among the states that ``keep_up`` keeps."""
    last = F.broadcast(kept.agg(F.max("snapshot_id").alias("snapshot_id")))  # one row
    return kept.join(last, "snapshot_id", "left_semi")


def keep_up(spark: SparkSession, path: str, table: str, checkpoint: str) -> StreamingQuery:
    """Run until the files that are there have been read; the states that a batch changes go to its own folder of ``table``.

    A batch that is tried again overwrites its folder, so that no state counts twice.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    return newest(read_snapshots(spark, path)).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_states(spark: SparkSession, table: str) -> DataFrame:
    """Each item's state after the last batch that changed it."""
    rows = spark.read.option("basePath", table).parquet(table)
    own = [c for c in rows.columns if c not in ("item_id", "batch")]
    return rows.groupBy("item_id").agg(F.max_by(F.struct(*own), "batch").alias("s")).select("item_id", "s.*")
