"""Connected components and removal by id, with nothing collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantryplan.llm.common import Scratch, bounded

#: Ids up to this many rows (8 bytes each) are broadcast.
BROADCAST_IDS = 500_000


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """node and component (the smallest node reachable) of every node that has an edge.

    Alternating large-star and small-star steps; each round is a table in the
    shared folder. Edges have two non-null numbers ``u`` and ``v``.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    e, last, turn = scratch.save(e, f"{label}0"), None, 0
    while True:
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        last = seen
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("s")).select("s.*").where("a <> b").distinct()
        e = scratch.save(small, f"{label}{turn + 1}")
        scratch.drop(f"{label}{turn}")
        turn += 1


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key is not among ``ids``, of which a null is one like any other; texts move only where the ids are too many to broadcast."""
    ids = ids.select(F.col(key).alias("__gone"))
    if bounded(ids, BROADCAST_IDS):
        ids = F.broadcast(ids)
    return docs.join(ids, docs[key].eqNullSafe(ids["__gone"]), "left_anti")
