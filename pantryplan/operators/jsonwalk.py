"""Walks over JSON documents of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantryplan.sources.settle import settled


def walk(docs: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """``path``, ``name``, ``value`` (JSON text), ``depth`` and ``place`` of every scalar of the JSON text in ``column``, beside ``keys``.

    One level at a time: each round explodes the objects and lists of a level into
    the next, until a level is empty, so there are as many rounds as the deepest
    document has levels. ``place`` orders lists as written and the fields of an
    object by name, as a VARIANT keeps them. Text that isn't JSON, null and empty
    objects and lists have no scalars; the last value of a repeated name counts.
    """
    spark, scalars = docs.sparkSession, []
    level = docs.select(*keys, F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.array().cast("array<int>").alias("place"), F.try_parse_json(column).alias("node")).where("node is not null")
    while True:
        below = level.lateralJoin(spark.tvf.variant_explode_outer(F.col("node").outer()))
        step = F.when(F.isnull("key"), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("key").rlike("^[A-Za-z0-9_]+$"), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit('."'), "key", F.lit('"')))
        # what explodes into nothing is a scalar, or empty
        below = settled(below.select(*keys, "path", "name", "place", "node", "pos", "key", F.col("value").alias("inner"), step.alias("step")))
        value = F.to_json("node")
        scalars.append(below.where("pos is null").select(*keys, "path", "name", value.alias("value"), F.size("place").alias("depth"), "place").where("value not in ('{}', '[]')"))
        level = below.where("pos is not null").select(*keys, F.concat("path", "step").alias("path"), F.coalesce("key", F.col("pos").cast("string")).alias("name"), F.concat("place", F.array("pos")).alias("place"), F.col("inner").alias("node"))
        if level.isEmpty():
            break
    out = scalars[0]
    for more in scalars[1:]:
        out = out.unionByName(more)
    return out
