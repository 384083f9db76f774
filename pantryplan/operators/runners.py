"""Prediction records of many baselines in one plan, their resumable sink, and the comparison of two selections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pantryplan.functions import identity
from pantryplan.operators import gates, policies

SCHEMA = "baseline string, search string, by_dimension boolean, by_size boolean, by_identity boolean, floor double"
KEYS = ("experiment", "baseline", "request_id")


def records(requests: DataFrame, found: DataFrame, baselines: DataFrame) -> DataFrame:
    """experiment, baseline, request_id, response, n_survivors, top_score and ids for every request and baseline.

    ``found`` holds the lists of each (experiment, search) once, with the products'
    fields; a baseline is a row that names its search, its gates and its floor, so a
    search serves all baselines that use it. ``baselines`` is a short list.
    """
    both = found.join(F.broadcast(baselines.drop("floor")), "search").join(requests.drop("needs_review", "text"), "request_id")
    passes = ~F.col("by_dimension") | gates.same_or_unknown(F.col("dimension"), F.col("dimension_"))
    passes = passes & (~F.col("by_size") | gates.size_fits(F.col("asked"), F.col("asked_unit"), F.col("size"), F.col("unit")))
    who = gates.identity(F.col("mode"), F.col("brand"), F.col("brand_"), identity.variants_conflict(F.col("variants"), F.col("variants_")))
    tag = F.when(~passes, "drop").when(F.col("by_identity"), who).otherwise("keep")
    asked = requests.select("request_id", "needs_review").crossJoin(F.broadcast(baselines.select("baseline", "floor"))).crossJoin(F.broadcast(found.select("experiment").distinct()))
    return policies.decide(asked, both.withColumn("tag", tag).where("tag <> 'drop'"), F.col("floor"), by=KEYS)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_missing(spark: SparkSession, path: str, baselines: DataFrame, plan: Callable[[DataFrame], DataFrame], again: tuple[str, ...] = ()) -> int:
    """Write the records of baselines that ``path`` doesn't hold yet, and of those in ``again``; how many were.

    A folder of JSON lines for each baseline. A folder appears when the job that
    filled it has ended, so what is there is whole, and a run that was stopped goes on
    with the rest. The others' files are not touched.
    """
    todo = baselines
    if exists(spark, path):
        there = spark.read.schema("request_id long, baseline string").json(path).select("baseline").distinct()
        todo = baselines.join(there.where(~F.col("baseline").isin(*again)), "baseline", "left_anti")
    n = todo.count()
    if n:
        plan(todo).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("baseline").json(path)
    return n


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("experiment string, request_id long, response string, n_survivors int, top_score double, ids string, baseline string").json(path)


def new_pairs(found: DataFrame, labelled: DataFrame, k: int = policies.TOP) -> DataFrame:
    """Pairs that any baseline's first ``k`` of the whole catalog hold and no label does, blind to who found them."""
    ids = F.explode(F.slice(F.split("ids", ","), 1, k))
    pairs = found.where("experiment = 'full_catalog' and ids is not null").select("request_id", ids.alias("id"))
    pairs = pairs.select("request_id", F.split_part("id", F.lit("/"), F.lit(1)).cast("long").alias("store_id"), F.split_part("id", F.lit("/"), F.lit(2)).alias("product_id")).distinct()
    return pairs.join(labelled, ["request_id", *policies.ID], "left_anti")


# --- two selections -------------------------------------------------------------------------------


def selection_delta(before: DataFrame, after: DataFrame, keys: list[str], every: DataFrame) -> DataFrame:
    """What a second selection changes: a row for each of ``every`` key, with ``change`` and ``saved_cents``.

    Selections have the keys, product_id and cost_cents; a row without a cost is not
    priced. Changes are same, cheaper, dearer, even (another product at one cost), gained,
    lost and neither. Null keys are keys like any other.
    """
    one = lambda df, tag: df.where("cost_cents is not null").select(*(F.col(k).alias(f"{tag}_{k}") for k in keys), F.col("product_id").alias(f"{tag}_product"), F.col("cost_cents").alias(f"{tag}_cents"))
    a, b = one(before, "before"), one(after, "after")
    meet = lambda other, tag: [every[k].eqNullSafe(other[f"{tag}_{k}"]) for k in keys]
    out = every.select(*keys).join(a, meet(a, "before"), "left").join(b, meet(b, "after"), "left")
    saved: Column = F.col("before_cents") - F.col("after_cents")
    change = (
        F.when(F.isnull("before_cents") & F.isnull("after_cents"), "neither").when(F.isnull("before_cents"), "gained").when(F.isnull("after_cents"), "lost")
        .when(F.col("before_product") == F.col("after_product"), F.when(saved == 0, "same").when(saved > 0, "cheaper").otherwise("dearer")).when(saved > 0, "cheaper").when(saved < 0, "dearer").otherwise("even")
    )
    return out.select(*keys, "before_product", "before_cents", "after_product", "after_cents", change.alias("change"), saved.alias("saved_cents"))


def delta_summary(delta: DataFrame, by: list[str]) -> DataFrame:
    return delta.groupBy(*by, "change").agg(F.count("*").alias("n"), F.coalesce(F.sum("saved_cents"), F.lit(0)).cast("long").alias("saved_cents"))
