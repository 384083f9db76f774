"""Integrity checks, labels, splits and samples of a benchmark."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pantryplan.operators.retrieval import small
from pantryplan.sources.settle import settled

LABELS = ("Acceptable", "Needs clarification", "Incorrect")
SPLITS = {"dev": 0.6, "validation": 0.2, "test": 0.2}


def check(name: str, bad: DataFrame, examples: int = 10) -> DataFrame:
    """One row: status, how many rows offend, and the first of them."""
    text = F.to_json(F.struct(*bad.columns))
    place = bad.select(text.alias("e")).orderBy("e").limit(examples).agg(F.array_sort(F.collect_list("e")).alias("examples"))
    return bad.agg(F.count("*").alias("n")).crossJoin(place).select(F.lit(name).alias("check"), F.when(F.col("n") == 0, "pass").otherwise("fail").alias("status"), "n", "examples")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)


def orphans(df: DataFrame, keys: list[str], parent: DataFrame) -> DataFrame:
    return df.select(*keys).distinct().join(parent.select(*keys), keys, "left_anti")


def strangers(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*allowed)).select(column)


def label_conflicts(labels: DataFrame, by: list[str]) -> DataFrame:
    """Groups in which one product has different labels."""
    return labels.groupBy(*by).agg(F.countDistinct("label").alias("n_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels")).where("n_labels > 1")


def assign_splits(groups: list[tuple[str, str, int]], pinned: set[str] = frozenset(), seed: int = 20) -> dict[str, str]:
    """Split of each (group, mode, size): pinned ones to dev, others where most is missing; a short driver-side list."""
    order = sorted(groups)
    random.Random(seed).shuffle(order)
    total, filled, out = sum(n for _, _, n in order), {}, {}
    for name, mode, n in sorted(order, key=lambda g: g[0] not in pinned):
        slack = {s: share * total - sum(filled.get((s, m), 0) for m in ("exact", "flexible")) for s, share in SPLITS.items()}
        split = "dev" if name in pinned else max(SPLITS, key=lambda s: (slack[s], -filled.get((s, mode), 0)))
        filled[split, mode] = filled.get((split, mode), 0) + n
        out[name] = split
    return out


def sample(rows: DataFrame, by: list[str], key: list[str], fraction: float, seed: int) -> DataFrame:
    """Of each group max(1, round(n * fraction)) rows, those with the least seeded hashes of their key; halves go to the even number.

    Rows are read twice and hardly shuffled: counts by the first bits of the hash tell in
    which of 64 parts a group's sample ends. Rows of earlier parts stay as they are, and
    only those of that part are put in order.
    """
    turn = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in key)))
    marked = rows.withColumn("__turn", turn).withColumn("__part", F.shiftright(F.conv(F.left("__turn", F.lit(2)), 16, 10).cast("int"), 2))
    group = Window.partitionBy(*by)
    ends = marked.groupBy(*by, "__part").agg(F.count("*").alias("__n")).withColumn("__upto", F.sum("__n").over(group.orderBy("__part"))).withColumn("__all", F.sum("__n").over(group))
    size = F.least(F.greatest(F.lit(1), F.bround(F.col("__all") * fraction, 0)), F.col("__all"))
    ends = ends.withColumn("__size", size).where((F.col("__upto") >= F.col("__size")) & (F.col("__upto") - F.col("__n") < F.col("__size")))
    ends = settled(ends.select(*by, F.col("__part").alias("__end"), (F.col("__size") - F.col("__upto") + F.col("__n")).alias("__left")))
    near = marked.join(small(ends), by)
    whole = near.where(F.col("__part") < F.col("__end"))
    edge = near.where(F.col("__part") == F.col("__end")).withColumn("__place", F.row_number().over(group.orderBy("__turn", *key))).where(F.col("__place") <= F.col("__left"))
    return whole.select(*rows.columns).unionByName(edge.select(*rows.columns))


def sample_each(rows: DataFrame, by: list[str], key: list[str], n: int, seed: int) -> DataFrame:
    """``n`` rows of each group, or of all rows where ``by`` is empty; all where there are fewer."""
    turn = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in key)))
    if not by:
        return rows.withColumn("__turn", turn).orderBy("__turn", *key).limit(n).drop("__turn")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("__turn", *key))
    return rows.withColumn("__turn", turn).withColumn("__place", place).where(F.col("__place") <= n).drop("__turn", "__place")


def transitions(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    both = before.select(*keys, F.col("label").alias("before")).join(after.select(*keys, F.col("label").alias("after")), keys)
    return transitions_in(both)


def transitions_in(rows: DataFrame) -> DataFrame:
    """``transitions`` of rows that hold both labels (``before``, ``after``): counted where they are read, nothing is joined."""
    return rows.groupBy("before", "after").agg(F.count("*").alias("n"))
