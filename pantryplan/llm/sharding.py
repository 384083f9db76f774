"""Operator 11: a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual`` points of a ring of 64-bit hashes. Rows are served in
the order of a hash of their own; a row goes to the shard of the first point at or
after its key's hash, and on clockwise past the points of shards that are full. A
shard takes its even share of the rows at ``slack`` 0 (then counts are at most one
apart, law ``rows``), else up to 1 + slack times that.

Serving one row after another isn't needed: which shards are full changes only when
one fills. Between two such moments a row's shard is a function of its arc, so the
work is to find, for each shard that fills, the row that fills it. Rows are numbered
in the order of service once, and that number is searched by counting rows by block
and shard, a thousandfold narrower at each step. What reaches the driver are those
counts, BLOCKS a shard at most, and the ring.

- A null key is placed by a hash of its ``ties``. Equal keys start at one point; a key
  with a third of all rows fills shards clockwise like any other load.
- Equal rows are told apart by their place in the input, so none is lost.
- Empty tables have no rows; fewer rows than shards leave shards empty.
- A column named like ``out`` is replaced; other columns stay.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pantryplan.llm.common import Scratch, table

#: Blocks that one step of the search counts.
BLOCKS = 1024
#: The ring is looked up by the leading bits of a hash.
CELL_BITS = 12
LOW, HIGH = -(2**63), 2**63 - 1


def ring_points(shards: int, virtual: int) -> list[tuple[int, int]]:
    """point and shard of every virtual node, clockwise. A shard's points do not depend on how many shards there are."""
    point = lambda s, i: int.from_bytes(hashlib.blake2b(f"{s}:{i}".encode(), digest_size=8).digest(), "big", signed=True)
    return sorted((point(s, i), s) for s in range(shards) for i in range(virtual))


def arc_table(points: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """cell, first, last, arc: which arc the hashes of a cell lie in. An arc ends at its point; what is behind the last point is of arc 0."""
    at, rows, step = [p for p, _ in points], [], 1 << (64 - CELL_BITS)
    for cell in range(LOW // step, HIGH // step + 1):
        low, high = cell * step, cell * step + step - 1
        for i in range(bisect_left(at, low), bisect_left(at, high) + 1):
            first = max(low, at[i - 1] + 1) if i else low
            last = min(high, at[i]) if i < len(at) else high
            if first <= last:
                rows.append((cell, first, last, i % len(at)))
    return rows


def owners(points: list[tuple[int, int]], full: set[int]) -> list[int]:
    """The shard of each arc: that of its point, or the next clockwise that isn't full."""
    out, shard = [0] * len(points), -1
    for i in [*range(len(points) - 1, -1, -1)] * 2:
        shard = shard if points[i][1] in full else points[i][1]
        out[i] = shard
    return out


def capacities(n: int, shards: int, slack: float) -> np.ndarray:
    """Rows that each shard takes."""
    if slack > 0:
        return np.full(shards, int(np.ceil((1 + slack) * n / shards)))
    return np.array([n // shards + (s < n % shards) for s in range(shards)])


def _filled(rows: DataFrame, loads: np.ndarray, room: np.ndarray, low: int, high: int) -> tuple[int, np.ndarray] | None:
    """The number of the first row, from ``low`` on, that fills a shard, and the loads with it; None if none does."""
    while low < high:
        width = -(-(high - low) // BLOCKS)
        block = F.floor((F.col("rank") - low) / width).cast("int").alias("block")
        seen = rows.where((F.col("rank") >= low) & (F.col("rank") < high)).groupBy(block, "shard").count().collect()
        counts = np.zeros((BLOCKS, len(loads)), np.int64)
        for b, shard, n in seen:
            counts[b, shard] = n
        upto = loads + np.cumsum(counts, axis=0)
        over = np.flatnonzero(((upto >= room) & (loads < room)).any(axis=1))
        if not len(over):
            return None
        at = int(over[0])
        if width == 1:
            return low + at, upto[at]
        loads = upto[at] - counts[at]
        low, high = low + at * width, min(high, low + (at + 1) * width)
    return None


def place(rows: DataFrame, key: str, shards: int = 8, virtual: int = 128, slack: float = 0.0, ties: tuple[str, ...] = (), out: str = "placed") -> DataFrame:
    """Add a struct of ``shard``, ``slot`` (gapless from 0 in each shard) and ``home`` (the shard if none were full).

    ``key`` and ``ties`` alone decide a row's hashes. All columns of ``rows`` move
    through three shuffles, so pass narrow rows. One search runs for each shard that
    fills: meant for up to some hundreds of shards.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "ring")
    points = ring_points(shards, virtual)
    arcs = F.broadcast(spark.createDataFrame(arc_table(points), "cell int, first long, last long, arc int"))  # shards * virtual + 2 ** CELL_BITS rows
    point = F.when(F.col(key).isNull(), F.xxhash64(F.lit("no key"), *ties)).otherwise(F.xxhash64(key))
    hashed = rows.select(F.struct(*rows.columns).alias("row"), point.alias("point"), F.xxhash64(F.lit("order"), key, *ties).alias("turn"), F.monotonically_increasing_id().alias("nth"))
    at = (F.shiftright("point", 64 - CELL_BITS) == F.col("cell")) & F.col("point").between(F.col("first"), F.col("last"))
    served = scratch.save(hashed, "hashed").join(arcs, at).select("row", "arc", "turn", "nth")
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    served = scratch.save(served.repartitionByRange("turn", "nth").sortWithinPartitions("turn", "nth").select("row", "arc", F.spark_partition_id().alias("part"), inside.alias("inside")), "served")
    # one row a task of the sort
    parts = served.groupBy("part").count().withColumn("base", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
    ranked = scratch.save(served.join(F.broadcast(parts), "part").select("row", "arc", (F.col("base") + F.col("inside")).alias("rank")), "ranked")
    scratch.drop("hashed", "served")

    n = ranked.count()
    room, loads, low, phases, ends = capacities(n, shards, slack), np.zeros(shards, np.int64), 0, [], []
    while True:
        full = {s for s in range(shards) if loads[s] >= room[s]}
        if len(full) == shards:
            break
        phases.append(owners(points, full))
        owned = spark.createDataFrame(list(enumerate(phases[-1])), "arc int, shard int")
        found = _filled(ranked.select("rank", "arc").join(F.broadcast(owned), "arc"), loads, room, low, n) if len(full) < shards - 1 else None
        if not found:
            break
        ends.append(found[0])
        low, loads = found[0] + 1, found[1]

    home = owners(points, set())
    table_ = spark.createDataFrame([(k, a, s, home[a]) for k, phase in enumerate(phases) for a, s in enumerate(phase)], "phase int, arc int, shard int, home int")
    phase = reduce(add, ((F.col("rank") > e).cast("int") for e in ends), F.lit(0))
    width = max(4096, n >> 20)
    placed = ranked.withColumns({"phase": phase, "block": F.floor(F.col("rank") / width)}).join(F.broadcast(table_), ["phase", "arc"])
    before = placed.groupBy("shard", "block").count()
    before = before.select("shard", "block", (F.sum("count").over(Window.partitionBy("shard").orderBy("block")) - F.col("count")).alias("base"))
    nth = F.row_number().over(Window.partitionBy("shard", "block").orderBy("rank")) - 1
    done = placed.withColumn("nth", nth).join(before, ["shard", "block"])
    cells = F.struct("shard", (F.col("base") + F.col("nth")).alias("slot"), "home").alias(out)
    return done.select(*(F.col("row")[c].alias(c) for c in rows.columns if c != out), cells)


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards by law ``rows``: full shards pass rows on, so counts are at most one apart; copies are rows of their own."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    done = place(docs, "doc_id", shards=8, ties=("size", "text_crc32"))
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "placed.shard", "placed.slot", F.lit(None).cast("int").alias("grown_shard"), "placed.home")
