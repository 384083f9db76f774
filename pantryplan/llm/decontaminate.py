"""Operator 3: benchmark decontamination by SimHash windows.

Columns and SQL functions only. A document holds a benchmark item if one of its
windows of as many words, laid so that a shingle of both stands at the same place
(and moved into the document where it would stick out), has a weighted Jaccard
similarity of 0.8 or more with it. Shingles are of five words (a shorter item's
whole sequence) and weigh their characters times their occurrences; letters are
compared in lower case.

1. Windows are laid where a shingle of a document stands in an item. Any other
   window shares no shingle with an item of its size and has similarity 0.
2. Each window and item has a 64-bit SimHash. Fingerprints within ``RADIUS`` bits
   differ by at most ``RADIUS // 4`` bits in one of four 16-bit blocks, so an
   index of each item's blocks with up to that many bits flipped meets every
   window within the radius on an equal block; the exact distance filters.
3. Exact weighted similarity decides.

Null and empty texts and items have no shingles and match nothing; a repeated
item or row gives its own matches. Documents with the same doc_id count as one,
with the best match of each item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pantryplan.llm.common import SEPARATORS, Scratch, bounded, table

SHINGLE = 5
RADIUS = 19
SIMILARITY = 0.8
#: Item shingles up to this many rows (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000
#: Places of up to this many documents are broadcast back to their texts.
BROADCAST_DOCS = 50_000
#: Items up to this many rows are broadcast with their shingles.
BROADCAST_ITEMS = 5_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _hashes(words: Column, k: int) -> Column:
    """Hash of the ``k`` words from each position on."""
    at = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))


def _shingles(words: Column) -> Column:
    """Shingles in order, repeats included."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - (SHINGLE - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(many)


def simhash(shingles: Column) -> Column:
    """Bit b is set where the weights of shingles with that bit outweigh the others."""
    weighted = F.transform(shingles, lambda s: F.struct(F.xxhash64(s).alias("h"), F.char_length(s).cast("long").alias("w")))
    bit = lambda b: F.aggregate(weighted, F.lit(0).cast("long"), lambda acc, x: acc + F.when(F.getbit(x["h"], b) == 1, x["w"]).otherwise(-x["w"]))
    # shiftleft takes a constant, so a set bit is carried by doubling; the last step may wrap into the sign.
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(F.when(bit(F.lit(63) - b) > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two shingle arrays; 0 where both are empty."""
    count = lambda xs, s: F.size(F.filter(xs, lambda x: x == s)).cast("double")
    both = F.array_union(a, b)
    total = lambda pick: F.aggregate(both, F.lit(0.0), lambda acc, s: acc + F.char_length(s) * pick(count(a, s), count(b, s)))
    return F.coalesce(F.try_divide(total(F.least), total(F.greatest)), F.lit(0.0))


def _blocks(h: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.struct(j.alias("block"), F.element_at(F.array(*(F.shiftrightunsigned(h, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4))), j + 1).alias("bits")))


def _items(items: DataFrame) -> DataFrame:
    words = items.select("item_id", _words(F.col("text")).alias("iw")).where(F.size("iw") > 0)
    return words.select("item_id", "iw", F.size("iw").alias("n"), _shingles(F.col("iw")).alias("item_shingles")).withColumn("item_hash", simhash(F.col("item_shingles")))


def _windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct item-sized windows of documents that share a shingle with an item of that size."""
    sizes = sorted(r.k for r in items.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect())
    words = docs.select("doc_id", _words(F.col("text")).alias("w"))
    places = words.select("doc_id", F.lit(0).alias("n"), F.lit(0).alias("start")).limit(0)
    for k in sizes:
        keys = items.where(F.col("n") >= k if k == SHINGLE else F.col("n") == k).select("n", F.posexplode(_hashes(F.col("iw"), k)).alias("offset", "hash")).distinct()
        keys = F.broadcast(keys) if bounded(keys, BROADCAST_SHINGLES) else keys
        # words stay behind here: a generator would copy them to each position
        at = words.select("doc_id", F.posexplode(_hashes(F.col("w"), k)).alias("pos", "hash"))
        places = places.unionByName(at.join(keys, "hash").select("doc_id", "n", (F.col("pos") - F.col("offset")).alias("start")))
    scratch = Scratch(docs.sparkSession, "places")
    places = scratch.save(places.groupBy("doc_id").agg(F.collect_set(F.struct("n", "start")).alias("places")), "places")
    places = F.broadcast(places) if bounded(places, BROADCAST_DOCS) else places
    held = words.alias("d").join(places.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))).select("d.doc_id", "w", "places")

    def window(x: Column) -> Column:
        start = F.greatest(F.least(x["start"], F.size("w") - x["n"]), F.lit(0))
        return F.struct(x["n"].alias("n"), start.alias("start"), F.array_join(F.slice("w", start + 1, x["n"]), " ").alias("window"))

    return held.select("doc_id", F.inline(F.transform("places", window))).groupBy("doc_id", "n", "window").agg(F.min("start").alias("start"))


def contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, least: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, start_word and n_words of every document that holds an item."""
    items = Scratch(docs.sparkSession, "items").save(_items(benchmark), "items")
    windows = _windows(docs, items).withColumn("shingles", _shingles(F.split("window", " "))).withColumn("hash", simhash(F.col("shingles")))
    probes = windows.select("doc_id", "n", "start", "shingles", "hash", F.inline(_blocks(F.col("hash"))))
    masks = F.expr(f"filter(sequence(0, 65535), x -> bit_count(x) <= {radius // 4})")
    index = items.select("item_id", "n", "item_hash", F.inline(_blocks(F.col("item_hash"))))
    index = index.select("item_id", "n", "item_hash", "block", "bits", F.explode(masks).alias("mask")).withColumn("bits", F.col("bits").bitwiseXOR(F.col("mask"))).drop("mask")
    # A plan doesn't see how far the masks spread an item, and must not broadcast the index.
    near = probes.join(index.hint("merge"), ["n", "block", "bits"]).where(F.bit_count(F.col("hash").bitwiseXOR(F.col("item_hash"))) <= radius)
    texts = items.select("item_id", "n", "item_hash", "item_shingles")
    texts = F.broadcast(texts) if bounded(texts, BROADCAST_ITEMS) else texts
    scored = near.drop("block", "bits").join(texts, ["item_id", "n", "item_hash"]).withColumn("similarity", weighted_similarity(F.col("shingles"), F.col("item_shingles"))).where(F.col("similarity") >= least)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("neg"), "n")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.similarity").alias("similarity"), (-F.col("m.neg")).alias("start_word"), F.col("m.n").alias("n_words"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
