"""Operator 10: deletion of repeated line runs by distributed prefix doubling.

A run is a sequence of whole lines of one document (texts are split at \\n). Runs
of more than ``words`` words (a blank line has none) that occur again, in the same
or another document, are kept where they first occur, by (doc_id, place), and
deleted elsewhere: a line goes if it is in such a run that has an earlier
occurrence. Shorter repeated lines stay.

1. Lines are named by two hashes and their length; only those that occur twice can
   be in a repeated run, and only those in consecutive repeated lines with more than
   ``words`` words go on. The most frequent lines (each a thousandth of all, so a
   thousand at most) are matched by broadcast, not by a shuffle on their name.
2. Prefix doubling: level k ranks the runs of 2^k lines. A level is ranked by the
   pairs of ranks of the level before, over the distinct pairs in sorted order, so
   ranks sort as the suffixes do; pairs that occur once leave.
3. Runs with one rank pair are an interval of the suffix array whose longest common
   prefix is at least their length. Any run is two overlapping runs of a level, so
   their ranks and its length name it. The shortest runs over ``words`` words from
   each line on, and those up to each line, together cover just the lines of all
   longer repeated runs; the least place in each interval is its first occurrence.

Rows with equal doc_id and text are one document, as are their lines' fates; a
null doc_id comes first. Null and empty texts have no runs and stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pantryplan.llm.common import Scratch, bounded, table, text_batches

#: Deletions of up to this many documents are broadcast to their texts.
BROADCAST_DOCS = 50_000
#: Lines that are this part of all repeated ones and more are matched by broadcast.
HOT = 1_000
KEY = ["doc", "row"]


def _shortest(lines: Column, words: int) -> Column:
    """From (pos, words) of a document's repeated lines: the shortest runs over ``words`` words, and the places that they cover."""
    kind = "struct<runs:array<struct<start:int,length:int,level:int>>,places:array<int>>"
    run = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("level", pa.int32())])

    @F.arrow_udf(kind)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for doc in batch:
                pos = doc.values.field("pos").to_numpy(zero_copy_only=False)
                total = np.concatenate([[0], np.cumsum(doc.values.field("words").to_numpy(zero_copy_only=False))])
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(pos) != 1) + 1, [len(pos)]])
                segment = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                first, last = cuts[segment], cuts[segment + 1]
                at = np.arange(len(pos))
                stop = np.searchsorted(total, total[at] + words, "right")  # the least with more words than that since ``at``
                start = np.searchsorted(total, total[at + 1] - words, "left") - 1
                runs = {(int(a), int(b)) for a, b in zip(at[stop <= last], stop[stop <= last])}
                runs |= {(int(a), int(b) + 1) for a, b in zip(start[start >= first], at[start >= first])}
                depth = np.zeros(len(pos) + 1, int)
                for a, b in runs:
                    depth[a] += 1
                    depth[b] -= 1
                found = [{"start": int(pos[a]), "length": b - a, "level": (b - a).bit_length() - 1} for a, b in sorted(runs)]
                out.append({"runs": found, "places": pos[np.cumsum(depth[:-1]) > 0].tolist()})
            yield pa.array(out, pa.struct([("runs", pa.list_(run)), ("places", pa.list_(pa.int32()))]))

    return find(lines)


def _row(text: Column) -> Column:
    return F.xxhash64(text)


def _doc(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)))


def repeated_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, row, pos, words and rank (a number of the line) of every line that occurs more than once."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select(_doc(F.col("doc_id")).alias("doc"), _row(text).alias("row"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    name = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.char_length("line").alias("chars")]
    lines = lines.select(*KEY, "pos", *name, F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    again = lines.groupBy("h1", "h2", "chars").agg(F.count("*").alias("n")).where("n > 1").withColumn("rank", F.monotonically_increasing_id())
    again = scratch.save(again, "again")
    total = again.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT >= total
    often, seldom = (again.where(c).drop("n") for c in (hot, ~hot))
    held = lines.join(F.broadcast(often.withColumnRenamed("rank", "known")), ["h1", "h2", "chars"], "left")
    # a line whose number is known is dealt out by its place and meets nothing
    dealt = F.when(F.col("known").isNull(), F.col("h1")).otherwise(F.xxhash64(*KEY, "pos"))
    held = held.withColumn("h1", dealt).withColumn("h2", F.when(F.col("known").isNull(), F.col("h2"))).join(seldom, ["h1", "h2", "chars"], "left")
    return held.withColumn("rank", F.coalesce("known", "rank")).where("rank is not null").select(*KEY, "pos", "words", "rank")


def levels(lines: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """doc, row, pos, level and rank of the runs of 2^level lines that occur more than once, up to ``most`` lines."""
    found = scratch.save(lines.select(*KEY, "pos", F.lit(0).alias("level"), "rank"), "level0")
    whole, k = found, 0
    while 2 << k <= most:
        after = found.select(*KEY, (F.col("pos") - (1 << k)).alias("pos"), F.col("rank").alias("next"))
        pairs = scratch.save(found.withColumnRenamed("rank", "first").join(after, [*KEY, "pos"]).select(*KEY, "pos", "first", "next"), f"pairs{k}")
        names = pairs.groupBy("first", "next").agg(F.count("*").alias("n")).where("n > 1").orderBy("first", "next")
        names = scratch.save(names.select("first", "next", F.monotonically_increasing_id().alias("rank")), f"names{k}")
        k += 1
        found = scratch.save(pairs.join(names, ["first", "next"]).select(*KEY, "pos", F.lit(k).alias("level"), "rank"), f"level{k}")
        scratch.drop(f"pairs{k - 1}", f"names{k - 1}")
        if found.isEmpty():
            break
        whole = whole.unionByName(found)
    return whole


def deletions(docs: DataFrame, words: int = 50) -> DataFrame:
    """doc, row and the places of the lines to delete."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.save(repeated_lines(docs, scratch).dropDuplicates([*KEY, "pos"]), "lines")
    by_doc = lines.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("lines"))
    found = scratch.save(by_doc.select(*KEY, _shortest(F.col("lines"), words).alias("f")).where(F.size("f.runs") > 0).select(*KEY, "f.*"), "found")
    runs = found.select(*KEY, F.inline("runs"))
    # lines outside all such runs, blank ones between other texts above all, stay behind
    lines = scratch.save(lines.join(found.select(*KEY, F.explode("places").alias("pos")), [*KEY, "pos"], "left_semi"), "inside")
    most = runs.agg(F.max("length")).first()[0]
    if most is None:
        return runs.select(*KEY, F.array(F.col("start")).alias("places")).limit(0)
    ranks = levels(lines, scratch, most)
    one = ranks.select(*KEY, F.col("pos").alias("start"), "level", F.col("rank").alias("head"))
    two = ranks.select(*KEY, F.col("pos").alias("tail_at"), "level", F.col("rank").alias("tail"))
    tail_at = F.col("start") + F.col("length") - F.pow(F.lit(2), F.col("level")).cast("int")
    named = runs.join(one, [*KEY, "start", "level"]).withColumn("tail_at", tail_at).join(two, [*KEY, "tail_at", "level"])
    named = scratch.save(named.select(*KEY, "start", "length", "head", "tail"), "named")
    place = F.struct("doc", "row", "start")
    first = named.groupBy("length", "head", "tail").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = named.join(first, ["length", "head", "tail"]).where(place > F.col("first"))
    gone = later.select(*KEY, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
    return scratch.save(gone.groupBy(*KEY).agg(F.collect_set("pos").alias("places")), "places")


def dedup_lines(docs: DataFrame, words: int = 50, lines_col: str = "n_lines", deleted_col: str = "n_deleted") -> DataFrame:
    """The rows with their text freed of later copies, and the numbers of lines and of deleted ones.

    Columns that have the names of these numbers are replaced.
    """
    gone = deletions(docs, words)
    gone = F.broadcast(gone) if bounded(gone, BROADCAST_DOCS) else gone
    same = (_doc(F.col("d.doc_id")) == F.col("g.doc")) & (_row(F.coalesce(F.col("d.text"), F.lit(""))) == F.col("g.row"))
    out = docs.alias("d").join(gone.alias("g"), same, "left")
    left = F.array_join(F.filter(F.split("d.text", "\n"), lambda x, i: ~F.array_contains("g.places", i)), "\n")
    keep = [F.col(f"d.`{c}`").alias(c) for c in docs.columns if c not in ("text", lines_col, deleted_col)]
    count = F.when(F.coalesce("d.text", F.lit("")) == "", 0).otherwise(F.regexp_count("d.text", F.lit("\n")) + 1)
    return out.select(*keep, F.when(F.col("g.places").isNull(), F.col("d.text")).otherwise(left).alias("text"), count.cast("long").alias(lines_col), F.coalesce(F.size("g.places"), F.lit(0)).cast("long").alias(deleted_col))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
