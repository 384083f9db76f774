"""Operator 12: grouping of spelling variants by dense prefix-suffix tiling.

Two different words are one insertion, deletion or replacement apart just where
their common prefix and common suffix together reach the longer length less one. So
one of both covers half of that, and near words share their first or their last
half: words are dealt by these halves, many small groups to a block, a group of over
TILE words to several blocks. Blocks are compared in pairs as padded matrices of
code points, column by column; only pairs of one group count, and only near ones
leave a tile.

A word's form is its most frequent near word (of equals the smallest in code-point
order) if that is ``ratio`` times as frequent, else null; its root is the end of the
chain of forms. Counts rise along a chain, so it has an end, found by doubling.

- Null and empty texts have no words; equal rows count each; a null doc_id is written
  as an empty string. Any length of word works: a matrix is as wide as its own words.
- A group of ``g`` words over TILE is compared in (g / TILE)^2 / 2 tiles; what is
  shuffled for them are the block pairs, not pairs of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pantryplan.llm.common import Scratch, bounded, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN = "([a-zÀ-ÿ]+)"
#: Words of a block, and rows of a tile that are compared at once.
TILE, ROWS = 1024, 128
#: Groups of more words than a block that are broadcast at most.
BROADCAST_GROUPS = 200_000
PAIR = "word string, n long, near string, near_n long"
MEMBERS = "struct(m, suffix, half, word, n)"


def runs(text: Column) -> Column:
    """Maximal runs of letters, in which only A-Z are lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), F.lit(RUN), 1)


def count_words(words: DataFrame, least_length: int = 6, least_n: int = 5) -> DataFrame:
    """word and n of the words with so many code points and occurrences; nulls don't count."""
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _codes(words: list[str], width: int, backwards: bool) -> np.ndarray:
    """Code points of each word, 0 behind its end; one row of memory a column."""
    a = np.array([w[::-1] for w in words] if backwards else words, dtype=f"U{width}")
    return np.ascontiguousarray(a.view(np.uint32).reshape(len(words), width).T)


def _common(a: np.ndarray, b: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each alive pair of a tile."""
    n, alive = np.zeros(alive.shape, np.int32), alive.copy()
    for x, y in zip(a, b):
        alive &= (x[:, None] == y[None, :]) & (x[:, None] > 0)
        if not alive.any():
            break
        n += alive
    return n


def _near(m: int, left: list[tuple], right: list[tuple], alive: np.ndarray) -> Iterator[tuple]:
    """Near pairs among the alive ones of a tile; members are (suffix, half, word, n), the longer word has ``m`` code points."""
    xs, ys = [x[2] for x in left], [y[2] for y in right]
    alive = alive & ((np.array([len(x) for x in xs]) == m)[:, None] | (np.array([len(y) for y in ys]) == m)[None, :])
    prefix = _common(_codes(xs, m, False), _codes(ys, m, False), alive)
    suffix = _common(_codes(xs, m, True), _codes(ys, m, True), alive)
    # a pair that shares its first half is told there alone
    told = (np.array([x[0] for x in left])[:, None] == 0) | (prefix < m // 2)
    for i, j in zip(*np.nonzero(alive & told & (prefix + suffix >= m - 1))):
        if xs[i] != ys[j]:
            yield left[i][2:] + right[j][2:]
            yield right[j][2:] + left[i][2:]


def _by_length(members: list[dict]) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for x in members:
        out.setdefault(x["m"], []).append((x["suffix"], x["half"], x["word"], x["n"]))
    return {m: sorted(part) for m, part in out.items()}


def _numbers(*parts: list[tuple]) -> list[np.ndarray]:
    """A number for each member's group."""
    seen: dict[tuple, int] = {}
    return [np.array([seen.setdefault(x[:2], len(seen)) for x in part]) for part in parts]


def tile(left: list[dict], right: list[dict] | None) -> Iterator[tuple]:
    """word, n, near, near_n, both ways, of the near pairs of two blocks, or of one with itself."""
    ls, rs = _by_length(left), _by_length(right) if right is not None else None
    for m, a in ls.items():
        if rs is None:
            (group,) = _numbers(a)
            for at in range(0, len(a), ROWS):
                end = min(at + ROWS, len(a))
                stop = int(np.searchsorted(group, group[end - 1], "right"))  # groups are numbered in order
                later = np.arange(at, stop)[None, :] > np.arange(at, end)[:, None]
                yield from _near(m, a[at:end], a[at:stop], later & (group[at:end, None] == group[None, at:stop]))
        elif m in rs:
            b = rs[m]
            ga, gb = _numbers(a, b)
            for at in range(0, len(a), ROWS):
                yield from _near(m, a[at : at + ROWS], b, ga[at : at + ROWS, None] == gb[None, :])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            rows = list(tile(*(batch.column(c)[k].as_py() for c in (0, 1))))
            if rows:
                word, n, near, near_n = zip(*rows)
                yield pa.record_batch({"word": pa.array(word, pa.string()), "n": pa.array(n, pa.int64()), "near": pa.array(near, pa.string()), "near_n": pa.array(near_n, pa.int64())})


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """word, n, near, near_n of all near pairs, both ways, once each. Words are distinct and not empty."""
    length = F.char_length("word")
    halves = [F.struct(m.alias("m"), F.lit(s).alias("suffix"), (F.right if s else F.left)("word", F.floor(m / 2).cast("int")).alias("half")) for m in (length, length + 1) for s in (0, 1)]
    dealt = words.select("word", "n", F.explode(F.array(*halves)).alias("g")).select("word", "n", "g.*")
    sizes = dealt.groupBy("m", "suffix", "half").count()
    sizes = scratch.save(sizes.where("count > 1"), "sizes")
    large = sizes.where(F.col("count") > TILE).select("m", "suffix", "half", F.ceil(F.col("count") / TILE).cast("int").alias("blocks"))
    few = bounded(large, BROADCAST_GROUPS)
    total = sizes.agg(F.sum("count")).first()[0] or 0
    shared = F.pmod(F.xxhash64("m", "suffix", "half"), F.lit(max(1, -(-total // TILE))))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    at = {"bucket": F.when(F.isnull("blocks"), shared), "block": F.when(F.isnull("blocks"), 0).otherwise(own)}
    dealt = dealt.join(F.broadcast(large) if few else large, ["m", "suffix", "half"], "left").withColumns(at)
    name = F.when(F.isnull("blocks"), F.concat(F.lit("b"), "bucket")).otherwise(F.concat_ws("/", "m", "suffix", "half")).alias("name")
    blocks = scratch.save(dealt.groupBy(name, "block").agg(F.collect_list(F.expr(MEMBERS)).alias("members"), F.first("blocks").alias("blocks")), "blocks")
    # a block holds a thousand members: few blocks to an Arrow batch
    inside = blocks.select("members", F.lit(None).cast(blocks.schema["members"].dataType).alias("other"))
    pairs = blocks.where("blocks is not null").select("name", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("with")).where("with > block")
    left, right = blocks.select("name", "block", "members"), blocks.select("name", F.col("block").alias("with"), F.col("members").alias("other"))
    across = pairs.join(left, ["name", "block"]).join(right, ["name", "with"]).select("members", "other")
    return inside.unionByName(across).mapInArrow(_tiles, PAIR)


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word and root of every word with a form: each round follows twice as many forms as the one before."""
    at, turn = scratch.save(forms.select("word", F.col("form").alias("root")), "root0"), 0
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        turn += 1
        moved = scratch.save(at.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.isnotnull("further").alias("more")), f"root{turn}")
        at = moved.select("word", "root")
        if moved.where("more").isEmpty():
            return at


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """Add form, root, n_near and form_n to the distinct words of ``word`` and ``n``."""
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.save(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    near = near_pairs(words, scratch).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    enough = -F.col("best.n") >= ratio * F.col("n")
    near = scratch.save(near.select("word", "n_near", F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")), "near")
    ends = roots(near.where("form is not null"), scratch)
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of six code points and five occurrences, after every 199th run by crc32 has lost a code point."""
    found = table(spark, sf_dir, "documents").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs(F.col("text"))).alias("run"))
    # a run shorter than six code points never becomes a word
    found = found.where(F.char_length("run") >= 6).withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.expr("left(run, cast(h % char_length(run) as int))"), F.substring("run", at + 2, F.char_length("run")))
    return variants(count_words(found.select(F.when(F.col("h") % 199 == 0, cut).otherwise(F.col("run")).alias("word"))))
