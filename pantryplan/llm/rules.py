"""Operator 9: quality rules and an isolation forest on their statistics.

Words are runs of bytes other than 20 and 09-0D; a null text has none. A document
fails the base rules if it has fewer than ten words or more than a fifth of its
words lie in five-word windows that it repeats. Of the others, those are rejected
whose path through the random splits of a forest is shorter than a threshold. The
forest is grown on rows labelled good, so that its dense region is that of good
text, with cuts over the box that all labelled rows span. The threshold is calibrated
on both labels: of those that reject at most ``cost`` of the good rows it is the one
with the greatest share of bad rows rejected less that of good
rows. Without labels of both kinds nothing is rejected beyond the base
rules. All statistics cover whole texts of all rows. The box and the threshold come
from all labelled rows, on grids of ``BOX_STEP`` and ``CUTS``; as the method has it, each tree
is grown on a few rows drawn from all good ones (those with the smallest hashes of doc_id).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pantryplan.llm.common import Scratch, table, text_batches

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct", "n_upper", "n_letters", "n_digits", "n_marks")
SYMBOLS, SPACES, MARKS = b"#*$%&|<>", b" \t\n\v\f\r", b"!?\"'()[]{}-_=+/\\:;,.@^~`"
WINDOW = 5
#: Scores that a threshold can have, and the steps in which the ends of the box are told.
CUTS, BOX_STEP = 100_000, 0.001


def _codes(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for each five-word window, equal only for equal windows."""
    if n**WINDOW < 2**63:
        out = ids[: len(ids) - WINDOW + 1].copy()
        for j in range(1, WINDOW):
            out = out * n + ids[j : len(ids) - WINDOW + 1 + j]
        return out
    pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
    four = np.unique(pair[:-2] * (pair.max() + 1) + pair[2:], return_inverse=True)[1]
    return four[: len(ids) - WINDOW + 1] * n + ids[WINDOW - 1 :]


def repeated_words(ids: np.ndarray, n: int) -> int:
    """Words covered by windows that occur at least twice."""
    if len(ids) <= WINDOW:
        return 0
    codes = _codes(ids, n)
    order = np.sort(codes)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(codes, twice))
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """COUNTS and MORE of a text."""
    raw = (text or "").encode()
    words, seen = raw.split(), {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    points = int(hist.sum() - hist[0x80:0xC0].sum())
    return (
        len(words),
        points - int(hist[list(SPACES)].sum()),
        int(hist[list(SYMBOLS)].sum()),
        len(lines) - len(set(lines)),
        repeated_words(ids, max(1, len(seen))),
        len(lines),
        len(seen),
        int(hist[65:91].sum()),
        int(hist[65:91].sum() + hist[97:123].sum()),
        int(hist[48:58].sum()),
        int(hist[list(MARKS)].sum()),
    )


def features(counts: np.ndarray) -> np.ndarray:
    """Rates that do not depend on a text's length, and its length."""
    words, chars, symbols, dup, repeat, lines, distinct, upper, letters, digits, marks = counts.T.astype(float)
    w, n = np.maximum(words, 1), np.maximum(lines, 1)
    rates = symbols / w, dup / n, repeat / w, n / w, upper / np.maximum(letters, 1), digits / np.maximum(chars, 1), marks / w
    return np.column_stack([np.log1p(words), np.log1p(chars / w), distinct / w**0.8, *(np.log1p(20 * r) for r in rates)])


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


def _mean_path(n: int) -> float:
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Isolation trees as arrays: a leaf has feature -1 and its path length as value."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    depth: int
    norm: float
    box: tuple[np.ndarray, np.ndarray]
    threshold: float = float("inf")

    @classmethod
    def grow(cls, good: np.ndarray, box: tuple[np.ndarray, np.ndarray], trees: int = 400, sample: int = 512, depth: int = 10, seed: int = 7) -> Forest:
        """Cuts are uniform over the cell, not over the good rows in it, so that empty parts of the box end in short paths."""
        rng = np.random.default_rng(seed)
        grown = []
        for _ in range(trees):
            nodes: list[list[float]] = []

            def split(rows: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> int:
                at = len(nodes)
                nodes.append([-1, level + _mean_path(len(rows)), at, at])
                open_ = np.flatnonzero(high > low)
                if level < depth and len(rows) > 1 and len(open_):
                    f = int(rng.choice(open_))
                    cut = rng.uniform(low[f], high[f])
                    left, a, b = rows[:, f] < cut, low.copy(), high.copy()
                    a[f] = b[f] = cut
                    nodes[at] = [f, cut, split(rows[left], low, b, level + 1), split(rows[~left], a, high, level + 1)]
                return at

            split(np.clip(good, *box)[rng.choice(len(good), min(sample, len(good)), replace=False)], *box, 0)
            a = np.array(nodes)
            grown.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int)))
        return cls(grown, depth, max(_mean_path(min(sample, len(good))), 1.0), box)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly, 0 to 1; the shorter the mean path, the higher."""
        x = np.clip(x, *self.box)
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, value, left, right in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where((f < 0) | (x[rows, f] < value[node]), left[node], right[node])
            total += value[node]
        return 2 ** (-total / len(self.trees) / self.norm)


def best_cut(cuts: np.ndarray, good: np.ndarray, bad: np.ndarray, cost: float) -> float:
    """Of ascending scores, with how many good and bad rows have each, the one above which at most ``cost`` of the good lie and the most of the bad less the share of the good."""
    lost, caught = (1 - np.cumsum(n) / n.sum() for n in (good, bad))
    return float(cuts[np.argmax(np.where(lost <= cost, caught - lost, -1.0))])


def calibrate(forest: Forest, x: np.ndarray, good: np.ndarray, cost: float) -> Forest:
    """Of thresholds that reject at most ``cost`` of the good rows, set the one that rejects the most of the bad less that of the good."""
    if good.any() and not good.all():
        cuts, at = np.unique(forest.score(x), return_inverse=True)
        forest.threshold = best_cut(cuts, np.bincount(at[good], minlength=len(cuts)), np.bincount(at[~good], minlength=len(cuts)), cost)
    return forest


def _statistics(text: Column) -> Column:
    kind = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS + MORE) + ">"

    @F.arrow_udf(kind)
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts = np.array([measure(t.as_py()) for t in batch], np.int64).reshape(-1, len(COUNTS + MORE))
            yield pa.StructArray.from_arrays([pa.array(c) for c in counts.T], names=list(COUNTS + MORE))

    return stats(text)


def _features(counts: Column) -> Column:
    @F.arrow_udf("array<double>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = features(np.column_stack([batch.field(c).to_numpy(zero_copy_only=False) for c in COUNTS + MORE]))
            yield pa.array(list(x), pa.list_(pa.float64()))

    return made(counts)


def _cut(x: Column, model: Forest) -> Column:
    """The least of the ``CUTS`` that is no less than a row's anomaly."""

    @F.arrow_udf("bigint")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.ceil(model.score(batch.flatten().to_numpy().reshape(len(batch), -1)) * CUTS).astype(np.int64))

    return scored(x)


def fit(docs: DataFrame, labels: DataFrame, cost: float = 0.005, trees: int = 400, sample: int = 512) -> Forest | None:
    """Grow the forest and set its threshold; None where labels lack one of the two kinds.

    What reaches the driver is the box, the rows that trees are grown on, ``sample`` a
    tree, and how many good and bad rows have each of the scores.
    """
    sure = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("a"), F.max("quality").alias("b")).where("a = b")
    sure = sure.select("doc_id", (F.col("a") == 1).alias("good"))
    scratch = Scratch(docs.sparkSession, "rules")
    # texts are measured where they are read: what meets the labels are numbers
    rows = docs.select("doc_id", _statistics(F.col("text")).alias("s")).where("s.n_words >= 10 and 100 * s.n_repeat_words <= 20 * s.n_words").join(sure, "doc_id")
    rows = scratch.save(rows.select("doc_id", "good", _features(F.col("s")).alias("x")), "labelled")
    n = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("good"), 1)).alias("good")).first()
    if not n.good or n.good == n.n:
        return None
    width = len(rows.first().x)
    ends = rows.select(*(F.percentile(F.round(F.col("x")[i] / BOX_STEP) * BOX_STEP, F.array(F.lit(0.001), F.lit(0.999))).alias(f"e{i}") for i in range(width))).first()
    box = tuple(np.array([ends[i][side] for i in range(width)]) for side in (0, 1))
    grown_on = rows.where("good").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(trees * sample).select("x").toArrow().column("x").combine_chunks()
    forest = Forest.grow(grown_on.flatten().to_numpy().reshape(-1, width), box, trees, sample)
    held = rows.select("good", _cut(F.col("x"), forest).alias("cut")).groupBy("cut").agg(F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(~F.col("good"), 1)).alias("bad")).orderBy("cut").toPandas()
    forest.threshold = best_cut(held["cut"].to_numpy() / CUTS, held["good"].to_numpy(), held["bad"].to_numpy(), cost)
    scratch.drop("labelled")
    return forest


def verdicts(docs: DataFrame, forest: Forest | None, text_col: str = "text", out: str = "rules") -> DataFrame:
    """Add a struct of the counts, ``base_failed``, ``anomaly`` and ``kept``."""
    kind = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ",base_failed:boolean,anomaly:double,kept:boolean>"
    model = forest

    @F.arrow_udf(kind)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts = np.array([measure(t.as_py()) for t in batch], np.int64).reshape(-1, len(COUNTS + MORE))
            failed = base_failed(counts)
            score = model.score(features(counts)) if model else np.zeros(len(counts))
            kept = ~failed & (score <= model.threshold if model else True)
            yield pa.StructArray.from_arrays(
                [*(pa.array(c) for c in counts.T[: len(COUNTS)]), pa.array(failed), pa.array(score), pa.array(kept)], names=[*COUNTS, "base_failed", "anomaly", "kept"]
            )

    return docs.withColumn(out, judge(F.col(text_col)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return verdicts(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "rules.*")
