"""Operator 8: a quality classifier of the naive-Bayes support-vector kind.

A text's features are indicators of hashed n-grams: its words, pairs of words,
word endings, word shapes, and doubled words. Each indicator is scaled by the log ratio of its
class-conditional frequencies, each text to unit length, and a linear hinge-loss
model is fitted by dual coordinate descent; a logistic curve fitted on training
rows that the model hasn't seen turns margins into scores.

The model is fitted on at most ``fit_rows`` labelled rows (those with the smallest
hash of doc_id) whose crc32(doc_id) mod ``folds`` is not 0; scores use whole texts
alone. Null and empty texts have only the constant feature and get its score.
Without rows of both labels every score is the share of label 1 (0.5 with none).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pantryplan.llm.common import table, text_batches

BITS = 18
SIZE = 1 << BITS
_WORD, _PAIR, _SHAPE, _END = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_LETTERS = re.compile(rb"[a-z]+|[\x80-\xff]+")
_CAPITALS = re.compile(rb"[A-Z]+")


def _shape(word: bytes) -> bytes:
    return _LETTERS.sub(b"a", _CAPITALS.sub(lambda m: b"A" if len(m[0]) == 1 else b"AA", word))[-6:]


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers; number 0 is the constant."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(1, np.int32)
    crc = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    once = set(words)
    shapes = np.fromiter((zlib.crc32(_shape(w)) for w in once), np.uint64, len(once))
    ends = np.fromiter((zlib.crc32(w[-3:]) for w in once), np.uint64, len(once))
    parts = [(crc + np.uint64(1)) * _WORD, (crc[:-1] * _PAIR) ^ ((crc[1:] + np.uint64(3)) * _WORD), (shapes + np.uint64(5)) * _SHAPE, (ends + np.uint64(7)) * _END]
    again = int((crc[1:] == crc[:-1]).sum())  # pairs of one word twice, as one n-gram for each power of four of them
    parts.append(np.array([(k + 11) * 0x9E3779B1 for k in range(8) if again >= 4**k], np.uint64) * _PAIR)
    mixed = np.concatenate(parts)
    found = ((mixed ^ (mixed >> np.uint64(29))) * _PAIR >> np.uint64(64 - BITS)).astype(np.int32)
    return np.unique(np.append(found, 0).astype(np.int32))


@dataclass
class Model:
    weights: np.ndarray  # ratio times fitted weight
    ratio: np.ndarray
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() / np.sqrt((self.ratio[found] ** 2).sum() + 1e-12))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-(self.slope * self.margin(features(text)) + self.offset))))


def _log_ratio(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    count = lambda pick: np.bincount(np.concatenate([r for r, g in zip(rows, good) if g == pick]), minlength=SIZE) + 1.0
    p, q = count(True), count(False)
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[0] = 1.0
    return ratio


def _descend(rows: list[np.ndarray], good: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, seed: int) -> np.ndarray:
    """Dual coordinate descent for the hinge loss, classes weighted to equal shares."""
    rng, w = np.random.default_rng(seed), np.zeros(SIZE)
    xs = [ratio[r] / np.sqrt((ratio[r] ** 2).sum() + 1e-12) for r in rows]
    y = np.where(good, 1.0, -1.0)
    top = cost * len(rows) / 2 / np.where(good, good.sum(), (~good).sum())
    alpha = np.zeros(len(rows))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, x = rows[i], xs[i]
            new = min(max(alpha[i] - (y[i] * (w[r] @ x) - 1), 0.0), top[i])
            if new != alpha[i]:
                w[r] += (new - alpha[i]) * y[i] * x
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def _logistic(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve (Newton steps, slightly ridged)."""
    x, t = np.column_stack([margin, np.ones(len(margin))]), np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ beta)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-4 * np.eye(2), x.T @ (t - p) - 1e-4 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit_rows_of(rows: list[np.ndarray], good: np.ndarray, cost: float = 1.0, epochs: int = 15, seed: int = 3) -> Model:
    if not len(rows) or good.all() or not good.any():
        share = float(np.clip(good.mean() if len(rows) else 0.5, 1e-3, 1 - 1e-3))
        return Model(np.zeros(SIZE), np.ones(SIZE), 0.0, float(np.log(share / (1 - share))))
    part = np.arange(len(rows)) % 4 == 3
    train = [r for r, c in zip(rows, part) if not c]
    if len(set(good[~part])) < 2 or len(set(good[part])) < 2:
        part, train = np.ones(len(rows), bool), rows
        ratio = _log_ratio(train, good)
        w = _descend(train, good, ratio, cost, epochs, seed)
    else:
        ratio = _log_ratio(train, good[~part])
        w = _descend(train, good[~part], ratio, cost, epochs, seed)
    model = Model(ratio * w, ratio, 1.0, 0.0)
    margins = np.array([model.margin(r) for r, c in zip(rows, part) if c])
    model.slope, model.offset = _logistic(margins, good[part])
    return model


def _held_out(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 16_000, folds: int = 5) -> Model:
    sure = labels.where("doc_id is not null and quality is not null").where(~_held_out(folds)).groupBy("doc_id").agg(F.min("quality").alias("a"), F.max("quality").alias("b")).where("a = b")
    chosen = sure.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select("doc_id", F.col("a").alias("quality_label"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch({"doc_id": batch.column(0), "good": batch.column(2), "found": pa.array([f.tobytes() for f in found], pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", (F.col("quality_label") == 1).alias("good"))
    got = rows.mapInArrow(scan, "doc_id long, good boolean, found binary").toArrow()
    by = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), got.column(2).to_pylist()))
    return fit_rows_of([np.frombuffer(f, np.int32) for _, _, f in by], np.array([g for _, g, _ in by], bool))


def score_column(text: Column, model: Model) -> Column:
    weights, ratio, slope, offset = model.weights.astype(np.float32), model.ratio.astype(np.float32), model.slope, model.offset

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(weights, ratio, slope, offset)
        for batch in batches:
            yield pa.array([own.score(t.as_py()) for t in batch], pa.float64())

    return score(text)


def classify(docs: DataFrame, model: Model, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    scored = docs.select("doc_id", score_column(F.col("text"), model).alias("score"))
    return scored.select("doc_id", F.coalesce(_held_out(folds), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
