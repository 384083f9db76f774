"""Operator 13: whitening of embeddings by spectrum slicing.

Vectors become whole numbers, floor(64 c) + 1000000 an entry. The mean and the covariance
are those of the distinct vectors: each task sums its rows, whole numbers exactly
and centred products as doubles, and the sums are added by entry. What reaches the
driver is one d x d matrix.

Sylvester's law slices its spectrum: V - s I = L D L^T has as many positive pivots as
V has eigenvalues above s. Bisection by these counts isolates each leading eigenvalue;
Rayleigh quotient iteration from inside its interval converges cubically, and counts
on both sides of the result certify its number. Eigenvalues that no count can tell
apart are found together, as an orthonormal basis of their space.

- Rows whose vector is null, empty or has null or non-finite entries are dropped,
  and so are those with an entry beyond 2^40 and those of another length than most (of
  equally many the longest).
- A component whose eigenvalue is zero to rounding isn't one: one distinct vector
  has none, and no rows. An empty table has no rows.
- Equal rows count once in the fit and are each whitened. ``deviation`` is null where
  it is beyond a long. Columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pantryplan.llm.common import Scratch, table

SCALE, SHIFT, REACH = 64, 1_000_000, 2.0**40


@dataclass
class Model:
    """n and S of the fit list, its eigenpairs as columns of ``axes``, the trace and the error of the whitened covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float = 0.0

    def whiten(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Whitened rows and their deviations."""
        centred, exact = _centred(x, self.n, self.sums)
        if exact.dtype != object and np.abs(exact).max(initial=0) ** 2.0 * exact.shape[1] < 2.0**62:
            deviation = (exact * exact).sum(axis=1).tolist()
        else:
            deviation = [d if (d := sum(int(v) ** 2 for v in row)) < 2**63 else None for row in exact]
        return centred @ self.axes / np.sqrt(self.values), deviation


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """x - S / n rounded once, and n x - S exactly."""
    if n * float(np.abs(x).max(initial=0)) < 2.0**62:
        exact = x * n - np.array(sums, np.int64)
    else:
        exact = x.astype(object) * n - np.array(sums, object)
    return exact.astype(float) / n, exact


def _matrix(column: pa.ListArray, kind: type) -> np.ndarray:
    """Rows of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


# --- spectrum -------------------------------------------------------------------------------------


def inertia(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above ``shift``, by the signs of its L D L^T with one- and two-row pivots (Bunch and Kaufman)."""
    a = a - shift * np.eye(len(a))
    alpha, k, above, n = (1 + 17**0.5) / 8, 0, 0, len(a)
    while k < n:
        below = np.abs(a[k + 1 :, k])
        r = k + 1 + int(below.argmax()) if len(below) else k
        top, pair = (below.max() if len(below) else 0.0), False
        if abs(a[k, k]) < alpha * top:
            side = max(np.abs(a[r, k:r]).max(), np.abs(a[r + 1 :, r]).max(initial=0))
            if abs(a[k, k]) * side < alpha * top * top:
                pair = abs(a[r, r]) < alpha * side
                to = k + 1 if pair else k
                a[[to, r]] = a[[r, to]]
                a[:, [to, r]] = a[:, [r, to]]
        if pair:
            # such a pivot has an eigenvalue of each sign
            c = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= c @ np.linalg.solve(a[k : k + 2, k : k + 2], c.T)
            above, k = above + 1, k + 2
        else:
            if a[k, k] != 0:
                c = a[k + 1 :, k]
                a[k + 1 :, k + 1 :] -= np.outer(c, c / a[k, k])
            above, k = above + (a[k, k] > 0), k + 1
    return above


def _rayleigh(a: np.ndarray, low: float, high: float, found: np.ndarray, rng: np.random.Generator) -> tuple[float, np.ndarray] | None:
    """An eigenpair in [low, high], from the middle; ``found`` are eigenvectors to stay off. None if the iteration leaves the interval."""
    eye, size = np.eye(len(a)), max(np.abs(a).max(), 1e-300)
    off = lambda v: v - found @ (found.T @ v)
    v = off(rng.standard_normal(len(a)))
    v /= np.linalg.norm(v)
    shift = (low + high) / 2
    for turn in range(60):
        nudge = 0.0
        while True:
            try:
                w = off(np.linalg.solve(a - (shift + nudge) * eye, v))
                break
            except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
                nudge = nudge * 2 or size * 1e-16
        v = w / np.linalg.norm(w)
        value = float(v @ a @ v)
        if np.linalg.norm(off(a @ v) - value * v) <= 8e-16 * len(a) ** 0.5 * size:
            return (value, v) if low - 1e-14 * size <= value <= high + 1e-14 * size else None
        # two steps at the middle first, so that the vector belongs to the interval
        shift = value if turn >= 2 and low <= value <= high else shift
    return None


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors as columns; fewer if the rest are zero to rounding."""
    d, rng, counts = len(a), np.random.default_rng(5), {}
    radius = float(np.abs(a).sum(axis=1).max()) if d else 0.0
    if radius == 0:
        return np.zeros(0), np.zeros((d, 0))
    gap = 4e-16 * d * radius

    def above(s: float) -> int:
        if s not in counts:
            counts[s] = inertia(a, s)
        return counts[s]

    # no eigenvalue is beyond the largest row sum
    bounds, values, axes = {-1.1 * radius: d, 1.1 * radius: 0}, [], np.zeros((d, 0))
    k = min(k, above(gap))
    while len(values) < k:
        nth = len(values) + 1
        low = max(s for s, c in bounds.items() if c >= nth)
        high = min(s for s, c in bounds.items() if c < nth)
        while bounds[low] != nth and high - low > gap:
            middle = (low + high) / 2
            bounds[middle] = above(middle)
            low, high = (middle, high) if bounds[middle] >= nth else (low, middle)
        together = min(bounds[low], k) - nth + 1
        pairs: list[tuple[float, np.ndarray]] = []
        while len(pairs) < together:
            stay_off = np.column_stack([axes, *(v for _, v in pairs)])
            if pair := _rayleigh(a, low, high, stay_off, rng):
                pairs.append(pair)
            else:  # too wide an interval: halve it
                middle = (low + high) / 2
                if not low < middle < high or high - low <= gap:
                    raise ArithmeticError(f"no eigenvector for number {nth}")
                bounds[middle] = above(middle)
                low, high = (middle, high) if bounds[middle] >= nth else (low, middle)
                together, pairs = min(bounds[low], k) - nth + 1, []
        for value, v in sorted(pairs, key=lambda p: -p[0]):
            values.append(value)
            axes = np.column_stack([axes, v])
        # the certificate: just so many eigenvalues lie above and below
        if above(values[-1] - gap) < len(values) or above(values[nth - 1] + gap) > nth - 1:
            raise ArithmeticError(f"counts do not certify number {nth}")
    return np.array(values), axes


# --- sums over tasks ------------------------------------------------------------------------------


def whole_numbers(rows: DataFrame, vector: str, out: str = "x") -> DataFrame:
    """Add the whole-number vector; rows without one are dropped."""
    finite = lambda c: c.isNotNull() & (F.abs(c) < REACH / SCALE)  # NaN is larger than all numbers
    sound = rows.where(F.size(vector) > 0).where(F.forall(vector, finite))
    length = sound.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    return sound.where(F.size(vector) == (length["n"] if length else 0)).withColumn(out, x)


def sums(fit: DataFrame, column: str = "x") -> tuple[int, list[int]]:
    """n and the exact sum of each entry."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            x = _matrix(batch.column(0), np.int64)
            n, total = n + len(x), total + x.sum(axis=0).astype(object)  # entries are below 2^40 and batches below 2^22 rows
        if n:
            yield pa.record_batch({"i": pa.array(range(-1, len(total)), pa.int32()), "s": pa.array([str(v) for v in (n, *total)])})

    got = fit.select(column).mapInArrow(add, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return (int(got[0].s), [int(r.s) for r in got[1:]]) if got else (0, [])


def covariance(fit: DataFrame, rows_of: object, d: int, n: int) -> np.ndarray:
    """Mean of the outer products of what ``rows_of`` makes of the integer vectors; they are centred already."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = rows_of(_matrix(batch.column(0), np.int64))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.record_batch({"i": pa.array(np.arange(d * d, dtype=np.int64)), "v": pa.array(total.ravel())})

    got = fit.select("x").mapInArrow(add, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(d * d)
    out[got["i"].to_numpy()] = got["v"].to_numpy() / n
    return out.reshape(d, d)


def fit(vectors: DataFrame, k: int = 16) -> Model | None:
    """Model of the distinct ``x`` vectors; None where there are none. The matrix is d x d, whatever the number of rows."""
    distinct = Scratch(vectors.sparkSession, "whitening").save(vectors.select("x").distinct(), "distinct")
    n, total = sums(distinct)
    if not n:
        return None
    v = covariance(distinct, lambda x: _centred(x, n, total)[0], len(total), n)
    v = (v + v.T) / 2
    values, axes = leading(v, min(k, len(total)))
    model = Model(n, total, values, axes, float(np.trace(v)))
    if len(values):
        mean = _mean(distinct, model)
        seen = covariance(distinct, lambda x: model.whiten(x)[0] - mean, len(values), n)
        model.identity_error = float(np.abs(seen - np.eye(len(values))).max())
    return model


def _mean(distinct: DataFrame, model: Model) -> np.ndarray:
    k = len(model.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            total += model.whiten(_matrix(batch.column(0), np.int64))[0].sum(axis=0)
        yield pa.record_batch({"i": pa.array(np.arange(k, dtype=np.int64)), "v": pa.array(total)})

    got = distinct.select("x").mapInArrow(add, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r.v for r in got]) / model.n


def whiten(vectors: DataFrame, model: Model | None) -> DataFrame:
    """Add ``deviation`` and ``whitened`` (an entry a component) to rows with an ``x`` vector."""
    k = len(model.values) if model else 0

    @F.arrow_udf("struct<deviation:bigint,whitened:array<double>>")
    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            w, deviation = model.whiten(_matrix(batch, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
            yield pa.StructArray.from_arrays([pa.array(deviation, pa.int64()), lists], names=["deviation", "whitened"])

    if not model:
        return vectors.withColumns({"deviation": F.lit(None).cast("long"), "whitened": F.lit(None).cast("array<double>")})
    return vectors.withColumn("__w", project(F.col("x"))).withColumns({"deviation": F.col("__w.deviation"), "whitened": F.col("__w.whitened")}).drop("__w")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_numbers(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", "x")
    model = fit(vectors)
    out = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*(F.lit(float(e) / model.trace) for e in model.values)) if model and len(model.values) else F.array().cast("array<double>")
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error if model else None).cast("double").alias("identity_error"))
