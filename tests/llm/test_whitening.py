import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pantryplan.llm import whitening


def symmetric(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    a = q * np.array(values, float) @ q.T
    return (a + a.T) / 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-9, 9), min_size=1, max_size=12), st.integers(-9, 9), st.integers(0, 99))
def test_inertia_counts(values, shift, seed):
    assert whitening.inertia(symmetric(values, seed), shift + 0.5) == sum(v > shift + 0.5 for v in values)


def test_inertia_needs_pivots():
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whitening.inertia(np.array([[0, 2.0, 0], [2.0, 0, 1.0], [0, 1.0, 0]]), 1e-9) == 1


@pytest.mark.parametrize(
    "values", [range(1, 40), [5] * 6 + [3, 3, 1], [1e9, 1e9 * (1 + 1e-13), 7, 1e-3], [2.0], [4, 0, 0, 0], [1 + 1e-9 * i for i in range(24)], [10.0**-i for i in range(24)]]
)
def test_leading_eigenpairs(values):
    values = sorted((float(v) for v in values), reverse=True)
    a = symmetric(values)
    got, axes = whitening.leading(a, 16)
    want = [v for v in np.linalg.eigvalsh(a)[::-1][:16] if v > 4e-16 * len(a) * np.abs(a).sum(axis=1).max()]
    assert len(got) == len(want) and np.allclose(got, want, rtol=0, atol=1e-14 * len(a) * values[0])
    assert np.abs(axes.T @ axes - np.eye(len(got))).max() < 1e-12
    assert np.abs(a @ axes - axes * got).max() < 1e-13 * len(a) * values[0]


def brute(rows):
    """vec_id, n, deviation and whitened rows up to the signs of components, by a dense solver."""
    x = {k: [math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for k, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[float(n * a - b) / n for a, b in zip(v, s)] for v in fit])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    deviation = {k: sum((n * a - b) ** 2 for a, b in zip(v, s)) for k, v in x.items()}
    white = {k: np.array([float(n * a - b) / n for a, b in zip(v, s)]) @ u / np.sqrt(e) for k, v in x.items()}
    return n, deviation, white, e / np.trace(y.T @ y / n)


def test_query(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = [(i, (rng.standard_normal(20) * np.arange(1, 21)).astype(np.float32).tolist()) for i in range(300)]
    good += [(300 + i, good[0][1]) for i in range(150)] + [(7, good[7][1])]
    bad = [(900, None), (901, [None] + [1.0] * 19), (902, [float("nan")] * 20), (903, [float("inf")] + [0.0] * 19), (904, []), (905, [1.0, 2.0]), (906, [3e38] * 20)]
    spark.createDataFrame([(i, v, 0, 0.0) for i, v in good + bad], "vec_id long, embedding array<float>, label int, whitened double").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op13_whitening(spark, str(tmp_path)).collect()
    n, deviation, white, explained = brute(good)
    assert len(got) == 16 * len(good) and {r.n for r in got} == {n}
    assert all(r.deviation == deviation[r.vec_id] for r in got)
    assert len({r.identity_error for r in got}) == 1 and 0 < got[0].identity_error < 1e-9
    for k in range(16):
        part = [r for r in got if r.component == k + 1]
        a, b = np.array([r.whitened for r in part]), np.array([white[r.vec_id][k] for r in part])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert all(abs(r.explained / explained[k] - 1) < 1e-9 for r in part)


@pytest.mark.parametrize("rows, n", [([], 0), ([(1, [1.0, 2.0])] * 3, 0), ([(1, [1.0, 2.0]), (None, [3.0, 2.0]), (2, None)], 2)])
def test_few_rows(spark, tmp_path, rows, n):
    """No component without spread; two distinct vectors have one."""
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op13_whitening(spark, str(tmp_path)).collect()
    assert len(got) == n and {r.component for r in got} <= {1}


def test_deviations_beyond_a_long():
    model = whitening.Model(10**9, [0, 0], np.ones(2), np.eye(2), 2.0)
    assert model.whiten(np.array([[2**39, 1], [3, 4]]))[1] == [None, None]
    assert model.whiten(np.array([[1, 0]]))[1] == [10**18]
