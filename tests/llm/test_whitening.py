"""Components and whitening against another method of linear algebra and exact integers."""

import numpy as np
import pytest

from reportmill.llm.polar import components, polar_factor
from reportmill.llm.whitening import whiten, whitened_rows


def matrices():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 30, 64):
        x = rng.normal(size=(20 * n + 2, n))
        q, _ = np.linalg.qr(rng.normal(size=(n, n)))
        yield x.T @ x
        yield (q * np.logspace(0, -12, n)) @ q.T
        yield (q * np.repeat([4.0, 1.0, 0.0], [n - n // 2, n // 2 - n // 4, n // 4])) @ q.T
        yield np.eye(n) * 3
        yield np.diag(np.arange(n) * 1.0)
        yield np.zeros((n, n))


def test_components_are_eigenvectors():
    for a in matrices():
        a = (a + a.T) / 2
        values, vectors = components(a)
        size = max(np.abs(a).max(), 1e-300)
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-12 * size * len(a)
        assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * size * len(a)


def test_polar_factor_of_an_indefinite_matrix():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    values = np.array([5, 3, 1e-9, 2, -1, -4, -1e-7, 8, -2, 1, 1, -3.0])
    assert np.abs(polar_factor((q * values) @ q.T) - (q * np.sign(values)) @ q.T).max() < 1e-6


def brute(rows, most=8):
    """Deviations in Python's integers; whitened values and shares by eigh."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    held = [k for k in range(min(most, len(values))) if values[k] > len(values) * 2.3e-16 * values[0]]
    return deviations, centred @ vectors[:, held] / np.sqrt(values[held]), values[held] / np.trace(covariance)


@pytest.mark.parametrize("dim", [3, 64])
def test_rows_equal_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    base = (rng.normal(size=(400, dim)) * np.linspace(2, 0.3, dim)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [rows[3], rows[3], (None, rows[5][1])]
    odd = [(900, None), (901, []), (902, [None] * dim), (903, [float("nan")] * dim), (904, [float("inf")] * dim), (905, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<float>, n int, component string")
    deviations, whitened, explained = brute([(i, np.array(v, np.float32)) for i, v in rows])
    got = whitened_rows(frame).collect()
    held = min(8, dim)
    assert len(got) == held * len(rows) and {r.n for r in got} == {len(rows)}
    assert {r.component for r in got} == set(range(1, held + 1)) and all(0 <= r.identity_error < 1e-9 for r in got)
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(((i, d, tuple(w)) for (i, _), d, w in zip(rows, deviations, whitened)), key=key)
    for c in range(1, held + 1):
        mine = sorted(((r.vec_id, r.deviation, r.whitened, r.explained) for r in got if r.component == c), key=key)
        assert [r[:2] for r in mine] == [r[:2] for r in want]
        ours, theirs = np.array([r[2] for r in mine]), np.array([r[2][c - 1] for r in want])
        assert np.abs(ours - theirs * np.sign(ours @ theirs)).max() < 1e-8
        assert max(abs(r[3] - explained[c - 1]) for r in mine) < 1e-12


def test_small_and_odd_tables(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    assert whitened_rows(frame.limit(0)).collect() == [] and whitened_rows(frame).collect() == []
    assert whitened_rows(frame.unionAll(frame)).collect() == []  # no spread at all
    rows, fit = whiten(frame.unionAll(spark.createDataFrame([(2, [1.0, 2.0, 5.0])], frame.schema)))
    assert fit["n"] == 2 and len(fit["values"]) == 1
    assert sorted(abs(r.whitened[0]) for r in rows.collect()) == pytest.approx([1.0, 1.0])
    wild = spark.createDataFrame([(i, [10.0 ** (3 * i), 1.0, float(i)]) for i in range(12)] + [(50, [1e90, 0.0, 0.0]), (51, [1e305, 0.0, 0.0])], frame.schema)
    assert {(r.deviation, r.n) for r in whitened_rows(wild).collect()} == {(None, 13)}
    large = spark.createDataFrame([(i, [1.5e4 * i, 1.0]) for i in range(12)], frame.schema)  # deviations beyond 2**53
    exact, _, _ = brute([(i, [1.5e4 * i, 1.0]) for i in range(12)])
    assert [r.deviation for r in sorted(whitened_rows(large).collect())] == exact
