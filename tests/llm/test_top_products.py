"""Exact top-k search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportmill.llm.top_products import Bucket, search_bucket, top_products


def brute(rows, asked, k, scale=256):
    """Expected (query_id, rank, vec_id, score); one row of each id."""
    whole = {i: [int(np.floor(scale * float(x))) for x in v] for i, v in rows}
    out = []
    for q in sorted(i for i in whole if asked(i)):
        scored = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole[q], v)))), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def clustered(seed, n, dim, lengths=(1.0, 1.0)):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 15), dim))
    v = centres[rng.integers(0, len(centres), n)] + 0.05 * rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1)[:, None]
    return np.round(v * rng.uniform(*lengths, n)[:, None], 4).astype(np.float32)


@pytest.mark.parametrize(("dim", "spread"), [(3, (0.1, 5.0)), (16, (1.0, 1.0)), (64, (0.5, 2.0)), (1, (0.1, 1.0))])
def test_bucket_with_thresholds_equals_all_products(dim, spread):
    v = np.floor(256 * clustered(dim, 400, dim, spread).astype(np.float64))
    ids, own = np.arange(400) // 2 * 2 + 1000, np.arange(1000, 1120)  # ids repeat, so that scores tie
    queries, scores = v[:120], v[:120] @ v.T
    scores[own[:, None] == ids[None, :]] = -np.inf
    for theta in (np.full(120, -np.inf), np.sort(scores, axis=1)[:, -4], np.sort(scores, axis=1)[:, -40], np.full(120, 1e12)):
        got = search_bucket(own, queries, theta.astype(np.float64), ids, v, 5)
        for q in range(120):
            want = sorted((-s, i) for s, i in zip(scores[q], ids) if s >= theta[q] and s > -np.inf)[:5]
            assert sorted((-s, i) for n, i, s in got if n == q and s >= theta[q]) == want


def test_vectors_that_are_nearly_parallel():
    """Long integer vectors one step apart: cosines round to one, and none may be lost."""
    rng = np.random.default_rng(4)
    base = np.floor(rng.normal(size=3) * 2**24)
    v = np.vstack([base + rng.integers(-1, 2, 3) for _ in range(30)] + [np.floor(rng.normal(size=(300, 3)) * 2**20)])
    ids, own, queries = np.arange(330), np.full(1, -1), v[:1]
    scores = v @ v[0]
    for k in (1, 3, 8):
        theta = np.sort(scores)[-k : len(scores)][:1]
        got = search_bucket(own, queries, theta, ids, v, k)
        assert sorted((-s, i) for _, i, s in got) == sorted((-int(s), i) for s, i in zip(scores, ids.tolist()))[:k]


def test_coordinate_pruning_leaves_few_candidates():
    v = clustered(5, 3000, 16).astype(np.float64)
    bucket = Bucket(np.arange(3000), v)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    used = 0
    for q in range(60):
        found = bucket.candidates(unit[q], 0.97, 0.0)
        near = set(np.flatnonzero(bucket.unit @ unit[q] >= 0.97).tolist())
        assert found is None or near <= set(found.tolist())
        used += found is not None and len(found) < 1500
    assert used > 30


@pytest.mark.parametrize(("least_bucket", "block"), [(4096, 65536), (32, 7)])
def test_rows_equal_brute_force(spark, least_bucket, block):
    vectors = clustered(1, 300, 8, (0.05, 9.0))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(400 + i, rows[i][1]) for i in range(40)]  # ties
    rows += [(500, [0.0] * 8), (510, [-0.001] * 8), (600, [1.0, 2.0]), (610, [2.0, 1.0]), (620, [1e30] + [0.0] * 7), (630, [3e38] * 8), (640, [-2e9] * 8)]
    odd = [(700, None), (710, []), (720, [1.0, None] * 4), (730, [float("nan")] * 8), (740, [float("-inf")] * 8), (None, rows[0][1])]
    repeated = [rows[10]] * 3 + [(20, [99.0] * 8)]  # the least vector of an id counts
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows + odd + repeated], "vec_id long, embedding array<float>, score int, query_id int")
    got = top_products(frame, F.col("vec_id") % 10 == 0, 5, least_bucket=least_bucket, block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    stored = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    stored = [(i, min(v, np.array([99.0] * 8, np.float32).tolist()) if i == 20 else v) for i, v in stored]
    assert sorted(tuple(r) for r in got.collect()) == brute(stored, lambda i: i % 10 == 0, 5)


def test_empty_tables_and_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (7, [2.0])], "vec_id long, embedding array<double>")
    assert top_products(frame.limit(0), F.col("vec_id") == 0).collect() == []
    assert [tuple(r) for r in top_products(frame, F.col("vec_id") == 0).collect()] == [(0, 1, 7, 256 * 512)]
    assert top_products(frame.filter("vec_id = 0"), F.col("vec_id") == 0).collect() == []
