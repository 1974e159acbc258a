"""Hard-negative mining against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportmill.llm.hard_negatives import MultiIndex, Positives, Windows, _k_means, halves, hard_negatives, window_of

LONG = (1 << 63) - 1


def brute(rows, asked, positives=5, negatives=10):
    """Expected rows over (id, label, vector), one of each id."""
    whole = {i: ([int(np.floor(256 * float(x))) for x in v], k) for i, k, v in rows}
    out = []
    for a in sorted(i for i in whole if asked(i)):
        own, label = whole[a]
        scored = [(-max(-LONG - 1, min(LONG, sum(x * y for x, y in zip(own, v)))), i, k) for i, (v, k) in whole.items() if i != a and len(v) == len(own)]
        scored.sort()
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(i, -t) for t, i, k in scored if k != label and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a, p, r + 1, i, -s, t) for r, (i, t) in enumerate(fits)]
    return sorted(out)


def clustered(seed, n, dim):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 20), dim))
    return np.round((centres[rng.integers(0, len(centres), n)] + rng.uniform(0.02, 0.6, (n, 1)) * rng.normal(size=(n, dim))) / np.sqrt(dim), 3)


@pytest.mark.parametrize("dim", [1, 2, 7, 16])
def test_index_equals_all_products_and_stops_early(dim):
    v = np.floor(256 * clustered(dim, 4000, dim))
    ids, labels = np.arange(4000)[::-1].copy(), np.random.default_rng(0).integers(0, 3, 4000)
    index = MultiIndex(ids, labels, v, tuple(_k_means(h[:500], 16) for h in halves(v)))
    read = 0
    for a in range(0, 4000, 200):
        scores = v @ v[a]
        search = Positives(int(ids[a]), int(labels[a]), 5)
        read += index.visit(v[a], search)
        want = sorted((-s, i) for s, i, k in zip(scores, ids, labels) if k == labels[a] and i != ids[a])[:5]
        assert [(-s, i) for _, i, s in search.found()] == want
        own = [int(-s) for s, _ in want]
        search = Windows(int(labels[a]), own, 10, 30, 90)
        read += index.visit(v[a], search)
        for p in own:
            low, high = window_of(p)
            fits = sorted((-s, i) for s, i, k in zip(scores, ids, labels) if k != labels[a] and low <= s <= high)[:10]
            assert [(-s, i) for q, i, s in search.found() if q == p] == fits
    assert read < (0.8 if dim < 16 else 1.0) * 2 * 20 * 4000


def test_windows_are_exact_integers():
    for p in (0, 1, 7, 33, 10**17 + 1):
        low, high = window_of(p)
        assert 30 * p <= 100 * low < 30 * p + 100 and 90 * p - 100 < 100 * high <= 90 * p
    assert window_of(-5)[0] > window_of(-5)[1]


@pytest.mark.parametrize("shard", [4096, 40])
def test_rows_equal_brute_force(spark, shard):
    rng = np.random.default_rng(3)
    base = clustered(9, 260, 6).astype(np.float32)
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(300 + i, rows[i][1] if i % 3 else 7, rows[i][2]) for i in range(40)]  # ties
    rows += [(400, 0, [0.0] * 6), (410, 1, [-0.5] * 6), (420, 1, [1.0, 2.0]), (430, 1, [2.0, 1.0]), (431, 2, [1.5, 1.0]), (440, 9, [1.0] * 6), (450, 2, [1e30] + [0.0] * 5), (460, 2, [3e38] * 6), (461, 3, [1e37] * 6)]
    odd = [(500, 1, None), (510, 1, []), (520, 1, [1.0, None, 1.0]), (530, 1, [float("nan")] * 6), (540, 1, [float("inf")] * 6), (None, 1, rows[0][2]), (550, None, rows[0][2])]
    repeated = [rows[10]] * 3 + [(20, 99, rows[21][2])]  # the least label of an id counts
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows + odd + repeated], "vec_id long, label int, embedding array<float>, rank int, positive_id string")
    got = hard_negatives(frame, F.col("vec_id") % 10 == 0, least_shard=shard)
    stored = [(i, k, np.array(v, np.float32).tolist()) for i, k, v in rows]
    assert sorted(tuple(r) for r in got.collect()) == brute(stored, lambda i: i % 10 == 0)


def test_small_tables(spark):
    frame = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5]), (3, 2, [2.0])], "vec_id long, label int, embedding array<double>")
    anchor = F.col("vec_id") == 0
    assert hard_negatives(frame.limit(0), anchor).collect() == []
    assert hard_negatives(frame.filter("vec_id < 2"), anchor).collect() == []
    assert [tuple(r) for r in hard_negatives(frame, anchor).collect()] == [(0, 1, 1, 2, 65536, 32768)]
