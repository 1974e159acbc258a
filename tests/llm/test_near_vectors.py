"""Cover trees and embedding near-dedup against brute force."""

import numpy as np
import pytest

from reportmill.llm import cover_tree
from reportmill.llm.cover_tree import Tree, threshold_links
from reportmill.llm.near_vectors import near_vectors


def groups(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 12), dim))
    return centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, dim))


def brute(vectors, weights, least, split=None):
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    if split is not None:
        near[:split, :split] = near[split:, split:] = False
    root = np.arange(len(vectors))
    while True:
        new = np.array([min(root[i], *root[near[i]]) if near[i].any() else root[i] for i in range(len(root))])
        if (new == root).all():
            return near @ weights, root
        root = new


def test_tree_covers_and_nests():
    points = groups(1, 300, 8, 0.2)
    points /= np.linalg.norm(points, axis=1)[:, None]
    points[7] = points[9]
    tree = Tree(points)
    assert sorted(tree.order.tolist()) == list(range(300))
    for node in range(len(tree.centre)):
        inside = tree.order[tree.begin[node] : tree.end[node]]
        assert tree.centre[node] in inside
        assert np.linalg.norm(points[inside] - points[tree.centre[node]], axis=1).max() <= tree.radius[node] + 1e-7
        if len(tree.children[node]):
            assert tree.centre[node] == tree.centre[tree.children[node][0]]
            assert tree.radius[tree.children[node]].max() <= tree.radius[node]


@pytest.mark.parametrize(("spread", "dim"), [(0.02, 16), (0.15, 16), (0.3, 4), (2.0, 64), (0.0, 8)])
def test_links_equal_brute_force(spread, dim):
    vectors = groups(dim, 240, dim, spread) * np.random.default_rng(0).uniform(0.1, 9, 240)[:, None]
    weights = np.random.default_rng(1).integers(1, 4, 240)
    for split in (None, 100, 0, 240):
        count, root = threshold_links(vectors, weights, 0.93, split)
        want, want_root = brute(vectors, weights, 0.93, split)
        assert (count == want).all() and (root == want_root).all()


@pytest.mark.parametrize("split", [None, 512])
def test_traversal_takes_many_pairs_a_step(monkeypatch, split):
    """Wide families prune little; pairs of one node go on together, so steps grow with nodes, not with their pairs."""
    vectors = groups(3, 1024, 64, 0.9)
    vectors[::8] = vectors[1::8] + 0.05 * np.random.default_rng(5).normal(size=(128, 64))
    steps, distance = [], cover_tree._distance
    monkeypatch.setattr(cover_tree, "_distance", lambda cosine: steps.append(cosine.ndim == 2) or distance(cosine))
    count, root = threshold_links(vectors, np.ones(1024, np.int64), 0.93, split)
    want, want_root = brute(vectors, np.ones(1024, np.int64), 0.93, split)
    assert (count == want).all() and (root == want_root).all()
    assert sum(steps) < 1024


@pytest.mark.parametrize("block", [2048, 16])
def test_rows_equal_brute_force(spark, block):
    rng = np.random.default_rng(4)
    base = groups(4, 150, 8, 0.15).astype(np.float32)
    rows = [(i, [float(x) for x in v], int(rng.integers(0, 3))) for i, v in enumerate(base)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(20)] + [(300, rows[3][1], rows[3][2])] * 2
    odd = [(400, None, 1), (401, [0.0] * 8, 1), (402, [1.0, None] * 4, 1), (403, [float("nan")] * 8, 1), (404, [float("inf")] * 8, 1), (405, rows[0][1], None), (406, [], 1), (407, [1.0] * 5, 1)]
    frame = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<float>, label int, n_links int")
    got = near_vectors(frame, block=block).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.vec_id: r for r in got}
    for label in range(3):
        mine = [(i, v) for i, v, k in rows if k == label]
        ids = np.array([i for i, _ in mine])
        count, _ = brute(np.array([v for _, v in mine], np.float64), np.ones(len(mine), np.int64), 0.93)
        order = np.argsort(ids, kind="stable")
        _, root = brute(np.array([mine[k][1] for k in order], np.float64), np.ones(len(mine), np.int64), 0.93)
        for k, i in enumerate(ids):
            assert by_id[i].n_links == count[k]
        for k, i in enumerate(ids[order]):
            assert by_id[i].component_id == ids[order][root[k]] and by_id[i].kept == (by_id[i].component_id == i)
    assert all((by_id[r[0]].n_links, by_id[r[0]].component_id, by_id[r[0]].kept) == (0, r[0], True) for r in odd)
    assert near_vectors(frame.limit(0)).collect() == []


def test_rows_without_id(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    frame = spark.createDataFrame([(None, v, 1), (None, v, 1), (3, v, 1), (None, w, 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(frame).collect()), key=str)
    assert got == sorted([(None, 2, 3, False), (None, 2, 3, False), (3, 2, 3, True), (None, 0, None, True)], key=str)
