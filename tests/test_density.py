import numpy as np
import pytest

import alarmloom.operators.clusters as cl
import alarmloom.operators.density as de
import alarmloom.operators.neighbors as nb
import alarmloom.runtime as rt
from test_neighbors import components, distances, points

RADII = [0.15, 0.4, 1.1, 3.0]


def blobs(seed=5):
    """Two blobs, scattered rows, one heavy vector and a grid with many equal distances."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0, .3, (40, 2)), rng.normal(3, .3, (30, 2)), rng.uniform(-4, 6, (20, 2)),
                           np.full((20, 2), 9.0), rng.integers(-8, -4, (30, 2))])


def brute(x, eps, m=5):
    near = distances(x, x) <= eps
    core = near.sum(1) >= m
    comp = components(len(x), [(i, j) for i, j in zip(*np.nonzero(near)) if core[i] and core[j]])
    want = {}
    for i in range(len(x)):
        adj = [comp[j] for j in np.nonzero(near[i])[0] if core[j]]
        want[i] = (comp[i], "core") if core[i] else (min(adj), "border") if adj else (-1 - i, "noise")
    return want


def heights(x, reach, m=5):
    """Weights of a minimum spanning forest by reach, with Kruskal over all pairs of distinct vectors."""
    d = distances(x, x)
    core = np.sort(d, axis=1)[:, m - 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    _, first = np.unique(x, axis=0, return_index=True)
    pairs = sorted((w[i, j], i, j) for i in first for j in first if i < j and w[i, j] <= reach)
    root = {i: i for i in first}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    out = []
    for v, i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            out.append(v)
    return out


def spanning(edges):
    """Weights that are left of a forest when edges that close a circle go."""
    root, out = {}, []

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for w, a, b in sorted(edges):
        a, b = find(a), find(b)
        if a != b:
            root[a] = b
            out.append(w)
    return out


@pytest.mark.parametrize("blocks", [{}, {"rows_per_cell": 20, "block_rows": 8}])
def test_every_radius_of_one_forest(spark, blocks):
    x = blobs()
    got = de.dbscan_sweep(points(spark, x), RADII, **blocks).collect()
    assert len(got) == len(RADII) * len(x)
    for run, eps in enumerate(RADII):
        assert {r["id"]: (r["cid"], r["kind"]) for r in got if r["run"] == run} == brute(x, eps)


def test_without_broadcast_and_against_one_radius(spark, monkeypatch):
    monkeypatch.setattr(nb, "BROADCAST_LIMIT", 0)
    monkeypatch.setattr(rt, "BROADCAST_LIMIT", 0)
    p = points(spark, blobs(7))
    got = de.dbscan_sweep(p, [0.4, 2.0], rows_per_cell=30, block_rows=16).collect()
    for run, eps in enumerate([0.4, 2.0]):
        one = {(r["id"], r["cid"], r["kind"]) for r in cl.dbscan(p, eps).collect()}
        assert {(r["id"], r["cid"], r["kind"]) for r in got if r["run"] == run} == one


def test_forest_is_minimal(spark):
    """Clusters wider than the neighbour lists, so that edges have to be searched for."""
    x = blobs(11)
    f = de.density_forest(points(spark, x), 30.0, rows_per_cell=25, block_rows=8)
    got = spanning([(r["w"], r["src"], r["dst"]) for r in f.edges.collect()])
    assert np.allclose(got, heights(x, 30.0)) and f.edges.count() < 2 * len(x)


def test_few_rows_and_limits(spark):
    none = points(spark, np.zeros((1, 2))).limit(0)
    assert de.dbscan_sweep(none, [0.5, 1.0]).count() == 0
    few = de.dbscan_sweep(points(spark, np.array([[0.0], [0.1], [9.0]])), [0.5, 20.0]).collect()
    assert {(r["run"], r["id"], r["cid"], r["kind"]) for r in few} == {
        (run, i, -1 - i, "noise") for run in (0, 1) for i in range(3)}
    with pytest.raises(ValueError):
        de.density_cuts(de.density_forest(points(spark, np.zeros((6, 1))), 1.0), [2.0])
