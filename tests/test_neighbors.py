import numpy as np
import pytest

import alarmloom.operators.neighbors as nb
import alarmloom.runtime as rt


def points(spark, x):
    return spark.createDataFrame(
        [(i, [float(v) for v in r]) for i, r in enumerate(x)], "index long, features array<double>")


def distances(a, b):
    d = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d += (a[:, None, j] - b[None, :, j]) ** 2
    return np.sqrt(d)


def brute(x, k, exclude):
    d, out = distances(x, x), set()
    for i in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), d[i])) if not (exclude and i == j)][:k]
        out |= {(i, int(j), r + 1) for r, j in enumerate(order)}
    return out


def skewed(seed=0):
    """A third of the rows are copies of one vector; grid values give many equal distances."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0, 1, (60, 4)), np.zeros((60, 4)), rng.integers(0, 3, (60, 4))])


@pytest.mark.parametrize("exclude", [True, False])
@pytest.mark.parametrize("blocks", [{}, {"rows_per_cell": 20, "block_rows": 8}])
def test_knn_matches_brute_force(spark, exclude, blocks):
    x = skewed()
    got = nb.knn_join(points(spark, x), None, 7, exclude, **blocks).collect()
    assert {(r.src, r.dst, r["rank"]) for r in got} == brute(x, 7, exclude)


def test_knn_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(nb, "BROADCAST_LIMIT", 0)
    monkeypatch.setattr(rt, "BROADCAST_LIMIT", 0)
    x = skewed(3)
    got = nb.knn_join(points(spark, x), None, 5, True, rows_per_cell=40, block_rows=16).collect()
    assert {(r.src, r.dst, r["rank"]) for r in got} == brute(x, 5, True)


def test_fewer_rows_than_k(spark):
    x = np.array([[0.0], [1.0], [3.0]])
    got = nb.knn_join(points(spark, x), None, 10, True)
    assert got.count() == 6
    kd = {r["src"]: r["kdist"] for r in nb.kth_distance(got).collect()}
    assert kd == {0: 3.0, 1: 2.0, 2: 3.0}


def test_groups_stay_apart(spark):
    df = points(spark, np.array([[0.0], [0.1], [0.2], [0.3]])).selectExpr("index", "features", "index % 2 AS g")
    got = {(r.src, r.dst) for r in nb.knn_join(df, None, 1, True, by="g").collect()}
    assert got == {(0, 2), (2, 0), (1, 3), (3, 1)}


@pytest.mark.parametrize("blocks", [{}, {"rows_per_cell": 20, "block_rows": 8}])
def test_range_join_modes(spark, blocks):
    x, eps = skewed(1), 1.0
    near = distances(x, x) <= eps
    df = points(spark, x)
    pairs = {(r.src, r.dst) for r in nb.range_join(df, eps, **blocks).collect()}
    assert pairs == {(int(i), int(j)) for i, j in zip(*np.nonzero(near))}
    counts = {r.src: r.n for r in nb.range_join(df, eps, "count", **blocks).collect()}
    assert counts == dict(enumerate(near.sum(1).tolist()))
    forest = nb.range_join(df, eps, "forest", **blocks).collect()
    assert components(len(x), [(r.src, r.dst) for r in forest]) == components(len(x), pairs)


def test_pairs_of_vectors_without_copies_are_not_joined_again(spark):
    """Two vectors of one id are two rows, as in SQL; pairs meet no table of copies unless there are copies."""
    df = spark.createDataFrame([(1, [0.0]), (1, [0.5]), (2, [10.0])], "index long, features array<double>")
    rows = sorted((r.src, r.dst, r.d) for r in nb.range_join(df, 1.0).collect())
    assert rows == [(1, 1, 0.0), (1, 1, 0.0), (1, 1, 0.5), (1, 1, 0.5), (2, 2, 0.0)]


def test_pairs_of_copies(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [0.0]), (3, [0.5]), (4, [9.0]), (4, [9.0])], "index long, features array<double>")
    others = spark.createDataFrame([(7, [0.1]), (8, [0.1]), (9, [20.0])], "index long, features array<double>")
    own = sorted((r.src, r.dst) for r in nb.range_join(df, 1.0).collect())
    assert own == sorted([(i, j) for i in (1, 2, 3) for j in (1, 2, 3)] + [(4, 4)] * 4)
    assert sorted((r.src, r.dst) for r in nb.range_join(df, 1.0, others=others).collect()) == [(i, j) for i in (1, 2, 3) for j in (7, 8)]


def components(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_majority_vote_takes_lowest_label_on_tie(spark):
    refs = spark.createDataFrame([(10, [0.0], 7), (11, [0.0], 3)], "index long, features array<double>, c long")
    q = points(spark, np.array([[0.1]]))
    assert nb.majority_vote(q, refs, "c").head()["c"] == 3


def block_pairs(n, rows=8, dims=3):
    """``n`` pairs of blocks as a kernel gets them, all in one batch."""
    import pyarrow as pa

    x = np.random.default_rng(5).normal(0, 1, (2, n, rows * dims))
    ids = [list(range(rows))] * n
    return pa.RecordBatch.from_pydict({
        "grp": [0] * n, "q_ids": ids, "q_vecs": x[0].tolist(), "r_ids": ids, "r_vecs": x[1].tolist(), "r_mult": [[1] * rows] * n}), x


@pytest.mark.parametrize("tile", [1, 24, 1 << 20])
def test_kernels_hand_on_each_block_pair(monkeypatch, tile):
    """What a kernel holds must not grow with the block pairs of a batch, nor with the distances of a pair."""
    monkeypatch.setattr(nb, "TILE", tile)
    batch, x = block_pairs(5)
    want = [distances(q.reshape(-1, 3), r.reshape(-1, 3)) for q, r in zip(*x)]
    got = list(nb._nearest_kernel(3, 2)([batch]))
    assert len(got) == 5
    for b, d in zip(got, want):
        assert b.column("dst").to_pylist() == np.argsort(d, axis=1)[:, :2].ravel().tolist()
    for mode in ("pairs", "count", "forest"):
        out = list(nb._within_kernel(3, 1.5, mode)([batch]))
        assert len(out) >= 5
        if mode == "pairs":
            assert sum(b.num_rows for b in out) == sum(int((d <= 1.5).sum()) for d in want)
        if mode == "count":
            assert sum(sum(b.column("dst").to_pylist()) for b in out) == sum(int((d <= 1.5).sum()) for d in want)


def test_visits_are_handed_on_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(nb, "VISITS", 16)
    x = np.random.default_rng(6).normal(0, 1, (40, 2))
    b = pa.RecordBatch.from_pydict({"grp": [0] * 40, "uid": list(range(40)), "vec": x.tolist(), "bound": [9.0] * 40})
    kernel = nb._reach_kernel(x[:4], {0: np.full(4, 9.0)}, {0: np.full(4, 10.0)})
    out = list(kernel([b]))
    assert max(o.num_rows for o in out) <= 16 and sum(o.num_rows for o in out) == 160


def test_a_bounded_block_hands_on_only_what_may_be_nearest():
    """The second round of the join knows how far the k-th neighbour is at most."""
    rng = np.random.default_rng(8)
    q, r = rng.random((40, 3)), np.vstack([rng.random((300, 3)), rng.random((1, 3))])
    d = np.sqrt(((q[:, None] - r[None]) ** 2).sum(2))
    bound = np.sort(d, 1)[:, 1]
    bound[:5], bound[5] = 0.0, 10.0  # nothing in reach; all in reach
    qid, rid = np.arange(40), np.arange(len(r)) + 1000
    got = nb._nearest_in_block(q, qid, r, rid, 4, bound)
    want = {(i, int(j) + 1000) for i in range(40) for j in np.lexsort((np.arange(len(r)), d[i]))[:4] if d[i, j] <= bound[i]}
    assert want == set(zip(got[0].tolist(), got[1].tolist()))
    loose = nb._nearest_in_block(q, qid, r, rid, 4, np.full(40, 10.0))
    assert len(loose[0]) == 4 * 40
