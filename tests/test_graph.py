import itertools

import numpy as np

import alarmloom.operators.clusters as cl
import alarmloom.operators.graph as gr
import alarmloom.runtime as rt
from test_neighbors import components, distances, points


def graph(spark, pairs):
    rows = [(0, a, b, 1.0) for a, b in pairs] + [(0, b, a, 1.0) for a, b in pairs]
    e = spark.createDataFrame(rows, "graph long, src long, dst long, w double")
    return e, e.selectExpr("graph", "src AS id").distinct()


def quality(edges, labels, gamma):
    k = {}
    for a, b in edges:
        k[a] = k.get(a, 0) + 1
        k[b] = k.get(b, 0) + 1
    m2 = sum(k.values())
    inner = 2 * sum(labels[a] == labels[b] for a, b in edges)
    tot = {}
    for v, d in k.items():
        tot[labels[v]] = tot.get(labels[v], 0) + d
    return inner / m2 - gamma * sum(t * t for t in tot.values()) / (m2 * m2)


def test_communities(spark):
    """Ring of cliques plus a hub star: planted parts found, connected, at least as good as trivial."""
    pairs = []
    for c in range(4):
        base = c * 10
        pairs += list(itertools.combinations(range(base, base + 5), 2))
        pairs.append((base + 4, (base + 10) % 40))
    pairs += [(100, 100 + i) for i in range(1, 30)]
    e, v = graph(spark, pairs)
    runs = [(0, 0, 1.0), (1, 0, 0.05), (2, 0, 50.0)]
    got = {}
    for r in gr.communities(e, v, runs).collect():
        got.setdefault(r["run"], {})[r["id"]] = r["cid"]
    ids = sorted(got[0])
    assert all(sorted(m) == ids for m in got.values())
    for c in range(4):
        assert len({got[0][c * 10 + i] for i in range(5)}) == 1
    whole = dict(zip(ids, [components(200, pairs)[i] for i in ids]))
    for run, _, gamma in runs:
        q = quality(pairs, got[run], gamma)
        assert q >= quality(pairs, whole, gamma) - 1e-9
        assert q >= quality(pairs, {i: i for i in ids}, gamma) - 1e-9
        inside = [(a, b) for a, b in pairs if got[run][a] == got[run][b]]
        parts = components(200, inside)
        assert len({parts[i] for i in ids}) == len(set(got[run].values()))
    assert len(set(got[2].values())) == len(ids)


def test_components_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(rt, "BROADCAST_LIMIT", 0)
    rng = np.random.default_rng(0)
    pairs = [(i, i + 1) for i in range(40)] + [(50, 50 + i) for i in range(1, 40)]
    pairs += [tuple(sorted(p)) for p in rng.integers(100, 160, (50, 2)).tolist() if p[0] != p[1]]
    e, v = graph(spark, pairs)
    got = {r["id"]: r["comp"] for r in gr.connected_components(e, v).collect()}
    want = components(200, pairs)
    assert got == {i: want[i] for i in got}


def test_component_round_reads_its_edges_four_times(spark, monkeypatch):
    """The driver keeps what it knows of every node, stage and task: a round is planned with four scans and four exchanges."""
    plans = []

    def noted(df, label="t"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return rt.durable(df, label)

    monkeypatch.setattr(gr, "durable", noted)
    e, v = graph(spark, [(i, i + 1) for i in range(20)] + [(30, 30)])
    want = components(31, [(i, i + 1) for i in range(20)])
    assert {r["id"]: r["comp"] for r in gr.connected_components(e, v).collect()} == {i: want[i] for i in [*range(21), 30]}
    assert len(plans) > 2
    for p in plans[1:]:
        assert p.count("FileScan") <= 4 and p.count("Exchange hashpartitioning") <= 4


def test_quality_and_density(spark):
    pairs = [(0, 1), (1, 2), (0, 2), (3, 4), (2, 3)]
    e, v = graph(spark, pairs)
    labels = {0: 0, 1: 0, 2: 0, 3: 1, 4: 1}
    m = spark.createDataFrame([(0, i, c) for i, c in labels.items()], "run long, id long, cid long")
    q = gr.partition_quality(e.withColumnRenamed("graph", "run"), m, {0: 0.7}).head()["quality"]
    assert abs(q - quality(pairs, labels, 0.7)) < 1e-12
    assert gr.average_degree(e, v).head()["avg_degree"] == 2.0
    assert gr.usable_resolutions([0.5, 10.0], True) == [0.5]
    assert gr.fallback_resolution(10.0, True, [1.0, 0.5, 10.0]) == 0.5
    assert gr.fallback_resolution(10.0, True, [0.5, 10.0], 1.0) == 1.0


def test_dbscan_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, .3, (40, 2)), rng.normal(3, .3, (30, 2)), rng.uniform(-4, 6, (20, 2)),
                        np.full((20, 2), 9.0)])
    eps = 0.4
    near = distances(x, x) <= eps
    core = near.sum(1) >= 5
    comp = components(len(x), [(i, j) for i, j in zip(*np.nonzero(near)) if core[i] and core[j]])
    want = {}
    for i in range(len(x)):
        if core[i]:
            want[i] = comp[i]
        else:
            adj = [comp[j] for j in np.nonzero(near[i])[0] if core[j]]
            want[i] = min(adj) if adj else -1 - i
    got = cl.dbscan(points(spark, x), eps, rows_per_cell=30, block_rows=8).collect()
    assert {r["id"]: r["cid"] for r in got} == want


def test_merge_micro_clusters(spark):
    x = np.array([[0.0], [0.1], [0.2], [0.3], [0.4], [5.0], [5.1], [5.2], [5.3], [5.4], [0.25], [5.25]])
    cids = [0] * 5 + [1] * 5 + [2, 3]
    m = spark.createDataFrame([(0, i, c) for i, c in enumerate(cids)], "run long, id long, cid long")
    from alarmloom.operators.neighbors import knn_join

    p = points(spark, x)
    for knn in (None, knn_join(p, None, 3, True), knn_join(p, None, 11, True)):
        got = {(r["min_size"], r["id"]): (r["cid"], r["merge_skipped"])
               for r in cl.merge_micro_clusters(p, m, [2, 100], knn).collect()}
        assert got[(2, 10)] == (0, False) and got[(2, 11)] == (1, False)
        assert all(got[(100, i)] == (c, True) for i, c in enumerate(cids))


def test_profiles_golden(spark):
    x = np.array([[0.0, 0.0], [2.0, 0.0], [4.0, 3.0]])
    m = spark.createDataFrame([(0, 0, 5), (0, 1, 5), (0, 2, 7)], "run long, id long, cid long")
    kd = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 9.0)], "id long, kdist double")
    got = {r["cid"]: r for r in cl.cluster_profiles(points(spark, x), m, kd).collect()}
    assert got[5]["size"] == 2 and got[5]["avg_kdist"] == 2.0
    assert got[5]["avg_intra_dist"] == 1.0 and got[5]["max_radius"] == 1.0
    assert got[5]["dist_to_anchor"] == 0.0 and abs(got[7]["dist_to_anchor"] - np.sqrt(18)) < 1e-12
    assert abs(got[7]["dist_to_global"] - np.sqrt(8)) < 1e-12
    assert abs(got[7]["density_score"] - 1e6) < 1e-3


def test_kmeans_bounds(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, .1, (10, 2)) for c in (0, 5)])
    p = points(spark, x)
    m = cl.kmeans(p, 2, tries=2)
    assert m.count() == 20 and m.select("cid").distinct().count() <= 2
    one = m.selectExpr("id", "0L AS cid")
    assert cl.total_spread(p, m).head()["cost"] < cl.total_spread(p, one).head()["cost"]


def best_quality(n, pairs, gamma):
    """Greatest quality of all partitions of n vertices (restricted growth strings)."""
    best = -np.inf

    def grow(labels, used):
        nonlocal best
        if len(labels) == n:
            best = max(best, quality(pairs, dict(enumerate(labels)), gamma))
            return
        for c in range(used + 1):
            grow([*labels, c], max(used, c + 1))

    grow([0], 1)
    return best


def test_quality_next_to_the_best_of_all_partitions(spark):
    """Twelve small graphs as runs of one job: no quality is far below the optimum, most are at it."""
    rng = np.random.default_rng(11)
    edges, nodes, runs, want, all_pairs = [], [], [], {}, {}
    for g in range(12):
        n = 7 if g % 2 else 8
        pairs = sorted({tuple(sorted(p)) for p in rng.integers(0, n, (14, 2)).tolist() if p[0] != p[1]} | {(0, 1)})
        edges += [(g, a, b, 1.0) for x, y in pairs for a, b in ((x, y), (y, x))]
        nodes += [(g, i) for i in range(n)]
        gamma = [0.5, 1.0, 2.0][g % 3]
        runs.append((g, g, gamma))
        want[g], all_pairs[g] = best_quality(n, pairs, gamma), (pairs, gamma)
    e = spark.createDataFrame(edges, "graph long, src long, dst long, w double")
    v = spark.createDataFrame(nodes, "graph long, id long")
    labels = {g: {} for g in want}
    for r in gr.communities(e, v, runs).collect():
        labels[r["run"]][r["id"]] = r["cid"]
    got = {g: quality(all_pairs[g][0], labels[g], all_pairs[g][1]) for g in want}
    gaps = [round(want[g] - got[g], 4) for g in want]
    assert min(gaps) >= 0 and max(gaps) <= 0.1, gaps
    assert sum(gaps) <= 0.3, gaps


def test_refined_parts_are_connected_and_stay_inside(spark):
    """Two cliques and a path that one community holds: parts never leave it and are connected; cliques grow together."""
    clique = lambda at: [(at + i, at + j) for i in range(6) for j in range(i)]
    pairs = clique(0) + clique(10) + [(20, 21), (22, 23), (5, 20), (30, 31), (30, 32), (31, 32)]
    e, _ = graph(spark, pairs)
    e = e.withColumnRenamed("graph", "run")
    ids = sorted({x for p in pairs for x in p})
    degree = {i: sum(i in p for p in pairs) for i in ids}
    community = {i: 30 if i >= 30 else 0 for i in ids}
    moved = spark.createDataFrame([(0, i, float(degree[i]), 0.0, community[i]) for i in ids], "run long, id long, k double, self double, cid long")
    for tick in range(3):
        sub = {r["id"]: r["sub"] for r in gr._refined(e, moved, {0: 1.0}, {0: 2.0 * len(pairs)}, len(ids), tick * 100).collect()}
        assert set(sub) == set(ids) and all(community[s] == community[i] for i, s in sub.items())
        within = [p for p in pairs if sub[p[0]] == sub[p[1]]]
        comp = components(max(ids) + 1, within)
        assert all(comp[i] == comp[j] for i in ids for j in ids if sub[i] == sub[j])
        assert len(set(sub.values())) < len(ids) - 6 and sub[0] != sub[10]
