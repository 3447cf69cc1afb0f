"""Neighbour graphs, connected components, partition quality and community detection.

Every table carries a key (``graph`` or ``run``), so that a whole parameter grid is one job per
step instead of one loop per cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import dense_rank_global, running_totals
from ..runtime import durable, local_rows, lookup_join, union_all

MAX_WEIGHT = 1e4
DENSE_DEGREE = 25.0
_GAIN_EPS = 1e-9
# A superstep that raises the quality by less than this counts as stalled.
_STALL = 1e-3
# Steps in which the parts of communities are grown again.
REFINE_STEPS = 3


def per_key(key: str, values: dict, default: float = 0.0) -> Column:
    """Small driver-side table (one entry per run) as a CASE expression."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(F.col(key) == F.lit(k), F.lit(v)).otherwise(out)
    return out


def knn_graph(knn: DataFrame, ks: list[int] | None = None) -> DataFrame:
    """Symmetric weighted edges (graph, src, dst, w); w = 1 / (d + 1e-4), parallel edges by max.

    ``ks`` builds one graph per k from the prefixes of a single neighbour list; graph = k.
    """
    if ks:
        pick = F.explode(F.array(*[F.lit(k) for k in sorted(ks)]))
        knn = knn.select("*", pick.alias("_k")).filter(F.col("rank") <= F.col("_k"))
        graph = F.col("_k").cast("long")
    else:
        graph = F.col("grp") if "grp" in knn.columns else F.lit(0).cast("long")
    w = F.least(F.lit(1.0) / (F.col("d") + F.lit(1e-4)), F.lit(MAX_WEIGHT))
    pairs = knn.filter(F.col("src") != F.col("dst")).select(
        graph.alias("graph"),
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w.alias("w"),
    ).groupBy("graph", "a", "b").agg(F.max("w").alias("w"))
    ends = F.explode(F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst")),
    ))
    return pairs.select("graph", ends.alias("e"), "w").select("graph", "e.src", "e.dst", "w")


def average_degree(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(graph, avg_degree): 2 x undirected edges / vertices; ``edges`` holds both directions."""
    m = edges.groupBy("graph").agg(F.count("*").alias("m"))
    n = vertices.groupBy("graph").agg(F.count("*").alias("n"))
    degree = F.coalesce("m", F.lit(0)) / F.greatest(F.col("n"), F.lit(1))
    return n.join(m, "graph", "left").select("graph", degree.alias("avg_degree"))


def dense_graphs(edges: DataFrame, vertices: DataFrame, limit: float = DENSE_DEGREE) -> set[int]:
    rows = average_degree(edges, vertices).filter(F.col("avg_degree") > limit).collect()
    return {r["graph"] for r in rows}


def usable_resolutions(resolutions: list[float], dense: bool) -> list[float]:
    """The sweep skips resolutions of 10 and more on dense graphs."""
    return [r for r in resolutions if not (dense and r >= 10.0)]


def fallback_resolution(
    resolution: float, dense: bool, resolutions: list[float], dense_fallback: float | None = None
) -> float:
    """Final runs on a dense graph fall back to the smallest listed resolution below 10."""
    if not (dense and resolution >= 10.0):
        return resolution
    return dense_fallback if dense_fallback is not None else min(r for r in resolutions if r < 10.0)


# --- connected components ---------------------------------------------------------------------

def connected_components(
    edges: DataFrame, vertices: DataFrame, by: str = "graph", max_rounds: int = 60
) -> DataFrame:
    """(by, id, comp) with comp = smallest id of the component.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): a logarithmic number of
    rounds, minima are combined before the shuffle, and the way back to the rows is a salted join.
    It ends when a round changes nothing; a labelling that is not final after ``max_rounds`` is an error.
    A round has three exchanges: what the large star repeats goes into minima, and leaves with the small star's copies.
    """
    e = durable(
        edges.filter(F.col("src") != F.col("dst"))
        .select(by, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(), "cc",
    )
    last, n = None, None
    for _ in range(max_rounds):
        n = 2 * e.count() if n is None else n  # at most this many vertices have an edge
        ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
        both = e.select(by, ways.alias("w")).select(by, "w.*")
        low = both.groupBy(by, "u").agg(F.min("v").alias("m")).select(
            by, "u", F.least("m", "u").alias("m"))
        large = lookup_join(both, low, [by, "u"], ["v"], "inner", n).filter(F.col("v") > F.col("u")).select(
            by, F.col("v").alias("u"), F.col("m").alias("v"))
        small_low = large.groupBy(by, "u").agg(F.min("v").alias("m"))
        linked = lookup_join(large, small_low, [by, "u"], ["v"], "inner", n)
        star = linked.select(by, F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        e = durable(star, "cc")
        sign = e.agg(F.expr("count(*) AS n"),
                     F.expr(f"sum(cast(xxhash64({by}, u, v) AS decimal(38, 0))) AS h")).head()
        if sign == last:
            break
        last = sign
    else:
        raise RuntimeError(f"components are not final after {max_rounds} rounds")
    roots = e.select(by, F.col("u").alias("id"), F.col("v").alias("comp"))
    return vertices.select(by, "id").join(roots, [by, "id"], "left").select(
        by, "id", F.coalesce("comp", "id").alias("comp"))


# --- partition quality ---------------------------------------------------------------------------

def partition_quality(
    edges: DataFrame, membership: DataFrame, gamma: dict, by: str = "run"
) -> DataFrame:
    """(by, quality): sum over ij in one community of A_ij - gamma k_i k_j / 2m, divided by 2m.

    ``edges`` (by, src, dst, w) holds both directions and no self-loops.
    """
    m = membership.select(by, "id", "cid")
    half = lookup_join(edges, m.select(by, F.col("id").alias("src"), F.col("cid").alias("c1")),
                       [by, "src"], ["dst"])
    per_src = half.groupBy(by, "src", "c1", "dst").agg(F.sum("w").alias("w"))
    full = lookup_join(per_src, m.select(by, F.col("id").alias("dst"), F.col("cid").alias("c2")),
                       [by, "dst"], ["src"])
    per_cid = full.groupBy(by, F.col("c1").alias("cid")).agg(
        F.sum(F.when(F.col("c1") == F.col("c2"), F.col("w")).otherwise(0.0)).alias("inner"),
        F.sum("w").alias("k"),
    )
    tot = per_cid.groupBy(by).agg(
        F.sum("inner").alias("inner"), F.sum("k").alias("m2"),
        F.sum(F.col("k") * F.col("k")).alias("kk"),
    )
    g = per_key(by, gamma)
    return tot.select(
        by, (F.col("inner") / F.col("m2") - g * F.col("kk") / (F.col("m2") * F.col("m2")))
        .alias("quality"))


# --- community detection ---------------------------------------------------------------------------

def _superstep(edges: DataFrame, state: DataFrame, params: DataFrame, n: int) -> DataFrame:
    """One parallel local move; returns the new state with what is needed to judge the old one.

    ``params`` has one row per active run: coef = resolution / 2m, the share of vertices allowed to
    move (of 1024) and a tick for the coin. It comes as a table, so every superstep has the same
    generated code.
    """
    totals = state.groupBy("run", "cid").agg(F.expr("sum(k) AS kc"))
    where = state.selectExpr("run", "id AS dst", "cid")
    toward = lookup_join(edges, where, ["run", "dst"], ["src"], "inner", n, hot=False).select(
        "run", "src", "cid", "w")
    # staying and going back to an own community are always candidates
    own = state.selectExpr("run", "id AS src", "explode(array(cid, id)) AS cid", "0D AS w")
    links = toward.union(own).groupBy("run", "src", "cid").agg(F.expr("sum(w) AS link"))
    links = lookup_join(links, totals, ["run", "cid"], ["src"], "left", n)
    now = state.selectExpr("run", "id AS src", "k", "self", "cid AS old").join(
        F.broadcast(params), "run")
    scored = lookup_join(links, now, ["run", "src"], ["cid"], "inner", n, hot=False).selectExpr(
        "*", "link - coef * k * (coalesce(kc, 0D) - if(cid = old, k, 0D)) AS gain")
    best = scored.groupBy("run", "src").agg(
        F.expr("max_by(struct(cid, gain), struct(round(gain, 9), -cid)) AS b"),
        F.expr("max(if(cid = old, gain, null)) AS stay"),
        F.expr("max(if(cid = old, link, null)) AS own"),
        F.expr("max(if(cid = old, kc, null)) AS kc"),
        F.expr("first(struct(k, self, old, share, tick)) AS v"))
    return best.selectExpr(
        "run", "src AS id", "v.k", "v.self", "own", "kc", f"b.gain > stay + {_GAIN_EPS!r}D AS wants",
        f"if(b.gain > stay + {_GAIN_EPS!r}D AND pmod(xxhash64(src, v.tick), 1024) < v.share, "
        "b.cid, v.old) AS cid")


def _local_moves(edges, state, runs: dict, two_m: dict, n: int, seed: int, level: int, cap: int):
    """Supersteps of one level; returns the best state of each run and the runs whose quality rose by more than the stall."""
    spark = edges.sparkSession
    active = set(runs)
    share = {r: 512 for r in runs}
    falls = {r: 0 for r in runs}
    best: dict = {}
    first: dict = {}
    states = [state]
    for t in range(cap + 1):
        tick = seed * 1_000_000 + level * 1000 + t
        params = local_rows(
            spark, [(r, runs[r] / two_m[r], share[r], tick) for r in sorted(active)],
            "run long, coef double, share int, tick long")
        live = F.broadcast(params.select("run"))
        current = states[-1].join(live, "run", "left_semi")
        step = _superstep(edges.join(live, "run", "left_semi"), current, params, n)
        nxt = durable(step, "move")
        # the quality of the old state is a sum over vertices
        seen = nxt.groupBy("run").agg(F.expr("sum(own + self) AS inner"), F.expr("sum(k * kc) AS kk"),
                                      F.expr("count_if(wants) AS wants")).collect()
        for got in seen:
            r, m2 = got["run"], two_m[got["run"]]
            q = got["inner"] / m2 - runs[r] * got["kk"] / (m2 * m2)
            first.setdefault(r, q)
            gained = q - best[r][0] if r in best else 1.0
            if gained > 0:
                best[r] = (q, t)
            if gained <= _STALL:
                falls[r] += 1
                share[r] = max(64, share[r] // 2)
            if got["wants"] == 0 or falls[r] >= 2:
                active.discard(r)
        if not active or t == cap:
            break
        states.append(nxt.select("run", "id", "k", "self", "cid"))
    picked = union_all([
        states[t].filter(F.col("run").isin([r for r in best if best[r][1] == t]))
        for t in sorted({b[1] for b in best.values()})
    ])
    return picked, {r for r in best if best[r][0] - first[r] > _STALL}


def _refined(links: DataFrame, moved: DataFrame, gamma: dict, two_m: dict, n: int, tick: int) -> DataFrame:
    """(run, id, k, self, cid, sub): every community re-grown from singletons into well-connected parts.

    A part is well connected if its links to the rest of its community reach what its strength makes expected. In each of
    ``REFINE_STEPS`` steps a coin names three in four as movers; a mover that is still alone and well connected joins the well-connected part
    of its community with the greatest positive gain. A part is joined only while its founder stays (it is no mover, or has
    been joined before), so that moves made at the same time cannot undo each other."""
    where = moved.select("run", "id", "cid")
    half = lookup_join(links, where.selectExpr("run", "id AS src", "cid"), ["run", "src"], ["dst"], "inner", n, hot=False)
    inner = durable(lookup_join(half, where.selectExpr("run", "id AS dst", "cid AS c2"), ["run", "dst"], ["src"], "inner", n, hot=False)
                    .filter("cid = c2").select("run", "src", "dst", "w"), "inner")
    own = inner.groupBy("run", F.col("src").alias("id")).agg(F.expr("sum(w) AS own"))
    totals = moved.groupBy("run", "cid").agg(F.expr("sum(k) AS kc"))
    state = lookup_join(moved.join(own, ["run", "id"], "left"), totals, ["run", "cid"], ["id"], "inner", n).selectExpr(
        "run", "id", "k", "self", "cid", "coalesce(own, 0D) AS own", "kc", "id AS sub")
    state = durable(state, "refine")
    coef = F.broadcast(local_rows(links.sparkSession, [(r, gamma[r] / two_m[r]) for r in sorted(gamma)], "run long, coef double"))
    for t in range(REFINE_STEPS):
        coin = f"pmod(xxhash64({{}}, {tick + t}), 4) > 0"
        subs = state.selectExpr("run", "id AS dst", "sub")
        toward = lookup_join(inner, subs, ["run", "dst"], ["src"], "inner", n, hot=False).groupBy("run", "src", "sub").agg(F.expr("sum(w) AS link"))
        kept = toward.join(state.selectExpr("run", "id AS src", "sub"), ["run", "src", "sub"]).groupBy("run", "sub").agg(
            F.expr("sum(link) AS within"))
        parts = state.groupBy("run", "sub").agg(
            F.expr("sum(k) AS ks"), F.expr("sum(own) AS own"), F.expr("first(kc) AS kc"), F.expr("count(*) AS size"))
        parts = parts.join(kept, ["run", "sub"], "left").join(coef, "run").withColumn(
            "good", F.expr("own - coalesce(within, 0D) >= coef * ks * (kc - ks) - 1e-12"))
        parts = parts.select("run", "sub", "ks", "size", "good")
        alone = state.join(parts.filter("size = 1 AND good").select("run", F.col("sub").alias("id")), ["run", "id"], "left_semi").filter(
            coin.format("id")).selectExpr("run", "id AS src", "k")
        open_parts = parts.filter("good").filter(f"size > 1 OR NOT ({coin.format('sub')})").selectExpr("run", "sub", "ks")
        ways = lookup_join(lookup_join(toward, open_parts, ["run", "sub"], ["src"], "inner", n), alone, ["run", "src"], ["sub"], "inner", n, hot=False)
        best = ways.join(coef, "run").withColumn("gain", F.expr("link - coef * k * ks")).filter(f"gain > {_GAIN_EPS!r}D").groupBy(
            "run", F.col("src").alias("id")).agg(F.expr("max_by(sub, struct(round(gain, 9), -sub)) AS to"))
        state = durable(state.join(best, ["run", "id"], "left").withColumn("sub", F.coalesce("to", "sub")).drop("to"), "refine")
    return state.select("run", "id", "k", "self", "cid", "sub")


def communities(
    edges: DataFrame, vertices: DataFrame, runs: list[tuple[int, int, float]], seed: int = 42,
    supersteps: int = 8, levels: int = 10,
) -> DataFrame:
    """(run, id, cid) for every (run, graph, resolution) in ``runs``.

    Maximises the weighted Reichardt-Bornholdt quality as Traag, Waltman & van Eck (2019) do, with parallel moves. A
    level moves vertices between communities, refines the communities into well-connected parts, and contracts the
    graph to the parts; the next level starts from the communities, so that whole parts can still change sides. Communities
    are split into their connected parts at the end; one community per component and all singletons are also judged and the
    best is returned. Ids are renumbered by size, then by smallest member.

    Limits. A level ends when no vertex wants to move, after ``supersteps`` steps (half of them above the first
    level), or when the quality has risen by less than ``_STALL`` twice; the best state seen counts. Levels end when no part
    holds two vertices, after a level that raises the quality by no more than the stall, or after ``levels``. So a result may hold vertices that would still gain by
    moving, by less than the stall in sum for each level; it is never worse than any state that was seen.
    """
    spark = edges.sparkSession
    plan = local_rows(spark, runs, "run long, graph long, gamma double")
    gamma = {r: g for r, _, g in runs}
    keys = F.broadcast(plan.select("run", "graph"))
    base = durable(edges.join(keys, "graph").select("run", "src", "dst", "w"), "edges")
    nodes = vertices.select("graph", "id").join(keys, "graph").select("run", "id")
    strength = base.groupBy("run", F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    state = durable(
        nodes.join(strength, ["run", "id"], "left").select(
            "run", "id", F.coalesce("k", F.lit(0.0)).alias("k"), F.lit(0.0).alias("self"),
            F.col("id").alias("cid")), "state")
    sums = state.groupBy("run").agg(F.sum("k").alias("m"), F.count("*").alias("n")).collect()
    two_m = {r["run"]: r["m"] for r in sums}
    n = sum(r["n"] for r in sums)
    todo = {r: g for r, g in gamma.items() if two_m.get(r, 0.0) > 0}
    membership = state.select("run", "id", F.col("id").alias("node"), F.col("id").alias("cid"))
    links = base
    for level in range(levels if todo else 0):
        moved, better = _local_moves(links, state, todo, two_m, n, seed, level,
                                     supersteps if level == 0 else max(2, supersteps // 2))
        todo = {r: g for r, g in todo.items() if r in better}
        goes_on = F.col("run").isin(sorted(todo))
        ended = moved.filter(~goes_on).selectExpr("run", "id", "k", "self", "cid", "id AS sub")
        if todo:
            parts = _refined(links.filter(goes_on), moved.filter(goes_on), todo, two_m, n, seed * 1_000_000 + level * 1000 + 500)
            # communities are named after the least part they hold, parts after their founders
            names = parts.groupBy("run", "cid").agg(F.min("sub").alias("name"))
            named = lookup_join(parts, names, ["run", "cid"], ["id"], "inner", n).drop("cid").withColumnRenamed("name", "cid")
            parts = durable(named.unionByName(ended), "parts")
            seen = parts.groupBy("run").agg(F.expr("count_if(id <> sub) AS joined")).filter("joined > 0").collect()
            todo = {r["run"]: todo[r["run"]] for r in seen}
        else:
            parts = ended
        to = parts.selectExpr("run", "id AS node", "sub", "cid AS now")
        membership = durable(
            lookup_join(membership, to, ["run", "node"], ["id"], "left", n, hot=False)
            .selectExpr("run", "id", "coalesce(sub, node) AS node", "coalesce(now, cid) AS cid"), "member")
        if not todo:
            break
        kept = F.col("run").isin(sorted(todo))
        a = to.filter(kept).selectExpr("run", "node AS src", "sub AS s1")
        b = to.filter(kept).selectExpr("run", "node AS dst", "sub AS s2")
        joined = lookup_join(lookup_join(links.filter(kept), a, ["run", "src"], ["dst"], "inner", n, hot=False), b,
                             ["run", "dst"], ["src"], "inner", n, hot=False)
        folded = durable(joined.groupBy("run", F.col("s1").alias("src"), F.col("s2").alias("dst"))
                         .agg(F.sum("w").alias("w")), "fold")
        loops = folded.filter(F.col("src") == F.col("dst")).select(
            "run", F.col("src").alias("id"), F.col("w").alias("loop"))
        sums = parts.filter(kept).groupBy("run", F.col("sub").alias("id")).agg(
            F.sum("k").alias("k"), F.sum("self").alias("self"), F.first("cid").alias("cid"))
        state = sums.join(loops, ["run", "id"], "left").select(
            "run", "id", "k", (F.col("self") + F.coalesce("loop", F.lit(0.0))).alias("self"), "cid")
        links = folded.filter(F.col("src") != F.col("dst"))
    return renumber(_best_partition(base, membership.select("run", "id", "cid"), runs, gamma), "run")


def _best_partition(base, membership, runs, gamma) -> DataFrame:
    """The found partition with its communities split into connected parts, or a trivial one."""
    m = membership
    c1 = m.select("run", F.col("id").alias("src"), F.col("cid").alias("c1"))
    c2 = m.select("run", F.col("id").alias("dst"), F.col("cid").alias("c2"))
    inner = lookup_join(lookup_join(base.filter(F.col("src") < F.col("dst")), c1, ["run", "src"],
                                    ["dst"]), c2, ["run", "dst"], ["src"])
    inner = inner.filter(F.col("c1") == F.col("c2"))
    # candidate key = 3 * run + kind (0 found and split, 1 whole components, 2 singletons)
    one_per_graph = {g: r for r, g, _ in reversed(runs)}
    whole = base.filter(F.col("run").isin(sorted(one_per_graph.values())))
    cc_edges = inner.select((F.col("run") * 3).alias("run"), "src", "dst").unionByName(
        whole.select((F.col("run") * 3 + 1).alias("run"), "src", "dst"))
    ids = m.select("run", "id")
    cc_ids = ids.select((F.col("run") * 3).alias("run"), "id").unionByName(
        ids.filter(F.col("run").isin(sorted(one_per_graph.values())))
        .select((F.col("run") * 3 + 1).alias("run"), "id"))
    parts = durable(connected_components(cc_edges, cc_ids, "run").withColumnRenamed("comp", "cid"),
                    "parts")
    shared = [(one_per_graph[g] * 3 + 1, r * 3 + 1) for r, g, _ in runs]
    spread = F.broadcast(local_rows(base.sparkSession, shared, "run long, to long"))
    candidates = durable(union_all([
        parts.filter(F.col("run") % 3 == 0),
        parts.filter(F.col("run") % 3 == 1).join(spread, "run").select(
            F.col("to").alias("run"), "id", "cid"),
        ids.select((F.col("run") * 3 + 2).alias("run"), "id", F.col("id").alias("cid")),
    ]), "cand")
    kinds = F.explode(F.array(*[F.lit(i) for i in range(3)]))
    tripled = base.select("*", kinds.alias("_k")).select(
        (F.col("run") * 3 + F.col("_k")).alias("run"), "src", "dst", "w")
    g3 = {r * 3 + i: g for r, g in gamma.items() for i in range(3)}
    winner: dict = {}
    for row in partition_quality(tripled, candidates, g3).collect():
        r, kind = divmod(row["run"], 3)
        rank = (round(row["quality"], 12), -kind)
        if r not in winner or rank > winner[r][0]:
            winner[r] = (rank, row["run"])
    chosen = [winner[r][1] if r in winner else r * 3 + 2 for r in gamma]
    return candidates.filter(F.col("run").isin(chosen)).select(
        F.expr("run div 3").alias("run"), "id", "cid")


def renumber(membership: DataFrame, by: str) -> DataFrame:
    """cid = 0, 1, ... by descending size, then smallest member, within ``by``."""
    sizes = membership.groupBy(by, "cid").agg(F.count("*").alias("n"), F.min("id").alias("lead"))
    ranked = _rank_by_size(sizes, by)
    return durable(lookup_join(membership, ranked, [by, "cid"], ["id"]).select(
        by, "id", F.col("new").alias("cid")), "communities")


def _rank_by_size(sizes: DataFrame, by: str) -> DataFrame:
    """Larger communities first: running counts over the size classes, then ranks inside each."""
    sizes = durable(sizes, "sizes")
    classes = sizes.groupBy(by, "n").agg(F.count("*").alias("many"))
    upto = running_totals(durable(classes, "classes"), "n", {"many": "seen"}, [by])
    before = upto.select(by, "n", (F.col("seen") - F.col("many")).alias("before"))
    inner = dense_rank_global(sizes.withColumn("_bn", F.concat_ws(":", by, "n")), "lead", "pos",
                              ["_bn"])
    return inner.join(before, [by, "n"]).select(
        by, "cid", (F.col("before") + F.col("pos")).alias("new"))


def singleton_communities(vertices: DataFrame) -> DataFrame:
    """Fallback labelling: every vertex is its own community."""
    return vertices.select("graph", "id", F.col("id").alias("cid"))
