import numpy as np
import pytest
from pyspark.sql import functions as F

import alarmloom.functions.ordered as od
import alarmloom.operators.features as fe
import alarmloom.operators.sampling as sa
from alarmloom import runtime
from alarmloom.functions.scalars import number_or_null
from alarmloom.runtime import durable


def test_running_totals_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(od, "ROWS_PER_RANGE", 50)
    rng = np.random.default_rng(0)
    v = np.unique(np.round(rng.exponential(1, 1000), 4))
    df = durable(spark.createDataFrame([(int(i % 2), float(x), 1 + i % 3) for i, x in enumerate(v)],
                                       "g int, v double, n int"))
    got = {(r["g"], r["v"]): r["c"] for r in od.running_totals(df, "v", {"n": "c"}, ["g"]).collect()}
    total = {0: 0, 1: 0}
    for i in range(len(v) - 1, -1, -1):
        total[i % 2] += 1 + i % 3
        assert got[(i % 2, float(v[i]))] == total[i % 2]


def test_exact_quantile(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 1, 301), 1)
    c = od.value_counts(spark.createDataFrame([(float(v),) for v in x], "v double"), "v")
    for q in (0.0, 0.13, 0.5, 0.99, 1.0):
        assert abs(od.exact_quantile(c, F.lit(q)).head()["quantile"] - np.quantile(x, q)) < 1e-12


@pytest.mark.parametrize("at_once", [1, 7, 100_000])
def test_quantiles_by_selection(spark, monkeypatch, at_once):
    """Every turn of the selection, with a coarse sketch and ties, next to numpy."""
    monkeypatch.setattr(od, "SORTED_AT_ONCE", at_once)
    monkeypatch.setattr(od, "SKETCH_ACCURACY", 20)
    rng = np.random.default_rng(9)
    shares = [0.0, 0.003, 0.13, 0.4, 0.5, 0.6, 0.99, 1.0]
    scales = rng.normal(0, 1, 400) * 10.0 ** rng.integers(-300, 300, 400)
    for x in (np.round(rng.normal(0, 1, 301), 1), np.repeat([1.0, 2.0, 3.0], [49, 1, 50]), np.ones(9), scales, np.array([4.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(3)
        got = od.quantiles(df, "v", shares)
        assert np.allclose(got, np.quantile(x, shares), rtol=1e-12, atol=0)
    assert od.quantiles(df.limit(0), "v", [0.5]) == [None]


def test_selection_writes_nothing_and_narrows(spark, monkeypatch):
    monkeypatch.setattr(od, "durable", None)
    monkeypatch.setattr(od, "SORTED_AT_ONCE", 100)
    df = spark.range(200_000).selectExpr("cast(pmod(id * 7919, 200000) as double) AS v")
    assert od.quantiles(df, "v", [0.25, 0.9]) == [49_999.75, 179_999.1]


def test_number_parsing(spark):
    texts = [" 12 ", "1d", "0x0b", "Infinity", "nan", "", None, "-3.5e2", ".5", "bad"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["n"] for r in df.select("i", number_or_null(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [12.0, None, None, None, None, None, None, -350.0, 0.5, None]


def test_minmax_log_golden(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0, [0.0, 5.0, nan]), (1, [1.0, 5.0, inf]), (2, [4.0, 5.0, 2.0]), (3, [None, 5.0, -inf])],
                               "index long, features array<double>")
    got = {r["index"]: r["features"] for r in fe.minmax_log(df).collect()}
    assert np.allclose(got[1], [np.log2(1.25), 0.0, 0.0]) and np.allclose(got[2], [1.0, 0.0, 1.0])
    assert np.allclose(got[0], 0.0) and np.allclose(got[3], 0.0)
    far = spark.createDataFrame([(9, [8.0, 0.0, -1.0])], "index long, features array<double>")
    assert np.allclose(fe.minmax_log(far, fitted=[(0.0, 4.0), (0.0, 1.0), (0.0, 1.0)]).head()["features"], [1.0, 0.0, 0.0])


def test_selection_and_ks(spark):
    rng = np.random.default_rng(2)
    y = np.arange(60) % 2
    x = np.stack([rng.normal(0, 1, 60), y * 10.0 + rng.normal(0, 1, 60), np.zeros(60), np.zeros(60)], 1)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "index long, features array<double>, y_true int")
    assert fe.top_variance_dims(df, 4) == [1, 0, 2, 3]
    assert fe.top_ks_dims(df, 2)[0] == 1
    assert fe.top_ks_dims(df.limit(4), 2) == [0, 1, 2, 3]


def test_bits(spark):
    df = spark.createDataFrame([([5.9, 2500.0, float("nan")],), ([-1.0, 9e9, 300.0],)], "features array<double>")
    got = [r["bits"] for r in fe.bit_encode(df, [(0, 4, False), (1, 3, True), (2, 8, False)]).collect()]
    assert got[0] == [-1, 1, -1, 1] + [-1, 1, -1] + [-1] * 8
    assert got[1] == [-1] * 4 + [1, 1, 1] + [1] * 8


def test_bit_profile():
    cols = ["Dur", "proto", "sbytes", "dbytes", "sttl", "dttl", "Sload", "Dload", "Spkts", "Dpkts", "smeansz",
            "dmeansz", "Sintpkt", "Dintpkt", "tcprtt", "synack", "ackdat", "ct_src_ ltm", "ct_dst_ltm", "ct_dst_src_ltm"]
    p = fe.bit_profile("UNSW_NB15", cols)
    assert [i for i, _, _ in p] == list(range(20)) and sum(b for _, b, _ in p) == 256
    assert [i for i, _, s in p if s] == [2, 3, 6, 7]
    try:
        fe.bit_profile("unsw-nb15", cols[1:])
        raise AssertionError("a missing input must be an error")
    except ValueError as e:
        assert "dur" in str(e)


def test_robust_z_constant(spark):
    df = spark.createDataFrame([(i, 3.0) for i in range(5)] + [(9, float("nan"))], "id long, v double")
    assert {r["z"] for r in fe.robust_z(df, "v").filter("id < 9").collect()} == {0.0}


def test_hot_stratum_sampling(spark):
    df = spark.range(20000).selectExpr("id", "if(id % 10 = 0, 1, 0) AS y")
    got = sa.stratified_subsample(df, "y", "id", frac=0.013)
    n = {r["y"]: r["count"] for r in got.groupBy("y").count().collect()}
    assert n == {0: 234, 1: 26}
    assert sa.stratified_subsample(df, "y", "id", frac=0.5, max_per_class=7).count() == 14
    assert sa.stratified_subsample(df, "y", "id") is df
    tiny = sa.stratified_fraction(df.limit(3), 0.01, ["y"], "id")
    assert tiny.count() == df.limit(3).select("y").distinct().count()
    again = sa.stratified_subsample(df.repartition(13), "y", "id", frac=0.013)
    assert {r["id"] for r in got.collect()} == {r["id"] for r in again.collect()}


def test_split_guard(spark):
    few = spark.range(30).selectExpr("id AS index", "if(id < 9, 0, 1) AS y_true")
    assert sa.validation_test_split(few) is None


def test_salted_lookup_keeps_a_column_of_the_callers(spark, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_LIMIT", 1)
    rows = spark.createDataFrame([(i % 3, i, f"s{i}") for i in range(60)], "k int, id long, _salt string")
    lookup = spark.createDataFrame([(0, "a"), (1, "b")], "k int, __salt string")
    out = runtime.lookup_join(rows, lookup, ["k"], ["id"], "left")
    assert sorted(out.columns) == ["__salt", "_salt", "id", "k"]
    assert {(r["id"], r["_salt"], r["__salt"]) for r in out.collect()} == {(i, f"s{i}", {0: "a", 1: "b"}.get(i % 3)) for i in range(60)}


@pytest.mark.parametrize("hot", [True, False])
def test_lookups_of_many_rows_stay_off_the_driver(spark, hot):
    rows = spark.range(50).selectExpr("id % 7 AS k", "id")
    lookup = spark.range(5).selectExpr("id AS k", "id * 2 AS v")
    out = runtime.lookup_join(rows, lookup, ["k"], ["id"], "left", 200_000, hot=hot)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and ("explode" in plan) == hot
    assert {(r["id"], r["v"]) for r in out.collect()} == {(i, i % 7 * 2 if i % 7 < 5 else None) for i in range(50)}
