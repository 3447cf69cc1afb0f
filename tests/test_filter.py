import pytest
from pyspark.sql import functions as F

import alarmloom.operators.evaluate as ev
import alarmloom.operators.metrics as me
import alarmloom.operators.scoring as sc


def scored(spark, rows):
    return spark.createDataFrame(rows, "id long, score double, y_true int")


CASE = [(0, 0.9, 0), (1, 0.9, 0), (2, 0.8, 1), (3, 0.7, 0), (4, 0.7, 0), (5, 0.2, 1), (6, 0.1, 1), (7, 0.1, 0)]


def test_curve_and_points(spark):
    c = ev.threshold_curve(scored(spark, CASE))
    got = [(r["tau"], r["fp_removed"], r["tp_removed"]) for r in c.orderBy(F.desc("tau")).collect()]
    assert got == [(0.9, 2, 0), (0.8, 2, 1), (0.7, 4, 1), (0.2, 4, 2), (0.1, 5, 3)]
    area = ev.curve_auc(c).head()["auc"]
    x, y = [0, 0, 1 / 3, 1 / 3, 2 / 3, 1], [0, .4, .4, .8, .8, 1.0]
    assert abs(area - sum((x[i] - x[i - 1]) * (y[i] + y[i - 1]) / 2 for i in range(1, 6))) < 1e-12
    p = ev.operating_point(c).head()
    assert p["tau"] == 0.9 and p["CER"] == pytest.approx(0.4 / 0.02) and p["quantile"] == 0.25
    assert p["source"] == "constraints"
    legacy = ev.operating_point(c, rtpr_budget=None).head()
    assert legacy["tau"] == 0.7
    assert ev.operating_point(c, min_rfpr=0.5).head()["source"] == "budget"
    assert ev.operating_point(c, rtpr_budget=None, min_rfpr=2.0).head()["tau"] == 0.7


def test_empty_class_gives_nothing(spark):
    rows = scored(spark, [(0, 0.5, 0), (1, 0.4, 0)])
    assert ev.evaluate_scores(rows).count() == 0


def test_quantile_transfer(spark):
    s = scored(spark, [(i, float(i), i % 2) for i in range(11)])
    assert ev.transfer_quantile(s, 0.3).head()["tau"] == pytest.approx(7.0)
    got = ev.evaluate_scores(s, tau=0.3, quantile_tau=True).head()
    assert (got["fp_removed"], got["tp_removed"]) == (2, 2)


def test_rules(spark):
    prof = spark.createDataFrame([(0, 1, 10, 2.0, 0.5), (0, 2, 30, 4.0, 0.5), (0, 3, 20, 3.0, 0.5)],
                                 "run long, cid long, size long, avg_intra_dist double, avg_kdist double")
    got = {(r["rule"], r["cid"]): r["score"] for r in sc.score_clusters(prof).collect()}
    assert len(got) == 36
    assert got[("intra_high", 2)] == 1.0 and got[("intra_low", 2)] == 0.0 and got[("size_small", 1)] == 1.0
    assert got[("kdist_high", 1)] == 0.5 and got[("combined_fwd", 3)] == 0.5 and got[("combined_inv", 1)] == 0.75
    with pytest.raises(ValueError):
        sc.score_clusters(prof, ["nothing_high"])


def test_alarm_scores_and_blend(spark):
    m = spark.createDataFrame([(0, i, c) for i, c in enumerate([1, 1, 2, 9])], "run long, id long, cid long")
    s = spark.createDataFrame([(0, 1, 10, "r", 0.7), (0, 2, 4, "r", 0.9)],
                              "run long, cid long, size long, rule string, score double")
    rows = sc.alarm_scores(m, s)
    assert {r["id"]: r["score"] for r in rows.collect()} == {0: 0.7, 1: 0.7, 2: 0.0, 3: 0.0}
    kd = spark.createDataFrame([(i, float(i)) for i in range(4)], "id long, kdist double")
    got = {r["id"]: r["score"] for r in sc.blended(rows, kd, [0.5]).collect()}
    assert got[0] == pytest.approx(0.35) and got[3] == pytest.approx(0.5)
    flat = spark.createDataFrame([(i, 1.0) for i in range(4)], "id long, kdist double")
    assert {r["score"] for r in sc.blended(rows, flat, [1.0]).collect()} == {0.0}


def test_metrics_with_zero_denominators(spark):
    pred = spark.createDataFrame([(0, 0), (0, 0)], "y_true int, y_pred int")
    m = me.binary_metrics(pred).head()
    assert (m["precision"], m["recall"], m["f1"], m["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_single_row_group_has_no_deviation(spark):
    r = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 2.0), ("b", "m", None)], "dataset string, model string, auc double")
    got = {x["dataset"]: x for x in me.group_summary(r, ["dataset", "model"], ["auc"]).collect()}
    assert got["a"]["auc_std"] is None and got["b"]["auc_mean"] == 2.0 and got[None]["auc_mean"] == 1.5
    best = me.best_method(r.withColumn("x", F.col("auc")), ["dataset"], [("first", "auc"), ("second", "x")])
    assert {x["best_method"] for x in best.collect()} == {"first"}
