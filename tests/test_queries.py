import duckdb
import pytest

import __spark_entry__ as entry
from oracle_check import TABLES, compare

SF = "/root/testdata/sf0.001"
QUICK = ["fea2_top_variance", "jn1_knn_self_join", "jn6_majority_vote", "ag1_cluster_profiles", "sc9_rule_pool",
         "ev1_threshold_curve", "ev5_fallback_budget", "gr2_partition_quality", "gr9_connected_components",
         "cln1_clean_strict", "cln8_encode_category", "smp3_train_test_split", "flw3_length_histogram",
         "flw4_gap_histogram", "bl2_lof_new_rows", "snk3_outcome_export", "ag4_cluster_summary_tp_cnt"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, con, name):
    out = compare(name, spark, SF, con, entry.queries(), entry.oracle_sql())
    assert out.startswith("ok"), out


def test_registry_is_consistent():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100


def test_plan_shapes(spark):
    """Alarm-level work never runs through a cartesian product; filters and columns reach the scan."""
    q = entry.queries()
    for name in ("jn1_knn_self_join", "ev1_threshold_curve", "cln1_clean_strict", "flw3_length_histogram"):
        plan = q[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
    plan = q["src8_packet_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan
