import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import alarmloom.operators.baselines as bl
import alarmloom.operators.flows as fl
import alarmloom.sources.alarm_sets as al
from alarmloom.operators.detectors import fit_detector
from alarmloom.plans import experiment as ex
from alarmloom.runtime import scratch_path
from alarmloom.sources import raw_flows as rf
from alarmloom.sources.raw_flows import load_dataset
from alarmloom.sources.specs import DatasetSpec, dataset_spec


def labelled(spark, n=120, gap=4.0, seed=0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    x = rng.normal(0, 1, (n, 6)) + gap * y[:, None]
    return spark.createDataFrame([(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))],
                                 "index long, features array<double>, y_true int")


def test_flow_markers(spark):
    rows = [("benign/a", 0.0, "b", "a", 1, 2, 6, 1600, 9), ("benign/a", 0.1, "a", "b", 2, 1, 6, None, 20),
            ("benign/a", 4000.0, "a", "b", 2, 1, 6, 16, 9), ("evil/b", 1.0, "a", "b", 5, 5, 17, 40, 9),
            ("evil/b", 1.0, "a", "b", 5, 5, 1, 40, 9)]
    p = spark.createDataFrame(rows, "pcap_path string, ts double, src_ip string, dst_ip string, sport int, dport int, "
                                    "proto int, ip_len int, frame_len int")
    k = fl.with_flow_key(fl.usable_packets(p))
    pl = {r["pcap_path"]: r["pl"] for r in fl.length_histogram(k).collect()}
    assert len(pl["benign/a"]) == 94 and pl["benign/a"][93] == 1 and pl["benign/a"][1] == 2 and sum(pl["benign/a"]) == 3
    ipt = {r["pcap_path"]: r["ipt"] for r in fl.gap_histogram(k).collect()}
    assert ipt == {"benign/a": {1: 1, 56249: 1}, "evil/b": {}}
    data = {r["class_name"]: r["y_true"] for r in fl.flow_dataset(p).collect()}
    assert data == {"benign": 0, "evil": 1}


def test_alarm_json_and_discovery(spark):
    root = scratch_path(spark, "tree")
    import os
    for name in ("Mal-TLS-csv-svm/split_seed3", "broken/split_seed1", "a-b-c/other"):
        os.makedirs(f"{root}/{name}")
        with open(f"{root}/{name}/alert.json", "w") as f:
            json.dump([{"index": i, "features": [0.5, i], "y_true": i % 2, "y_pred": 1} for i in range(3)], f, indent=2)
    e = al.discover_experiments(spark, root).collect()
    assert [(r["dataset"], r["data_type"], r["model"], r["seed"], r["tag"]) for r in e] == [
        ("Mal-TLS", "csv", "svm", 3, "Mal-TLS-csv-svm-seed3")]
    rows = al.load_alarms(spark, e[0]["alert_path"]).orderBy("index").collect()
    assert [r["features"] for r in rows] == [[0.5, 0.0], [0.5, 1.0], [0.5, 2.0]]


def test_experiments_in_one_write(spark, tmp_path):
    """Odd names survive, a large set is several files, and every set is read back from its own folder."""
    names = [("kdd-99", "csv", "svm", 1), ("a/b+c %41", "flow", "rf", -2)]
    rows = [(i, [float(i)], i % 2, *names[i % 50 == 0]) for i in range(400)]
    al.save_experiments(spark.createDataFrame(
        rows, "index long, features array<double>, y_true int, dataset string, data_type string, model string, seed int"), str(tmp_path / "x"), 4)
    found = {(r["dataset"], r["data_type"], r["model"], r["seed"]): r["alert_path"] for r in al.discover_experiments(spark, str(tmp_path)).collect()}
    assert set(found) == set(names)
    for name, path in found.items():
        back = {r["index"]: r["features"] for r in al.load_alarms(spark, path, lines=True).collect()}
        assert back == {r[0]: r[1] for r in rows if r[3:] == name}


def test_windows_1252(spark, tmp_path):
    every = bytes(b for b in range(256) if b not in b'\r\n",\\')
    (tmp_path / "a.csv").write_bytes(b"x" + every + b"x,\x80 5\n")
    got = rf.read_headerless(spark, rf.list_files(spark, str(tmp_path)), ("a", "b")).head()
    text = "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in every)
    assert got["a"] == "x" + text + "x" and got["b"] == "\u20ac 5"


def test_rows_follow_file_and_position(spark):
    """Category codes go by first file and first row, whatever the size and the order of the splits."""
    import os

    from alarmloom.operators.cleaning import encode_category
    root = scratch_path(spark, "ordered")
    os.makedirs(root)
    with open(f"{root}/a 1.csv", "w") as f:
        f.write("proto,v\ntcp,1\nicmp,2\ntcp,3\n")
    with open(f"{root}/b+2.csv", "w") as f:
        f.write("v,proto\n" + "".join(f"{i},{'udp' if i else 'arp'}\n" for i in range(20000)))
    with open(f"{root}/c.csv", "w") as f:
        f.write("proto,v\nsctp,1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = rf.read_headed(spark, rf.list_files(spark, root))
        order = [(r["origin_file"], r["v"]) for r in raw.orderBy("row_id").collect()]
        assert order == [("a 1.csv", v) for v in "123"] + [("b+2.csv", str(i)) for i in range(20000)] + [("c.csv", "1")]
        coded = encode_category(raw, "proto", "row_id").select("proto", "proto_code").distinct().collect()
        assert {r["proto"]: r["proto_code"] for r in coded} == {"tcp": 0, "icmp": 1, "arp": 2, "udp": 3, "sctp": 4}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_bit_encoding_and_medians_of_extreme_values(spark):
    from alarmloom.operators.features import bit_encode, robust_z
    df = spark.createDataFrame([([1e300, -1e300, 5999.9],), ([float("nan"), float("inf"), 1e19],)], "features array<double>")
    rows = bit_encode(df, [(0, 8, False), (1, 8, True), (2, 8, True)]).collect()
    number = lambda bits: int("".join("1" if b > 0 else "0" for b in bits), 2)
    assert [[number(r["bits"][i:i + 8]) for i in (0, 8, 16)] for r in rows] == [[255, 0, 5], [0, 0, 255]]
    nothing = spark.createDataFrame([(float("nan"),), (None,)], "x double")
    assert all(r["z"] != r["z"] for r in robust_z(nothing, "x").collect())


def test_load_dataset_rules(spark):
    import os
    root = scratch_path(spark, "csv")
    os.makedirs(root)
    with open(f"{root}/a.csv", "w") as f:
        f.write("x,y,Flow ID,Activity,empty\n1,2,q,Normal,\nInfinity,3,q,scan,\n,bad,q, benign ,\n5,6,q,,\n")
    with open(f"{root}/b.csv", "w") as f:
        f.write("y,more,x,Activity\n7,1,8,attack\n")
    out = load_dataset(spark, root, "dapt_2020")
    assert out.features == ["x", "y"]
    got = sorted((r["origin_file"], r["features"], r["y_true"]) for r in out.rows.collect())
    assert got == [("a.csv", [0.0, 0.0], 0), ("a.csv", [0.0, 3.0], 1), ("a.csv", [1.0, 2.0], 0),
                   ("a.csv", [5.0, 6.0], 1), ("b.csv", [8.0, 7.0], 1)]
    strict = DatasetSpec("s", ("Activity",), benign=("Normal",), drop=("Flow ID", "empty"))
    kept = load_dataset(spark, root, strict).rows
    assert sorted(r["features"] for r in kept.collect()) == [[1.0, 2.0], [5.0, 6.0], [8.0, 7.0]]
    with pytest.raises(ValueError):
        load_dataset(spark, root, "kdd")
    with pytest.raises(ValueError):
        dataset_spec("somewhere")
    with pytest.raises(ValueError):
        dataset_spec("kdd", "pcap")


def test_isolation_forest_ranks_outliers_lowest(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), np.full((3, 3), 12.0)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "index long, features array<double>")
    s = bl.isolation_scores(df, df, trees=50)
    low = {r["id"] for r in s.orderBy("score").limit(3).collect()}
    assert low == {300, 301, 302}
    assert bl.isolation_scores(df.limit(5), df) is None


@pytest.mark.parametrize("n", [12, 90, 150, 170, 4000])
def test_one_law_of_sampling_at_every_size(spark, n):
    """Trees draw the rows of least hash among all rows, for few rows and for many more than all trees hold together."""
    rows = spark.range(n).selectExpr("id * 3 AS id", "array(cast(id AS double)) AS features")
    psi, trees = min(16, n), 5
    got = {(r["tree"], r["id"]) for r in bl.least_hashes(rows, n, trees, psi, 42).collect()}
    pairs = rows.selectExpr("id", f"explode(sequence(0, {trees - 1})) AS tree").selectExpr("tree", "id", "xxhash64(42, tree, id) AS h").collect()
    want = set()
    for t in range(trees):
        want |= {(t, r["id"]) for r in sorted((r for r in pairs if r["tree"] == t), key=lambda r: (r["h"], r["id"]))[:psi]}
    assert got == want
    if n == 4000:  # nearly all samples differ, and no part of the rows is left out
        assert len({i for _, i in got}) > 70 and max(i for _, i in got) > 9000 > 3000 > min(i for _, i in got)


def test_a_limit_that_finds_too_few_rows_is_raised(spark):
    rows = spark.range(3000).selectExpr("id", "array(0D) AS features")
    assert bl.least_hashes(rows, 10**7, 3, 40, 1).groupBy("tree").count().filter("count = 40").count() == 3


@pytest.mark.parametrize("kind,params", [("svm", {}), ("tree", {"maxDepth": 3}), ("rf", {"numTrees": 5, "maxDepth": 3}),
                                         ("ae", {"components": 2})])
def test_detectors_beat_chance(spark, kind, params):
    data = labelled(spark, 200, 6.0)
    pred = fit_detector(kind, data, **params).predict(data)
    right = pred.filter(F.col("y_true") == F.col("y_pred")).count()
    assert right >= 150


def test_test_labels_do_not_move_the_cut(spark):
    """Labels of the test side are only read by the metrics."""
    data = ex.prepare(labelled(spark, 160, 3.0), ex.Grid(top_features=3))
    choice = ex.Choice({"eps": 0.3}, 5, "size_large", 0.3, tau=0.4)
    a = ex.apply_frozen(data.test, choice, ex.Grid())[0]
    flipped = data.test.withColumn("y_true", 1 - F.col("y_true"))
    b = ex.apply_frozen(flipped, choice, ex.Grid())[0]
    pick = lambda d: sorted((r["id"], r["removed"]) for r in d.select("id", "removed").collect())
    assert pick(a) == pick(b)


def test_tuned_baseline_keeps_first_of_equals(spark):
    refs = labelled(spark, 60, 2.0)
    n = refs.count()
    best, metrics = ex.tune_baseline(ex._knn_baseline(n), [5, 10, 20], refs, labelled(spark, 40, 2.0, 1))
    assert best in (5, 10, 20) and metrics.count() == 1
    none, m = ex.tune_baseline(ex._knn_baseline(3), [5, 10, 20], refs.limit(3), refs)
    assert none == 10 and m is None


def test_dataset_registry():
    from alarmloom.sources.specs import REGISTRY, dataset_spec
    import pytest
    for name, spec in REGISTRY.items():
        assert dataset_spec(name.upper().replace("-", "_")) == spec and spec.label and spec.files
    assert dataset_spec("UNSW_NB15_lowvar").stems is None and dataset_spec("kdd-lowvar") == REGISTRY["kdd"]
    with pytest.raises(ValueError):
        dataset_spec("unheard of")
    with pytest.raises(ValueError):
        dataset_spec("kdd", "pcap")


def test_dense_counts_are_the_map(spark):
    from alarmloom.operators.flows import dense_counts

    maps = [{}, None, {0: 3}, {4: 1}, {0: 2, 1: 5, 4: 7}, {2: 9}]
    df = spark.createDataFrame(list(enumerate(maps)), "i int, m map<int,bigint>")
    got = {r["i"]: r["x"] for r in df.select("i", dense_counts("m", 5).alias("x")).collect()}
    assert got == {i: [(m or {}).get(j, 0) for j in range(5)] for i, m in enumerate(maps)}


def test_gap_markers_look_at_every_bin_once(spark):
    """No map is searched bin by bin: that took time with bins times entries."""
    from alarmloom.operators import flows as fl

    rows = spark.range(40).selectExpr("'a/b' AS pcap_path", "'x' AS ip1", "1 AS p1", "'y' AS ip2", "2 AS p2", "6 AS proto",
                                      "CAST(id * id AS double) AS ts", "CAST(100 AS int) AS len")
    m = fl.markers(rows, use_gaps=True)
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"element_at\((coalesce\()?ipt", plan)
    x = m.head()["features"]
    want = [0.0] * (fl.length_bins() + fl.gap_bins())
    want[100 >> 4] = 40.0
    for i in range(1, 40):
        want[fl.length_bins() + ((2 * i - 1) * 1000 >> 6)] += 1.0
    assert x == want


def test_training_rows_are_dealt_to_all_cores(spark, monkeypatch):
    """Rows of a single part go to even parts, the same ones in whatever order they come."""
    from alarmloom.operators import detectors as de

    monkeypatch.setattr(de, "ROWS_PER_TASK", 500)
    data = spark.range(4000).select(
        (F.col("id") % 7).alias("index"), F.array(F.col("id").cast("double"), F.rand(3)).alias("features"),
        (F.col("id") % 2).cast("int").alias("y_true")).coalesce(1).localCheckpoint()
    parts = lambda df: [p for p in df.rdd.glom().collect()]
    got = parts(de.dealt(data))
    assert len(got) == min(spark.sparkContext.defaultParallelism, 8) > 1
    assert max(map(len, got)) < 2 * 4000 / len(got)
    assert got == parts(de.dealt(data.orderBy(F.desc("y_true"), F.rand(5))))
    assert sorted(r["features"] for p in got for r in p) == sorted(r["features"] for r in data.collect())
    seen = []
    monkeypatch.setattr(de.RandomForestClassifier, "fit", lambda self, x: seen.append(x.rdd.getNumPartitions()))
    fit_detector("rf", data)
    assert seen == [len(got)]
    assert de.dealt(data.limit(400)).rdd.getNumPartitions() == 1


def test_experiments_run_side_by_side(spark, tmp_path, monkeypatch):
    """Two experiments meet while both run; rows come in the order of the experiments, and none is run again."""
    import threading

    from alarmloom.plans import batch as ba

    meeting = threading.Barrier(2, timeout=30)
    alarms = spark.range(4).select(F.col("id").alias("index"), F.array(F.lit(1.0)).alias("features"), F.lit(1).alias("y_true"))

    def experiment(rows, grid):
        n = rows.count()
        meeting.wait()
        return {"n_test": n, "filter_auc": 0.5}

    monkeypatch.setattr(ba, "run_experiment", experiment)
    monkeypatch.setattr(ba, "run_variant", lambda variant, rows, grid: meeting.wait() and None)
    root, out = str(tmp_path / "root"), str(tmp_path / "out")
    for seed in (16, 17):
        (tmp_path / "root" / "vec-csv-svm" / f"split_seed{seed}").mkdir(parents=True)
        (tmp_path / "root" / "vec-csv-svm" / f"split_seed{seed}" / "alert.json").write_text("[]")
    load = lambda spark, path: alarms
    done = ba.run_batch(spark, root, out, load=load)
    assert sorted((r["seed"], r["n_test"]) for r in done.collect()) == [(16, 4), (17, 4)]
    assert ba.run_batch(spark, root, out, load=load).count() == 2
    rows = ba.run_ablation(spark, root, str(tmp_path / "ablation"), prior=done, variants=["Full", "w/o Blend"], load=load)
    assert sorted((r["seed"], r["variant"], r["auc"]) for r in rows.collect()) == [
        (16, "Full", 0.5), (16, "w/o Blend", None), (17, "Full", 0.5), (17, "w/o Blend", None)]


def test_a_failed_variant_is_no_result(spark, tmp_path, monkeypatch):
    """Whatever fails, also where metrics are first computed: the others get rows, the failure is an error, and is run again."""
    from alarmloom.plans import batch as ba

    broken = {"w/o Blend", "w/o AdaptSc"}
    metrics = spark.range(1).selectExpr("0.5D AS auc", "0.1D AS r_fpr", "0.9D AS r_tpr", "2D AS CER")

    def variant(name, rows, grid):
        if name in broken and name == "w/o Blend":
            raise ValueError("no such luck")
        return None, metrics.withColumn("auc", F.raise_error(F.lit("out of reach")).cast("double")) if name in broken else metrics

    monkeypatch.setattr(ba, "run_variant", variant)
    (tmp_path / "root" / "vec-csv-svm" / "split_seed16").mkdir(parents=True)
    (tmp_path / "root" / "vec-csv-svm" / "split_seed16" / "alert.json").write_text("[]")
    names = ["w/o Blend", "w/o AdaptSc", "Full", "w/o FeatSel"]
    run = lambda: ba.run_ablation(spark, str(tmp_path / "root"), str(tmp_path / "out"), variants=names, load=lambda *a: metrics)
    with pytest.raises(RuntimeError, match="w/o Blend: no such luck"):
        run()
    assert sorted((r["variant"], r["auc"]) for r in ba.read_results(spark, str(tmp_path / "out")).collect()) == [("Full", 0.5), ("w/o FeatSel", 0.5)]
    broken.clear()
    assert sorted((r["variant"], r["auc"]) for r in run().collect()) == [(n, 0.5) for n in sorted(names)]


def test_a_failed_task_ends_its_company(spark):
    from alarmloom.runtime import side_by_side

    def bad():
        raise ValueError("bad")

    assert list(side_by_side(spark, [lambda: spark.range(3).count(), lambda: 5])) == [3, 5]
    with pytest.raises(ValueError, match="bad"):
        list(side_by_side(spark, [bad, lambda: 1]))
