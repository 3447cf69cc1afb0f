"""Cleaning, labelling, sampling, packet flows, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as cl
from ..operators import flows as fl
from ..operators import sampling as sa
from ..runtime import durable, scratch_path
from ..sources import adapters as ad
from ..sources import alarm_sets as al
from ..sources import raw_flows as rf
from ..sources.specs import NB15_COLUMNS, DatasetSpec, dataset_spec
from .filter_queries import METRICS_SQL
from .registry import ALARMS, PACKETS, PREDICTIONS, RAW, SCORED, query, r6

FEATURES = ["c0", "c1", "c2", "c3"]
LINES = DatasetSpec("lines", ("Label",), benign=("N",), drop=("row_key",))


# --- cleaning --------------------------------------------------------------------------------------------

@query("cln1_clean_strict", f"WITH {RAW} SELECT row_id, n0 AS c0, c1, c2, c3 FROM clean WHERE n0 IS NOT NULL")
def cln1(spark, sf):
    return cl.clean_strict(ad.raw_flows(spark, sf), FEATURES).select("row_id", *FEATURES)


@query("cln2_clean_flexible", f"WITH {RAW} SELECT row_id, coalesce(n0, 0.0) AS c0, c1, c2, c3 FROM clean")
def cln2(spark, sf):
    raw = ad.raw_flows(spark, sf).withColumn("note", F.lit("text"))
    return cl.clean_flexible(raw, [*FEATURES, "note"]).select(
        "row_id", *[c for c in (*FEATURES, "note") if c != "note"])


@query("cln3_align_schemas", f"""WITH {RAW} SELECT row_id, c1, CASE WHEN origin_file = 'F' THEN c2 END AS c2 FROM raw""")
def cln3(spark, sf):
    raw = ad.raw_flows(spark, sf)
    first = raw.filter("origin_file = 'F'").select("row_id", "c1", "c2")
    later = raw.filter("origin_file <> 'F'").select("row_id", "c3", "c1")
    return cl.union_aligned([first, later])


@query("cln4_label_by_token", f"WITH {RAW} SELECT row_id, y AS y_true FROM clean")
def cln4(spark, sf):
    return ad.raw_flows(spark, sf).select("row_id", cl.label_by_token(F.col("Label"), "N").alias("y_true"))


@query("cln5_label_by_set", """SELECT CAST(event_id AS BIGINT) AS row_id,
  CASE WHEN upper(trim(event_type)) IN ('VIEW', 'CLICK') THEN 0 ELSE 1 END AS y_true FROM events""")
def cln5(spark, sf):
    return ad.categories(spark, sf).select(
        "row_id", cl.label_by_set(F.col("proto"), ("VIEW", "CLICK")).alias("y_true"))


@query("cln6_label_column", "SELECT CAST(event_id AS BIGINT) AS row_id, event_type AS label FROM events")
def cln6(spark, sf):
    c = ad.categories(spark, sf).withColumnRenamed("proto", " label")
    name = cl.first_present(c.columns, ["Label", " Label", "label", " label"])
    return c.select("row_id", F.col(f"`{name}`").alias("label"))


@query("cln7_label_mixed", """SELECT CAST(event_id AS BIGINT) AS row_id, CAST(event_id % 2 AS INTEGER) AS binary,
  CASE WHEN lower(CASE WHEN event_type = 'view' THEN ' Normal ' ELSE event_type END) LIKE '%normal%' THEN 0 ELSE 1 END AS text FROM events""")
def cln7(spark, sf):
    c = ad.categories(spark, sf).select(
        "row_id", F.when(F.col("row_id") % 2 == 0, "0").otherwise("1.0").alias("a"),
        F.when(F.col("proto") == "view", " Normal ").otherwise(F.col("proto")).alias("b"))
    return c.select("row_id", cl.label_mixed(c, "a").alias("binary"), cl.label_mixed(c, "b").alias("text"))


@query("cln8_encode_category", """WITH f AS (SELECT event_type AS proto, min(event_id) AS first FROM events GROUP BY 1),
c AS (SELECT proto, row_number() OVER (ORDER BY first) - 1 AS code FROM f)
SELECT CAST(event_id AS BIGINT) AS row_id, CAST(code AS INTEGER) AS proto_code FROM events JOIN c ON event_type = proto""")
def cln8(spark, sf):
    return cl.encode_category(ad.categories(spark, sf), "proto", "row_id").select("row_id", "proto_code")


@query("cln9_row_metadata", f"WITH {RAW} SELECT row_id, label AS raw_label, y AS label, origin_file FROM clean WHERE n0 IS NOT NULL")
def cln9(spark, sf):
    out = rf.ingest(ad.raw_flows(spark, sf), LINES)
    return out.rows.select("row_id", "raw_label", F.col("y_true").alias("label"), "origin_file")


@query("cln10_drop_columns", f"WITH {RAW} SELECT row_id, origin_file, c1, c3 FROM raw")
def cln10(spark, sf):
    return cl.drop_columns(ad.raw_flows(spark, sf), ["Label", "c0", "c2", "not there"])


@query("cln11_row_accounting", f"""WITH {RAW} SELECT count(*) AS total, count(*) FILTER (WHERE n0 IS NOT NULL) AS kept,
  count(*) FILTER (WHERE n0 IS NULL) AS dropped, count(*) FILTER (WHERE n0 IS NOT NULL AND y = 1) AS positives,
  count(*) FILTER (WHERE n0 IS NOT NULL AND y = 0) AS negatives FROM clean""")
def cln11(spark, sf):
    raw = ad.raw_flows(spark, sf)
    ready = raw.select(cl.to_number(raw, "c0").alias("n0"), cl.label_by_token(F.col("Label"), "N").alias("y"))
    return cl.row_accounting(ready, F.col("n0").isNotNull(), "y")


def _write_csv(df, path, header=True):
    df.write.option("header", header).csv(path)


@query("cln12_load_headed_dataset", f"""WITH {RAW}, k AS (SELECT row_id, origin_file, y, n0, c1, c2, c3 FROM clean WHERE n0 IS NOT NULL)
SELECT y AS y_true, count(*) AS n, round(sum(n0), 4) + 0.0 AS s0, round(sum(c1), 2) + 0.0 AS s1, round(sum(c2), 4) + 0.0 AS s2 FROM k GROUP BY 1""")
def cln12(spark, sf):
    """CSV files derived from the line items, written, found, read and ingested."""
    raw = ad.raw_flows(spark, sf).drop("origin_file").withColumnRenamed("row_id", "row_key")
    root = scratch_path(spark, "csv")
    _write_csv(raw, root)
    out = rf.load_dataset(spark, root, LINES)
    f = F.col("features")
    return out.rows.groupBy("y_true").agg(
        F.count("*").alias("n"), r6(F.sum(f[0]), 4).alias("s0"), r6(F.sum(f[1]), 2).alias("s1"),
        r6(F.sum(f[2]), 4).alias("s2"))


def nb15_rows(spark, sf):
    """The event table in the 49-column headerless layout."""
    e = ad.table(spark, sf, "events")
    made = {
        "srcip": F.concat(F.lit("10.0.0."), F.col("user_id")), "dstip": F.lit("10.0.1.1"),
        "sport": F.col("user_id").cast("string"), "dsport": F.lit("443"),
        "proto": F.col("event_type"), "state": F.when(F.col("event_id") % 2 == 0, "FIN").otherwise("CON"),
        "service": F.when(F.col("event_id") % 3 == 0, "dns").otherwise("-"),
        "dur": F.when(F.col("event_id") % 50 == 0, "bad").otherwise(F.col("value").cast("string")),
        "attack_cat": F.when(F.col("event_type") == "error", "Exploits").otherwise(""),
        "Label": F.when(F.col("event_type") == "error", "1").otherwise("0"),
    }
    return e.select(*[made.get(c, F.lit("0")).cast("string").alias(c) for c in NB15_COLUMNS])


@query("cln13_load_headerless_dataset", """SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y_true, count(*) AS n,
  round(sum(value), 4) + 0.0 AS dur, count(DISTINCT event_type) AS protos, CAST(sum(user_id) AS DOUBLE) AS sport
FROM events WHERE event_id % 50 <> 0 GROUP BY 1""")
def cln13(spark, sf):
    root = scratch_path(spark, "nb15")
    rows = nb15_rows(spark, sf)
    rows.write.csv(root)
    spec = dataset_spec("UNSW_NB15_lowvar")
    out = rf.load_dataset(spark, root, spec)
    at = {c: F.col("features")[i] for i, c in enumerate(out.features)}
    return out.rows.groupBy("y_true").agg(
        F.count("*").alias("n"), r6(F.sum(at["dur"]), 4).alias("dur"),
        F.countDistinct(at["proto"]).alias("protos"), F.sum(at["sport"]).alias("sport"))


# --- sampling ----------------------------------------------------------------------------------------------

def key(seed, col):
    return f"md5('{seed}:' || CAST({col} AS VARCHAR))"


@query("smp1_stratified_fraction", f"""WITH {RAW} SELECT row_id FROM clean
QUALIFY row_number() OVER (PARTITION BY origin_file, y ORDER BY {key(42, 'row_id')}, row_id) <=
  greatest(1, ceil(count(*) OVER (PARTITION BY origin_file, y) * 0.01))""")
def smp1(spark, sf):
    raw = ad.raw_flows(spark, sf).select("row_id", "origin_file", cl.label_by_token(F.col("Label"), "N").alias("y"))
    return sa.stratified_fraction(raw, 0.01, ["origin_file", "y"], "row_id").select("row_id")


@query("smp2_capped_per_class", f"""WITH {SCORED} SELECT id, y_true FROM scored
QUALIFY row_number() OVER (PARTITION BY y_true ORDER BY {key(42, 'id')}, id) <= 700""")
def smp2(spark, sf):
    return sa.stratified_subsample(ad.scored(spark, sf), "y_true", "id", max_per_class=700).select("id", "y_true")


@query("smp2_stratified_share", f"""WITH {SCORED} SELECT id, y_true FROM scored
QUALIFY row_number() OVER (PARTITION BY y_true ORDER BY {key(42, 'id')}, id) <= ceil(count(*) OVER (PARTITION BY y_true) * 0.1)""")
def smp2_share(spark, sf):
    return sa.stratified_subsample(ad.scored(spark, sf), "y_true", "id", frac=0.1).select("id", "y_true")


@query("smp3_train_test_split", f"""WITH {SCORED} SELECT id, CASE WHEN row_number() OVER (PARTITION BY y_true ORDER BY {key(7, 'id')}, id)
  <= ceil(count(*) OVER (PARTITION BY y_true) * 0.3) THEN 'test' ELSE 'train' END AS split FROM scored""")
def smp3(spark, sf):
    return sa.train_test_split(ad.scored(spark, sf), "y_true", "id", 0.3, 7).select("id", "split")


@query("smp3_hash_split", f"""WITH {SCORED} SELECT id, CASE WHEN CAST(('0x' || substr({key(7, 'id')}, 1, 8)) AS BIGINT) / 4294967296.0 < 0.3
  THEN 'test' ELSE 'train' END AS split FROM scored""")
def smp3_hash(spark, sf):
    return sa.train_test_split(ad.scored(spark, sf), "y_true", "id", 0.3, 7, exact=False).select("id", "split")


@query("smp4_validation_test_split", f"""WITH {ALARMS} SELECT index AS id, CASE WHEN row_number() OVER (PARTITION BY y_true ORDER BY {key(42, 'index')}, index)
  <= ceil(count(*) OVER (PARTITION BY y_true) * 0.7) THEN 'test' ELSE 'val' END AS side FROM alarms""")
def smp4(spark, sf):
    return sa.validation_test_split(ad.alarms(spark, sf)).select(F.col("index").alias("id"), "side")


@query("smp5_capped_subsample", f"WITH {SCORED} SELECT id FROM scored ORDER BY {key(42, 'id')}, id LIMIT 3000")
def smp5(spark, sf):
    return sa.capped_subsample(ad.scored(spark, sf).select("id"), 3000, "id")


@query("jn10_row_subset", f"""WITH {SCORED}, s AS (SELECT id FROM scored ORDER BY {key(1, 'id')}, id LIMIT 500)
SELECT id, score FROM scored WHERE id IN (FROM s)""")
def jn10(spark, sf):
    rows = ad.scored(spark, sf)
    return rows.join(sa.capped_subsample(rows.select("id"), 500, "id", 1), "id", "left_semi").select("id", "score")


# --- packets and flows ----------------------------------------------------------------------------------------

KEYS = "pcap_path, ip1, p1, ip2, p2, proto"


def keyed(spark, sf):
    return fl.with_flow_key(fl.usable_packets(ad.packets(spark, sf)))


@query("src8_packet_scan", f"WITH {PACKETS} SELECT event_id, pcap_path, round(ts, 6) + 0.0 AS ts, proto, len FROM usable")
def src8(spark, sf):
    return fl.usable_packets(ad.packets(spark, sf)).select("event_id", "pcap_path", r6("ts").alias("ts"), "proto", "len")


@query("src9_class_from_directory", f"""WITH {PACKETS} SELECT event_id, split_part(pcap_path, '/', 1) AS class_name,
  CASE WHEN split_part(pcap_path, '/', 1) IN ('benign', 'normal', 'Benign', 'BENIGN') THEN 0 ELSE 1 END AS y_true FROM packets""")
def src9(spark, sf):
    return fl.class_from_path(ad.packets(spark, sf)).select("event_id", "class_name", "y_true")


@query("flw1_flow_key", f"WITH {PACKETS} SELECT event_id, ip1, p1, ip2, p2 FROM keyed")
def flw1(spark, sf):
    return keyed(spark, sf).select("event_id", "ip1", "p1", "ip2", "p2")


@query("flw2_flow_assembly", f"""WITH {PACKETS} SELECT {KEYS}, count(*) AS packets, round(min(ts), 6) + 0.0 AS first_ts,
  round(max(ts), 6) + 0.0 AS last_ts, CAST(sum(len) AS BIGINT) AS bytes FROM keyed GROUP BY {KEYS}""")
def flw2(spark, sf):
    return fl.flows(keyed(spark, sf)).select(
        *fl.FLOW, "packets", r6("first_ts").alias("first_ts"), r6("last_ts").alias("last_ts"), "bytes")


@query("flw3_length_histogram", f"""WITH {PACKETS}, h AS (SELECT {KEYS}, least(least(len, 1500) >> 4, 93) AS bin, count(*) AS n FROM keyed GROUP BY {KEYS}, bin),
k AS (SELECT DISTINCT {KEYS} FROM keyed)
SELECT k.pcap_path, k.ip1, k.p1, k.ip2, k.p2, k.proto, CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n FROM k CROSS JOIN range(94) t(b)
LEFT JOIN h ON (k.pcap_path, k.ip1, k.p1, k.ip2, k.p2, k.proto, b) = (h.pcap_path, h.ip1, h.p1, h.ip2, h.p2, h.proto, bin)""")
def flw3(spark, sf):
    return fl.length_histogram(keyed(spark, sf)).select(*fl.FLOW, F.posexplode("pl").alias("bin", "n"))


GAPS_SQL = f"""g AS (SELECT {KEYS}, (ts - lag(ts) OVER (PARTITION BY {KEYS} ORDER BY ts)) * 1000.0 AS ms FROM keyed),
gaps AS (SELECT {KEYS}, CAST(CASE WHEN ms > 3600000 THEN 56249 ELSE least(CAST(floor(ms) AS BIGINT) >> 6, 56249) END AS INTEGER) AS gap_bin, count(*) AS n
  FROM g WHERE ms >= 0 GROUP BY {KEYS}, 7)"""


@query("flw4_gap_histogram", f"""WITH {PACKETS}, {GAPS_SQL} SELECT {KEYS}, gap_bin, n FROM gaps
UNION ALL SELECT {KEYS}, NULL, NULL FROM keyed GROUP BY ALL HAVING count(*) = 1""")
def flw4(spark, sf):
    """Flows of one packet have an empty histogram and show as a row without a bin."""
    return fl.gap_histogram(keyed(spark, sf)).select(*fl.FLOW, F.explode_outer("ipt").alias("gap_bin", "n"))


@query("flw5_marker_concat", f"""WITH {PACKETS}, {GAPS_SQL},
m AS (SELECT {KEYS}, least(least(len, 1500) >> 4, 93) AS pos, count(*)::DOUBLE AS v FROM keyed GROUP BY {KEYS}, pos
  UNION ALL SELECT {KEYS}, 94 + gap_bin, n::DOUBLE FROM gaps)
SELECT {KEYS}, CAST(pos AS INTEGER) AS pos, v, 56344 AS width FROM m""")
def flw5(spark, sf):
    m = fl.markers(keyed(spark, sf), use_gaps=True)
    return m.select(*fl.FLOW, F.size("features").alias("width"), F.posexplode("features").alias("pos", "v")).filter("v > 0")


@query("flw6_flow_dataset", f"""WITH {PACKETS}, m AS (SELECT {KEYS}, least(least(len, 1500) >> 4, 93) AS pos, count(*)::DOUBLE AS v FROM keyed GROUP BY {KEYS}, pos)
SELECT {KEYS}, split_part(pcap_path, '/', 1) AS class_name, CASE WHEN pcap_path LIKE 'benign/%' THEN 0 ELSE 1 END AS y_true, CAST(pos AS INTEGER) AS pos, v FROM m""")
def flw6(spark, sf):
    d = fl.flow_dataset(ad.packets(spark, sf))
    return d.select(*fl.FLOW, "class_name", "y_true", F.posexplode("features").alias("pos", "v")).filter("v > 0")


@query("flw7_first_lengths", f"""WITH {PACKETS} SELECT pcap_path, CAST(row_number() OVER (PARTITION BY pcap_path ORDER BY ts, event_id) - 1 AS INTEGER) AS pos,
  coalesce(ip_len, frame_len) AS len FROM packets QUALIFY pos < 256""")
def flw7(spark, sf):
    return fl.first_lengths(ad.packets(spark, sf)).select("pcap_path", F.posexplode("lengths").alias("pos", "len"))


# --- alarm sets -------------------------------------------------------------------------------------------------

@query("src1_load_alarms", f"WITH {ALARMS} SELECT index, y_true, len(features) AS width, round(list_sum(features), 6) + 0.0 AS total FROM alarms")
def src1(spark, sf):
    """Alarms written as JSON and read back."""
    path = scratch_path(spark, "alarms")
    al.save_alarms(ad.alarms(spark, sf), path)
    return al.load_alarms(spark, path, lines=True).select(
        "index", "y_true", F.size("features").cast("long").alias("width"),
        r6(F.aggregate("features", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("src2_discover_experiments", """SELECT DISTINCT 'kdd-' || label AS dataset, 'csv' AS data_type, 'svm' AS model, CAST(label AS INTEGER) AS seed FROM embeddings""")
def src2(spark, sf):
    """A tree of alarm sets, one per partition, plus a malformed name that must be skipped."""
    root = scratch_path(spark, "tree")
    a = ad.alarms(spark, sf)
    named = a.select("index", "features", "y_true", F.concat(F.lit("kdd-"), "given_cid").alias("dataset"), F.lit("csv").alias("data_type"),
                     F.lit("svm").alias("model"), F.col("given_cid").cast("int").alias("seed"))
    al.save_experiments(named, root)
    named.limit(1).select("features", "y_true").write.json(f"{root}/broken/split_seed1/alert.json")
    return al.discover_experiments(spark, root).select("dataset", "data_type", "model", "seed")


@query("src4_headed_csv_scan", f"WITH {RAW} SELECT row_id AS row_key, c0, count(*) OVER () AS n FROM raw")
def src4(spark, sf):
    root = scratch_path(spark, "headed")
    raw = ad.raw_flows(spark, sf).select(F.col("row_id").alias("row_key"), "c0")
    _write_csv(raw, root)
    back = rf.read_headed(spark, rf.list_files(spark, root))
    return back.select("row_key", "c0", F.lit(raw.count()).cast("long").alias("n"))


@query("src5_headerless_csv_scan", """SELECT CAST(user_id AS VARCHAR) AS sport, event_type AS proto, count(*) AS n FROM events GROUP BY 1, 2""")
def src5(spark, sf):
    root = scratch_path(spark, "headerless")
    nb15_rows(spark, sf).write.csv(root)
    back = rf.read_headerless(spark, rf.list_files(spark, root), NB15_COLUMNS)
    return back.groupBy("sport", "proto").agg(F.count("*").alias("n"))


@query("snk1_alarm_records", f"WITH {PREDICTIONS} SELECT id AS index, y_true, y_pred FROM pred WHERE y_pred = 1")
def snk1(spark, sf):
    pred = with_features(spark, sf)
    path = scratch_path(spark, "alert")
    al.save_alarms(pred, path)
    return al.load_alarms(spark, path, lines=True).select("index", "y_true", "y_pred")


def with_features(spark, sf):
    return ad.predictions(spark, sf).select(
        F.col("id").alias("index"), F.array(F.col("id") * 0.5, F.col("id") * 1.0).alias("features"), "y_true", "y_pred")


@query("snk2_alarm_summary", f"""WITH {PREDICTIONS}, {METRICS_SQL} SELECT tp + fp + tn + fn AS num_test_samples, tp + fp AS num_alerts, tp AS num_tp, fp AS num_fp,
  round(fp / (tp + fp), 6) + 0.0 AS fp_share, round(accuracy, 6) + 0.0 AS accuracy, round(recall, 6) + 0.0 AS tpr FROM r""")
def snk2(spark, sf):
    path = scratch_path(spark, "metrics")
    al.alarm_summary(ad.predictions(spark, sf), "svm", "svm").write.json(path)
    back = spark.read.schema("num_test_samples long, num_alerts long, num_tp long, num_fp long, fp_share double, accuracy double, tpr double").json(path)
    return back.select("num_test_samples", "num_alerts", "num_tp", "num_fp", *[r6(c).alias(c) for c in ("fp_share", "accuracy", "tpr")])


@query("snk3_outcome_export", f"""WITH {PREDICTIONS} SELECT CASE WHEN y_pred = 1 THEN CASE WHEN y_true = 1 THEN 'TP' ELSE 'FP' END
  ELSE CASE WHEN y_true = 1 THEN 'FN' ELSE 'TN' END END AS outcome, y_true AS code, '0.0.0.0' AS saddr, count(*) AS n,
  count(*) FILTER (WHERE y_pred = 1) AS with_features FROM pred GROUP BY 1, 2""")
def snk3(spark, sf):
    path = scratch_path(spark, "outcomes")
    al.save_outcomes(with_features(spark, sf), path)
    back = spark.read.schema("code int, saddr string, feature array<double>, outcome string").json(path)
    return back.groupBy("outcome", "code", "saddr").agg(
        F.count("*").alias("n"), F.count("feature").alias("with_features"))


@query("snk4_resumable_results", """SELECT 'e' || event_id AS tag, value AS auc FROM events""")
def snk4(spark, sf):
    """Two appends; the second only adds the tags that are missing."""
    rows = ad.table(spark, sf, "events").select(
        F.concat(F.lit("e"), F.col("event_id")).alias("tag"), F.col("value").alias("auc"))
    path = scratch_path(spark, "results")
    al.append_results(rows.filter(F.col("tag").endswith("3")), path)
    al.append_results(al.pending(rows, durable(al.read_results(spark, path)), ["tag"]), path)
    return al.read_results(spark, path)


@query("snk5_curve_csv", """WITH s AS (SELECT value AS tau, count(*) AS n FROM events GROUP BY 1) SELECT tau, CAST(sum(n) OVER (ORDER BY tau DESC) AS BIGINT) AS filtered_total FROM s""")
def snk5(spark, sf):
    from ..operators.evaluate import threshold_curve
    path = scratch_path(spark, "curve")
    al.save_curve(threshold_curve(ad.scored(spark, sf)).select("tau", "filtered_total"), path)
    return spark.read.schema("tau double, filtered_total long").option("header", True).csv(path)


@query("jn8_resume_anti_join", """SELECT 'u' || user_id || '-' || event_type AS tag FROM events GROUP BY user_id, event_type HAVING max(value) <= 300""")
def jn8(spark, sf):
    e = ad.table(spark, sf, "events")
    tag = F.concat(F.lit("u"), F.col("user_id"), F.lit("-"), F.col("event_type")).alias("tag")
    return al.pending(e.select(tag).distinct(), e.filter("value > 300").select(tag), ["tag"])


@query("jn9_reference_row_reuse", """WITH r AS (SELECT DISTINCT user_id, event_type FROM events), p AS (SELECT user_id, avg(value) AS auc FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT CAST(user_id AS BIGINT) AS tag, event_type AS variant, round(auc, 6) + 0.0 AS auc FROM r LEFT JOIN p USING (user_id)""")
def jn9(spark, sf):
    e = ad.table(spark, sf, "events").withColumn("tag", F.col("user_id").cast("long"))
    prior = e.filter("event_type = 'error'").groupBy("tag").agg(F.avg("value").alias("auc"))
    runs = e.select("tag", F.col("event_type").alias("variant")).distinct()
    return al.reuse_rows(runs, prior, ["tag"], ["auc"]).select("tag", "variant", r6("auc").alias("auc"))


def _put(spark, path: str, text: str) -> None:
    """A small text file on any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


@query("src6_column_list_file", "SELECT event_type AS protocol_name, count(*) AS n, count(DISTINCT user_id) AS ports FROM events GROUP BY 1")
def src6(spark, sf):
    """A column-list file next to the data is preferred to the default names."""
    root = scratch_path(spark, "named")
    nb15_rows(spark, sf).write.csv(root)
    own = {"proto": "protocol_name", "sport": "source_port"}
    _put(spark, f"{root}/UNSW-NB15_features.csv", "No.,Name\n" + "".join(
        f"{i},{own.get(c, c)}\n" for i, c in enumerate(NB15_COLUMNS)))
    files = rf.list_files(spark, root)
    names = rf.column_list(spark, root, dataset_spec("unsw-nb15"), files)
    back = rf.read_headerless(spark, [f for f in files if not f.endswith("_features.csv")], names)
    return back.groupBy("protocol_name").agg(F.count("*").alias("n"), F.countDistinct("source_port").alias("ports"))


@query("src7_file_selection", "SELECT CASE WHEN event_type = 'error' THEN '1' ELSE '0' END AS Label, count(*) AS n FROM events GROUP BY 1")
def src7(spark, sf):
    """Lists, ground truth and feature descriptions lie in the folder too; only the data files reach the scan."""
    root = scratch_path(spark, "files")
    nb15_rows(spark, sf).write.csv(root)
    for name in ("UNSW_NB15_features.csv", "UNSW-NB15_LIST_EVENTS.csv", "UNSW-NB15_GT.csv"):
        _put(spark, f"{root}/{name}", "not,data\n" * 5)
    files = rf.select_files(rf.list_files(spark, root), dataset_spec("unsw-nb15-lowvar"))
    return rf.read_headerless(spark, files, NB15_COLUMNS).groupBy("Label").agg(F.count("*").alias("n"))


@query("src10_nested_outcomes", f"WITH {PREDICTIONS} SELECT y_true AS code, count(*) AS n, count(*) FILTER (WHERE y_pred = 1) AS with_features FROM pred GROUP BY 1")
def nested(spark, sf):
    """Records packed into bounded {{"result": [...]}} objects and exploded again."""
    rec = al.outcome_records(with_features(spark, sf))
    path = scratch_path(spark, "nested")
    packs = rec.groupBy(F.pmod(F.xxhash64("index"), F.lit(16)).alias("part"), F.floor(F.col("index") / 1000).alias("block")).agg(
        F.collect_list(F.struct("code", "saddr", "daddr", "start", "end", "len", "loss", "feature")).alias("result"))
    packs.select("result").write.json(path)
    back = spark.read.schema("result array<struct<code:int, feature:array<double>>>").json(path)
    return back.select(F.explode("result").alias("r")).groupBy("r.code").agg(
        F.count("*").alias("n"), F.count("r.feature").alias("with_features"))


