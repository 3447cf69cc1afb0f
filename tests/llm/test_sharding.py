import zlib
from collections import defaultdict

from alarmloom.llm import queries, sharding


def test_query_law(spark, sf, documents):
    rows = queries.op3_sharding(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert len(rows) == len(texts)
    shards = defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        shards[r["shard"]].append((r["slot"], r["size"]))
    for s in shards.values():
        assert sorted(x for x, _ in s) == list(range(len(s)))
    mean = sum(r["size"] for r in rows) / 24
    largest = max(r["size"] for r in rows)
    assert set(shards) <= set(range(24))
    for i in range(24):
        assert abs(sum(b for _, b in shards[i]) - mean) <= largest + 0.01 * mean


def test_a_third_of_equal_rows_is_cut(spark):
    df = spark.range(3000).selectExpr("if(id < 1000, null, id) doc_id", "if(id < 1000, 'copy of a text', concat('text ', id)) text")
    rows = sharding.histogram_shards(df, 6).groupBy("shard").count().collect()
    assert len(rows) == 6 and max(r["count"] for r in rows) < 1.3 * min(r["count"] for r in rows)


def test_equal_texts_stay_together(spark):
    df = spark.range(2000).selectExpr("id doc_id", "concat('text ', id % 500) text")
    split = sharding.histogram_shards(df, 5).groupBy("text").agg({"shard": "max", "*": "count"}).collect()
    apart = sharding.histogram_shards(df, 5).select("text", "shard").distinct().groupBy("text").count().filter("count > 1").count()
    assert len(split) == 500 and apart <= 4


def test_odd_rows(odd_docs, no_docs):
    out = sharding.histogram_shards(odd_docs, 4)
    assert out.columns == [*odd_docs.columns, "_shard", "_slot"] and out.count() == odd_docs.count()
    assert sorted(map(str, out.select(odd_docs.columns).collect())) == sorted(map(str, odd_docs.collect()))
    by = defaultdict(list)
    for r in out.collect():
        by[r["_shard"]].append(r["_slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.histogram_shards(no_docs, 4).count() == 0
