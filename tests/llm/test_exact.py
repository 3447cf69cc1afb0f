import hashlib
import re
from collections import defaultdict

import pytest

from alarmloom.llm import exact


def groups(rows):
    """Expected decisions of (id, text) rows; of rows that agree in id and length any one stays."""
    found = defaultdict(list)
    for i, t in rows:
        found[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is not None, i or 0, i))
    out = []
    for text, members in found.items():
        members.sort(key=lambda m: m[:3])
        keep = members[0][3]
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(m[3], keep, len(members), k == 0, sha) for k, m in enumerate(members)]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(str(v) for v in r))


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("small", [exact.SMALL, 0])
def test_documents_and_odd_rows(spark, documents, odd_docs, no_docs, small):
    more = spark.createDataFrame([
        (1, "a b\tc"), (2, "abc"), (3, " a b c "), (3, " a b c "), (None, " a b c "), (4, "ab c"), (5, None), (6, " \v\f"), (7, ""), (8, "abd"),
        (9, "x" * 64 + "1"), (10, "x" * 64 + "2"), (11, "x" * 64 + "1 "), (12, "a bc"), (13, "ABC")], "doc_id long, text string")
    for df in (documents, odd_docs, more):
        want = groups(rows_of(df))
        got = [tuple(r) for r in exact.decisions(df, every_hash=True, small=small).collect()]
        assert ordered(got) == ordered(want)
    assert exact.decisions(no_docs).count() == 0


def test_full_hash_for_survivors_only(spark):
    df = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (4, "o n e"), (5, "longer")], "doc_id long, text string")
    hashed = {r["doc_id"] for r in exact.decisions(df).collect() if r["text_sha256"]}
    assert hashed == {1, 4}  # "two" has the length of "one" and another prefix


@pytest.mark.parametrize("small", [exact.SMALL, 0])
def test_deduplicate_keeps_whole_rows(spark, odd_docs, no_docs, small):
    odd = odd_docs.withColumnsRenamed({"rid": "n", "rhash": "size", "key": "prefix", "shard": "sha", "slot": "row"})
    for df in (odd, odd_docs):
        out = exact.deduplicate(df, small=small)
        assert out.schema.names == df.schema.names
        want = sorted(str(r[1]) for r in groups(rows_of(df)) if r[3])
        assert sorted(str(r["doc_id"]) for r in out.collect()) == want
    assert exact.deduplicate(no_docs).count() == 0


def test_a_third_of_all_rows_in_one_group(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'the same  text', concat('text ', id)) AS text")
    got = exact.decisions(df, small=0).filter("group_size > 1").collect()
    assert len(got) == 1000 and {r["keep_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1
