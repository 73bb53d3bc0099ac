import zlib

import pytest
from pyspark.sql import functions as F
from cases import hard, hard_rows, nothing

from helioquery.llm import sharding as S


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 97, 1000, 4097])
def test_permutation_is_one_and_inverts(n):
    places = [S.place_of(i, n, 4, seed=9) for i in range(n)]
    assert len(set(places)) == n
    assert sorted(slot * 4 + shard for shard, slot in places) == list(range(n))
    assert all(S.row_of(*p, n, 4, seed=9) == i for i, p in enumerate(places))
    if n > 90:
        assert places != [S.place_of(i, n, 4, seed=10) for i in range(n)]


@pytest.mark.parametrize("n", [1, 3, 7, 97, 1000])
def test_native_expression_agrees_with_python(spark, n):
    got = spark.range(n).select("id", S.permuted(F.col("id"), n, 9).alias("p")).collect()
    assert all((r["p"] % 4, r["p"] // 4) == S.place_of(r["id"], n, 4, 9) for r in got)


def test_hard_rows(spark):
    out = S.shard(hard(spark), 4, ["doc_id", "text"], seed=3)
    got = out.collect()
    n = len(hard_rows())
    assert sorted(r["row_number"] for r in got) == list(range(n))
    by = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(4)]
    assert all(b == list(range(len(b))) for b in by) and max(map(len, by)) - min(map(len, by)) <= 1
    assert all((r["shard"], r["slot"]) == S.place_of(r["row_number"], n, 4, 3) for r in got)
    numbered = [(r["doc_id"], r["text"]) for r in sorted(got, key=lambda r: r["row_number"])]
    assert numbered == sorted(numbered, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))


def test_rerun_and_layout_do_not_matter(spark, data):
    a = S.op2_sharding(spark, data).drop("grown_shard")
    once = sorted(map(tuple, a.collect()))
    docs = spark.read.parquet(f"{data}/documents.parquet")
    again = S.shard(docs.repartition(7).selectExpr("doc_id", "octet_length(text) + 1 as size"), 16, ["doc_id"], seed=20)
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in again.collect()) == [(x[0], x[4], x[5]) for x in once]
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    assert all((x[1], x[2]) == (len(texts[x[0]]) + 1, zlib.crc32(texts[x[0]])) for x in once)


def test_repeated_ids_spread(spark):
    out = S.shard(spark.range(4000).selectExpr("cast(null as long) as doc_id", "'x' as text"), 16).groupBy("shard").count().collect()
    assert {r["count"] for r in out} == {250}


def test_empty(spark):
    assert S.shard(nothing(spark), 4).count() == 0


def test_native_only(spark, data):
    plan = S.op2_sharding(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
