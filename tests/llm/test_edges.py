"""Columns named like helpers, samples of very large tables, long benchmark items, hot windows, and queries against brute force."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import hard, hard_rows
from pyspark.sql import functions as F
from test_decontam import brute as hits
from tokenizers import Tokenizer

from helioquery.llm import common, decontam, exact_dedup, importance, jaccard_join, langid, line_dedup, records, sharding, toxicity

NAMES = ["_id", "_th", "_at", "_part", "_good", "_tie", "_before", "_down", "_removed", "_hq_id", "_hq_at"]


@pytest.fixture(scope="module")
def clashing(spark):
    return hard(spark).withColumns({n: F.lit(n) for n in NAMES})


def test_columns_with_leading_underscores_stay(spark, clashing, data):
    import corpus_pipeline as P

    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    made = {
        "line_dedup": line_dedup.line_dedup(clashing), "shard": sharding.shard(clashing),
        "resample": importance.resample(importance.weigh(clashing, labels), 0.5),
        "identify": langid.identify(clashing, langid.fit(clashing)), "score": toxicity.score(clashing, toxicity.fit(clashing, labels)),
        "decontaminate": decontam.decontaminate(clashing, items),
        "keep_one": jaccard_join.keep_one(clashing, jaccard_join.jaccard_components(clashing)),
        "source_mix": P.source_mix(spark, clashing, data),
    }
    for name, out in made.items():
        got = out.select(*NAMES).distinct().collect()
        assert [tuple(r) for r in got] == [tuple(NAMES)], name
    assert exact_dedup.exact_dedup(clashing).count() == len(hard_rows())


def test_shares_of_very_large_tables_are_not_empty(spark):
    assert common.share_bound(4000 / 1e11) > 10**11 and common.share_bound(1e-18) >= 1 and common.share_bound(2) == 2**62
    rows = spark.range(20_000)
    for share in (0.5, 0.01, 1.0):
        assert common.sampled(rows, F.xxhash64("id"), share).count() == pytest.approx(20_000 * share, rel=0.2)


def test_toxicity_sample_is_bounded_in_bytes_and_fixed(spark):
    found = spark.range(5000).selectExpr("shiftrightunsigned(xxhash64(id), 2) as mark", "cast(id % 2 as int) as y", "cast(repeat('x', 100) as binary) as x")
    some = [tuple(r) for r in toxicity.bounded(found, 10_000, 100_000).collect()]
    assert 700 < len(some) <= 100_000 // 116 and max(r[0] for r in some) < 2**62 // 4
    assert some == [tuple(r) for r in toxicity.bounded(found.repartition(5), 10_000, 100_000).collect()]
    assert len(toxicity.bounded(found, 10_000, 1 << 30).collect()) == 5000
    assert 2900 < len(toxicity.bounded(found, 1000, 1 << 30).collect()) <= 3000


def test_long_items_are_cut_without_losing_windows_and_automata_are_few(spark, monkeypatch):
    words = [f"w{i}" for i in range(3000)]
    text = " ".join(words)
    pieces = list(decontam._pieces(text, 10, 2000))
    found = {tuple(w[i : i + 10]) for p in pieces for w in [decontam.words_of(p)] for i in range(len(w) - 9)}
    assert len(pieces) > 5 and max(map(len, pieces)) < 2100 and found == {tuple(x.encode() for x in words[i : i + 10]) for i in range(2991)}
    built = []
    monkeypatch.setattr(decontam, "Matcher", lambda b, w, make=decontam.Matcher: built.append(1) or make(b, w))
    items = [("a", text), ("b", "short one"), (None, "x " * 9)]
    shipped = [type("B", (), {"value": b})() for b in decontam._blocks(spark.createDataFrame(items, "item_id string, text string"), "item_id", "text", 2000, 10)]
    texts = [" ".join(words[i : i + 15]).encode() for i in range(0, 2900, 100)] + [b"a short one here", b""]
    got = decontam._by_block(texts, decontam._Matchers(shipped, 10))
    assert len(built) == len(shipped) > 5
    assert [(n, k) for n, k, *_ in got] == [hits(t.decode(), items)[:2] for t in texts]


def test_a_window_in_every_document(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('one\\ntwo\\nthree\\nown ', id) as text")
    got = line_dedup.line_dedup(docs).groupBy("n_removed").count().collect()
    assert {r["n_removed"]: r["count"] for r in got} == {0: 1, 3: 5999}


def test_importance_query_is_the_plain_draw(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    good = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").filter("quality = 1").collect()}
    counts = np.zeros((2, importance.BUCKETS))
    for i, t in docs:
        seen = np.bincount(importance.grams(t), minlength=importance.BUCKETS)
        counts[0] += seen
        counts[1] += seen * (i in good)
    p = (counts + 1) / (counts.sum(axis=1, keepdims=True) + importance.BUCKETS)
    weight = {i: np.log(p[1] / p[0])[importance.grams(t)].sum() for i, t in docs}
    got = importance.op4_importance_resampling(spark, data).collect()
    assert len(got) == len(docs) and all(r["log_weight"] == pytest.approx(weight[r["doc_id"]], abs=1e-6) for r in got)
    order = sorted(got, key=lambda r: -r["gumbel_key"])
    assert [r["rank"] for r in order] == list(range(len(docs)))
    assert {r["doc_id"] for r in got if r["selected"]} == {r["doc_id"] for r in order[: -(-len(docs) // 2)]}


def test_record_query_is_the_plain_encoding(spark, data):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    want, start = [], 0
    for i, t in docs:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = records.op6_token_records(spark, data).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want
