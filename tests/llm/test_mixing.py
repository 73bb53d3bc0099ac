from collections import defaultdict

import pytest
from cases import hard, hard_rows, nothing
from pyspark.sql import functions as F

from helioquery.llm import mixing as M


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Reshare what is above the cap, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, free = share * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(w[s] for s in free)
        above = {s for s in free if w[s] * level > cap * sizes[s]}
        if not above:
            return out | {s: w[s] * level for s in free}
        for s in above:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= above
    return out


def sized(df):
    return df.select("doc_id", "source", M.words_size().alias("size"))


def check(docs, rows, block):
    mix, known = M.mix_sources(docs, block=block, bucket_rows=7)
    pieces, known = mix.collect(), {r["row"]: r for r in known.collect()}
    assert len(known) == rows
    per, docs_in = defaultdict(int), defaultdict(list)
    for r in known.values():
        per[r["source"]] += r["size"]
        docs_in[r["source"]].append(r)
    want = brute_targets(per)
    taken = defaultdict(int)
    words = defaultdict(int)
    for p in pieces:
        assert 0 <= p["start"] < p["end"] <= known[p["row"]]["size"]
        taken[p["row"]] += p["end"] - p["start"]
        words[p["source_no"], p["slot"]] += p["end"] - p["start"]
    assert max(words.values(), default=0) <= block  # equal blocks; only a source's last one is shorter
    assert len({p["slot"] for p in pieces}) <= len(words)
    for s, group in docs_in.items():
        assert all(r["target"] == pytest.approx(want[s]) for r in group)
        assert want[s] - 3 * block <= sum(taken[r["row"]] for r in group) <= want[s] + 1e-9
        assert all(taken[r["row"]] <= 2 * r["size"] for r in group)


@pytest.mark.parametrize("block", [1, 16, 1024])
def test_hard_rows(spark, block):
    check(sized(hard(spark)), len(hard_rows()), block)


def test_schedule_is_even_and_reruns_agree(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('s', id % 5) as source", "cast(20 + id % 7 as long) as size")
    mix, _ = M.mix_sources(docs, block=32)
    slots = sorted({(r["slot"], r["source_no"]) for r in mix.collect()})
    assert sorted({(r["slot"], r["source_no"]) for r in M.mix_sources(docs.repartition(5), block=32)[0].collect()}) == slots
    shares = defaultdict(int)
    for i, (_, s) in enumerate(slots[: len(slots) // 2]):
        shares[s] += 1
    total = defaultdict(int)
    for _, s in slots:
        total[s] += 1
    assert all(abs(shares[s] - total[s] / 2) <= 6 for s in total)


def test_another_schedule_gives_another_mix(spark):
    """Points that are all in one source's share give no words of another."""
    docs = spark.range(400).selectExpr("id as doc_id", "concat('s', id % 4) as source", "cast(20 + id % 7 as long) as size")
    golden, uneven = ({r["doc_id"]: r["taken"] for r in M.mixed_counts(docs, multiplier=m).collect()} for m in (M._GOLDEN, 1))
    assert golden != uneven and len({i % 4 for i, n in uneven.items() if n}) == 1 and len({i % 4 for i, n in golden.items() if n}) == 4


def test_points_do_not_overflow(spark):
    slots = [0, 1, 65535, 65536, 2**32 - 1, 2**32, 2**40 + 12345, 2**46 - 1]
    got = spark.createDataFrame([(s,) for s in slots], "s long").select("s", M.weyl(F.col("s")).alias("u")).collect()
    assert all(r["u"] == r["s"] * M._GOLDEN % 2**32 for r in got)


def test_null_and_equal_ids_are_spread_over_buckets(spark):
    docs = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'a' as source", "cast(id % 300 as long) as size")
    marks = docs.select(M.stream_mark(0).substr(1, 8).alias("m")).distinct().count()
    assert marks == 300
    got = M.mixed_counts(docs, bucket_rows=100)
    assert sorted(got.select("size", "taken").collect()) == sorted(M.mixed_counts(docs.repartition(3), bucket_rows=100).select("size", "taken").collect())


def test_counts_carry_the_first_slot(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "concat('s', id % 5) as source", "cast(20 + id % 7 as long) as size")
    first = {}
    for r in M.mix_sources(docs, block=32)[0].collect():
        first[r["doc_id"]] = min(first.get(r["doc_id"], r["slot"]), r["slot"])
    got = M.mixed_counts(docs, block=32).collect()
    assert len(first) < 300 and {r["doc_id"]: r["slot"] for r in got} == {i: first.get(i) for i in range(300)}
    assert all((r["slot"] is None) == (r["taken"] == 0) for r in got)


def test_words_size(spark):
    texts = ["a b", "", None, " \t a\x0b\n b\x1fc  ", "é\xa0é", "x" * 100]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(M.words_size()).collect()
    assert [r[0] for r in got] == [2, 0, 0, 2, 1, 1]


def test_cap_of_all_and_empty(spark):
    one = spark.createDataFrame([(1, "a", 10)], "doc_id long, source string, size long")
    assert M.mixed_counts(one).select("taken").first()[0] == 15
    assert M.mixed_counts(one.withColumn("size", F.lit(0))).select("taken").first()[0] == 0
    assert M.mixed_counts(sized(nothing(spark))).count() == 0
