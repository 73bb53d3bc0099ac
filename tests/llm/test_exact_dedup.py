import hashlib
import re

import numpy as np
import pandas as pd
from cases import hard, hard_rows, nothing

from helioquery.llm import exact_dedup as D


def test_perfect_hash_is_minimal_and_bytes_decide():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000):
        keys = rng.integers(0, 2**63, (n, 4), dtype=np.uint64)
        sizes, bits = D.build_mph(keys)
        assert sorted(D.mph_slots(keys, sizes, bits)) == list(range(n))
    other = rng.integers(0, 2**63, (1000, 4), dtype=np.uint64)
    slots = D.mph_slots(other, sizes, bits)
    assert (slots >= 0).any()  # a nonmember may get a slot; only the digest tells
    assert not (keys[np.maximum(slots, 0)] == other).all(axis=1).any()


def brute(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in rows]
    out = []
    for r, t in zip(rows, norm):
        ids = [s[0] for s, u in zip(rows, norm) if u == t]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_hard_rows(spark):
    for shard_keys in (5, 100_000):
        got = D.exact_dedup(hard(spark), shard_keys=shard_keys).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in got), key=repr) == brute(hard_rows())


def test_one_huge_group_and_none(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else concat('t', id) end as text")
    got = D.exact_dedup(df).filter("group_size > 1").collect()
    assert len(got) == 1667 and {r["keep_id"] for r in got} == {0}
    assert D.exact_dedup(nothing(spark)).count() == 0


def test_members_are_counted_in_their_slots():
    key = lambda i: hashlib.sha256(bytes([i])).digest()
    index = D._build(pd.DataFrame({"shard": 0, "digest": [key(i) for i in range(50)], "winner": range(100, 150), "n": 2}))
    new = pd.DataFrame({"shard": 0, "digest": [key(i) for i in range(40, 60)], "winner": range(1000, 1020), "n": 3})
    for arrived in (new, new[:0]):
        seen = set(arrived["digest"])
        got = sorted(map(tuple, D._merge(arrived, index)[["digest", "winner", "n"]].to_numpy()))
        assert got == sorted([(key(i), 100 + i, 5 if key(i) in seen else 2) for i in range(50)] + [(key(i), 960 + i, 3) for i in range(50, 60) if key(i) in seen])
    assert len(D._merge(new, index[:0])) == len(new)


def test_groups_come_from_the_index(spark, monkeypatch):
    df = spark.range(40).selectExpr("id as doc_id", "concat('t', id % 20) as text")
    pick = lambda: sorted(map(tuple, D.exact_dedup(df).select("doc_id", "keep_id", "group_size").collect()))
    assert pick() == [(i, i % 20, 2) for i in range(40)]
    build = D.build_index
    monkeypatch.setattr(D, "build_index", lambda history, *a: build(history.filter("winner <> 3"), *a))
    assert (3, 3, 2) not in pick() and (23, 23, 1) in pick()
