import hashlib
import random
import re

from cases import SCHEMA, hard, hard_rows, nothing, row, words
from compare import same

from helioquery.llm import decontam as D

W = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(text, items, width=10):
    w = W.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        b = W.findall(lower(t))
        n = min(width, len(b))
        keys = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in keys:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def items():
    rng = random.Random(2)
    out = [(i, words(rng, rng.choice([3, 9, 10, 11, 40]), 30)) for i in range(30)]
    return out + [(100, None), (101, ""), (102, "Ünï-Cödé, ONE"), (103, "...")]


def documents():
    rng, it = random.Random(4), items()
    out = hard_rows()
    for i in range(60):
        passage = rng.choice(it)[1] or ""
        out.append(row(1000 + i, f"{words(rng, 20, 30)}. {passage.upper()}, {words(rng, 5, 30)} ünï; cödé?one"))
    return out


def test_brute_force_in_one_block_and_many(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    docs = spark.createDataFrame(documents(), SCHEMA)
    want = sorted(((r[0], r[1], *brute(r[1], items())) for r in documents()), key=repr)
    for block in (1 << 20, 100):
        got = D.decontaminate(docs, bench, block_bytes=block).collect()
        assert sorted(((r["doc_id"], r["text"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=repr) == want
        for r in got:
            covered = [w for s in r["spans"] for w in W.findall(lower(r["text"][s["start"] : s["end"]]))]
            assert len(covered) == r["n_hit"]


def test_spans_are_characters_of_the_original():
    m = D.Matcher([("1", "alpha beta gamma")], 10)
    text = "日本 — Alpha\n beta, GAMMA! ü"
    n, hit, found, spans = D.scan(text.encode(), [m])
    assert (n, hit, found) == (6, 3, ["1"]) or hit == 3
    assert [text[s["start"] : s["end"]] for s in spans] == ["Alpha\n beta, GAMMA"]


def test_query_digest(spark, data):
    got = D.op5_decontamination(spark, data).filter("contaminated").collect()
    assert got and all(r["n_hit"] > 0 and r["n_items"] > 0 and r["items_sha256"] != hashlib.sha256(b"").hexdigest() for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(nothing(spark), none).count() == 0
    assert D.decontaminate(hard(spark), none).filter("n_hit > 0").count() == 0


def test_items_without_an_id_count_as_one(spark, duck, tmp_path):
    bench = [(None, "red green blue"), (None, "sun moon"), (7, "red green blue"), (None, None), (10, "moon star")]
    docs = [(1, "a red GREEN blue b"), (2, "sun moon"), (3, "moon star, sun moon red green blue"), (4, "nothing"), (None, "sun moon")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    for block in (1 << 20, 5):
        got = D.decontaminate(read("documents"), read("benchmark"), block_bytes=block).collect()
        assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in got} == {1: (3, ["7", None]), 2: (2, [None]), 3: (7, ["10", "7", None]), 4: (0, []), None: (2, [None])}
    con = duck.cursor()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE TEMP VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet' WHERE {'doc_id IS NOT NULL' if name == 'documents' else 'true'}")
    same(D.op5_decontamination(spark, str(tmp_path)).filter("doc_id is not null"), con, D.ORACLE["op5_decontamination"])
