"""The pipeline against a plain version of it."""

import hashlib
import re
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import corpus_pipeline as P
from cases import hard, hard_rows, nothing
from pyspark.sql import functions as F
from test_decontam import brute as hits
from test_jaccard import brute as groups

from test_mixing import brute_targets

from helioquery.llm import langid
from helioquery.llm import sharding as S

SPACE = re.compile("[^\x20\x09-\x0d]+")


def plain(rows, items):
    """Documents after each of the first three stages."""
    component = {}
    for (i, _, least), r in zip(groups(rows, 5, 4, 5), sorted(rows, key=repr)):
        component.setdefault(i, set()).add(least)
    one = {}
    for r in rows:
        if r[0] in component[r[0]]:
            one.setdefault(r[0], []).append(r)
    clean = {i: [r for r in g if hits(r[1], items)[1] == 0] for i, g in one.items()}
    return {i: g for i, g in clean.items() if g}


def mixed(rows, block=64, multiplier=2654435769):
    """How often each document comes: streams in the order of their marks, cut where their source's slots or its target end."""
    size = {i: len(SPACE.findall(t)) for i, t, _ in rows}
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    target = brute_targets({s: sum(size[i] for i, _, x in rows if x == s) for s in order})
    total, upto, slots = sum(target.values()), 0.0, {}
    points = [k * multiplier % 2**32 for k in range(-(-int(total) // block))]
    for s in order:
        low, upto = upto, upto + target[s]
        slots[s] = sum(round(low / total * 2**32) <= u < round(upto / total * 2**32) for u in points)
    out = Counter()
    for s in order:
        stream = sorted((hashlib.md5(f"0:{i}:{size[i]}".encode()).hexdigest(), i) for i, _, x in rows if x == s)
        left, given = min(slots[s] * block, int(target[s])), Counter()
        for _, i in stream * 2:
            given[i] += min(left, size[i])
            left -= min(left, size[i])
        out |= {i: int(Decimal(n / size[i]).quantize(0, ROUND_HALF_UP)) for i, n in given.items() if size[i]}
    return +out


def test_pipeline_agrees_with_plain_version(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    table = spark.read.parquet(f"{data}/documents.parquet")
    decoded = langid.identify(table.select("doc_id", "text"), langid.fit(table)).collect()
    known = {r["doc_id"] for r in decoded if r["lang_pred"] != "und" and not r["ambiguous"]}
    clean = plain([r for r in docs if r[0] in known], items)
    copies = mixed([(g[0][0], g[0][1], g[0][3]) for g in clean.values()])
    got = P.run(spark, data).collect()
    assert Counter(r["doc_id"] for r in got) == copies
    n = len(got)
    assert sorted(r["row_number"] for r in got) == list(range(n))
    assert all((r["shard"], r["slot"]) == S.place_of(r["row_number"], n, P.SHARDS, 20) for r in got)
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["row_number"])]
    assert ids == sorted(ids)
    text = {r[0]: r[1] for r in docs}
    assert all(r["text"] == text[r["doc_id"]] for r in got)


def test_the_model_decides_what_language_id_drops(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs)
    model.weights[:], model.bias[:] = 0, 0
    monkeypatch.setattr(langid, "fit", lambda *_: model)
    assert P.language_id(spark, docs, data).count() == 0


def test_tied_rows_are_placed_the_same_however_they_are_dealt(spark, data):
    docs = spark.createDataFrame([(1, f"text {i}", "a", 6) for i in range(64)], "doc_id long, text string, source string, n_chars int")
    placed = [{r["text"]: (r["shard"], r["slot"]) for r in P.shards(spark, docs.repartition(k), data).collect()} for k in (2, 7)]
    assert placed[0] == placed[1]


def test_stages_on_hard_rows_and_none(spark, data):
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "decontamination", "source_mix", "shards"]
    for docs in (hard(spark), nothing(spark)):
        for k, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, data)
            rows = out.collect()
            if k < 4:
                assert out.columns == docs.columns
            if k == 0 and rows:
                lettered = sum(r[1] is not None and any(map(str.isalpha, r[1])) for r in hard_rows())
                assert lettered - 12 <= len(rows) <= lettered  # languages are no guide to these texts
            docs = spark.createDataFrame(rows, out.schema)


def test_no_text_without_a_letter_stays_where_no_row_has_a_language(spark, data):
    docs = hard(spark).withColumn("lang", F.lit(None).cast("string"))
    got = dict(P.STAGES)["language_id"](spark, docs, data)
    assert got.columns == docs.columns
    assert Counter(r["text"] for r in got.collect()) == Counter(r[1] for r in hard_rows() if r[1] is not None and any(map(str.isalpha, r[1])))


def test_registered():
    import __spark_entry__ as e

    assert "pipeline" in e.queries() and P.ORACLE_SQL is None
