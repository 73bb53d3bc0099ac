"""Language ID, toxicity and importance resampling: held-out accuracy, method, hard rows."""

import random
from collections import Counter

import numpy as np
import pytest
from cases import hard, hard_rows, nothing, words
from pyspark.sql import functions as F

from helioquery.llm import importance as I
from helioquery.llm import langid as L
from helioquery.llm import toxicity as X


# -- language ID


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 40])
def test_codewords_are_far_apart(n):
    code = L.codewords(n)
    bits = code.shape[1]
    d = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert set(np.unique(code)) <= {-1, 1} and all(x >= max(1, bits // 5) for x in d)
    if n > 1:
        assert (np.abs(code.astype(int).sum(axis=0)) < n).all()


def texts_of(rng, letters, n):
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(40)) for _ in range(n)]


def test_decoding_corrects_a_wrong_bit():
    rng = random.Random(1)
    alphabets = ["abcde", "fghij", "klmno", "pqrst", "uvwxy"]
    x, y = [], []
    for name, letters in zip("ABCDE", alphabets):
        for t in texts_of(rng, letters, 40):
            x.append(L.features(t))
            y.append(name)
    m = L.train(np.stack(x), y)
    best, score, unsure = m.predict(np.stack(x))
    assert [m.languages[b] for b in best] == y and score.min() > 0.8 and not unsure.any()
    broken = L.Model(m.languages, m.code, m.weights.copy(), m.bias.copy(), m.trust)
    broken.weights[:, 0] *= -1
    broken.bias[0] *= -1
    assert (broken.predict(np.stack(x))[0] == best).all()
    mixed = L.features(texts_of(rng, "abcde", 1)[0] + " " + texts_of(rng, "pqrst", 1)[0])
    assert m.predict(mixed[None])[1][0] < score.min()


def test_held_out_accuracy(spark, data):
    got = L.op1_language_id(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 200 and len(held) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_hard_rows(spark):
    out = L.identify(hard(spark), L.fit(hard(spark)))
    got = out.collect()
    assert len(got) == len(hard_rows()) and out.columns[:3] == ["doc_id", "text", "lang"]
    for r in got:
        letters = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not letters) and (letters or (r["score"] == 0 and not r["ambiguous"]))
    assert {r["lang_pred"] for r in L.identify(hard(spark), None).collect()} == {"und"}
    assert L.fit(nothing(spark)) is None and L.identify(nothing(spark), None).count() == 0
    one = L.fit(hard(spark).filter("lang = 'en'"))
    assert {r["lang_pred"] for r in L.identify(hard(spark), one).collect()} == {"en", "und"}


def test_sample_holds_hot_texts_and_rare_languages_in_their_share(spark, monkeypatch):
    text = "case when id < 6000 then 'one hot text' when id < 8980 then concat('other words ', id) else concat('zzz ', id) end as text"
    docs = spark.range(9000).selectExpr("id as doc_id", text, "case when id < 6000 then 'aa' when id < 8980 then 'bb' else 'zz' end as lang")
    seen = []
    monkeypatch.setattr(L, "train", lambda x, labels: seen.append(Counter(labels)))
    L.fit(docs, sample_rows=200)
    L.fit(docs.repartition(7), sample_rows=200)
    assert seen[0] == seen[1] and seen[0]["zz"] == 20
    assert 80 < seen[0]["aa"] < 190 and 30 < seen[0]["bb"] < 110


def test_prediction_reads_text_alone(spark):
    df = hard(spark)
    model = L.fit(df)
    pick = lambda d: sorted(((r["text"], r["lang_pred"], r["score"]) for r in L.identify(d, model).collect()), key=repr)
    assert pick(df) == pick(df.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.lit(1).cast("long")))


# -- toxicity


def test_machine_learns_a_pair_that_weights_cannot():
    rng = random.Random(2)
    found, y = [], []
    for _ in range(4000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        text = words(rng, 12, 2000) + " vile" * insult + " folk" * group
        found.append(X.terms(text))
        y.append(int(insult and group))
    m = X.train(found, np.array(y), floor=10)
    s = m.score([X.terms(t) for t in ("a vile day", "good folk here", "vile folk here", "nothing", "")])
    assert s[2] > 0.9 and max(s[0], s[1], s[3], s[4]) < 0.2
    place = m.inputs(np.concatenate((X.terms("vile"), X.terms("folk"))))
    assert m.factors[place[0]] @ m.factors[place[1]] > 0.5


def test_score_is_the_naive_sum_over_pairs():
    rng = np.random.default_rng(0)
    at = X.terms("one two three four")
    m = X.Model(at, -0.3, rng.normal(size=len(at)), rng.normal(size=(len(at), 3)))
    k = m.inputs(X.terms("one three four"))
    z = -0.3 + m.weights[k].sum() + sum(m.factors[i] @ m.factors[j] for a, i in enumerate(k) for j in k[:a])
    assert m.score([X.terms("one three four, one unknown")])[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_of_hard_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(20)] + [(0, None, "x"), (None, 1, "x"), (3, 0, "y")], "doc_id long, toxic int, text string")
    m = X.fit(hard(spark), labels)
    got = X.score(hard(spark), m).collect()
    assert len(got) == len(hard_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if not (r["text"] or "").strip()}) == 1
    assert X.fit(nothing(spark), labels) is None and X.fit(hard(spark), labels.limit(0)) is None
    assert {r["score"] for r in X.score(hard(spark), None).collect()} == {0.0} and X.score(nothing(spark), m).count() == 0


def test_toxicity_query_finds_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = X.op3_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").filter("held_out and lang = 'en'").collect()
    bad = [r for r in got if r["toxic"] == 1]
    assert np.mean([r["predicted"] for r in bad]) > 0.6
    assert np.mean([r["predicted"] for r in got if r["toxic"] == 0]) < 0.05


# -- importance resampling


def test_weights_are_log_ratios(spark):
    df, labels = hard(spark), spark.createDataFrame([(i, 1) for i in range(10)] + [(11, 0), (None, 1), (2, 1)], "doc_id long, quality int")
    good = set(range(10))
    counts = np.zeros((2, I.BUCKETS))
    for r in hard_rows():
        seen = np.bincount(I.grams(r[1]), minlength=I.BUCKETS)
        counts[0] += seen
        counts[1] += seen * (r[0] in good)
    ratio = np.log((counts[1] + 1) / (counts[1].sum() + I.BUCKETS)) - np.log((counts[0] + 1) / (counts[0].sum() + I.BUCKETS))
    for per in (True, False):
        for r in I.weigh(df, labels, per_gram=per).collect():
            g = I.grams(r["text"])
            assert r["log_weight"] == pytest.approx(ratio[g].sum() / (max(1, len(g)) if per else 1), abs=1e-9)


def test_gumbel_top_k(spark):
    weighed = spark.range(4000).selectExpr("id as doc_id", "case when id < 1000 then 2.0D else 0.0D end as log_weight", "'x' as rank")
    out = I.resample(weighed, 0.25, seed=1).collect()
    chosen = [r for r in out if r["selected"]]
    assert len(chosen) == 1000 and min(r["gumbel_key"] for r in chosen) >= max(r["gumbel_key"] for r in out if not r["selected"])
    assert sorted(r["rank"] for r in out) == list(range(4000))
    heavy = sum(r["doc_id"] < 1000 for r in chosen)
    # without replacement from 1000 rows of weight e**2 and 3000 of weight 1
    assert 520 < heavy < 720
    again = {r["doc_id"] for r in I.resample(weighed.repartition(7), 0.25, seed=1).collect() if r["selected"]}
    assert again == {r["doc_id"] for r in chosen}
    assert again != {r["doc_id"] for r in I.resample(weighed, 0.25, seed=2).collect() if r["selected"]}


def test_importance_of_hard_rows_and_none(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = I.resample(I.weigh(hard(spark), labels), 0.5).collect()
    assert len(out) == len(hard_rows()) and {r["log_weight"] for r in out} == {0.0}
    assert sum(r["selected"] for r in out) == -(-len(out) // 2)
    assert I.resample(I.weigh(nothing(spark), labels), 0.5).count() == 0
