"""Documents with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, slot long, row_number long, items string, id long, c long, size long, row long, n_words long"


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), 0.5, 1, 2, 3, "x", 4, 5, 6, 7, 8)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, edits):
    out = text.split(" ")
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"n{rng.randrange(10**6)}"
    return " ".join(out)


def hard_rows(seed=1):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(5, 300)) for _ in range(20)]
    out = [row(i, t, source=rng.choice(["a", "b", None])) for i, t in enumerate(base)]
    out += [row(100 + i, edited(rng, base[i % 20], rng.randrange(0, 4))) for i in range(60)]
    out += [row(300, None, None, None), row(301, "", None, ""), row(302, " \t\n\r ", "en", "ä"), row(303, "...!!! 123", "de"), row(None, "a null id with words", None, None), row(None, None), row(None, base[0])]
    out += [row(304, "ünïcödé wörds ñ 日本", "fr"), row(305, "one"), row(306, "ONE"), row(307, "one two"), row(308, "one  two")]
    out += [row(309, words(rng, 30_000, 50_000))]  # long
    out += [row(310, "same row twice")] * 2 + [row(311, "same id"), row(311, "other text")]
    return out


def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
