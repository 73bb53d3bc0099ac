import random

from cases import SCHEMA, hard, hard_rows, nothing, row

from helioquery.llm import line_dedup as D


def brute(rows, width=3, short=False):
    fits = lambda x: range(max(len(x) - width + 1, int(short))) if x else ()
    last = 2**63 - 1
    lines = [None if r[1] is None else r[1].split("\n") for r in rows]
    norm = [None if x is None else [y.replace("\t", " ").replace("\r", " ").strip(" ") for y in x] for x in lines]
    first = {}
    for r, x in zip(rows, norm):
        for i in fits(x):
            w = tuple(x[i : i + width])
            if any(w):
                at = (last if r[0] is None else r[0], i)
                first[w] = min(first.get(w, at), at)
    gone = {}
    for r, x in zip(rows, norm):
        for i in fits(x):
            w = tuple(x[i : i + width])
            if any(w) and first[w] != (last if r[0] is None else r[0], i):
                gone.setdefault((r[0], r[1]), set()).update(range(i, min(i + width, len(x))))
    out = []
    for r, x in zip(rows, lines):
        g = gone.get((r[0], r[1]), set())
        out.append((r[0], None if x is None else "\n".join(y for i, y in enumerate(x) if i not in g), len(x or []), len(g)))
    return sorted(out, key=repr)


def documents():
    rng = random.Random(8)
    pool = [f"line {i}" for i in range(12)] + ["", "  ", "\t x \r", "ü"]
    out = hard_rows()
    for i in range(120):
        out.append(row(2000 + i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 30)))))
    out += [row(3000 + i, "hot a\nhot b\nhot c\nown %d" % i) for i in range(50)]
    out += [row(4000, "\n".join(["same"] * 6)), row(4001, "\n\n\n\n"), row(4002, "\n\n\n\n"), row(None, "hot a\nhot b\nhot c")]
    return out


def test_brute_force(spark):
    docs = spark.createDataFrame(documents(), SCHEMA).repartition(3)
    for lines in (4_000_000, 0):
        for short in (False, True):
            got = D.line_dedup(docs, broadcast_bytes=lines, short=short).collect()
            assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got), key=repr) == brute(documents(), short=short)


def test_overlapping_windows_merge_within_a_document(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\nd\ny")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in D.line_dedup(docs).collect()} == {1: "a\nb\nc\nd\ne", 2: "x\ny"}


def test_hard_rows_and_none(spark):
    assert D.line_dedup(hard(spark)).count() == len(hard_rows())
    assert D.line_dedup(nothing(spark)).count() == 0


def test_short_documents_are_one_window(spark):
    rows = [(1, "a\nb"), (2, " a\nb\t"), (3, "b\na"), (4, "one"), (5, "one"), (6, ""), (7, " \n"), (8, "\n "), (9, "x\na\nb\ny"), (10, "one\n"), (11, None), (12, "x\na\nb\nz"), (None, "one"), (13, "p\n\n"), (14, "p\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = {2: 2, 5: 1, 12: 3, None: 1}
    for lines in (4_000_000, 0):
        got = {r["doc_id"]: r for r in D.line_dedup(docs, broadcast_bytes=lines, short=True).collect()}
        assert {i: r["n_removed"] for i, r in got.items() if r["n_removed"]} == removed
        assert {i: r["text"] for i, r in got.items()} == dict(rows) | {2: "", 5: "", None: "", 12: "z"}
    # longer documents lose the same lines with and without
    docs = spark.createDataFrame(documents(), SCHEMA)
    pick = lambda df: sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in df.filter("n_lines >= 3").collect()), key=repr)
    assert pick(D.line_dedup(docs, short=True)) == pick(D.line_dedup(docs))
