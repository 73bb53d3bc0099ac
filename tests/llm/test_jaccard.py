import random
import re

import numpy as np
import pytest
from cases import SCHEMA, edited, hard, hard_rows, nothing, row, words

from helioquery.llm import jaccard_join as J
from helioquery.llm.components import components

W = re.compile("[^\x20\x09-\x0d]+")


def sets_of(rows, width):
    out = []
    for r in rows:
        w = W.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))
        k = min(width, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def brute(rows, width, num, den):
    s = sets_of(rows, width)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j]:
                common = len(s[i] & s[j])
                if den * common >= num * (len(s[i]) + len(s[j]) - common):
                    root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s[i]), least.get(find(i)) if s[i] else r[0]) for i, r in enumerate(rows)), key=repr)


def families(seed):
    """Chains and stars of edits of texts of all lengths, with shared passages and exact copies."""
    rng = random.Random(seed)
    passage = words(rng, 60, 5000)
    out = []
    for n in (4, 6, 9, 12, 18, 25, 35, 50, 80, 130, 220, 400):
        text = words(rng, n, 3000)
        for _ in range(6):
            out.append(text)
            out.append(edited(rng, text, max(1, n // 60)))
            text = edited(rng, text, max(1, n // 50))
    out += [f"{passage} {words(rng, rng.randrange(2, 12), 5000)}" for _ in range(40)]
    base = words(rng, 140, 5000)
    out += [edited(rng, base, rng.randrange(0, 12)) for _ in range(60)] + [base] * 10
    return [row(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("width", "num", "den"), [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_brute_force(spark, width, num, den):
    rows = families(width) + [(r[0] if r[0] is None else r[0] + 10_000, *r[1:]) for r in hard_rows()]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows, width, num, den)
    assert len({x[2] for x in want}) < len(rows) - 60
    for region_rows, broadcast_rows in ((4096, 500_000), (20, 0))[: 2 if num == 4 else 1]:
        got = J.jaccard_components(docs, width, num, den, region_rows=region_rows, broadcast_rows=broadcast_rows).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == want


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5), (1, 2)])
def test_similar_sets_share_a_key_and_sketches_never_overstate(num, den):
    m = J.Metric(num, den, 3)
    rng = np.random.default_rng(3)
    for n in [1, 2, 3, 5, 8, 10, 13, 17, 19, 26, 27, 40, 77, 100, 171, 300, 768, 1500, 4000]:
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        for _ in range(20):
            change = rng.integers(0, m.differ(n) + 1)
            lost = rng.integers(0, change + 1)
            b = np.unique(np.concatenate((rng.permutation(a)[lost:], rng.integers(0, 2**63, change - lost, dtype=np.uint64) * np.uint64(2) + np.uint64(1))))
            common = len(np.intersect1d(a, b))
            apart = len(a) + len(b) - 2 * common
            rows = J._folded([m.sketch(a), m.sketch(b)])
            assert J._apart(rows[:1], rows[1])[0] <= apart
            if apart and m.similar(common, len(a), len(b)):
                assert len(np.intersect1d(m.keys(a), m.keys(b))), (n, change, lost)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 6000 + i) for i in range(100)] + [(7, 7)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {n: find(n) for n in root if find(n) != n}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_regions_are_parted_by_nearest_pivots_and_no_pair_is_lost(spark):
    """Clusters of sets: each has regions of its own; every similar pair of different anchors meets in one, one of it at home."""
    rng, metric = np.random.default_rng(8), J.Metric(4, 5, 5)
    sets = {}
    for _ in range(12):
        centre = np.unique(rng.integers(0, 2**63, 150, dtype=np.uint64) * np.uint64(2))
        for _ in range(25):
            change = int(rng.integers(0, 20))
            sets[len(sets)] = np.unique(np.concatenate((rng.permutation(centre)[change:], rng.integers(0, 2**63, change, dtype=np.uint64) * np.uint64(2) + np.uint64(1))))
    rows = [(7, x, len(s), metric.sketch(s), True, x) for x, s in sets.items()]
    members = spark.createDataFrame(rows, "r long, x long, n long, sketch binary, home boolean, anchor long")
    similar = {(a, b) for a in sets for b in range(a) if metric.similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))}
    assert similar

    def none(pairs):
        return spark.createDataFrame([], "a long, b long")

    parted, links = J.voronoi(members, metric, none, 60, ways=40)
    parted = parted.collect()
    assert links.isEmpty()
    regions = {}
    for r in parted:
        regions.setdefault(r["r"], []).append(r)
    assert len(regions) > 5 and max(map(len, regions.values())) < 200
    met = {(max(a["x"], b["x"]), min(a["x"], b["x"])) for g in regions.values() for a in g if a["home"] for b in g}
    assert similar <= met
    dealt = J.in_blocks(spark.createDataFrame(parted, members.schema), 20, 10**9).collect()
    blocks = {}
    for r in dealt:
        blocks.setdefault((r["r"], r["i"], r["j"]), ([], []))[r["role"]].append(r["x"])
    assert similar <= {(max(a, b), min(a, b)) for probes, held in blocks.values() for a in probes for b in held}


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_keep_one(spark, broadcast_rows):
    docs = hard(spark)
    rows = hard_rows()
    kept = J.keep_one(docs, J.jaccard_components(docs, 5, 4, 5), broadcast_rows=broadcast_rows).collect()
    s = sets_of(rows, 5)
    assert sum(not W.findall(r["text"] or "") for r in kept) == sum(not x for x in s)
    left = [i for i, r in enumerate(rows) for k in kept if s[i] and (k["doc_id"], k["text"]) == (r[0], r[1])]
    groups = {}
    for i, x in enumerate(s):
        if x:
            near = [g for g in groups if any(5 * len(x & s[j]) >= 4 * len(x | s[j]) for j in groups[g])]
            groups[i] = [i] + [j for g in near for j in groups.pop(g)]
    # of each group one document, repeated rows count once
    assert sorted(len({(rows[i][0], rows[i][1]) for i in g} & {(rows[i][0], rows[i][1]) for i in left}) for g in groups.values()) == [1] * len(groups)
    assert sum(bool(W.findall(r["text"] or "")) for r in kept) == len(groups)


def test_empty(spark):
    assert J.jaccard_components(nothing(spark)).count() == 0


def test_pivots_of_cells_that_span_partitions(spark):
    """A cell that every class is in, and small ones, dealt over many partitions."""
    rng = random.Random(6)
    members = [(rng.sample(range(50), 3) + [99], i - 300) for i in range(600)] + [([99], 5)] * 40
    sets = spark.createDataFrame(members, "keys array<long>, c long")
    want = set()
    for key in [*range(50), 99]:
        cell = {c for keys, c in members if key in keys}
        want |= {(min(cell), c) for c in cell if c != min(cell)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {tuple(r) for r in J.pivots(sets).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert J.pivots(sets.limit(0)).count() == 0
