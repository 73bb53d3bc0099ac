"""Exact self-join of documents by Jaccard similarity of word shingles, through metric regions.

Documents with equal shingle sets are one class. Between classes of sizes a <= b, similarity of at least t means
b <= a/t and a symmetric difference of at most a*(1-t)/t shingles. The symmetric difference is a metric, and the search
works in it by regions, windows and recursion:

1. Pivot: the empty set, whose distance to a set is its size. Regions are rings of sizes; by the triangle inequality a
   partner lies in the ring of the smaller set or the next, so sets near a ring's lower edge are replicated into the
   rings of their possible smaller partners.
2. A ring's sets are cut into parts by a hash of the shingle, more parts than shingles can differ (by some spare ones):
   two similar sets agree wholly in one part, with distance 0 there, so sets with an equal part are in one cell. Small
   parts (none or one shingle), which far sets share, are left out as long as the spare parts make up for them.
3. The least class of a cell is its pivot; the sets that share a cell with it are its region (a set may lie in several:
   the windows of step 1 and the several parts replicate it). Any similar pair is together in a region. Members that
   sketches allow to be similar to the pivot are compared with it exactly, and such links give them anchors: the least pivot
   that they, or a pivot of theirs, are linked with. A sketch
   is the parities of the numbers of shingles in hash buckets; the Hamming distance of sketches is a metric that never
   exceeds the symmetric difference.
4. Where a region's members have several anchors and are more than ``region_rows``, some of them become pivots, and the
   region is parted into their Voronoi regions: each member is at home with its nearest pivot, and a guest of those where the
   triangle inequality (its distance less the least one, at most twice what similar sets differ in) leaves room for a
   partner. Links with the pivots join anchors; then each part is a region, and this recurs until all are small enough.
   A region that its pivots cannot part (its parts would have more than 0.7 of its pairs; so it is with members that
   differ from one another as much as from any pivot) is dealt as it is, in blocks.
5. In a region, members of another anchor than most, and guests, are compared with those at home: those in the window
   around their distance to one of them, by short sketches, then by whole ones; what may be similar, exactly, leaving out what
   links connect already. So a region gives fewer links than it has members, and no task holds more than two blocks.

Document pivots alone do not do for step 1: unrelated texts have Jaccard distance close to 1 to every pivot, and
windows of twice 1-t would replicate everything everywhere.

Links make connected components; pairs already known to be connected through a pivot are not listed. Shingles and
classes are 64-bit hashes. Exact copies, however many, are one class and are counted before they are shuffled.

Null texts and texts without words have no shingles and are linked with nothing; null ids take part and are named as
component only if no other id is there; rows with equal ids are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, join_hot, mix, outcome, partitions, release, shingle_hashes, ship, slices, trim, word_hashes, written
from .components import components

_RING = 1.5
_SEEN = 200_000
_TRIM = 1000  # groups of so many rows give freed memory back
_SEEDS = np.uint64(0xA0761D6478BD642F)


class Metric:
    """Rings, parts and sketches for similarity ``num/den`` of shingles of ``width`` words."""

    def __init__(self, num: int, den: int, width: int):
        self.num, self.den, self.width = num, den, width
        lows = [1]
        while lows[-1] < 2**31:
            lows.append(max(lows[-1] + 1, int(np.ceil(lows[-1] * _RING))))
        self.lows = np.array(lows)
        self._parts: dict[int, tuple[int, int, int]] = {}

    def ring(self, n: int) -> int:
        return int(np.searchsorted(self.lows, n, "right")) - 1

    def differ(self, n: int) -> int:
        """Most shingles in which a set of n and a larger or equal one can differ."""
        return n * (self.den - self.num) // self.num

    def parts(self, ring: int) -> tuple[int, int, int]:
        """Number of parts of a ring, of spare ones, and the most shingles of a part that the spare ones make up for (-1: none).
        No parts where only equal sets are similar."""
        if ring not in self._parts:
            low, d = int(self.lows[ring]), self.differ(int(self.lows[ring + 1]) - 1)
            self._parts[ring] = (d + 1, 0, -1) if d else (0, 0, -1)
            for small, most in ((0, 1.0), (1, 0.15)) if d >= 2 else ():
                count = d + 1
                for _ in range(50):  # as many spare parts as a small set has small parts, nearly always
                    load = low / count
                    expected = count * np.exp(-load) * (1 + load * small)
                    spare = int(np.ceil(expected + (3 if d >= 20 else 1.5) * np.sqrt(expected)))
                    if d + 1 + spare <= count or spare > most * d:
                        break
                    count = d + 1 + spare
                if spare <= most * d:
                    self._parts[ring] = (count, count - d - 1, small)
        return self._parts[ring]

    def shingles(self, text: str | None) -> np.ndarray:
        return shingle_hashes(word_hashes((text or "").encode().translate(FOLD)), self.width)

    def similar(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)

    def keys(self, s: np.ndarray) -> np.ndarray:
        """One key for each part of each ring that the set has to be in."""
        n, out = len(s), []
        h = mix(s ^ _SEEDS)
        for ring in range(self.ring(-(-n * self.num // self.den)), self.ring(n) + 1):
            count, spare, most = self.parts(ring)
            if not count:
                continue
            part = (h % np.uint64(count)).astype(np.int64)
            sizes = np.bincount(part, minlength=count)
            order = np.argsort(part, kind="stable")
            full = np.flatnonzero(sizes)
            with np.errstate(over="ignore"):
                total = np.zeros(count, np.uint64)
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))[full]
                total[full] = np.add.reduceat(mix(h[order] + np.uint64(ring)), starts)
                key = mix(total + np.arange(count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(ring * 7919 + 1))
            small = sizes <= most
            out.append(key[~small] if small.sum() <= spare else key)
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def sketch(self, s: np.ndarray) -> bytes:
        """For each of a power of two hash buckets, two to four for a shingle, whether it holds an odd number of shingles."""
        buckets = 1 << max(6, (4 * len(s)).bit_length() - 1)
        at = (s & np.uint64(buckets - 1)).astype(np.int64)
        return np.packbits((np.bincount(at, minlength=buckets) & 1).astype(bool)).tobytes()


def class_of(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s * np.uint64(3) + np.uint64(len(s))).sum(dtype=np.uint64)]))[0].astype(np.int64))


def doc_sets(docs: DataFrame, metric: Metric, id_col: str, text_col: str) -> DataFrame:
    """id, th (hash of the text), n (shingles), c (class; null without words), keys and sketch of every row.

    A task gives the keys of a class once (again where it has met too many classes since), so copies are few before the shuffle."""

    def made(batches):
        seen: set[int] = set()
        for batch in slices(batches, 512):
            n, c, keys, sketch = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = metric.shingles(text)
                n.append(len(s))
                c.append(class_of(s) if len(s) else None)
                again = not len(s) or c[-1] in seen
                keys.append(np.zeros(0, np.int64) if again else metric.keys(s).astype(np.int64))
                if not again:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(c[-1])
                sketch.append(metric.sketch(s))
            lengths = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
            listed = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(c, pa.int64()), listed, pa.array(sketch, pa.binary())],
                                             names=["id", "th", "n", "c", "keys", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), text_col).mapInArrow(made, "id long, th long, n long, c long, keys array<long>, sketch binary")


_CELLS = pa.schema([(k, pa.int64()) for k in ("kind", "key", "a", "b", "last_key", "last_pivot")])
_PAIR, _FIRST_RUN, _SUMMARY = 0, 1, 2


def _cells(batches):
    """Read cells in the order of (key, c), a batch at a time, and pair each member with the first of its cell.

    The partition's first cell may have begun in the one before, so its members are listed by key; a summary tells its
    first key and member and its last key and pivot."""

    def rows(kind: int, **columns: np.ndarray) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind) if f.name == "kind" else columns.get(f.name, np.zeros(n, np.int64)), pa.int64()) for f in _CELLS], schema=_CELLS)

    key = pivot = first_key = first = None
    for batch in batches:
        k, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        if first_key is None:
            first_key, first = k[0], c[0]
        start = np.concatenate(([key is None or k[0] != key], k[1:] != k[:-1]))
        at = np.maximum.accumulate(np.where(start, np.arange(len(k)), -1))
        own = np.where(at >= 0, c[np.maximum(at, 0)], pivot if pivot is not None else 0)
        key, pivot = k[-1], own[-1]
        leading = k == first_key
        if leading.any():
            members = np.unique(c[leading])
            yield rows(_FIRST_RUN, key=np.full(len(members), first_key), b=members)
        other = ~leading & (own != c)
        if other.any():
            p, x = np.unique(np.stack((own[other], c[other])), axis=1)
            yield rows(_PAIR, a=p, b=x)
    if first_key is not None:
        one = lambda v: np.array([v], np.int64)
        yield rows(_SUMMARY, key=one(first_key), a=one(TaskContext.get().partitionId()), b=one(first), last_key=one(key), last_pivot=one(pivot))


def pivots(sets: DataFrame) -> DataFrame:
    """Distinct (p, x): x shares a cell with its least class p.

    Cells are dealt by ranges of (key, class), so a cell with many members lies in several partitions; the pivot of a
    partition's first cell comes from the summaries of those before it."""
    spark = sets.sparkSession
    dealt = sets.select(F.explode("keys").alias("key"), "c").repartitionByRange(partitions(spark), "key", "c").sortWithinPartitions("key", "c")
    found = written(dealt.mapInArrow(_cells, ", ".join(f"{n} long" for n in _CELLS.names)), "cells")
    pivot_of: dict[int, int] = {}
    last_key = last_pivot = None
    for r in found.filter(F.col("kind") == _SUMMARY).orderBy("a").collect():  # one row a partition
        pivot_of[r["key"]] = first = last_pivot if r["key"] == last_key else r["b"]
        last_key, last_pivot = r["last_key"], first if r["last_key"] == r["key"] else r["last_pivot"]
    known = F.broadcast(spark.createDataFrame(list(pivot_of.items()), "key long, p long"))  # as many rows as partitions
    begun = found.filter(F.col("kind") == _FIRST_RUN).join(known, "key").select("p", F.col("b").alias("x")).filter("p <> x")
    return found.filter(F.col("kind") == _PAIR).select(F.col("a").alias("p"), F.col("b").alias("x")).unionByName(begun).distinct()


def _folded(sketches: list[bytes], size: int | None = None) -> np.ndarray:
    """Sketches as rows of ``size`` bytes (that of the shortest), the parts of longer ones added modulo 2."""
    size = size or min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(c, np.uint64).reshape(-1, size // 8), axis=0) for c in sketches])


def _narrow(rows: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches folded to at most ``words`` words."""
    while rows.shape[1] > words:
        rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
    return np.ascontiguousarray(rows)


def _apart(rows: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hamming distances; never more than the symmetric difference of the sets."""
    return np.bitwise_count(rows ^ row).sum(axis=1, dtype=np.int64)


def _distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Hamming distances of each of ``rows`` and each of ``others``, a word at a time."""
    out = np.zeros((len(rows), len(others)), np.int32)
    for k in range(rows.shape[1]):
        out += np.bitwise_count(rows[:, k, None] ^ others[None, :, k])
    return out


def _may(metric: Metric, least: np.ndarray, a, b) -> np.ndarray:
    """Whether sets of a and b elements that differ in ``least`` at least can be similar."""
    return metric.similar((a + b - least) // 2, a, b)


def near_pivot(regions: DataFrame, metric: Metric) -> DataFrame:
    """Of (p, x, n, sketch, pn, psketch), the (p, x) whose sketches allow a link."""

    def bounded(batches):
        for batch in batches:
            cols = {k: batch[k].to_pylist() for k in ("p", "x", "n", "sketch", "pn", "psketch")}
            keep = []
            for i in range(batch.num_rows):
                both = _folded([cols["sketch"][i], cols["psketch"][i]])
                keep.append(bool(_may(metric, _apart(both[:1], both[1])[0], cols["n"][i], cols["pn"][i])))
            yield pa.RecordBatch.from_arrays([batch["p"], batch["x"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return regions.mapInArrow(bounded, "a long, b long")


# -- regions: rows (r, x, n, sketch, home, anchor); pairs of a home row and another row of a region with another anchor count ----

_SPLIT = "r long, x long, n long, sketch binary, home boolean, anchor long, px long, panchor long, near boolean"


def nearest_pivots(metric: Metric):
    """Members of a part of a region (and the region's pivots) to the pivots' Voronoi regions: at home with the nearest,
    guests of those that the triangle inequality allows a partner to be at home with."""

    def dealt(table: pa.Table) -> pa.Table:
        x, n, home, anchor, pivot = (table[k].to_numpy() for k in ("x", "n", "home", "anchor", "pivot"))
        rows = _folded(table["sketch"].to_pylist(), table["w"][0].as_py())
        p = np.flatnonzero(pivot)
        p = p[np.argsort(x[p])]  # the same order for all parts of a region
        m = np.flatnonzero(~pivot)
        far = _distances(rows[m], rows[p])
        own = far.argmin(axis=1)
        send = far <= (far.min(axis=1) + 2 * metric.differ(n[m]))[:, None]
        send &= ~home[m][:, None] | (np.arange(len(p)) <= own[:, None])  # of two regions' members one is enough as a guest
        i, j = np.nonzero(send)
        at_home = home[m[i]] & (j == own[i])
        i, j, least = m[i], p[j], far[i, j]
        near = at_home & (anchor[i] != anchor[j]) & _may(metric, np.maximum(least, np.abs(n[i] - n[j])), n[i], n[j])
        out = table.select(["r", "x", "n", "sketch"]).take(pa.array(i))
        for name, column in (("home", at_home), ("anchor", anchor[i]), ("px", x[j]), ("panchor", anchor[j]), ("near", near)):
            out = out.append_column(name, pa.array(column))
        return out

    return dealt


def split(members: DataFrame, sizes: DataFrame, metric: Metric, region_rows: int, ways: int) -> DataFrame:
    """One step of the recursion: rows of regions (``sizes``: r, m, w) dealt to the Voronoi regions of at most ``ways`` of their
    members, preferably such as no link connects with others yet. Columns of ``_SPLIT``."""
    rows = members.join(sizes.select("r", "m", "w"), "r")
    mark = F.xxhash64("x", "r")
    first = F.min(F.struct(F.col("anchor") != F.col("x"), mark.alias("h"), "x", "n", "sketch", "anchor")).alias("v")
    pivots = rows.filter("home").groupBy("r", "m", "w", F.pmod(mark, F.lit(ways)).alias("k")).agg(first)
    parts = F.ceil(F.col("m") / region_rows).cast("int")
    pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    pivots = pivots.select("r", "w", "salt", "v.x", "v.n", "v.sketch", F.lit(True).alias("home"), "v.anchor", F.lit(True).alias("pivot"))
    rows = rows.select("r", "w", F.pmod(F.xxhash64("x"), parts).cast("int").alias("salt"), "x", "n", "sketch", "home", "anchor", F.lit(False).alias("pivot"))
    return rows.unionByName(pivots).groupBy("r", "salt").applyInArrow(nearest_pivots(metric), _SPLIT)


def region_sizes(members: DataFrame) -> DataFrame:
    """r, m (rows) and w (bytes of the shortest sketch) of the regions that are still open: of more than one anchor."""
    per = members.groupBy("r").agg(F.count(F.lit(1)).alias("m"), F.min(F.length("sketch")).alias("w"), F.min("anchor").alias("_a"), F.max("anchor").alias("_b"))
    return written(per.filter("_a <> _b").drop("_a", "_b"), "region-sizes")


def voronoi(members: DataFrame, metric: Metric, verify, region_rows: int, ways: int = 32) -> tuple[DataFrame, DataFrame | None]:
    """Regions split around nearest pivots again and again until they have at most ``region_rows`` rows, and the links
    found on the way. A region whose parts have more than 0.7 times the pairs of rows that it has, which pivots cannot part, stays whole."""
    columns = ["r", "x", "n", "sketch", "home", "anchor"]
    done, links = [], None
    while True:
        sizes = region_sizes(members)
        done.append(members.join(sizes.filter(F.col("m") <= region_rows), "r", "left_semi"))
        large = sizes.filter(F.col("m") > region_rows)
        if large.isEmpty():
            return functools.reduce(DataFrame.unionByName, done), links
        parted = written(split(members, large, metric, region_rows, ways), "split")
        per = parted.groupBy("r", "px").agg(F.count(F.lit(1)).cast("double").alias("_k")).groupBy("r").agg(F.sum(F.col("_k") * F.col("_k")).alias("_pairs"))
        fine = written(large.join(per, "r").filter("_pairs <= 0.7D * m * m").select("r"), "parted")
        done.append(members.join(large, "r", "left_semi").join(fine, "r", "left_anti"))
        parted = parted.join(fine, "r", "left_semi")
        found = verify(parted.filter("near").select(F.col("px").alias("a"), F.col("x").alias("b")).distinct())
        met = parted.filter("near").join(found.select(F.col("a").alias("px"), F.col("b").alias("x")), ["px", "x"]).groupBy("r", "x").agg(F.first("panchor").alias("_met"), F.first("anchor").alias("_was"))
        met = written(met, "met")
        new = met.select(F.col("_met").alias("a"), F.col("_was").alias("b"))
        links = new if links is None else links.unionByName(new)
        moved = parted.join(met.drop("_was"), ["r", "x"], "left").withColumn("anchor", F.coalesce("_met", "anchor"))
        members = written(moved.withColumn("r", F.xxhash64("r", "px")).select(columns), "members")


def in_blocks(members: DataFrame, block_rows: int, block_shingles: int, *more: str) -> DataFrame:
    """Rows of regions as probes (guests, and home rows of another anchor than most) and as members (home rows), each in
    blocks; a probe meets each block of members: role, r, i, j and the columns of a row."""
    anchors = members.groupBy("r", "anchor").agg(F.count(F.lit(1)).alias("_k"))
    base = written(anchors.groupBy("r").agg(F.max(F.struct("_k", "anchor")).alias("_b"), F.sum("_k").alias("_m")), "bases")
    rows = join_hot(members, base.select("r", F.col("_b.anchor").alias("base"), "_m"), "r", "_m", members.count())
    rows = rows.withColumn("role", F.explode(F.when(~F.col("home"), F.array(F.lit(0))).when(F.col("anchor") != F.col("base"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    one = lambda k: F.sum((F.col("role") == k).cast("long"))
    size = lambda k: F.sum(F.when(F.col("role") == k, F.col("n")))
    blocks = lambda m, n: F.greatest(F.lit(1), F.ceil(F.col(m) / block_rows), F.ceil(F.col(n) / block_shingles)).cast("int")
    per = rows.groupBy("r").agg(one(0).alias("_m0"), one(1).alias("_m1"), size(0).alias("_n0"), size(1).alias("_n1"), F.count(F.lit(1)).alias("_rows"))
    per = written(per.filter("_m0 > 0 and _m1 > 0").select("r", blocks("_m0", "_n0").alias("_i"), blocks("_m1", "_n1").alias("_j"), "_rows"), "blocks")
    rows = join_hot(rows.drop("_m"), per, "r", "_rows", members.count())
    probe = F.col("role") == 0
    own = F.pmod(F.xxhash64("x"), F.when(probe, F.col("_i")).otherwise(F.col("_j"))).cast("int")
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.when(probe, F.col("_j")).otherwise(F.col("_i")) - 1)))
    both = F.col("home") & (F.col("anchor") != F.col("base"))
    return rows.select("r", F.when(probe, F.col("_own")).otherwise(F.col("_other")).alias("i"), F.when(probe, F.col("_other")).otherwise(F.col("_own")).alias("j"),
                       "role", "x", "n", "sketch", "anchor", both.alias("both"), *more)


class _Leaf:
    """Probes and members of a region or of a block pair of one, ordered by their sketch's distance to that of one of them."""

    def __init__(self, table: pa.Table, metric: Metric):
        self.metric = metric
        self.x, self.n, self.anchor, self.both, role = (table[k].to_numpy() for k in ("x", "n", "anchor", "both", "role"))
        self.rows = _folded(table["sketch"].to_pylist())
        self.coarse = _narrow(self.rows, 8)
        at = _apart(self.rows, self.rows[np.argmin(self.x)])
        by = np.argsort(at, kind="stable")
        self.at, self.probes, self.members = at, by[role[by] == 0], by[role[by] == 1]

    def candidates(self):
        """Arrays of probes and members of different anchors that may be similar, by window, sizes and sketches."""
        ranked = self.at[self.members]
        for start in range(0, len(self.probes), 64):
            p = self.probes[start : start + 64]
            reach = self.metric.differ(self.n[p])
            m = self.members[np.searchsorted(ranked, (self.at[p] - reach).min()) : np.searchsorted(ranked, (self.at[p] + reach).max(), "right")]
            least = np.maximum(_distances(self.coarse[p], self.coarse[m]), np.abs(self.n[p][:, None] - self.n[m]))
            keep = _may(self.metric, least, self.n[p][:, None], self.n[m]) & (self.anchor[p][:, None] != self.anchor[m])
            keep &= ~(self.both[p][:, None] & self.both[m]) | (self.x[p][:, None] < self.x[m])
            i, j = np.nonzero(keep)
            i, j = p[i], m[j]
            if self.rows.shape[1] > self.coarse.shape[1]:
                words = max(1, (1 << 20) // self.rows.shape[1])
                for k in range(0, len(i), words):
                    a, b = i[k : k + words], j[k : k + words]
                    ok = _may(self.metric, np.bitwise_count(self.rows[a] ^ self.rows[b]).sum(axis=1, dtype=np.int64), self.n[a], self.n[b])
                    yield a[ok], b[ok]
            else:
                yield i, j


def open_members(metric: Metric):
    """(r, x) of the rows that have a possible partner of another anchor."""

    def found(table: pa.Table) -> pa.Table:
        leaf, used = _Leaf(table, metric), np.zeros(len(table), bool)
        for i, j in leaf.candidates():
            used[i] = used[j] = True
        if len(table) > _TRIM:
            trim()
        return table.select(["r", "x"]).filter(pa.array(used)).combine_chunks()

    return found


def region_links(metric: Metric, gather: int = 1 << 20):
    """Links of anchors within a region or block pair, each by an exactly compared pair; pairs that a link connects already
    are not compared. At most ``gather`` shingles, or one set, are laid side by side."""

    def linked(table: pa.Table) -> pa.Table:
        leaf = _Leaf(table, metric)
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table["s"]]
        anchors, label = np.unique(leaf.anchor, return_inverse=True)
        of = np.arange(len(anchors))
        out: list[tuple[int, int]] = []
        for rows, others in leaf.candidates():
            for i in np.unique(rows):
                left = others[rows == i]
                while len(left := left[of[label[left]] != of[label[i]]]):
                    part = left[: max(1, int(np.searchsorted(np.cumsum(leaf.n[left]), gather)))]
                    left = left[len(part) :]
                    flat = np.concatenate([sets[k] for k in part])
                    place = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
                    starts = np.concatenate(([0], np.cumsum(leaf.n[part])[:-1]))
                    common = np.add.reduceat((sets[i][place] == flat).astype(np.int64), starts)
                    for k in part[metric.similar(common, leaf.n[part], leaf.n[i])]:
                        a, b = of[label[i]], of[label[k]]
                        if a != b:
                            out.append((anchors[a], anchors[b]))
                            of[of == b] = a
        ends = np.array(out, np.int64).reshape(-1, 2)
        if len(table) > _TRIM:
            trim()
        return pa.table({"a": pa.array(ends.min(axis=1) if len(ends) else [], pa.int64()), "b": pa.array(ends.max(axis=1) if len(ends) else [], pa.int64())})

    return linked


def shingle_sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, metric: Metric, id_col: str, text_col: str, broadcast_rows: int) -> DataFrame:
    """c, s (sorted shingles) of the classes in ``wanted`` (c), from one document each."""
    needed = written(classes.join(wanted.distinct(), "c", "left_semi").select("rep"), "needed")
    hint = F.broadcast if needed.count() <= broadcast_rows else (lambda df: df)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(hint(needed), texts["id"].eqNullSafe(needed["rep"]), "left_semi")

    def shingled(batches):
        for batch in slices(batches):
            found = [s for s in map(metric.shingles, batch.column(1).to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["c", "s"])

    return written(texts.mapInArrow(shingled, "c long, s binary").dropDuplicates(["c"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, metric: Metric) -> DataFrame:
    """Of pairs (a, b) of classes those that are similar."""
    full = pairs.join(sets.withColumnsRenamed({"c": "a", "s": "sa"}), "a").join(sets.withColumnsRenamed({"c": "b", "s": "sb"}), "b")

    def compared(batches):
        for batch in slices(batches):
            keep = []
            for left, right in zip(batch["sa"].to_pylist(), batch["sb"].to_pylist(), strict=True):
                a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                at = np.searchsorted(a, b)
                common = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                keep.append(bool(metric.similar(common, len(a), len(b))))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(full.select("a", "b", "sa", "sb").mapInArrow(compared, "a long, b long"), "links")


def similar_components(docs: DataFrame, sets: DataFrame, metric: Metric, id_col: str, text_col: str, region_rows: int, region_shingles: int, broadcast_rows: int) -> DataFrame:
    """c, root of the classes that links connect with others (root: one class of the component)."""
    fetch = functools.partial(shingle_sets, docs=docs, metric=metric, id_col=id_col, text_col=text_col, broadcast_rows=broadcast_rows)
    known = sets.filter(F.col("c").isNotNull())
    classes = written(known.groupBy("c").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("id").alias("rep")), "classes")
    stars = written(pivots(known.select("keys", "c")), "stars")
    side = classes.select("c", "n", "sketch")
    regions = stars.join(side.withColumnRenamed("c", "x"), "x").join(side.withColumnsRenamed({"c": "p", "n": "pn", "sketch": "psketch"}), "p")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        return verified(pairs, fetch(pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))), classes=classes), metric)

    first = verify(near_pivot(regions, metric))
    release(docs.sparkSession)

    # The least pivot that a class is linked with, or that this one is linked with; a pivot is less than its region's members.
    hop = written(first.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("m")), "hop")
    hops = hop.join(hop.select(F.col("x").alias("m"), F.col("m").alias("_m")), "m", "left").select("x", F.coalesce("_m", "m").alias("_anchor"))
    # Regions whose members links with pivots, here or elsewhere, have not made one component that far.
    anchored = written(stars.join(hops, "x", "left").select("p", "x", F.coalesce("_anchor", "x").alias("anchor")), "anchored")
    unlike = written(anchored.groupBy("p").agg(F.min("anchor").alias("_a"), F.max("anchor").alias("_b")).filter("_a <> _b").select("p"), "unlike")
    members = anchored.join(unlike, "p", "left_semi").join(side.withColumnRenamed("c", "x"), "x").select(F.col("p").alias("r"), "x", "n", "sketch", F.lit(True).alias("home"), "anchor")
    members, links = voronoi(written(members, "members"), metric, verify, region_rows)
    members = written(members, "leaves")
    release(docs.sparkSession)

    grouped = in_blocks(members, region_rows, 16 * region_shingles).groupBy("r", "i", "j")
    still = written(grouped.applyInArrow(open_members(metric), "r long, x long").distinct(), "open")
    full = in_blocks(members.join(still, ["r", "x"]).join(fetch(still.select(F.col("x").alias("c")), classes=classes).withColumnRenamed("c", "x"), "x"), region_rows, region_shingles, "s")
    last = full.groupBy("r", "i", "j").applyInArrow(region_links(metric), "a long, b long").distinct()
    more = last if links is None else last.unionByName(links)
    return components(first.unionByName(more)).select(F.col("node").alias("c"), "root")


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text",
                       region_rows: int = 4096, region_shingles: int = 1_000_000, broadcast_rows: int = 500_000) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the least id reachable by links of similarity >= num/den),
    class_id, text_hash, and stays (true for the rows with the least id and hash of their components)."""
    ship(docs.sparkSession)
    metric = Metric(num, den, width)
    return outcome(lambda: _components_of(docs, metric, id_col, text_col, region_rows, region_shingles, broadcast_rows), docs.sparkSession, "jaccard")


def _components_of(docs: DataFrame, metric: Metric, id_col: str, text_col: str, region_rows: int, region_shingles: int, broadcast_rows: int) -> DataFrame:
    sets = written(doc_sets(docs, metric, id_col, text_col), "doc-sets")
    roots = similar_components(docs, sets, metric, id_col, text_col, region_rows, region_shingles, broadcast_rows).withColumnRenamed("c", "node")
    rows = sets.select("id", "n", "c", "th")
    with_words = written(rows.filter(F.col("c").isNotNull()).join(roots, F.col("c") == F.col("node"), "left").select(*rows.columns, F.coalesce("root", "c").alias("root")), "rooted")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th"))
    groups = with_words.groupBy("root").agg(F.min("id").alias("component_id"), first.alias("_first"), F.count(F.lit(1)).alias("_size"))
    stays = F.col("id").eqNullSafe(F.col("_first.id")) & (F.col("th") == F.col("_first.th"))
    named = join_hot(with_words, groups, "root", "_size", with_words.count()).withColumn("stays", stays)
    alone = rows.filter(F.col("c").isNull()).withColumn("component_id", F.col("id")).withColumn("stays", F.lit(True))
    out = [F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("c").alias("class_id"), F.col("th").alias("text_hash"), "stays"]
    return named.select(*out).unionByName(alone.select(*out))


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, and all without words. ``found``: of :func:`jaccard_components`."""
    gone = written(found.filter(~F.col("stays")).select("doc_id", "text_hash").distinct(), "gone")
    twice = written(found.filter(F.col("stays") & F.col("class_id").isNotNull()).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"), "twice")

    def of(rows: DataFrame):
        return docs[id_col].cast("long").eqNullSafe(rows["doc_id"]) & F.xxhash64(docs[text_col]).eqNullSafe(rows["text_hash"])

    def hinted(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("doc_id"), F.col("text_hash"))
        return F.broadcast(rows) if rows.count() <= broadcast_rows else rows

    if twice.isEmpty():
        rows = hinted(gone)
        return docs.join(rows, of(rows), "left_anti")
    rows, pairs = hinted(gone.unionByName(twice)), hinted(twice)
    return docs.join(rows, of(rows), "left_anti").unionByName(docs.join(pairs, of(pairs), "left_semi").dropDuplicates([id_col, text_col]))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, 3, 9, 10).select("doc_id", "n_shingles", "component_id")


ORACLE = {
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS k FROM s),
c AS (SELECT k FROM e GROUP BY k HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.k = b.k AND a.doc_id < b.doc_id WHERE a.k IN (SELECT k FROM c) GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
twice AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, twice.b FROM r JOIN twice ON twice.a = r.seen)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_shingles, m.component_id
FROM n JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""
}
