"""Mixing sources to target weights along a low-discrepancy schedule.

Sources sorted by code point (null last) have weights that repeat; they share ``share`` of all sizes, and no target
exceeds ``cap`` times its source: what is above is reshared by weight, which ends at ``min(cap * size, weight * level)``
with one level for all, found by sorting sources by their ratio of cap to weight.

Each source's documents, shuffled by a hash of their ids and sizes, form a stream that may run ``cap`` times and is cut into
blocks of equal numbers of words (the last one ends at the whole part of the target). As many slots as blocks fit into all
targets are Weyl points ``slot * golden mod 2**32``; the cumulative targets map a point to a source, and the slot's rank among
its source's slots is the block that it takes. A source gives the blocks that its slots name, no others: what it gives falls
short of its target by the discrepancy of the points, a block or two, whatever its size. Sources whose target is a few
blocks want a smaller ``block``.

Hot sources: positions in a stream and ranks of slots come from sums per (source, bucket) and a window within a
bucket, so no task holds a source. A document is cut at block bounds, never copied whole.

Null texts have size 0 and are never taken; null sources form one source, sorted last; rows with equal ids and sizes are separate
documents of the mix, of which any may come first; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import outcome, written

_GOLDEN = 2654435769  # 2**32 over the golden ratio, odd
_RANGE = 2**32
_HALF = 2**16


def _div(x: Column, by: Column | int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("long") if isinstance(by, int) else by)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """source, source_size, n_docs, weight, target from (source, size) rows."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # One row per source from here on.
    at = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    w = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (at % len(weights) + 1).cast("int")))
    w = w.withColumn("_all", F.sum("source_size").over(Window.partitionBy()) * F.lit(share)).withColumn("_cap", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # The level if all sources before this one are at their cap and none from here on is.
    w = w.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    fits = F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level"))
    w = w.withColumn("_level", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level"), F.lit(float("inf"))) * F.col("weight"))
    return w.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def _running(df: DataFrame, key: str, bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its key before it, by (bucket, order)."""
    sums = df.groupBy(key, bucket).agg(F.sum(value).alias("_s"))
    base = sums.withColumn("_base", F.coalesce(F.sum("_s").over(Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    within = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(base, [key, bucket]).withColumn(name, (F.col("_base") + F.col("_in")).cast("long")).drop("_base", "_in")


def weyl(slot: Column, multiplier: int = _GOLDEN) -> Column:
    """``slot * multiplier mod 2**32``, by halves of the slot so that no product overflows."""
    low, high = slot % F.lit(_HALF).cast("long"), _div(slot, _HALF) % F.lit(_HALF).cast("long")
    by = F.lit(multiplier).cast("long")
    return (low * by + (high * by) % F.lit(_HALF).cast("long") * F.lit(_HALF).cast("long")) % F.lit(_RANGE).cast("long")


def stream_mark(seed: int) -> Column:
    """What orders a source's stream, by seed, id and size, so that null and equal ids spread too."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("size").cast("string")))


def mix_sources(docs: DataFrame, block: int = 64, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: int = 0,
                bucket_rows: int = 4_000, multiplier: int = _GOLDEN) -> tuple[DataFrame, DataFrame]:
    """(mix, documents). mix: slot, source_no, block, doc_id, row, start, end, with words start .. end of the document taken
    in this slot. documents: row, doc_id, source, size, source_size, target. ``docs``: doc_id, source, size."""
    spark = docs.sparkSession
    rows = written(docs.select("doc_id", "source", F.col("size").cast("long").alias("size"), stream_mark(seed).alias("_mark")).withColumn("row", F.monotonically_increasing_id()), "sizes")
    per = written(targets(rows, weights, share, cap).withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).cast("long")), "targets")
    n_docs, total, n_sources = per.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0.0)), F.count(F.lit(1))).first()
    rows = rows.join(per.select("source", "source_no", "source_size", "target"), rows["source"].eqNullSafe(per["source"])).drop(per["source"])
    known = rows.select("row", "doc_id", "source", "size", "source_size", "target")

    # The schedule: points through cumulative weights by cells, ranks per source by chunks.
    slots = max(1, -(-int(total) // block))
    cells = max(4096, 2 * n_sources)
    upto = F.sum("target").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.lit(total or 1.0)
    bounds = per.withColumn("_hi", F.round(upto * F.lit(_RANGE)).cast("long")).withColumn("_lo", F.coalesce(F.lag("_hi").over(Window.orderBy("source_no")), F.lit(0)).cast("long"))
    cell = lambda x: _div(x * F.lit(cells).cast("long"), _RANGE)
    bounds = bounds.filter("_lo < _hi").withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi") - 1)))).select("_cell", "_lo", "_hi", "source_no")
    points = spark.range(slots).withColumn("_u", weyl(F.col("id"), multiplier)).withColumn("_cell", cell(F.col("_u")))
    given = points.join(bounds, "_cell").filter("_lo <= _u and _u < _hi").select(F.col("id").alias("slot"), "source_no", _div(F.col("id"), 65536).alias("_chunk"))
    ranked = written(_running(given, "source_no", "_chunk", ["slot"], F.lit(1), "block").select("slot", "source_no", "block"), "slots")
    ends = ranked.groupBy("source_no").agg((F.count(F.lit(1)) * block).alias("_end"))  # one row per source

    # The streams: documents by mark, cut at block bounds, as far as the source's slots reach.
    buckets = max(1, -(-n_docs // bucket_rows))
    first = F.conv(F.substring("_mark", 1, 8), 16, 10).cast("long")
    streams = _running(rows.withColumn("_bucket", _div(first * F.lit(buckets).cast("long"), _RANGE)), "source_no", "_bucket", ["_mark", "doc_id", "size", "row"], F.col("size"), "_at")
    passes = streams.join(ends, "source_no").withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))).withColumn("_from", F.col("_at") + F.col("_pass") * F.col("source_size"))
    passes = passes.withColumn("_to", F.least(F.col("_from") + F.col("size"), "_end", F.floor("target").cast("long"))).filter(F.col("_from") < F.col("_to"))
    pieces = passes.withColumn("block", F.explode(F.sequence(_div(F.col("_from"), block), _div(F.col("_to") - 1, block))))
    low, high = F.greatest(F.col("_from"), F.col("block") * block), F.least(F.col("_to"), (F.col("block") + 1) * block)
    pieces = pieces.select("source_no", "block", "doc_id", "row", (low - F.col("_from")).alias("start"), (high - F.col("_from")).alias("end"))
    mix = pieces.join(ranked, ["source_no", "block"])  # a block without a slot is not taken
    return mix.select("slot", "source_no", "block", "doc_id", "row", "start", "end"), known


def words_size(text_col: str = "text") -> Column:
    """Number of runs of characters other than 20 and 09-0D; null: 0."""
    spaces = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[^\\x20\\x09-\\x0D]+", "x")
    return F.length(F.regexp_replace(spaces, "[\\x20\\x09-\\x0D]+", "")).cast("long")


def mixed_counts(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, size): row, doc_id, size, source_size, target, taken, and slot: the first that takes words of it, null if none does."""

    def counted() -> DataFrame:
        mix, known = mix_sources(docs, **options)
        counts = mix.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("taken"), F.min("slot").alias("slot"))
        return known.join(counts, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))

    return outcome(counted, docs.sparkSession, "mixed")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mixed_counts(docs.select("doc_id", "source", words_size().alias("size")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = {
    "op8_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
m AS (SELECT *, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || CAST(size AS VARCHAR)) AS mark FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
             ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)] AS weight,
             1.5::DOUBLE * sum(source_size) OVER () AS everything FROM s0),
l AS (SELECT *, (everything - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
lv AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT level FROM lv), 1e300)) AS target FROM s),
n AS (SELECT *, CAST(round(sum(target) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(target) OVER () * 4294967296) AS BIGINT) AS hi FROM t),
b AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY source NULLS LAST), 0) AS lo FROM n),
u AS (SELECT (slot * 2654435769) % 4294967296 AS u
      FROM (SELECT unnest(range(greatest(1, CAST(ceil(floor((SELECT sum(target) FROM t)) / 64) AS BIGINT)))) AS slot)),
k AS (SELECT source, source_size, target, least((SELECT count(*) FROM u WHERE u.u >= b.lo AND u.u < b.hi) * 64, CAST(floor(target) AS BIGINT)) AS cut FROM b),
p AS (SELECT doc_id, size, source_size, target, cut,
             coalesce(sum(size) OVER (PARTITION BY m.source ORDER BY mark, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at
      FROM m JOIN k ON m.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, cut - start_at)) + greatest(0, least(size, cut - start_at - source_size)) AS BIGINT) AS taken
FROM p
"""
}
