"""Connected components by alternating large and small stars, all in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import written


def _marked(edges: DataFrame, tag: str) -> tuple[DataFrame, tuple]:
    """The edges, written, with their number and the sum of their hashes, which writing counts."""
    seen = Observation()
    out = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")), tag)
    return out, (seen.get["n"], seen.get["h"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("_m", "u").alias("_m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("_m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("_m"))
    moved = down.join(least, "u").filter("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("_m", "v")).filter("u <> v").distinct()


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """node, root (the least node of the component) of every node that has a link; ``links``: two columns of longs."""
    a, b = links.columns
    edges, now = _marked(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), tag)
    mark = None
    while mark != now:
        mark = now
        edges, now = _marked(_small_star(_large_star(edges)), tag)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
