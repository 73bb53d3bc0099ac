"""Scan, filter, project, aggregate, join and count, as thin functions over DataFrames.

They only build logical plans: pruning, pushdown, join order and strategy are Catalyst's and AQE's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import all_of
from ..sources.catalog import read_table


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    return read_table(spark, path, columns)


def filter_all(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which every condition is true."""
    return df.filter(all_of(list(conditions)))


def project(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in columns.items()])


def aggregate(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Grouped, or with no keys global, aggregation; with keys alone the distinct keys."""
    named = [c.alias(n) for n, c in aggregates.items()]
    if not named:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*named) if keys else df.agg(*named)


def inner_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, build: str | None = None) -> DataFrame:
    """Inner equi-join. ``build="left"`` asks for a hash join built on the left side, shuffled unless AQE finds it small."""
    if build == "left":
        left = left.hint("shuffle_hash")
    return left.join(right, on=left_key) if left_key == right_key else left.join(right, left[left_key] == right[right_key])


def result_count(df: DataFrame) -> DataFrame:
    """The number of rows as a one-row DataFrame, lazily."""
    return df.agg(F.count(F.lit(1)).alias("result_count"))
