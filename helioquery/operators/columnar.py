"""Columnar helpers: dictionaries, slices, appending, comparing, building and hashing tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.testing import assertDataFrameEqual, assertSchemaEqual


def from_columns(spark: SparkSession, columns: dict[str, list], schema: T.StructType | str | None = None) -> DataFrame:
    """A DataFrame from equally long columns."""
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("columns differ in length")
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema or list(columns))


def add_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"there is a column {name}")
    return df.withColumn(name, value)


def remove_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise ValueError(f"there is no column {name}")
    return df.drop(name)


def slice_rows(df: DataFrame, order: list[str], offset: int, length: int | None = None) -> DataFrame:
    """Rows ``offset`` to ``offset + length`` in the order of columns that identify a row."""
    out = df.orderBy(*order).offset(offset)
    return out if length is None else out.limit(length)


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """value, code: distinct values but NULL, numbered from 0 in their order.

    Strings are numbered by ranges of their first bytes, moved by the counts of the ranges before, so no task sees them
    all; other types, whose dictionaries are short if they are worth having, are numbered in one task.
    """
    values = df.select(F.col(column).alias("value")).filter("value is not null").distinct()
    ranged = values.withColumn("_bucket", F.substring(F.hex(F.col("value").cast("string")), 1, 4)) if dict(df.dtypes)[column] == "string" else None
    if ranged is None:
        return values.select("value", (F.row_number().over(Window.orderBy("value")) - 1).cast("long").alias("code"))
    counts = ranged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))  # at most 65,536 rows
    before = counts.select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("value")) - 1
    return ranged.withColumn("_in", inside).join(before, "_bucket").select("value", (F.col("_in") + F.col("_before")).cast("long").alias("code"))


def index_type(size: int) -> T.IntegralType:
    """The narrowest integer for codes 0 .. size-1."""
    for bits, kind in ((7, T.ByteType()), (15, T.ShortType()), (31, T.IntegerType())):
        if size <= 1 << bits:
            return kind
    return T.LongType()


def dictionary_encode(df: DataFrame, column: str, codes: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """``df`` with the column replaced by its code (or the code under another name); NULL stays NULL."""
    codes = (dictionary(df, column) if codes is None else codes).withColumnsRenamed({"value": "_value", "code": "_code"})
    joined = df.join(codes, df[column] == codes["_value"], "left").drop("_value")
    return joined.withColumn(name or column, F.col("_code")).drop("_code")


def dictionary_decode(df: DataFrame, column: str, codes: DataFrame, name: str | None = None) -> DataFrame:
    """``df`` with codes replaced by their values; codes that the dictionary lacks give an error, NULL stays NULL."""
    codes = codes.withColumnsRenamed({"value": "_value", "code": "_code"})
    joined = df.join(codes, df[column] == codes["_code"], "left")
    known = F.when(F.col(column).isNotNull() & F.col("_code").isNull(), F.raise_error(F.lit("code without a value")).cast("string")).otherwise(F.col("_value"))
    return joined.withColumn(name or column, known).drop("_value", "_code")


def encode_elements(df: DataFrame, column: str, codes: DataFrame, key: list[str]) -> DataFrame:
    """Codes of the elements of an array column, in place; ``key`` identifies a row."""
    each = df.select(*key, F.posexplode(column).alias("_at", "_item"))
    coded = dictionary_encode(each, "_item", codes).groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_item"))), lambda s: s["_item"]).alias("_codes"))
    return df.join(coded, key, "left").withColumn(column, F.when(F.size(column) == 0, F.array().cast("array<bigint>")).otherwise(F.col("_codes"))).drop("_codes")


def encode_field(df: DataFrame, column: str, field: str, codes: DataFrame) -> DataFrame:
    """A struct column with one field replaced by its code."""
    out = dictionary_encode(df.withColumn("_field", F.col(column)[field]), "_field", codes)
    return out.withColumn(column, F.col(column).withField(field, F.col("_field"))).drop("_field")


def append(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """All rows of all, duplicates too; names and types have to agree."""
    for df in rest:
        assertSchemaEqual(df.schema, first.schema, ignoreNullable=True, ignoreColumnOrder=True)
        first = first.unionByName(df)
    return first


def equal(a: DataFrame, b: DataFrame, tolerance: float = 0.0) -> bool:
    """Same schema and rows in any order; numbers within ``tolerance``. For results that fit the driver."""
    try:
        assertDataFrameEqual(a, b, rtol=0, atol=tolerance)
    except AssertionError:
        return False
    return True


def approx_equal(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> bool:
    return equal(a, b, tolerance)


def same_rows(a: DataFrame, b: DataFrame) -> Column | DataFrame:
    """Rows in one but not the other, counted with duplicates, without a driver: empty where both are equal."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def same_types(a: DataFrame, b: DataFrame) -> bool:
    return [f.dataType for f in a.schema.fields] == [f.dataType for f in b.schema.fields]


def hashed(df: DataFrame, columns: list[str], murmur: bool = True) -> DataFrame:
    return df.select("*", (F.hash(*columns) if murmur else F.xxhash64(*columns)).alias("hash"))


def to_arrow(df: DataFrame) -> pa.Table:
    """For results that fit the driver."""
    return df.toArrow()


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)


def schema_to_json(df: DataFrame) -> str:
    return df.schema.json()


def schema_from_json(text: str) -> T.StructType:
    import json

    return T.StructType.fromJson(json.loads(text))


def to_tsv(df: DataFrame) -> DataFrame:
    """One tab-separated line per row."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in df.columns]).alias("line"))


def sample_data(spark: SparkSession, schema: T.StructType, rows: int) -> DataFrame:
    """Rows made of their numbers: integers count, doubles halve, strings spell, booleans alternate; every tenth value is NULL."""
    made = {
        T.BooleanType: lambda i: i % 2 == 0, T.StringType: lambda i: F.concat(F.lit("s"), i.cast("string")), T.DateType: lambda i: F.date_add(F.lit("1970-01-01").cast("date"), (i % 20000).cast("int")),
        T.BinaryType: lambda i: i.cast("string").cast("binary"), T.TimestampNTZType: lambda i: F.timestamp_seconds(i).cast("timestamp_ntz"), T.TimestampType: lambda i: F.timestamp_seconds(i),
    }
    out = []
    for k, f in enumerate(schema.fields):
        i = F.col("id")
        value = made[type(f.dataType)](i) if type(f.dataType) in made else ((i % 100) / 2 if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)) else i % 100).cast(f.dataType)
        out.append((F.when(i % 10 != k % 10, value) if f.nullable else value).alias(f.name))
    return spark.range(rows).select(*out)
