import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helioquery.functions import exprs as X
from helioquery.operators import columnar as C
from helioquery.operators import relational as R
from helioquery.operators import sinks as S


def one(df):
    return df.first()[0]


def test_empty_input(spark):
    df = spark.createDataFrame([], "i int, d double")
    row = R.aggregate(df, [], n=F.count(F.lit(1)), s=F.sum("d"), z=X.sum0(F.col("i")), a=X.average(F.col("d")), own=X.sum_or_null(F.col("d"))).first()
    assert row.asDict() == {"n": 0, "s": None, "z": 0, "a": None, "own": None}
    assert R.aggregate(df, ["i"], n=F.count(F.lit(1))).count() == 0


def test_null_keys_group_together_and_never_join(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None), (1, 2.0)], "k int, d double")
    got = {r["k"]: (r["n"], r["s"]) for r in R.aggregate(df, ["k"], n=F.count(F.lit(1)), s=F.sum("d")).collect()}
    assert got == {None: (2, 1.0), 1: (1, 2.0)}
    assert R.inner_join(df, df.withColumnRenamed("d", "e"), "k", "k").count() == 1


def test_negative_keys_dates_and_wide_match(spark):
    df = spark.createDataFrame([(-2, dt.date(1960, 2, 29)), (-2, dt.date(1960, 2, 29)), (0, dt.date(1970, 1, 1))], "k int, day date")
    assert R.aggregate(df, ["day"], n=F.count(F.lit(1))).count() == 2
    many = spark.range(20_000).select(F.lit(-2).alias("k2"))
    assert R.inner_join(many, df, "k2", "k", build="left").count() == 40_000


def test_duplicate_keys_multiply(spark):
    a, b = spark.createDataFrame([(1,)] * 3, "k int"), spark.createDataFrame([(1,)] * 2, "j int")
    assert R.inner_join(a, b, "k", "j").count() == 6


def test_int_sum_widens(spark):
    df = spark.createDataFrame([(2**31 - 1,)] * 3, "i int")
    assert one(R.aggregate(df, [], s=F.sum("i"))) == 3 * (2**31 - 1)


def test_divide_by_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0), (3, 2)], "n int, z int")
    assert [r[0] for r in df.select(X.divide(F.col("n"), F.col("z"))).collect()] == [None, 1.5]


def test_nan_groups_together(spark):
    df = spark.createDataFrame([(math.nan,), (math.nan,), (1.0,)], "d double")
    assert R.aggregate(df, ["d"], n=F.count(F.lit(1))).count() == 2


def test_not_equal_is_not_less(spark):
    df = spark.createDataFrame([(1, 2), (2, 2), (3, 2)], "a int, b int")
    assert df.filter(F.col("a") != F.col("b")).count() == 2


def test_strings_compare_by_value(spark):
    df = spark.createDataFrame([("é,(;)", "é,(;)"), ("x" * 500, "x" * 500), ("a", "b")], "a string, b string")
    assert df.filter(F.col("a") == F.col("b")).count() == 2
    assert df.filter(X.contains(F.col("a"), ",(")).count() == 1


@pytest.mark.parametrize(("start", "n", "unit", "want"), [
    ("1996-02-29", 1, "YEAR", "1997-02-28"), ("1996-01-31", 1, "MONTH", "1996-02-29"), ("1996-03-01", -1, "DAY", "1996-02-29"),
    ("1969-12-25", 1, "WEEK", "1970-01-01"), ("1970-01-01", -1, "MONTH", "1969-12-01")])
def test_date_shift(spark, start, n, unit, want):
    assert str(one(spark.range(1).select(X.date_shift(start, n, unit)))) == want


def test_date_shift_unknown_unit():
    with pytest.raises(ValueError, match="unit"):
        X.date_shift("1996-01-01", 1, "CENTURY")


def test_between_open_and_closed(spark):
    df = spark.range(5)
    assert df.filter(X.between(F.col("id"), 1, 3)).count() == 3
    assert df.filter(X.between(F.col("id"), 1, 3, closed=False)).count() == 2


def test_text_and_sinks(spark):
    df = spark.createDataFrame([(1, 2.345, dt.date(2020, 1, 2), None)], "a int, b double, c date, d string")
    assert list(S.to_text(df)) == ["1, 2.35, 2020-01-02, null"] or list(S.to_text(df)) == ["1, 2.34, 2020-01-02, null"]
    seen = []
    assert S.consume(df, seen.append) == 1 and seen[0]["a"] == 1
    S.discard(df)
    assert one(R.result_count(df)) == 1


def test_dictionary_round_trip(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b"), (5, "äé")], "id int, s string")
    codes = C.dictionary(df, "s")
    assert {r["value"]: r["code"] for r in codes.collect()} == {"a": 0, "b": 1, "äé": 2}
    coded = C.dictionary_encode(df, "s", codes)
    assert {r["id"]: r["s"] for r in coded.collect()} == {1: 1, 2: None, 3: 0, 4: 1, 5: 2}
    assert C.equal(C.dictionary_decode(coded, "s", codes), df)
    numbers = C.dictionary(spark.createDataFrame([(5,), (3,), (5,)], "x int"), "x")
    assert {r["value"]: r["code"] for r in numbers.collect()} == {3: 0, 5: 1}
    assert [type(C.index_type(n)) for n in (128, 129, 2**15 + 1, 2**31 + 1)] == [T.ByteType, T.ShortType, T.IntegerType, T.LongType]


def test_nested_encoding(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None)], "id int, xs array<string>")
    codes = spark.createDataFrame([("a", 0), ("b", 1)], "value string, code long")
    assert {r["id"]: r["xs"] for r in C.encode_elements(df, "xs", codes, ["id"]).collect()} == {1: [1, 0, 1], 2: [], 3: None}
    st = spark.createDataFrame([(1, ("a", 2))], "id int, s struct<u:string,v:int>")
    assert C.encode_field(st, "s", "u", codes).first()["s"].asDict() == {"u": 0, "v": 2}


def test_columns_slices_append_and_compare(spark):
    df = C.from_columns(spark, {"a": [3, 1, 2], "b": ["x", "y", "z"]})
    with pytest.raises(ValueError, match="length"):
        C.from_columns(spark, {"a": [1], "b": []})
    assert C.add_column(df, "c", F.lit(1)).columns == ["a", "b", "c"] and C.remove_column(df, "b").columns == ["a"]
    with pytest.raises(ValueError):
        C.add_column(df, "a", F.lit(1))
    with pytest.raises(ValueError):
        C.remove_column(df, "zz")
    assert [r["a"] for r in C.slice_rows(df, ["a"], 1, 1).collect()] == [2]
    assert [r["a"] for r in C.slice_rows(df, ["a"], 1).collect()] == [2, 3]
    assert C.append(df, df).count() == 6
    with pytest.raises(Exception):
        C.append(df, df.drop("b"))
    assert C.same_rows(df, df).count() == 0 and C.same_types(df, df)
    a, b = spark.createDataFrame([(1.0,)], "d double"), spark.createDataFrame([(1.0 + 5e-7,)], "d double")
    assert C.approx_equal(a, b) and not C.equal(a, b)


def test_arrow_schema_hash_and_samples(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert C.equal(C.from_arrow(spark, C.to_arrow(df)), df)
    assert C.schema_from_json(C.schema_to_json(df)) == df.schema
    assert C.hashed(df, ["a"]).select("hash").first()[0] == df.select(F.hash("a")).first()[0]
    assert one(C.to_tsv(df)) == "1\tx"
    made = C.sample_data(spark, T.StructType([T.StructField("i", T.IntegerType()), T.StructField("s", T.StringType()), T.StructField("d", T.DoubleType()), T.StructField("b", T.BooleanType(), False)]), 30)
    assert made.count() == 30 and made.filter("i is null").count() == 3 and made.filter("b is null").count() == 0
