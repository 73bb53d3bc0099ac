import datetime as dt
from decimal import Decimal

import pyarrow as pa
import pyarrow.ipc as ipc
import pytest
from pyspark.sql import functions as F

from helioquery.functions import conversions as V
from helioquery.sources import arrow_ipc
from helioquery.sources.arrow_types import readable_type


def test_all_readable_types_reach_spark(spark, tmp_path):
    t = pa.table({
        "u1": pa.array([255, None], pa.uint8()), "u2": pa.array([65535, 0], pa.uint16()), "u4": pa.array([2**32 - 1, 0], pa.uint32()), "u8": pa.array([2**64 - 1, None], pa.uint64()),
        "i1": pa.array([-1, 1], pa.int8()), "f2": pa.array([0.5, None], pa.float16()), "b": pa.array([True, None]), "n": pa.nulls(2),
        "d64": pa.array([dt.date(2020, 1, 2), None], pa.date64()), "d32": pa.array([dt.date(1969, 12, 31), None], pa.date32()),
        "ts": pa.array([1_500, None], pa.timestamp("ms")), "tn": pa.array([1_999, None], pa.timestamp("ns")), "t32": pa.array([2, None], pa.time32("s")), "t64": pa.array([2500, None], pa.time64("ns")),
        "dec": pa.array([Decimal("1.25"), None], pa.decimal256(30, 2)), "fix": pa.array([b"ab", b"cd"], pa.binary(2)), "ls": pa.array(["x", None], pa.large_string()),
        "dic": pa.array(["p", "q"]).dictionary_encode(), "li": pa.array([[1, 2], None], pa.list_(pa.uint8())), "fl": pa.array([[1, 2], [3, 4]], pa.list_(pa.int32(), 2)),
        "st": pa.array([{"a": 1, "b": "z"}, None], pa.struct([("a", pa.uint32()), ("b", pa.string())])), "m": pa.array([[("k", 1)], None], pa.map_(pa.string(), pa.int32())),
    })
    with ipc.new_file(str(tmp_path / "t.arrow"), t.schema) as w:
        w.write_table(t)
    row = arrow_ipc.read(spark, str(tmp_path / "t.arrow")).first().asDict(recursive=True)
    assert row == {
        "u1": 255, "u2": 65535, "u4": 2**32 - 1, "u8": Decimal(2**64 - 1), "i1": -1, "f2": 0.5, "b": True, "n": None, "d64": dt.datetime(2020, 1, 2), "d32": dt.date(1969, 12, 31),
        "ts": dt.datetime(1970, 1, 1, 0, 0, 1, 500_000), "tn": dt.datetime(1970, 1, 1, 0, 0, 0, 1), "t32": 2_000_000, "t64": 2, "dec": Decimal("1.25"), "fix": b"ab", "ls": "x", "dic": "p",
        "li": [1, 2], "fl": [1, 2], "st": {"a": 1, "b": "z"}, "m": {"k": 1},
    }


@pytest.mark.parametrize("t", [pa.dense_union([pa.field("a", pa.int32())]), pa.month_day_nano_interval(), pa.decimal256(50, 2)])
def test_types_without_a_spark_type(t):
    with pytest.raises(TypeError):
        readable_type(t)


def test_conversions(spark):
    df = spark.createDataFrame([(dt.date(1969, 12, 31), -1, 1_500, -12345), (dt.date(2024, 2, 29), 19782, -1, 5)], "d date, days int, ms long, u long")
    got = df.select(V.days_of(F.col("d")), V.date_of(F.col("days")), V.millis_of(V.time_of(F.col("ms"))), V.decimal_of(F.col("u"), 10, 3), V.unscaled_of(V.decimal_of(F.col("u"), 10, 3), 3), V.decimal_of(F.col("u"), 10, 0)).collect()
    assert [tuple(r) for r in got] == [(-1, dt.date(1969, 12, 31), 1500, Decimal("-12.345"), -12345, Decimal(-12345)), (19782, dt.date(2024, 2, 29), -1, Decimal("0.005"), 5, Decimal(5))]
    with pytest.raises(ValueError):
        V.decimal_of(F.col("u"), 2, 3)
