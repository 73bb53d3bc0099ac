"""Which Arrow types become which, so that Spark can hold them.

Unsigned integers widen to the next signed one, 64-bit ones to decimal(20, 0); half floats to floats; date64 and all
timestamps to microseconds (finer parts are cut off); times to microseconds since midnight as bigint; durations to
microseconds; 256-bit decimals of up to 38 digits to 128 bits; dictionaries to their values, also inside lists, structs
and maps. Unions, mixed intervals, wider decimals and extension types have no Spark type and are refused.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.types as pt


def readable_type(t: pa.DataType) -> pa.DataType:
    """The type in which a column of type ``t`` is handed to Spark."""
    if pt.is_dictionary(t):
        return readable_type(t.value_type)
    if pt.is_uint64(t):
        return pa.decimal128(20, 0)
    if pt.is_unsigned_integer(t):
        return {8: pa.int16(), 16: pa.int32(), 32: pa.int64()}[t.bit_width]
    if pt.is_float16(t):
        return pa.float32()
    if pt.is_date64(t):
        return pa.timestamp("us")
    if pt.is_timestamp(t):
        return pa.timestamp("us", t.tz)
    if pt.is_time(t):
        return pa.int64()
    if pt.is_duration(t):
        return pa.duration("us")
    if pt.is_decimal256(t) and t.precision <= 38:
        return pa.decimal128(t.precision, t.scale)
    if pt.is_fixed_size_binary(t):
        return pa.binary()
    if pt.is_map(t):
        return pa.map_(readable_type(t.key_type), readable_type(t.item_type))
    if pt.is_list(t) or pt.is_large_list(t) or pt.is_fixed_size_list(t):
        return pa.list_(readable_type(t.value_type))
    if pt.is_struct(t):
        return pa.struct([pa.field(f.name, readable_type(f.type), f.nullable) for f in t])
    if pt.is_union(t) or pt.is_interval(t) or pt.is_decimal256(t) or isinstance(t, pa.BaseExtensionType):
        raise TypeError(f"Spark has no type for {t}")
    return t


def readable_schema(schema: pa.Schema) -> pa.Schema:
    return pa.schema([pa.field(f.name, readable_type(f.type), f.nullable) for f in schema])


def _readable(a: pa.Array, want: pa.DataType) -> pa.Array:
    if a.type == want:
        return a
    if pt.is_dictionary(a.type):
        return _readable(a.dictionary_decode(), want)
    if pt.is_time(a.type):
        unit = a.type.unit
        per = {"s": 1_000_000, "ms": 1000, "us": 1, "ns": 1}[unit]
        whole = pc.cast(pc.cast(a, pa.int32()) if pt.is_time32(a.type) else a, pa.int64())
        return pc.divide(whole, 1000) if unit == "ns" else pc.multiply(whole, per)
    return pc.cast(a, want, safe=False)


def readable_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch in types that Spark can hold."""
    schema = readable_schema(batch.schema)
    return pa.RecordBatch.from_arrays([_readable(c, f.type) for c, f in zip(batch.columns, schema, strict=True)], schema=schema)
