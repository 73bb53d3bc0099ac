"""Conversions between dates, times, decimals and the numbers that stand for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_of(date: Column) -> Column:
    """Days since 1970-01-01."""
    return F.datediff(date, F.lit("1970-01-01").cast("date"))


def date_of(days: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))


def millis_of(time: Column) -> Column:
    """Milliseconds since 1970-01-01 00:00 of a timestamp."""
    return F.unix_millis(time)


def time_of(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def decimal_of(unscaled: Column, precision: int, scale: int) -> Column:
    """unscaled / 10**scale of a bigint as an exact decimal; at most 18 digits after the point."""
    if not 0 <= scale <= min(precision, 18) or precision > 38:
        raise ValueError(f"no decimal({precision}, {scale})")
    shown = F.lpad(F.abs(unscaled).cast("string"), 19, "0")  # digits are moved as text, so nothing is rounded
    digits = F.concat(F.when(unscaled < 0, "-").otherwise(""), F.substring(shown, 1, 19 - scale), F.lit("."), F.substring(shown, 20 - scale, scale) if scale else F.lit("0"))
    return digits.cast(f"decimal({precision}, {scale})")


def unscaled_of(value: Column, scale: int) -> Column:
    """The whole number behind a decimal of a scale."""
    return (value * F.lit(10**scale).cast("decimal(19, 0)")).cast("decimal(38, 0)").cast("long")
