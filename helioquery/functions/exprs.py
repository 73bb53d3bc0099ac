"""Column expressions of the query surface, with SQL NULL semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"DAY": "days", "WEEK": "weeks", "MONTH": "months", "YEAR": "years"}


def all_of(conditions: list[Column]) -> Column:
    """The conjunction; of none: true."""
    out = F.lit(True)
    for i, c in enumerate(conditions):
        out = c if i == 0 else out & c
    return out


def between(col: Column, low, high, closed: bool = True) -> Column:
    """low <= col <= high, or low <= col < high."""
    return (col >= low) & ((col <= high) if closed else (col < high))


def contains(col: Column, needle: str) -> Column:
    """LIKE '%needle%', with no wildcard in the needle."""
    return col.contains(needle)


def date_shift(day: Column | str, count: int, unit: str) -> Column:
    """A date moved by ``count`` DAY, WEEK, MONTH or YEAR; short months end at their last day. Constants fold."""
    if unit.upper() not in UNITS:
        raise ValueError(f"no such unit: {unit}")
    start = F.lit(day).cast("date") if isinstance(day, str) else day
    return (start + F.make_interval(**{UNITS[unit.upper()]: F.lit(count)})).cast("date")


def divide(a: Column, b: Column) -> Column:
    """a / b as a double; NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def case_eq(a: Column, b: Column, then: Column, otherwise: Column) -> Column:
    return F.when(a == b, then).otherwise(otherwise)


def sum0(col: Column) -> Column:
    """SUM that is 0 over no rows."""
    return F.coalesce(F.sum(col), F.lit(0))


def sum_or_null(col: Column) -> Column:
    """SUM written as count and sum of its own: NULL over no rows."""
    return F.when(F.count(F.lit(1)) == 0, None).otherwise(sum0(col))


def average(col: Column) -> Column:
    """SUM / COUNT of the values that are there."""
    return divide(F.sum(col), F.count(col))
