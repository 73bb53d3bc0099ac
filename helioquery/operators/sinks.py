"""Ends of a query: text, iteration, and running for its cost alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_rows(df: DataFrame, separator: str = ", ") -> DataFrame:
    """One string per row: values joined, doubles with two decimals, dates as yyyy-MM-dd, NULL as ``null``."""
    shown = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.format_string("%.2f", c.cast("double"))
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        shown.append(F.when(F.col(f"`{f.name}`").isNull(), F.lit("null")).otherwise(c.cast("string")))
    return df.select(F.concat_ws(separator, *shown).alias("line"))


def to_text(df: DataFrame) -> Iterator[str]:
    """The lines of :func:`text_rows`, one partition on the driver at a time."""
    return (r["line"] for r in text_rows(df).toLocalIterator())


def consume(df: DataFrame, take: Callable[[Row], None]) -> int:
    """Give every row to ``take`` on the driver, one partition at a time; the number of rows."""
    n = 0
    for row in df.toLocalIterator():
        take(row)
        n += 1
    return n


def discard(df: DataFrame) -> None:
    """Compute every column of every row and keep nothing."""
    df.write.format("noop").mode("overwrite").save()
