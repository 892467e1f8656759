"""Windows over the rows of a series in date order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "series_id"


def by_date(*extra: str):
    return Window.partitionBy(KEY, *extra).orderBy("date")


def so_far(*extra: str):
    return by_date(*extra).rowsBetween(Window.unboundedPreceding, 0)


def trailing(rows: int, *extra: str):
    """The current row and the ``rows - 1`` before it."""
    return by_date(*extra).rowsBetween(-(rows - 1), 0)


def full(c: Column, rows: int, value: Column) -> Column:
    """``value`` where the trailing frame has ``rows`` values of ``c``, else NULL."""
    return F.when(F.count(c).over(trailing(rows)) == rows, value)


def with_position(df: DataFrame, name: str = "pos") -> DataFrame:
    """Position of each row in its series, from 0."""
    return df.withColumn(name, F.row_number().over(by_date()) - 1)
