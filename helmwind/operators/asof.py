"""Backward as-of join of a slower table, column by column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helmwind.operators.frames import KEY


def asof_join(data: DataFrame, extra: DataFrame, columns: list[str], key: str | None = KEY) -> DataFrame:
    """Each row of ``data`` gets, per column, the latest value of ``extra`` on or before its date that is not null.

    Both sides go through one sort by date: extra rows come first on a tie and fill
    forward. With ``key=None`` all series read the same extra table, which is small
    beside the panel (a row per date), so it joins the dates of the panel once.
    """
    if key is None:
        days = data.select("date").distinct().withColumn(KEY, F.lit(0))
        filled = asof_join(days, extra.withColumn(KEY, F.lit(0)), columns).drop(KEY)
        return data.join(filled, "date", "left")
    rest = [c for c in data.columns if c not in (key, "date")]
    left = data.select(key, "date", F.lit(1).alias("__data"), F.struct(*rest).alias("__row"), *[F.lit(None).cast("double").alias(c) for c in columns])
    right = extra.select(key, "date", F.lit(0).alias("__data"), F.lit(None).alias("__row"), *columns)
    order = Window.partitionBy(key).orderBy("date", "__data").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right.withColumn("__row", F.lit(None).cast(left.schema["__row"].dataType)))
    filled = both.withColumns({c: F.last(c, ignorenulls=True).over(order) for c in columns})
    return filled.where("__data = 1").select(key, "date", "__row.*", *columns)
