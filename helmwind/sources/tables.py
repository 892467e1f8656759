"""Panels made of the order and line tables: a daily close, a rate and a custom variable for each series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwind.operators.asof import asof_join
from helmwind.operators.clean import clean_panel
from helmwind.operators.frames import KEY


def daily_close(spark: SparkSession, sf_dir: str, series: bool = True) -> DataFrame:
    """(series_id, date, close): mean order price of a day and priority, or of the day."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderpriority") if series else F.lit("ALL")
    return orders.groupBy(key.alias(KEY), F.to_date("o_orderdate").alias("date")).agg(F.round(F.avg("o_totalprice"), 4).alias("close"))


def daily_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, rf_raw, qty): mean discount in percent and mean quantity of a shipping day."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.round(F.avg("l_discount") * 100, 4).alias("rf_raw"), F.round(F.avg("l_quantity"), 4).alias("qty")
    )


def raw_panel(spark: SparkSession, sf_dir: str, series: bool = True) -> DataFrame:
    """Closes with the rate and the variable as of each day."""
    return asof_join(daily_close(spark, sf_dir, series), daily_extra(spark, sf_dir), ["rf_raw", "qty"], key=None)


def panel(spark: SparkSession, sf_dir: str, series: bool = True, **options) -> DataFrame:
    """Clean panel of the tables, with the variable qty."""
    raw = raw_panel(spark, sf_dir, series).withColumn("row_idx", F.lit(0))
    return clean_panel(raw, variables=["qty"], **options)
