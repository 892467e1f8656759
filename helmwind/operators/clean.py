"""Cleaning of a panel (series_id, date, close, rf_raw, variables): the steps and their order."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from helmwind.functions.casts import rf_to_daily
from helmwind.operators.frames import KEY, by_date, so_far


def dedup_last(df: DataFrame, order: str = "row_idx", keys: tuple[str, ...] = (KEY, "date")) -> DataFrame:
    """One row per key: the last by ``order``.

    ``max_by`` aggregates before the shuffle, so many repeats of one key cost one row a task.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__last"))
    return picked.select(*keys, "__last.*").select(df.columns)


def fill_rf(c: str = "rf_raw") -> Column:
    """Forward fill, then the first later value for a gap at the head."""
    after = by_date().rowsBetween(0, Window.unboundedFollowing)
    return F.coalesce(F.last(c, ignorenulls=True).over(so_far()), F.first(c, ignorenulls=True).over(after))


def with_returns(df: DataFrame) -> DataFrame:
    """Simple return and return in excess of rf."""
    ret = F.col("close") / F.lag("close").over(by_date()) - 1
    return df.withColumn("ret", ret).withColumn("excess_ret", F.col("ret") - F.col("rf"))


def date_filter(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Both ends included. Comes after the returns, so that the first row keeps its own."""
    if start is not None:
        df = df.where(F.col("date") >= F.to_date(F.lit(start)))
    if end is not None:
        df = df.where(F.col("date") <= F.to_date(F.lit(end)))
    return df


def fill_forward(df: DataFrame, columns: list[str]) -> DataFrame:
    """Forward fill of custom variables; a gap at the head stays."""
    return df.withColumns({c: F.last(c, ignorenulls=True).over(so_far()) for c in columns})


class Watch:
    """What cleaning a panel finds out on the way, without a pass of its own."""

    def __init__(self):
        self.raw, self.dated, self.of = Observation(), Observation(), None

    def report(self, written: DataFrame, rf_unit: str = "annual_percent") -> None:
        """Raise for data that cannot be used, warn for what cleaning mended; ``written`` is the cleaned panel as a table.

        Where nothing is left of a panel, Spark drops the counts with the rest of the plan, and
        the raw rows are counted once more.
        """
        if written.isEmpty():
            validate_panel(self.of, rf_unit)
        else:
            judge(self.raw.get | {"days": self.dated.get["days"]}, rf_unit)


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.count("date").alias("dates"),
        F.count("close").alias("closes"),
        F.count("rf_raw").alias("rates"),
        F.count_if(F.col("close") <= 0).alias("low"),
        F.percentile(F.abs("rf_raw"), F.lit(0.5)).alias("rate"),
    ]


def clean_panel(
    raw: DataFrame,
    rf_unit: str = "annual_percent",
    trading_days: int = 252,
    start: str | None = None,
    end: str | None = None,
    variables: list[str] | None = None,
    order: str = "row_idx",
    watch: Watch | None = None,
) -> DataFrame:
    """Clean daily panel: series_id, date, close, rf_raw, rf, ret, excess_ret and the variables.

    Drops rows without a date, keeps the last row of a date, drops rows without a
    close, fills rf, computes returns, drops each series' first row, filters dates
    and fills the variables forward, in this order. A ``watch`` counts what comes by.
    """
    variables = list(variables or [])
    if watch is not None:
        watch.of, raw = raw, raw.observe(watch.raw, *_counts())
    rows = dedup_last(raw.where("date is not null"), order)
    if watch is not None:
        rows = rows.observe(watch.dated, F.count(F.lit(1)).alias("days"))
    rows = rows.where("close is not null")
    rows = with_returns(rows.withColumn("rf_raw", fill_rf()).withColumn("rf", rf_to_daily(F.col("rf_raw"), rf_unit, trading_days)))
    rows = date_filter(rows.where("ret is not null"), start, end)
    if variables:
        rows = fill_forward(rows, variables)
    return rows.select(KEY, "date", "close", "rf_raw", "rf", "ret", "excess_ret", *variables)


def quality_report(raw: DataFrame) -> DataFrame:
    """Per series: rows, unreadable dates, repeated dates, missing closes and rates, closes of 0 or less."""
    return raw.groupBy(KEY).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("date").isNull()).alias("bad_dates"),
        (F.count("date") - F.count_distinct("date")).alias("repeated_dates"),
        F.count_if(F.col("close").isNull()).alias("missing_close"),
        F.count_if(F.col("rf_raw").isNull()).alias("missing_rf"),
        F.count_if(F.col("close") <= 0).alias("bad_close"),
    )


def validate_panel(raw: DataFrame, rf_unit: str = "annual_percent") -> None:
    """One aggregate over the raw panel: raises for data that cannot be used, warns for what cleaning will mend."""
    judge(raw.agg(*_counts(), F.count_distinct(KEY, "date").alias("days")).head().asDict(), rf_unit)


def judge(found: dict, rf_unit: str) -> None:
    """Errors and warnings of a panel's counts."""
    n, dates, closes, rates = (found[c] for c in ("n", "dates", "closes", "rates"))
    if not (n and dates and closes and rates):
        raise ValueError("the panel has no usable dates, closes or rates")
    if found["low"]:
        raise ValueError(f"{found['low']} closes are 0 or less")
    for what, there in (("dates", dates), ("closes", closes), ("rates", rates)):
        if n > there:
            warnings.warn(f"{n - there} {what} are missing or unreadable", stacklevel=3)
    if dates > found["days"]:
        warnings.warn(f"{dates - found['days']} rows repeat a date; the last row of each counts", stacklevel=3)
    if rf_unit == "annual_percent" and 0 < found["rate"] < 0.5:
        warnings.warn("the rates look like decimals, not percents", stacklevel=3)
    if rf_unit == "annual_decimal" and found["rate"] > 1:
        warnings.warn("the rates look like percents, not decimals", stacklevel=3)
