"""Casts of text columns as files hold them; what cannot be read becomes NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helmwind.sources.headers import RF_UNITS

#: Date layouts that are tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "yyyy/M/d", "yyyy-M-d", "MM/dd/yyyy")


def to_number(c: Column) -> Column:
    """Double of a text that may hold ``,``, ``%`` and blanks; empty, ``-``, nan and None are NULL."""
    plain = F.regexp_replace(c.cast("string"), r"[,%\s]", "")
    number = plain.try_cast("double")
    return F.when(F.isnan(number) | F.lower(plain).isin("", "-", "nan", "none"), F.lit(None)).otherwise(number)


def to_day(c: Column) -> Column:
    """Date of a text in one of ``DATE_FORMATS``, else NULL."""
    text = F.trim(c.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]).cast("date")


def rf_to_daily(c: Column, unit: str = "annual_percent", trading_days: int = 252) -> Column:
    """Daily rate of a quoted risk-free rate."""
    if unit not in RF_UNITS:
        raise ValueError(f"rf_unit must be one of {RF_UNITS}")
    if unit == "annual_percent":
        return c / F.lit(100.0) / F.lit(float(trading_days))
    return c / F.lit(float(trading_days)) if unit == "annual_decimal" else c
