"""Refit schedules and the rows that each refit reads."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helmwind.operators.frames import KEY, with_position

# Refits fall on the first row of these months, unless it comes so many days late.
REFIT_MONTHS, MAX_GAP_DAYS = (1, 7), 45


def anchors(dates: DataFrame) -> DataFrame:
    """(series_id, date, pos): first row of each January and July of a series (series_id, date).

    A month's first row is the first one on or after its first day, in this or a
    later month. Position 0 and gaps over 45 days do not count.
    """
    rows = with_position(dates.select(KEY, "date"))
    month = F.trunc("date", "month")
    first = F.lag("date").over(Window.partitionBy(KEY).orderBy("date"))
    # A row anchors every refit month that starts after the row before it and not after itself.
    starts = F.sequence(F.trunc(F.coalesce("__from", "date"), "month"), month, F.expr("interval 1 month"))
    marked = rows.withColumn("__from", first).withColumn("__start", F.explode(starts))
    hit = marked.where(
        F.month("__start").isin(*REFIT_MONTHS)
        & (F.col("pos") > 0)
        & (F.col("__start") > F.col("__from"))
        & (F.col("__start") <= F.col("date"))
        & (F.datediff("date", "__start") <= MAX_GAP_DAYS)
    )
    return hit.select(KEY, "date", "pos").distinct()


def refit_schedule(dates: DataFrame, window: int = 3000, min_window: int = 500, start_date: str | None = None) -> DataFrame:
    """(series_id, refit_id, refit_date, pos, win, seg_end) of the semi-annual refits.

    A refit trains on the ``win`` rows before ``pos`` and serves the rows up to ``seg_end``.
    """
    if min_window > window:
        raise ValueError("min_window must not exceed window")
    found = anchors(dates).where(F.col("pos") >= min_window)
    if start_date is not None:
        found = found.where(F.col("date") >= F.to_date(F.lit(start_date)))
    return _numbered(found, dates, window)


def fixed_schedule(dates: DataFrame, every: int = 21, window: int = 3000, min_window: int = 500, start_date: str | None = None) -> DataFrame:
    """The same for a refit at every so-many-th row from the first one with ``min_window`` rows before it."""
    if min_window > window:
        raise ValueError("min_window must not exceed window")
    rows = with_position(dates.select(KEY, "date"))
    live = rows.where(F.col("pos") >= min_window)
    if start_date is not None:
        live = live.where(F.col("date") >= F.to_date(F.lit(start_date)))
    numbered = live.withColumn("__first", F.min("pos").over(Window.partitionBy(KEY)))
    return _numbered(numbered.where((F.col("pos") - F.col("__first")) % every == 0), dates, window)


def _numbered(found: DataFrame, dates: DataFrame, window: int) -> DataFrame:
    order = Window.partitionBy(KEY).orderBy("pos")
    length = dates.groupBy(KEY).agg(F.count("*").alias("__n"))
    return found.join(length, KEY).select(
        KEY,
        F.row_number().over(order).alias("refit_id"),
        F.col("date").alias("refit_date"),
        F.col("pos").cast("int").alias("pos"),
        F.least(F.lit(window), "pos").cast("int").alias("win"),
        F.coalesce(F.lead("pos").over(order), "__n").cast("int").alias("seg_end"),
    )


def training_windows(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """Each row with every refit that reads it: positions from pos - win up to seg_end.

    The refits of a series travel as one array, so this is an equi-join on the
    series and a generator, not a range join.
    """
    refits = schedule.groupBy(KEY).agg(
        F.array_sort(F.collect_list(F.struct("refit_id", "refit_date", "pos", "win", "seg_end"))).alias("__refits")
    )
    placed = with_position(rows, "__row").join(refits, KEY)
    own = F.filter("__refits", lambda r: (F.col("__row") >= r["pos"] - r["win"]) & (F.col("__row") < r["seg_end"]))
    return placed.withColumn("__refit", F.explode(own)).drop("__refits").select(
        *[c for c in placed.columns if c not in ("__refits", "__row")],
        F.col("__row").cast("int").alias("row_pos"),
        "__refit.*",
    )


#: A row is in so many slices at most, while refits are less than half a span apart.
COPIES = 4


def refit_slices(rows: DataFrame, schedule: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Runs of consecutive refits and the rows that each run reads, once for all its refits.

    Refits whose positions fall into one span of ``window / 2.5`` rows are a slice: (series_id,
    slice_id, refits array in order). The first frame has the columns of ``rows``, slice_id
    and row_pos: the rows from the start of a slice's first training window to the end of its
    last segment. Slices and rows meet by intervals: both are cut into buckets of a span, so
    it is an equi-join whose keys hold a span of rows, whatever the series' length.
    """
    span = max(1, math.ceil(window * 2 / (2 * COPIES - 3)))
    refit = F.struct("refit_id", "refit_date", "pos", "win", "seg_end")
    slices = (
        schedule.withColumn("slice_id", F.floor(F.col("pos") / span).cast("int"))
        .groupBy(KEY, "slice_id")
        .agg(F.min(F.col("pos") - F.col("win")).alias("__low"), F.max("seg_end").alias("__high"), F.array_sort(F.collect_list(refit)).alias("refits"))
    )
    buckets = F.sequence(F.floor(F.col("__low") / span), F.floor((F.col("__high") - 1) / span))
    ranges = slices.select(KEY, "slice_id", "__low", "__high", F.explode(buckets).alias("__bucket"))
    placed = with_position(rows, "row_pos").withColumn("row_pos", F.col("row_pos").cast("int"))
    dealt = placed.withColumn("__bucket", F.floor(F.col("row_pos") / span)).join(ranges, [KEY, "__bucket"])
    dealt = dealt.where((F.col("row_pos") >= F.col("__low")) & (F.col("row_pos") < F.col("__high")))
    return dealt.select(*rows.columns, "slice_id", "row_pos"), slices.select(KEY, "slice_id", "refits")
