"""Exponentially weighted means as window sums.

The mean at row t is sum(d**(t-i) * x_i) / sum(d**(t-i)) over the rows i <= t with
a value, d = 0.5**(1/halflife): positions count rows, null rows carry the last value,
rows before the first value are null. A series is cut into blocks of positions so
that weights stay within a double; inside a block the sums are plain windows, and
a block takes over what the blocks before it left, which is one row per block.
All halflives share both passes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmwind.operators.frames import KEY, with_position

#: Binary orders of magnitude that the weights of one block may span.
BLOCK_BITS = 480


def _decayed_sum(values: Column, decay: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, value: total * decay + value)


def ewm_means(df: DataFrame, wanted: dict[str, tuple[str, float]], key: str = KEY) -> DataFrame:
    """Adds column ``name`` for each ``name: (column, halflife)`` of ``wanted``; df has key and date."""
    if not wanted:
        return df
    if any(h <= 0 for _, h in wanted.values()):
        raise ValueError("a halflife must be positive")
    span = max(1, math.floor(BLOCK_BITS * min(h for _, h in wanted.values())))
    # Blocks further back than this weigh less than the smallest double.
    reach = math.ceil(1100 * max(h for _, h in wanted.values()) / span) + 1
    rows = with_position(df, "__pos").withColumn("__block", F.floor(F.col("__pos") / F.lit(span)))
    k = F.col("__pos") - F.col("__block") * F.lit(span)
    inside = Window.partitionBy(key, "__block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    sums = {}
    for name, (column, halflife) in wanted.items():
        up = F.pow(F.lit(2.0), k / F.lit(float(halflife)))
        value = F.col(column)
        sums[f"__n_{name}"] = F.coalesce(F.sum(up * value).over(inside), F.lit(0.0))
        sums[f"__d_{name}"] = F.coalesce(F.sum(F.when(value.isNotNull(), up)).over(inside), F.lit(0.0))
    rows = rows.withColumns(sums)
    # What each block leaves at its end, and what the blocks before it hand over.
    ends = rows.groupBy(key, "__block").agg(*[F.max_by(F.col(c), F.col("__pos")).alias(c) for c in sums])
    back = Window.partitionBy(key).orderBy("__block").rowsBetween(-reach, -1)
    carries = []
    for name, (_, halflife) in wanted.items():
        down = F.lit(2.0 ** (-span / halflife))
        last = F.lit(2.0 ** (-(span - 1) / halflife))
        for part in ("n", "d"):
            own = F.col(f"__{part}_{name}") * last
            carries.append(_decayed_sum(F.collect_list(own).over(back), down).alias(f"__c{part}_{name}"))
    handed = ends.select(F.col(key).alias("__key"), F.col("__block").alias("__of"), *carries)
    joined = rows.join(handed, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__of")), "left")
    out = {}
    for name, (_, halflife) in wanted.items():
        down = F.pow(F.lit(2.0), -k / F.lit(float(halflife)))
        step = F.lit(2.0 ** (-1.0 / halflife))
        n = (F.col(f"__n_{name}") + F.coalesce(f"__cn_{name}", F.lit(0.0)) * step) * down
        d = (F.col(f"__d_{name}") + F.coalesce(f"__cd_{name}", F.lit(0.0)) * step) * down
        out[name] = F.try_divide(n, F.when(d != 0, d))
    keep = df.columns
    return joined.withColumns(out).select(*[c for c in keep if c not in out], *out)
