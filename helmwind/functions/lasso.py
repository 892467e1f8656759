"""Feature weights under a 1-norm bound, as array expressions.

With a threshold t between two neighbouring scores the k scores above it are active. With
their mean m and sum of squared deviations Q, the ratio of the 1-norm to the 2-norm of the
scores less t equals the bound where ``m - t = bound * sqrt(Q / (k * (k - bound**2)))``: a candidate
for each k from prefix sums, of which the one that lies between its scores holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from helmwind.models.sparse import FLOOR


def _norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda total, v: total + v * v))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def threshold(scores: Column, bound: float, tolerance: float = 1e-8) -> Column:
    """Smallest threshold of non-negative scores that keeps the 1-norm of the unit vector within ``bound``.

    0 if they are within it already, if all are equal or if only one level is above the tolerance; the
    second highest level if no lower threshold does.
    """
    falling = F.reverse(F.array_sort(scores))
    levels = F.reverse(F.array_sort(F.array_distinct(scores)))
    second = F.get(levels, 1)
    square = float(bound) ** 2
    first = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("one"), F.lit(0.0).alias("two"), F.lit(None).cast("double").alias("best"))

    def further(state: Column, value: Column) -> Column:
        k, one, two = state["k"] + 1, state["one"] + value, state["two"] + value * value
        spread = F.greatest(two - one * one / k, F.lit(0.0))
        room = k * (k - F.lit(square))
        found = one / k - F.lit(float(bound)) * F.sqrt(F.try_divide(spread, F.when(room > 0, room)))
        holds = (found < value) & (found >= F.coalesce(F.get(falling, k), F.lit(0.0)))
        return F.struct(k.alias("k"), one.alias("one"), two.alias("two"), F.least(state["best"], F.when(holds, found)).alias("best"))

    best = F.aggregate(falling, first, further)["best"]
    needed = (F.size(levels) > 1) & (second >= F.lit(tolerance)) & (_total(scores) > F.lit(float(bound)) * _norm(scores))
    return F.when(needed, F.coalesce(best, second)).otherwise(F.lit(0.0))


def lasso_weights(scores: Column, bound: float, pins: Sequence[bool] | None = None, floor: float = FLOOR) -> Column:
    """Unit vector along the scores (array<double>) less their threshold.

    Pinned places are exempt from the threshold and never below ``floor`` times the largest score.
    Null and negative scores count as 0; without a positive score all places are equal.
    """
    s = F.transform(scores, lambda v: F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)))
    cut, top = threshold(s, bound), F.array_max(s)
    kept = F.array(*[F.lit(bool(p)) for p in pins]) if pins is not None else F.transform(s, lambda v: F.lit(False))
    raw = F.zip_with(s, kept, lambda v, pin: F.when(pin, F.greatest(v, floor * top)).otherwise(F.greatest(v - cut, F.lit(0.0))))
    equal = F.transform(s, lambda v: 1 / F.sqrt(F.size(s).cast("double")))
    return F.when(top <= 0, equal).otherwise(F.transform(raw, lambda v: v / _norm(raw)))
