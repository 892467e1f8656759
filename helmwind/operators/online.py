"""Online regimes of a jump model with given centres, and Viterbi states with given parameters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from helmwind.models.hmm import HmmFit
from helmwind.models.jump import losses
from helmwind.operators.frames import KEY, with_position
from helmwind.operators.scan import cheapest_states


def center_losses(x: Column, centers: Sequence[Sequence[float]]) -> Column:
    """Half the squared distance of an array column to each centre."""

    def one(center: Sequence[float]) -> Column:
        at = F.array(*[F.lit(float(c)) for c in center])
        return F.aggregate(F.zip_with(x, at, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, d: total + d) * 0.5

    return F.array(*[one(c) for c in centers])


def online_regimes(rows: DataFrame, centers: Sequence[Sequence[float]], penalty: float) -> DataFrame:
    """(series_id, date, regime) of (series_id, date, x array<double>), each day from its own and earlier rows.

    Blocks of a series are worked on apart and chained, so its length bounds neither
    memory nor parallelism.
    """
    moves = penalty * (1 - np.eye(len(centers)))
    states = cheapest_states(rows.select(KEY, "date", center_losses(F.col("x"), centers).alias("loss")), moves)
    return states.withColumnRenamed("state", "regime")


def log_densities(x: Column, fit: HmmFit) -> Column:
    """Log density of a column in each state, as an array."""
    parts = []
    for mean, vol in zip(fit.means.tolist(), fit.vols.tolist()):
        u = (x - F.lit(mean)) / F.lit(vol)
        parts.append(-0.5 * u * u - F.lit(0.5 * np.log(2 * np.pi) + np.log(vol)))
    return F.array(*parts)


def viterbi_online(rows: DataFrame, fit: HmmFit) -> DataFrame:
    """(series_id, date, state) of (series_id, date, x): the last state of the likeliest path from the series' first row on."""
    with np.errstate(divide="ignore"):
        start, moves = -np.log(fit.start), -np.log(fit.transitions)
    loss = F.transform(log_densities(F.col("x"), fit), lambda d: -d)
    return cheapest_states(rows.select(KEY, "date", loss.alias("loss")), moves, start)


def viterbi_trailing(rows: DataFrame, fit: HmmFit, window: int, min_window: int) -> DataFrame:
    """(series_id, date, state) of (series_id, date, x): the last state of the likeliest path over each row's trailing window.

    A max-product recurrence over the densities of the window, as an array expression. The
    row at position p has the ``min(window, p)`` rows up to it; rows before ``min_window`` have none.
    """
    with np.errstate(divide="ignore"):
        start, moves = np.log(fit.start).tolist(), np.log(fit.transitions).tolist()
    k = len(start)
    back = Window.partitionBy(KEY).orderBy("date").rowsBetween(-(window - 1), 0)
    placed = with_position(rows.select(KEY, "date", log_densities(F.col("x"), fit).alias("density")))
    seen = placed.withColumn("seen", F.collect_list("density").over(back)).where(F.col("pos") >= min_window)
    seen = seen.withColumn("seen", F.slice("seen", F.size("seen") - F.least(F.lit(window), F.col("pos").cast("int")) + 1, F.lit(window)))
    first = F.array(*[F.element_at(F.element_at("seen", 1), j + 1) + F.lit(start[j]) for j in range(k)])

    def later(value: Column, density: Column) -> Column:
        return F.array(*[F.greatest(*[F.get(value, i) + F.lit(moves[i][j]) for i in range(k)]) + F.get(density, j) for j in range(k)])

    value = F.aggregate(F.slice("seen", F.lit(2), F.greatest(F.size("seen") - 1, F.lit(0))), first, later)
    return seen.select(KEY, "date", (F.array_position(value, F.array_max(value)) - 1).cast("int").alias("state"))


def fold(loss: np.ndarray, penalty: float, value: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """States of further rows and the costs after them, from the costs before them (None: the series begins)."""
    states = np.empty(len(loss), dtype=np.int64)
    for t, row in enumerate(loss):
        value = row.copy() if value is None else np.minimum(value, value.min() + penalty) + row
        states[t] = value.argmin()
    return states, value


class JumpOnline:
    """Table function ``jm_online(TABLE(t) PARTITION BY series_id ORDER BY date, centers, penalty)`` of rows (series_id, date, x).

    A partition is one series in date order; its key and date come back as they are, with
    the regime of each day from its own and earlier rows.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, centers: AnalyzeArgument, penalty: AnalyzeArgument) -> AnalyzeResult:
        names = [f.name for f in rows.dataType.fields] if rows.isTable else []
        if any(names.count(c) != 1 for c in (KEY, "date", "x")):
            raise ValueError(f"jm_online reads a table with the columns {KEY}, date and x, not {names}")
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        schema = StructType().add(KEY, kinds[KEY]).add("date", kinds["date"]).add("regime", IntegerType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(KEY)], orderBy=[OrderingColumn("date")])

    def __init__(self):
        self.value = None

    def eval(self, row, centers, penalty):
        loss = losses(np.array([row["x"]], dtype=float), np.array(centers, dtype=float))
        states, self.value = fold(loss, float(penalty), self.value)
        yield row[KEY], row["date"], int(states[0])


def register_functions(spark: SparkSession) -> None:
    """Give the session the SQL face of the online operators."""
    spark.udtf.register("jm_online", udtf(JumpOnline))
