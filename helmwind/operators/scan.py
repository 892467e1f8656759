"""Scans of series in blocks, so that one long series spreads over tasks.

A block is a calendar year of a series, at most 366 rows. What a block does to whatever
comes before it is one row; these rows are chained, and each block is then replayed
from what the chain hands to it. No task sorts or holds a whole series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmwind.operators.frames import KEY

BLOCK = "__block"


def with_block(rows: DataFrame) -> DataFrame:
    """Adds the block of each row, in the order of the dates."""
    return rows.withColumn(BLOCK, F.year("date"))


def inside(*extra: str):
    """Rows of a block up to the current one."""
    return Window.partitionBy(KEY, *extra, BLOCK).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def earlier(*extra: str):
    """Blocks before the current one, of a table with a row for each block."""
    return Window.partitionBy(KEY, *extra).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def hand_over(rows: DataFrame, handed: DataFrame, *extra: str) -> DataFrame:
    """Rows with the columns that a table of blocks (series_id, extra keys, block, columns) has for theirs."""
    keys = [KEY, *extra, BLOCK]
    named = handed.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys[:-1]] + [F.col(BLOCK) == F.col(f"__of_{BLOCK}")]
    return rows.join(named, same, "left").drop(*[f"__of_{k}" for k in keys])


def wealth_and_peak(rows: DataFrame, growth: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """Adds __wealth, the product of ``growth`` so far, and __peak, its highest value so far.

    A block is summed up by its product and its highest inner product. Nulls of ``growth``
    change nothing; both are null before the first value.
    """
    cut = with_block(rows).withColumn("__growth", growth)
    cut = cut.withColumn("__inner", F.product("__growth").over(inside(*extra)))
    cut = cut.withColumn("__high", F.max("__inner").over(inside(*extra)))
    keys = [KEY, *extra, BLOCK]
    ends = cut.groupBy(*keys).agg(F.product("__growth").alias("__whole"), F.max("__inner").alias("__top"))
    ends = ends.withColumn("__start", F.product("__whole").over(earlier(*extra)))
    reached = F.max(F.coalesce("__start", F.lit(1.0)) * F.col("__top")).over(earlier(*extra))
    handed = ends.select(*keys, "__start", reached.alias("__reached"))
    out = hand_over(cut, handed, *extra)
    start = F.coalesce("__start", F.lit(1.0))
    wealth = F.when(F.col("__inner").isNotNull() | F.col("__start").isNotNull(), start * F.coalesce("__inner", F.lit(1.0)))
    peak = F.greatest(start * F.col("__high"), F.col("__reached"))
    return out.withColumns({"__wealth": wealth, "__peak": peak}).select(*rows.columns, "__wealth", "__peak")


def running_sums(rows: DataFrame, columns: dict[str, Column], extra: tuple[str, ...] = ()) -> DataFrame:
    """Adds the sum so far of each expression by name; null before its first value."""
    cut = with_block(rows).withColumns({f"__v_{n}": c for n, c in columns.items()})
    cut = cut.withColumns({f"__i_{n}": F.sum(f"__v_{n}").over(inside(*extra)) for n in columns})
    ends = cut.groupBy(KEY, *extra, BLOCK).agg(*[F.sum(f"__v_{n}").alias(f"__e_{n}") for n in columns])
    handed = ends.select(KEY, *extra, BLOCK, *[F.sum(f"__e_{n}").over(earlier(*extra)).alias(f"__s_{n}") for n in columns])
    out = hand_over(cut, handed, *extra)
    zero = F.lit(0.0)
    sums = {
        n: F.when(F.col(f"__s_{n}").isNotNull() | F.col(f"__i_{n}").isNotNull(), F.coalesce(f"__s_{n}", zero) + F.coalesce(f"__i_{n}", zero))
        for n in columns
    }
    return out.withColumns(sums).select(*[c for c in rows.columns if c not in columns], *columns)


def step(costs: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """(min,+) product of row vectors (..., i) of costs and a matrix of moves (i, j)."""
    return (costs[..., :, None] + moves).min(axis=-2)


def _stacked(loss: list[np.ndarray]) -> np.ndarray:
    """Blocks of losses (n, k) as one array (blocks, longest, k); padded rows are NaN."""
    out = np.full((len(loss), max(map(len, loss)), loss[0].shape[1]), np.nan)
    for i, own in enumerate(loss):
        out[i, : len(own)] = own
    return out


def summaries(loss: list[np.ndarray], moves: np.ndarray) -> np.ndarray:
    """The (min,+) product of each block, (blocks, k, k): cheapest cost from state i on its first row to state j on its last."""
    stack, k = _stacked(loss), len(moves)
    value = np.where(np.eye(k, dtype=bool), stack[:, 0, :, None], np.inf)
    for t in range(1, stack.shape[1]):
        live = ~np.isnan(stack[:, t, 0])
        value[live] = step(value[live], moves) + stack[live, t, None, :]
    return value


def replay(loss: list[np.ndarray], start: np.ndarray, moves: np.ndarray) -> list[np.ndarray]:
    """The cheapest last state after each row of each block, from the costs (blocks, k) that it starts with; ties go to the lower state."""
    stack = _stacked(loss)
    states, value = np.zeros(stack.shape[:2], dtype=np.int32), start
    for t in range(stack.shape[1]):
        value = (value if t == 0 else step(value, moves)) + stack[:, t]
        states[:, t] = np.where(np.isnan(value), np.inf, value).argmin(axis=1)
    return [states[i, : len(own)] for i, own in enumerate(loss)]


def chain(start: np.ndarray, products: Sequence[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """The costs that each block starts with."""
    out, value = [], np.asarray(start, dtype=float)
    for product in products:
        out.append(value)
        value = step(step(value, product), moves)
    return out


def _whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[list[pd.DataFrame]]:
    """Blocks of sorted rows, a list for each batch; a block that runs over the end of a batch waits for its rest."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if batch.empty:
            continue
        new = (batch[KEY] != batch[KEY].shift()) | (batch[BLOCK] != batch[BLOCK].shift())
        starts = np.flatnonzero(new.to_numpy())
        rest = batch.iloc[starts[-1] :]
        if len(starts) > 1:
            yield [batch.iloc[a:b] for a, b in zip(starts[:-1], starts[1:])]
    if rest is not None and not rest.empty:
        yield [rest]


def cheapest_states(rows: DataFrame, moves: Sequence[Sequence[float]], start: Sequence[float] | None = None) -> DataFrame:
    """(series_id, date, state): the last state of the cheapest sequence up to each row of (series_id, date, loss array<double>).

    A sequence costs its states' losses, ``moves[i][j]`` for each step from i to j and ``start``
    (zeros unless given). Regimes of a jump model and Viterbi paths (losses and moves are
    minus logarithms) are of this kind. Ties go to the lower state; dates of a series differ; an
    empty table gives an empty result.
    """
    table = np.asarray(moves, dtype=float)
    first = np.zeros(len(table)) if start is None else np.asarray(start, dtype=float)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for blocks in _whole_blocks(batches):
            found = summaries([np.array(b["loss"].tolist(), dtype=float) for b in blocks], table)
            yield pd.DataFrame({KEY: [b[KEY].iat[0] for b in blocks], BLOCK: [b[BLOCK].iat[0] for b in blocks], "product": list(found.reshape(len(blocks), -1))})

    def hand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, value = object(), first
        for batch in batches:
            costs = []
            for name, product in zip(batch[KEY], batch["product"]):
                if name != series:
                    series, value = name, first
                costs.append(value.tolist())
                value = step(step(value, np.asarray(product).reshape(table.shape)), table)
            yield pd.DataFrame({KEY: batch[KEY], BLOCK: batch[BLOCK], "start": costs})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for blocks in _whole_blocks(batches):
            losses = [np.array(b["loss"].tolist(), dtype=float) for b in blocks]
            states = replay(losses, np.array([b["start"].iat[0] for b in blocks], dtype=float), table)
            whole = pd.concat(blocks)
            yield pd.DataFrame({KEY: whole[KEY].to_numpy(), "date": whole["date"].to_numpy(), "state": np.concatenate(states)})

    dealt = with_block(rows.select(KEY, "date", "loss")).repartition(n, KEY, BLOCK)
    products = dealt.sortWithinPartitions(KEY, BLOCK, "date").mapInPandas(sum_up, f"{KEY} string, {BLOCK} int, product array<double>")
    carried = products.repartition(n, KEY).sortWithinPartitions(KEY, BLOCK).mapInPandas(hand, f"{KEY} string, {BLOCK} int, start array<double>")
    begun = hand_over(dealt, carried).repartition(n, KEY, BLOCK).sortWithinPartitions(KEY, BLOCK, "date")
    return begun.mapInPandas(run, f"{KEY} string, date date, state int")
