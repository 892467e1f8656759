"""Online features and regimes of a stream of daily rows.

Rows may come late, out of order and more than once. A series keeps the rows whose date
the watermark has not passed, takes them in date order once it has, and drops rows
of a date that is waiting or done. What it carries from day to day is what the batch
definitions carry: numerator and denominator of each exponentially weighted mean,
the cost of each regime, and the features of the last days. At a refit the centres change,
and the costs are rebuilt from those days under the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from helmwind.models.jump import losses
from helmwind.operators.frames import KEY
from helmwind.operators.online import fold
from helmwind.sources.store import shared_dir
from helmwind.sources.tables import panel

HALFLIVES = (5, 20, 60)
OUTPUT = f"{KEY} string, date date, " + ", ".join(f"mean_{h} double" for h in HALFLIVES) + ", regime int"
CARRIED = "day date, numerators array<double>, denominators array<double>, costs array<double>, refit int, recent array<double>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Refit:
    """Centres of (mean over 5 days, mean over 20 days) from a date on."""

    since: date
    centers: tuple[tuple[float, float], ...]


#: Refits of the registered stream, the penalty of a switch, and the days that rebuild the costs at a refit.
REFITS = (
    Refit(date(1, 1, 1), ((0.1, 0.1), (1.0, 0.6))),
    Refit(date(1997, 1, 2), ((0.0, 0.1), (0.8, 0.5))),
    Refit(date(1999, 7, 1), ((0.2, 0.2), (1.2, 0.7))),
)
PENALTY, LOOKBACK = 1.0, 60


@dataclass(frozen=True)
class Online:
    """What a stream needs to know besides its rows."""

    refits: Sequence[Refit] = REFITS
    penalty: float = PENALTY
    lookback: int = LOOKBACK

    def advance(self, days: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        """Output rows of new days (date, ret) after a state, and the state after them.

        Days come in date order without repeats; one that is not after the state's is left out.
        """
        decay = np.power(0.5, 1.0 / np.array(HALFLIVES, dtype=float))
        last, num, den, costs, refit, recent = None, np.zeros(len(decay)), np.zeros(len(decay)), None, -1, np.zeros((0, 2))
        if state is not None:
            last, num, den, refit = state[0], np.array(state[1]), np.array(state[2]), int(state[4])
            costs, recent = np.array(state[3]), np.array(state[5], dtype=float).reshape(-1, 2)
            days = days[days["date"] > last]
        means, states = np.empty((len(days), len(decay))), np.empty(len(days), dtype=np.int32)
        for t, (day, r) in enumerate(zip(days["date"], days["ret"].to_numpy(dtype=float))):
            num, den = num * decay, den * decay
            if not np.isnan(r):
                num, den = num + r, den + 1
            means[t] = np.divide(num, den, out=np.full(len(decay), np.nan), where=den > 0)
            due = max(i for i, x in enumerate(self.refits) if x.since <= day)
            centers = np.asarray(self.refits[due].centers)
            if due != refit:
                refit, costs = due, None
                if len(recent):
                    _, costs = fold(losses(recent, centers), self.penalty, None)
            own = np.nan_to_num(means[t : t + 1, :2])
            found, costs = fold(losses(own, centers), self.penalty, costs)
            states[t], recent, last = found[0], np.concatenate([recent, own])[-self.lookback :], day
        out = pd.DataFrame({"date": days["date"].to_numpy()} | {f"mean_{h}": means[:, i] for i, h in enumerate(HALFLIVES)})
        out["regime"] = states
        return out, (last, num.tolist(), den.tolist(), [] if costs is None else costs.tolist(), refit, recent.ravel().tolist())


class OnlineProcessor(StatefulProcessor):
    """State of a series: what is carried, and the rows that wait for the watermark by their time."""

    def __init__(self, online: Online):
        self.online = online

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", CARRIED)
        self.waiting = handle.getMapState("waiting", "at long", "date date, ret double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:  # a filter before would hide the row from the watermark
            return
        now, done = timerValues.getCurrentWatermarkInMs(), self.carried.get()[0] if self.carried.exists() else None
        for batch in rows:
            for at, day, ret in zip(batch["at"], batch["date"], batch["ret"]):
                at = (int(at),)
                if at[0] > now and (done is None or day > done) and not self.waiting.containsKey(at):
                    self.waiting.updateValue(at, (day, None if pd.isna(ret) else float(ret)))
        yield from self._take(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._take(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _take(self, key, now: int) -> Iterator[pd.DataFrame]:
        """Rows that the watermark has passed; a timer stands for the first one that waits."""
        held = sorted((at[0], *row) for at, row in self.waiting.iterator())
        ready = [row for row in held if row[0] <= now]
        if len(held) > len(ready):
            wanted, there = held[len(ready)][0], list(self.handle.listTimers())
            if there != [wanted]:
                for timer in there:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(wanted)
        if not ready:
            return
        days = pd.DataFrame({"date": [r[1] for r in ready], "ret": pd.Series([r[2] for r in ready], dtype=float)})
        out, after = self.online.advance(days, self.carried.get() if self.carried.exists() else None)
        if after[0] is not None:
            self.carried.update(after)
        for at, *_ in ready:
            self.waiting.removeKey((at,))
        out.insert(0, KEY, key[0])
        yield out


def online_stream(rows: DataFrame, delay: str = "60 days", online: Online | None = None) -> DataFrame:
    """Streaming (series_id, date, means, regime) of a stream (series_id, date, ret), each row once the watermark has passed its date.

    ``delay`` is how far rows may come behind the latest date of the stream; later ones are
    dropped, as are rows without a date and repeats. Rows without a series carry the clock
    on and give nothing. State is kept by the RocksDB provider, which the session must name.
    """
    timed = rows.where("date is not null").withColumn("time", F.col("date").cast("timestamp")).withWatermark("time", delay)
    timed = timed.withColumn("at", F.unix_millis("time"))
    return timed.groupBy(KEY).transformWithStateInPandas(OnlineProcessor(online or Online()), OUTPUT, "append", "eventTime")


#: Batches and files of a batch of the registered stream; rows come up to SHIFT days early or late.
BATCHES, FILES, SHIFT = 8, 2, 25
FIRST, LAST = "1995-01-01", "2001-08-01"


def shuffled_batches(market: DataFrame) -> DataFrame:
    """(batch, series_id, date, ret): rows by date, but shifted by up to SHIFT days, every fifth twice, every seventh again with another return when it is too late."""
    day = F.datediff("date", F.to_date(F.lit(FIRST)))
    width = F.datediff(F.to_date(F.lit(LAST)), F.to_date(F.lit(FIRST))) / BATCHES
    dealt = F.pmod(F.xxhash64(KEY, "date"), F.lit(2 * SHIFT + 1)) - SHIFT
    own = F.least(F.greatest(F.floor((day + dealt) / width), F.lit(0)), F.lit(BATCHES - 1))
    again = F.when(F.pmod(F.xxhash64("date", F.lit(1)), F.lit(5)) == 0, F.struct(own.alias("batch"), F.col("ret")))
    late = F.when((F.pmod(F.xxhash64("date", F.lit(2)), F.lit(7)) == 0) & (own < BATCHES - 2), F.struct((own + 2).alias("batch"), (F.col("ret") + 1).alias("ret")))
    sent = F.array_compact(F.array(F.struct(own.alias("batch"), F.col("ret")), again, late))
    return market.select(KEY, "date", F.inline(sent)).select("batch", KEY, "date", "ret")


def stream_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams the panel's rows from files, shuffled and repeated, in batches, and returns all output rows.

    A last file moves the clock beyond all dates, so that no row waits any more.
    """
    import uuid

    market = panel(spark, sf_dir).select(KEY, "date", "ret")
    sent = shuffled_batches(market)
    folder = f"{shared_dir(spark)}/helmwind-stream-{uuid.uuid4().hex}"
    rows = sent.drop("batch")
    for batch in range(BATCHES):
        sent.where(F.col("batch") == batch).drop("batch").repartition(FILES).write.mode("append").parquet(f"{folder}/in")
    spark.range(1).select(F.lit(None).cast("string").alias(KEY), F.to_date(F.lit("2200-01-01")).alias("date"), F.lit(None).cast("double").alias("ret")).write.mode("append").parquet(f"{folder}/in")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(f"{folder}/in")
        writer = online_stream(source).writeStream.format("parquet").option("checkpointLocation", f"{folder}/marks").trigger(availableNow=True)
        query = writer.start(f"{folder}/out")
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()
    found = spark.read.schema(OUTPUT).parquet(f"{folder}/out")
    return found.select(KEY, "date", *[F.round(f"mean_{h}", 6).alias(f"mean_{h}") for h in HALFLIVES], "regime")
