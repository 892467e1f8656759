"""Mix sources to target weights by blocks dealt through a multivariate-hypergeometric splitting tree.

Documents fall into blocks of their source by a hash. A source draws whole passes
over its blocks and, for the rest of its target, a prefix of their permuted order;
the block that the target ends in is cut at a document. The draws of a few documents
are then chosen so that the source comes nearest to its target; what they are drawn
more often than their blocks makes a last block. The exact number of block draws of each
source is the root of a tree over the output shards: each node splits its quotas
between its two halves without replacement, and leaves take the next disjoint draws
of the permuted order. A document is taken as often as a leaf holds a draw of one of
its blocks, and is shuffled within that shard.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from helmwind.llm.common import discard, documents, materialise, shuffle_partitions

#: A word of the contract's sizes.
WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SHARDS = 16
SEED = 20_240
#: A table of sources of at most so many bytes is broadcast; beyond, documents are joined to it.
BROADCAST_BYTES = 32 << 20
#: Blocks of a source are the power of four that holds its documents, up to 4 ** MAX_HALF.
MAX_HALF = 6
#: Documents of a source whose numbers of draws are chosen anew so that the source comes nearest to its target.
TUNED = 24
#: Sums that this choice tells apart.
TUNED_SUMS = 1 << 20
#: Most that numpy's hypergeometric draw takes.
_EXACT = 10**9 - 1


def targets_of(sizes: list[int], weights: list[float], cap: float = MAX_REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight; a share stops at cap * size and its excess is shared anew by weight."""
    size, weight = np.array(sizes, dtype=np.float64), np.array(weights, dtype=np.float64)
    out, open_, left = np.zeros(len(size)), size > 0, float(sum(sizes))
    while open_.any():
        unit = left / weight[open_].sum()
        full = open_ & (unit * weight >= cap * size)
        if not full.any():
            out[open_] = unit * weight[open_]
            break
        out[full] = cap * size[full]
        left -= out[full].sum()
        open_ &= ~full
    return out.tolist()


def _hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Draws without replacement; beyond numpy's range, of their normal limit, which differs by far less than one part in 10,000 there."""
    out = np.zeros_like(good)
    small = good + bad <= _EXACT
    out[small] = rng.hypergeometric(good[small], bad[small], draws[small])
    if not small.all():
        g, b, n = (x[~small].astype(np.float64) for x in (good, bad, draws))
        total = g + b
        spread = np.sqrt(n * (g / total) * (b / total) * (total - n) / np.maximum(total - 1, 1))
        drawn = np.rint(n * (g / total) + spread * rng.standard_normal(len(n)))
        out[~small] = np.clip(drawn, np.maximum(0, n - b), np.minimum(n, g)).astype(np.int64)
    return out


def _draw(rng: np.random.Generator, own: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Multivariate draw of ``draws`` units for each row of ``own``: halves of the sources are split until single ones are left."""
    width = 1 << max(0, (own.shape[1] - 1).bit_length())
    sums = [np.pad(own, ((0, 0), (0, width - own.shape[1])))]
    while sums[-1].shape[1] > 1:
        sums.append(sums[-1][:, 0::2] + sums[-1][:, 1::2])
    need = draws[:, None]
    for level in reversed(sums[:-1]):
        first = _hypergeometric(rng, level[:, 0::2].ravel(), level[:, 1::2].ravel(), need.ravel()).reshape(need.shape)
        need = np.stack([first, need - first], axis=2).reshape(len(own), -1)
    return need[:, : own.shape[1]]


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Splitting tree: a shards x sources table whose columns sum to ``quotas``, shard totals as even as can be.

    Each node draws its first half's quotas from the node's own without replacement;
    the nodes of a level are drawn together.
    """
    if not len(quotas):
        return np.zeros((shards, 0), dtype=np.int64)
    own, first, count, level = np.asarray(quotas, dtype=np.int64)[None, :], [0], [shards], 0
    while max(count) > 1:
        half = np.array([c // 2 for c in count])
        total = own.sum(axis=1)
        draws = np.array([int(t) * int(h) // c for t, h, c in zip(total, half, count)], dtype=np.int64)
        left = _draw(np.random.default_rng([seed, level]), own, draws)
        nodes, own = list(zip(first, count, half.tolist())), np.stack([left, own - left], axis=1).reshape(-1, own.shape[1])
        keep = np.array([c > 0 for _, n, h in nodes for c in (h, n - h)])
        first = [x for f, n, h in nodes for x, c in ((f, h), (f + h, n - h)) if c]
        count = [c for _, n, h in nodes for c in (h, n - h) if c]
        own, level = own[keep], level + 1
    return own[np.argsort(first)]


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` (doc_id, source, text, any others) with size, and h, the hash that places in permuted orders follow from."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumn("size", size).withColumn("h", F.xxhash64("doc_id", "size", F.lit(seed)))


def permuted(block: Column, half: Column, mask: Column, *key: Column) -> Column:
    """Place of a block in an order of 4 ** half blocks: a Feistel permutation whose key is ``key``; ``mask`` has ``half`` bits."""
    left, right = F.call_function("shiftright", block, half), block.bitwiseAND(mask)
    for turn in range(3):
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(turn), *key).bitwiseAND(mask))
    return F.call_function("shiftleft", left, half).bitwiseOR(right)


def mix_plan(docs: DataFrame, weights=WEIGHTS, cap: int = MAX_REPEATS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Which documents a mix takes, how often and into which shard.

    ``docs`` has doc_id, text and source. Returns doc_id, size, source, source_size,
    target, taken and draws array<struct<unit, shard, position>>, one draw for each
    time the document is taken; ordering a shard by position shuffles it.

    Null texts have size 0 and take part with 0 words; texts of any length are counted
    whole; a null source is a source of its own, last in order. Sources by code point
    weigh ``weights``, repeating. Rows that a hash ties, such as repeated rows, are
    taken or left together. An empty table gives an empty plan. Reruns agree: all
    choices follow from ``seed`` and the rows. Other columns are ignored. About 500
    bytes a source are held on the driver.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    rows = materialise(sized(plain, seed).drop("text"), "mix-sizes")
    parameters = mix_parameters(rows, weights, cap, shards, seed)
    drawn = parameters.with_draws(rows)
    taken = (F.col("size") * F.size("draws")).cast("long")
    return drawn.select("doc_id", "size", "source", "p.source_size", "p.target", taken.alias("taken"), "draws")


@dataclass(frozen=True)
class Parameters:
    """A row p per source: its totals, where its draws end, and the draws up to each shard's last."""

    table: DataFrame
    cap: int
    seed: int
    small: bool

    def joined(self, df: DataFrame) -> DataFrame:
        """``df`` with the row p of its source."""
        table = F.broadcast(self.table) if self.small else self.table
        return df.join(table, F.col("source").eqNullSafe(F.col("key")), "inner").drop("key")

    def rank(self, epoch: Column) -> Column:
        """Place of a document's block in the permuted order of a pass."""
        block = F.col("h").bitwiseAND(F.col("p.blocks") - 1)
        return permuted(block, F.col("p.half"), F.col("p.mask"), F.col("p.key"), epoch.cast("int"))

    def takes(self) -> tuple[Column, Column]:
        """Indices of the draws of a document's blocks, and how often it is taken."""
        blocks = F.col("p.blocks")
        passes = [F.when(F.col("p.passes") > e, e * blocks + self.rank(F.lit(e))) for e in range(self.cap)]
        place = self.rank(F.col("p.passes"))
        cut = (place == F.col("p.full")) & F.coalesce(F.col("h") <= F.col("p.h_cut"), F.lit(False))
        partial = F.when((F.col("p.passes") < self.cap) & ((place < F.col("p.full")) | cut), F.col("p.passes") * blocks + place)
        indices = F.array_compact(F.array(*passes, partial))
        tuned = F.try_element_at(F.filter("p.tuned", lambda x: x["h"] == F.col("h")), F.lit(1))["times"]
        return indices, F.coalesce(tuned, F.size(indices))

    def with_draws(self, df: DataFrame) -> DataFrame:
        """Adds p and draws to rows (doc_id, source, size, h): the draws of the document that a leaf of the tree holds."""
        indices, times = self.takes()
        more = F.array_repeat(F.element_at("p.ends", -1) - 1, F.greatest(times - F.size(indices), F.lit(0)))
        both = F.concat(F.slice(indices, F.lit(1), F.least(times, F.size(indices))), more)
        held = F.filter(both, lambda i: i.between(0, F.element_at("p.ends", -1) - 1))

        def draw(index: Column, turn: Column) -> Column:
            leaf = F.size(F.filter("p.ends", lambda end: end <= index))
            shard = F.element_at("p.leaves", leaf + 1)
            return F.struct(index.alias("unit"), shard.alias("shard"), F.xxhash64("doc_id", "h", index, turn, F.lit(self.seed)).alias("position"))

        return self.joined(df).withColumn("draws", F.transform(held, draw))


def nearest_times(sizes: np.ndarray, target: float, cap: int) -> np.ndarray:
    """How often to take each size, 0 to ``cap`` times, so that the sum comes nearest to ``target``: sums are bits of a number."""
    unit = max(1, -(-int(sizes.sum()) * cap // TUNED_SUMS))
    steps = [int(x) for x in sizes // unit]
    reach = [1]
    for x in steps:
        bits = reach[-1]
        for _ in range(cap):
            bits |= reach[-1] | bits << x
        reach.append(bits)
    bits, goal = reach[-1], max(0, round(target / unit))
    below, above = bits & ((1 << (goal + 1)) - 1), bits >> goal
    low = below.bit_length() - 1
    high = goal + (above & -above).bit_length() - 1 if above else low
    left, out = low if goal - low <= high - goal else high, np.zeros(len(steps), dtype=np.int64)
    for i in range(len(steps) - 1, -1, -1):
        while not (left >= 0 and reach[i] >> left & 1):
            left -= steps[i]
            out[i] += 1
    return out


def _prefix(rows: DataFrame, order: str, room: str) -> DataFrame:
    """Sums of (source, order, size, room) by order, those before, and whether the sum still fits into ``room``; a few thousand rows a source."""
    sums = rows.groupBy("source", order).agg(F.sum("size").alias("words"), F.first(room).alias("room"))
    before = F.sum("words").over(W.Window.partitionBy("source").orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1))
    return sums.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("fits", F.col("before") + F.col("words") <= F.col("room"))


def mix_parameters(rows: DataFrame, weights=WEIGHTS, cap: int = MAX_REPEATS, shards: int = SHARDS, seed: int = SEED) -> Parameters:
    """Plan of a mix of (source, size, h): what reaches the driver is a few numbers a source."""
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).toArrow()
    names = found.column("source").to_pylist()
    by_name = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
    found, names = found.take(pa.array(by_name, pa.int64())), [names[i] for i in by_name]
    at = {x: i for i, x in enumerate(names)}
    size, docs = (found.column(c).to_numpy().astype(np.int64) for c in ("size", "docs"))
    target = np.array(targets_of(size.tolist(), [float(weights[i % len(weights)]) for i in range(len(names))], cap), dtype=np.float64)
    passes = np.where(size > 0, np.minimum(cap, target // np.maximum(size, 1)), 0).astype(np.int64)
    gap = np.where((size > 0) & (passes < cap), target - passes * size, 0.0)
    half = np.minimum(MAX_HALF, np.ceil(np.log2(np.maximum(docs, 1)) / 2)).astype(np.int32)
    blocks, keys = 4 ** half.astype(np.int64), np.random.default_rng([seed, 1]).integers(0, 1 << 62, len(names))
    full, h_cut = np.zeros(len(names), np.int64), [None] * len(names)
    tuned: list[list[dict]] = [[] for _ in names]
    tuned_type = pa.list_(pa.struct([("h", pa.int64()), ("times", pa.int32())]))

    def parameters(**more) -> Parameters:
        own = {
            "source_size": pa.array(size), "target": pa.array(target), "passes": pa.array(passes), "half": pa.array(half), "full": pa.array(full),
            "h_cut": pa.array(h_cut, pa.int64()), "tuned": pa.array(tuned, tuned_type), "gap": pa.array(gap), "docs": pa.array(docs),
            "blocks": pa.array(blocks), "mask": pa.array((1 << half.astype(np.int64)) - 1), "key": pa.array(keys), **more,
        }
        table = pa.table({"key": pa.array(names, pa.string()), "p": pa.StructArray.from_arrays(list(own.values()), names=list(own))})
        return Parameters(spark.createDataFrame(table), cap, seed, table.nbytes <= BROADCAST_BYTES)

    def each(df: DataFrame) -> list[tuple[int, dict]]:
        return [(at[r["source"]], r.asDict()) for r in df.collect()]

    # The permuted order of the partial pass: blocks that fit, then, in the next one, documents by their hash, in two steps.
    now = parameters()
    open_ = now.joined(rows).where("p.gap >= 1").withColumn("rank", now.rank(F.col("p.passes"))).withColumn("room", F.col("p.gap"))
    for i, r in each(_prefix(open_, "rank", "room").where("not fits").groupBy("source").agg(F.min_by(F.struct("rank", "before"), "rank").alias("x"))):
        full[i], gap[i] = r["x"]["rank"], gap[i] - r["x"]["before"]
    now = parameters()
    cut = now.joined(rows).where((F.col("p.gap") >= 1) & (now.rank(F.col("p.passes")) == F.col("p.full")))
    cut = materialise(cut.select("source", "size", "h", F.call_function("shiftright", "h", F.lit(52)).alias("part"), F.col("p.gap").alias("room")), "mix-cut")
    parts = _prefix(cut, "part", "room").groupBy("source").agg(
        F.min(F.when(~F.col("fits"), F.struct("part", "before"))).alias("next"), F.max(F.when(F.col("fits"), F.struct("part", F.col("before") + F.col("words")))).alias("last")
    )
    ends = [(i, r["next"], r["last"]) for i, r in each(parts)]
    tail = pa.table({"key": pa.array([names[i] for i, x, _ in ends if x], pa.string()), "own": pa.array([x["part"] for _, x, _ in ends if x], pa.int64()), "left": pa.array([gap[i] - x["before"] for i, x, _ in ends if x], pa.float64())})
    inside = cut.drop("room").join(spark.createDataFrame(tail), F.col("source").eqNullSafe(F.col("key")) & (F.col("part") == F.col("own")))
    held = {i: r["x"] for i, r in each(_prefix(inside, "h", "left").where("fits").groupBy("source").agg(F.max(F.struct("h", (F.col("before") + F.col("words")).alias("words"))).alias("x")))}
    for i, following, last in ends:
        if i in held:
            h_cut[i], gap[i] = held[i]["h"], gap[i] - (following["before"] if following else 0) - held[i]["words"]
        elif following and following["before"] or not following:
            # Whole parts fit, of the next none of its documents does.
            part = following["part"] - 1 if following else last["part"]
            h_cut[i], gap[i] = (part << 52) + (1 << 52) - 1, gap[i] - (following["before"] if following else last["col2"])
    discard(cut)

    # Of each source about TUNED documents by a hash, all of them if it has no more, and the one whose size is nearest to what is left.
    now = parameters()
    able = now.joined(rows).where((F.col("size") >= 1) & (F.abs("p.gap") >= 1)).withColumn("times", now.takes()[1])
    turn = F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    some = able.where(turn < F.lit(1.5 * TUNED) / F.col("p.docs")).groupBy("source", "h").agg(F.sum("size").alias("size"), F.first("times").alias("times"), F.first("p.gap").alias("gap"))
    first = F.row_number().over(W.Window.partitionBy("source").orderBy(F.xxhash64("h", F.lit(seed))))
    off = F.struct(F.abs(F.col("p.gap") - F.col("size")), "h")
    one = able.where("times < 1").groupBy("source").agg(F.min(F.struct(off, F.struct("h", "size", "times", "p.gap"))).alias("x")).select("source", "x.col2.*")
    both = some.withColumn("n", first).where(f"n <= {TUNED}").drop("n").unionByName(one).groupBy("source", "h").agg(*[F.max(c).alias(c) for c in ("size", "times", "gap")])

    def tune(group: pa.Table) -> pa.Table:
        group = group.sort_by("h")
        sizes, times = group.column("size").to_numpy(), group.column("times").to_numpy()
        best = nearest_times(sizes, group.column("gap")[0].as_py() + float(sizes @ times), cap)
        return pa.table({"source": group.column("source"), "h": group.column("h"), "times": pa.array(best.astype(np.int32))})

    for i, r in each(both.groupBy("source").applyInArrow(tune, "source string, h long, times int")):
        tuned[i].append({"h": r["h"], "times": r["times"]})

    quotas = passes * blocks + full + np.array([h is not None for h in h_cut]) + np.array([len(x) > 0 for x in tuned])
    dealt = split_quotas(quotas, shards, seed)
    # Leaves that hold draws of a source, in an order of its own, and its draws up to the last of each.
    orders = np.random.default_rng([seed, 2]).permuted(np.broadcast_to(np.arange(shards, dtype=np.int32), dealt.T.shape), axis=1)
    leaves = [x[dealt[x, i] > 0] for i, x in enumerate(orders)]
    ends_of = [np.cumsum(dealt[x, i]) for i, x in enumerate(leaves)]
    nobody = np.zeros(1, np.int64)
    return parameters(
        leaves=pa.array([x if len(x) else nobody.astype(np.int32) for x in leaves], pa.list_(pa.int32())),
        ends=pa.array([x if len(x) else nobody for x in ends_of], pa.list_(pa.int64())),
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the shard and position of each draw of every document."""
    plan = mix_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.col("draws.shard").alias("shards"), F.col("draws.position").alias("positions"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, dealt to shards and shuffled within them.

    The draws follow from a document's own id, size and source, so its text moves
    once, to its shard, a task each. Nulls, ties, repeated rows, long texts and empty
    tables count as in :func:`mix_plan`. Columns of ``docs`` are returned as they are,
    whatever their names.
    """
    shards = max(SHARDS, shuffle_partitions(spark))
    keys = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").alias("text")]
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("own")
    parameters = mix_parameters(materialise(sized(docs.select(*keys), SEED).drop("text"), "mix-sizes"), shards=shards)
    drawn = parameters.with_draws(sized(docs.select(*keys, own), SEED))
    dealt = drawn.select("own", F.explode("draws").alias("draw")).select("own", "draw.shard", "draw.position")
    return (
        dealt.repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("shard", "position")
        .select([F.col(f"own.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    )
