"""Connected components by alternating large-star and small-star rounds over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helmwind.llm.common import discard, materialise, shuffle_partitions


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One round: each node's kept neighbours are tied to the smallest id of its neighbourhood.

    The minimum is a partial aggregate and the join has a plain exchange on both
    sides, so a hub with very many neighbours is split by the skew join.
    """
    n = shuffle_partitions(edges.sparkSession)
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if both_ways:
        near = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = down
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    keep = near.where("v > u") if both_ways else near
    moved = keep.join(low.repartition(n), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not both_ways:
        moved = moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Components of an undirected edge table (a, b) of longs.

    Returns (node, component) for every node that is not its component's smallest
    id; a node that is absent is its own component. Self loops, repeated edges and
    an empty table are allowed; edges with a null end are ignored. Each round is
    written to the shared folder; only two numbers a round reach the driver. Rounds go
    on until one changes nothing, which takes about the square of the logarithm of the
    longest path at most.
    """
    current = materialise(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), name)
    digest = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    last = current.agg(digest.alias("d")).head()["d"]
    while last[0]:
        before, current = current, materialise(_star(_star(current, True), False), name)
        discard(before)
        now = current.agg(digest.alias("d")).head()["d"]
        if now == last:
            break
        last = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
