"""Embedding near-duplicates by sorted projection passes.

Equal vectors of a label are one class. In each pass a class gets a key of the signs
of its vector, less the mean of its label, on random directions; classes are
range-sorted by (label, key) and each is compared with the next ``window`` ones, also
over the ends of partitions. Verified pairs of all passes are united into components.
Within a component the links are then counted exactly, tile by tile, so that a group
larger than any window loses no link.

How many passes a label takes follows from its size and from how close its vectors
lie to their mean: of a pair at the threshold, the rests after subtracting the mean
share a sign with probability 1 - angle / pi, and so many bits narrow the label to a
window. The outcome is measured in each label by planted partners: some of its classes get
one at the threshold, which takes part in the sort alone, and counts as seen if it comes
within a window of its class. A label that sees too few of them gets more passes with new
directions; one that would take too many is compared as a whole, tile by tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwind.llm.common import materialise, shuffle_partitions
from helmwind.llm.components import connected_components

THRESHOLD = 0.98
WINDOW = 512
KEY_BITS = 64
#: Expected share of pairs at the threshold that a label's passes leave unseen; labels that need more passes than these are compared whole.
MISS, MOST_PASSES = 2e-3, 160
#: About so many classes of a label get a planted partner; the share of partners that must be seen, and rounds of passes.
PLANTED, RECALL, ROUNDS = 128, 0.99, 3
#: Least and most classes of one side of a comparison of tiles, and tiles that a component is cut into where they allow it.
TILE, LARGE_TILE, TILES = 256, 2048, 8
SEED = 77


def passes_needed(size: int, closeness: float = 0.0, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold is unseen with probability ``miss``; ``closeness`` is the squared length of the label's mean."""
    rest = max(1e-3, 1.0 - closeness)
    agree = 1 - math.acos(min(1.0, max(0.0, 1 - (1 - threshold) / rest))) / math.pi
    bits = max(0.0, math.log2(max(size, 1) / window)) + 1
    return min(1 << 30, max(2, math.ceil(math.log(miss) / math.log1p(-min(agree**bits, 1 - 1e-9)) if agree**bits > 1e-12 else 1 << 30)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as they are; all have the same number of components."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _units(rows: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, without overflow or underflow of squares."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return a @ b.T >= threshold


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def find_edges(units: np.ndarray, ids: np.ndarray, fresh: int, window: int, threshold: float) -> list[tuple[int, int]]:
    """Edges that span the linked neighbours of a sorted run; rows before ``fresh`` were compared among themselves.

    Products are blocks of 256 rows, so that a worker holds a few megabytes of them.
    """
    n, parent, edges = len(ids), list(range(len(ids))), []
    for s in range(0, n, 256):
        e = min(n, s + 256)
        to = min(n, e + window)
        if to <= fresh:
            continue
        rows, cols = np.nonzero(_linked(units[s:e], units[s:to], threshold))
        keep = (cols > rows) & (cols - rows <= window)
        for i, j in zip((rows[keep] + s).tolist(), (cols[keep] + s).tolist()):
            a, b = _root(parent, i), _root(parent, j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((int(ids[i]), int(ids[j])))
    return edges


def classes_of(vectors: DataFrame) -> DataFrame:
    """(label, embedding, dim, rep, copies): one row per distinct comparable vector of a label."""
    fine = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    ) & F.exists("embedding", lambda x: x != 0)
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    return (
        usable.groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
        .withColumn("dim", F.size("embedding"))
    )


def label_passes(classes: DataFrame, threshold: float, window: int) -> DataFrame:
    """(label, dim, n, mean, passes) of each label and dimension; tasks sum before anything moves."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table({"label": batch.column(0), "dim": batch.column(2), "i": pa.array(np.arange(batch.num_rows))})
            groups = table.group_by(["label", "dim"]).aggregate([("i", "list")])
            at = [x.as_py() for x in groups.column("i_list")]
            totals = [_units(_matrix(batch.column(1).take(pa.array(i)))).sum(axis=0) for i in at]
            yield pa.RecordBatch.from_arrays(
                [groups.column("label").combine_chunks(), groups.column("dim").combine_chunks(), pa.array([len(i) for i in at], pa.int64()), pa.array(totals, pa.list_(pa.float64()))],
                names=["label", "dim", "n", "total"],
            )

    label = classes.schema["label"].dataType.simpleString()
    parts = classes.select("label", "embedding", "dim").mapInArrow(sums, f"label {label}, dim int, n long, total array<double>")
    each = parts.select("label", "dim", "n", F.posexplode("total").alias("at", "x")).groupBy("label", "dim", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("at", (F.col("x") / F.col("n")).alias("x")))), lambda v: v["x"])
    means = each.groupBy("label", "dim").agg(F.max("n").alias("n"), mean.alias("mean"))

    @F.pandas_udf("int")
    def passes(n, mean):
        return n.combine(mean, lambda k, m: passes_needed(k, float(np.dot(m, m)), threshold, window)).astype("int32")

    return means.select("label", "dim", "n", "mean", passes("n", "mean").alias("passes"))


def with_planted(classes: DataFrame, means: DataFrame, window: int) -> DataFrame:
    """Classes of the labels in ``means`` with mean, passes and whether they get a partner; a label within a window needs none, it is compared whole."""
    drawn = F.pmod(F.xxhash64("rep", F.lit(SEED)), F.col("n")) < PLANTED
    joined = classes.select("label", "embedding", "rep", "dim").join(means, ["label", "dim"])
    return joined.withColumn("planted", (F.col("n") > window) & (F.col("dim") > 1) & drawn)


def partners(units: np.ndarray, reps: np.ndarray, threshold: float) -> np.ndarray:
    """For each unit vector one at the threshold, in a direction that its id draws."""
    across = np.stack([np.random.default_rng([SEED, rep & ((1 << 63) - 1)]).standard_normal(units.shape[1]) for rep in reps.tolist()])
    across -= np.einsum("ij,ij->i", across, units)[:, None] * units
    return threshold * units + math.sqrt(1 - threshold**2) * across / np.linalg.norm(across, axis=1, keepdims=True)


def pass_edges(classes: DataFrame, means: DataFrame, threshold: float, window: int, turn: int, kind) -> DataFrame:
    """Edges (a, b) that a round of sorted passes finds between classes."""
    return sorted_passes(classes, means, threshold, window, turn, kind).where("b is not null")


def sorted_passes(classes: DataFrame, means: DataFrame, threshold: float, window: int, turn: int, kind) -> DataFrame:
    """Edges (a, b) that a round of sorted passes finds, and (a, null) for each class whose planted partner came within a window of it."""
    n = shuffle_partitions(classes.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims, most = whole.column(3).to_numpy(), whole.column(5).to_numpy()
            for dim, passes in sorted(set(zip(dims.tolist(), most.tolist()))):
                batch = whole.filter(pa.array((dims == dim) & (most == passes)))
                rows, mean = _matrix(batch.column(1)).astype(kind), _matrix(batch.column(4))
                units, raw = _units(rows), [x.tobytes() for x in rows]
                drawn = np.flatnonzero(batch.column(6).to_numpy(zero_copy_only=False))
                rest = units - mean
                if len(drawn):
                    rest = np.concatenate([rest, partners(units[drawn], batch.column(2).to_numpy()[drawn], threshold) - mean[drawn]])
                every = pa.array(np.concatenate([np.arange(len(rows)), drawn]))
                held = pa.array([*raw, *[None] * len(drawn)], pa.binary())
                for p in range(passes):
                    planes = np.random.default_rng([SEED, dim, turn, p]).standard_normal((dim, KEY_BITS))
                    packed = np.packbits(rest @ planes > 0, axis=1)
                    label, dimension, rep = (batch.column(i).take(every) for i in (0, 3, 2))
                    key = pa.array([x.tobytes() for x in packed], pa.binary())
                    columns = [pa.array(np.full(len(every), p, np.int32)), label, dimension, key, rep, held]
                    yield pa.RecordBatch.from_arrays(columns, names=["pass", "label", "dim", "key", "rep", "vector"])

    label = classes.schema["label"].dataType.simpleString()
    run = f"pass int, label {label}, dim int, key binary, rep long, vector binary"
    keyed = with_planted(classes, means, window)
    keyed = keyed.select("label", "embedding", "rep", "dim", "mean", "passes", "planted").mapInArrow(keys, run)

    def compared(runs: list, ids: list, vectors: list, fresh: int) -> list[tuple[int, int | None]]:
        """Rows without a vector are partners: they stand between the others and count for nothing but their class."""
        found: list[tuple[int, int | None]] = []
        cuts = [i for i in range(1, len(runs)) if runs[i] != runs[i - 1]]
        for s, e in zip([0, *cuts], [*cuts, len(runs)]):
            if e - s < 2 or e <= fresh:
                continue
            real = [i for i in range(s, e) if vectors[i] is not None]
            if len(real) > 1:
                units = _units(np.frombuffer(b"".join([vectors[i] for i in real]), dtype=kind).reshape(len(real), -1))
                found += find_edges(units, np.array([ids[i] for i in real]), int(np.searchsorted(real, fresh)), window, threshold)
            if len(real) < e - s:
                planted, place = [i for i in range(s, e) if vectors[i] is None], {ids[i]: k for k, i in enumerate(real)}
                ranks = np.searchsorted(real, planted).tolist()
                found += [(ids[i], None) for i, rank in zip(planted, ranks) if -window <= place.get(ids[i], rank + window) - rank < window]
        return found

    names = ["a", "b", "border", "side", "at", "pass", "label", "dim", "rep", "vector"]
    schema = f"a long, b long, border int, side int, at int, pass int, label {label}, dim int, rep long, vector binary"
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), None, pa.int32(), pa.int64(), pa.binary()]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows; the last ``window`` of a batch are compared again with what follows. The first and last of a partition go out to meet their neighbours'."""
        runs, ids, vectors, kinds = [], [], [], list(types)
        own, heads, head_size = TaskContext.get().partitionId(), 0, 0

        def rows(found, border):
            columns = list(zip(*[(*e, *[None] * 8) for e in found], *[(None, None, *x) for x in border])) or [()] * 10
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for batch in batches:
            kinds[6] = batch.schema.field(1).type
            fresh = len(ids)
            runs += zip(*(batch.column(k).to_pylist() for k in range(3)))
            ids += batch.column(4).to_pylist()
            vectors += batch.column(5).to_pylist()
            found, new = compared(runs, ids, vectors, fresh), []
            for i in range(fresh, len(ids)):
                if heads == window:
                    break
                new.append((own, 1, head_size + len(new), *runs[i], ids[i], vectors[i]))
                heads += vectors[i] is not None
            head_size += len(new)
            yield rows(found, new)
            real = [i for i in range(len(ids)) if vectors[i] is not None]
            cut = real[-window] if len(real) > window else 0
            runs, ids, vectors = runs[cut:], ids[cut:], vectors[cut:]
        if ids:
            yield rows([], [(own + 1, 0, i, *runs[i], ids[i], vectors[i]) for i in range(len(ids))])

    def meet(table: pa.Table) -> pa.Table:
        """The last rows of a partition and the first of the next one."""
        table = table.sort_by([("side", "ascending"), ("at", "ascending")])
        runs = list(zip(*(table.column(k).to_pylist() for k in ("pass", "label", "dim"))))
        fresh = int((table.column("side").to_numpy() == 0).sum())
        found = compared(runs, table.column("rep").to_pylist(), table.column("vector").to_pylist(), fresh)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    order = ["pass", "label", "dim", "key"]
    found = materialise(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(compare, schema), "embed-found-pairs")
    across = found.where("border is not null").groupBy("border").applyInArrow(meet, "a long, b long")
    return found.where("border is null").select("a", "b").unionByName(across)


def unseen_labels(classes: DataFrame, means: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """Labels of ``means`` of whose planted partners too few were seen."""
    seen = found.where("b is null").select(F.col("a").alias("rep")).distinct().withColumn("seen", F.lit(True))
    planted = with_planted(classes, means, window).where("planted").select("label", "dim", "rep").join(seen, "rep", "left")
    counts = planted.groupBy("label", "dim").agg(F.count("*").alias("planted"), F.count("seen").alias("seen"))
    short = counts.where(F.col("seen") < RECALL * F.col("planted")).select(F.col("label").alias("short"), F.col("dim").alias("short_dim"))
    return means.join(short, (F.col("label") == F.col("short")) & (F.col("dim") == F.col("short_dim")), "left_semi")


def whole_edges(classes: DataFrame, means: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that span the links of whole labels, by comparing tiles of them pairwise: exact, and quadratic in a label's classes."""
    n = shuffle_partitions(classes.sparkSession)
    tiles = F.ceil(F.col("n") / LARGE_TILE).cast("int")
    tiled = classes.select("label", "embedding", "rep", "dim").join(means.select("label", "dim", tiles.alias("tiles")), ["label", "dim"])
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    meet = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "label", "dim", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "rep", "embedding"
    )

    def link(table: pa.Table) -> pa.Table:
        tile, reps = table.column("tile").to_numpy(), table.column("rep").to_numpy()
        units = _units(_matrix(table.column("embedding").combine_chunks()))
        first, second = np.flatnonzero(tile == table.column("lo")[0].as_py()), np.flatnonzero(tile == table.column("hi")[0].as_py())
        parent, edges = list(range(len(reps))), []
        for s in range(0, len(first), 256):
            rows, cols = np.nonzero(_linked(units[first[s : s + 256]], units[second], threshold))
            for i, j in zip(first[rows + s].tolist(), second[cols].tolist()):
                a, b = _root(parent, i), _root(parent, j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    edges.append((int(reps[i]), int(reps[j])))
        pairs = np.array(edges, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    keys = ["label", "dim", "lo", "hi"]
    return meet.repartition(n, *keys).groupBy(*keys).applyInArrow(link, "a long, b long")


def linked_classes(classes: DataFrame, threshold: float, window: int, kind) -> DataFrame:
    """Edges (a, b) between classes from rounds of passes, and from whole labels where passes do not see what is planted."""
    means = materialise(label_passes(classes, threshold, window), "embed-means")
    whole, todo, edges = means.where(F.col("passes") > MOST_PASSES), means.where(F.col("passes") <= MOST_PASSES), None
    for turn in range(ROUNDS):
        found = materialise(sorted_passes(classes, todo, threshold, window, turn, kind), f"embed-round-{turn}")
        own = found.where("b is not null")
        edges = own if edges is None else edges.unionByName(own)
        short = materialise(unseen_labels(classes, todo, found, window).withColumn("passes", 2 * F.col("passes")), "embed-short")
        last = turn == ROUNDS - 1
        whole = whole.unionByName(short if last else short.where(F.col("passes") > MOST_PASSES))
        todo = short.where(F.col("passes") <= MOST_PASSES)
        if last or todo.isEmpty():
            break
    whole = materialise(whole, "embed-whole")
    return edges if whole.isEmpty() else edges.unionByName(whole_edges(classes, whole, threshold))


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """Links and components of (vec_id, embedding, label).

    Returns (vec_id, n_links, component_id, kept), a row per input row. Rows compare
    only with equal labels that are not null and with equal dimensions. Null, empty
    and zero vectors, vectors with null or non-finite components and rows without a
    vec_id link with nothing. Repeated rows are copies of each other and link; equal
    keys are sorted anyhow; vectors of any length are read whole; an empty table gives
    an empty result; other columns are ignored. Labels that passes would not serve
    are compared whole, which is quadratic in their classes.
    """
    spark = vectors.sparkSession
    n = shuffle_partitions(spark)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind, cast = (np.float32, "array<float>") if single else (np.float64, "array<double>")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(cast).alias("embedding"), "label")
    classes = materialise(classes_of(base), "embed-classes")
    roots = connected_components(materialise(linked_classes(classes, threshold, window, kind), "embed-edges"), "embed-cc")

    # Exact counts within components: tiles of a component meet pairwise, each pair of tiles is one task's matrix product.
    member = classes.join(roots, classes.rep == roots.node, "left").select(
        "label", "embedding", "dim", "rep", "copies", F.coalesce("component", "rep").alias("component_id")
    )
    member = materialise(member, "embed-members")
    sizes = member.groupBy("component_id").agg(F.count("*").alias("classes")).where("classes > 1")
    side = F.greatest(F.lit(TILE), F.least(F.lit(LARGE_TILE), F.col("classes") / TILES))
    tiled = member.join(sizes.repartition(n), "component_id").withColumn("tiles", F.ceil(F.col("classes") / side).cast("int"))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    meet = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "component_id",
        F.least("tile", "other").alias("lo"),
        F.greatest("tile", "other").alias("hi"),
        "tile",
        "rep",
        "copies",
        "embedding",
    )

    def count(table: pa.Table) -> pa.Table:
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        tile = table.column("tile").to_numpy()
        units = _units(_matrix(table.column("embedding").combine_chunks()))
        copies, reps = table.column("copies").to_numpy(), table.column("rep").to_numpy()
        first, second = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
        links = np.zeros(len(reps), dtype=np.int64)
        for s in range(0, len(first), 512):
            own = first[s : s + 512]
            near = _linked(units[own], units[second], threshold)
            near &= reps[own][:, None] != reps[second][None, :]
            links[own] += near @ copies[second]
            if lo != hi:
                links[second] += near.T @ copies[own]
        return pa.table({"rep": pa.array(reps), "others": pa.array(links)})

    dealt = meet.repartition(n, "component_id", "lo", "hi")  # else all tiles of a component stay where the join left them
    others = dealt.groupBy("component_id", "lo", "hi").applyInArrow(count, "rep long, others long").groupBy("rep").agg(F.sum("others").alias("others"))
    found = member.join(others.withColumnRenamed("rep", "orep"), F.col("rep") == F.col("orep"), "left").select(
        F.col("label").alias("clabel"),
        F.col("embedding").alias("cembedding"),
        "component_id",
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
    )
    found = materialise(found, "embed-found")
    joined = base.join(found, (F.col("label") == F.col("clabel")) & (F.col("embedding") == F.col("cembedding")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
