"""Near-duplicates by exact similarity of word shingles.

A text is the set of its runs of five words, and texts link where the Jaccard
similarity of their sets is four fifths or more. No pair that links is missed:

* equal sets are one class;
* of two linked sets, ordered alike, the first ``m`` common shingles lie in the
  first ``n - need(n) + m`` of each, so a set stays only if enough of its first
  shingles occur in other sets too (packed requests answer that, as in op6);
* the sets left are ordered by frequency, rare first: linked sets share a shingle
  of their prefixes, which ties them into one group of candidates;
* groups are compared pairwise on whole sets, tile by tile, each pair of tiles in one task.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helmwind.llm.common import hash_spans, materialise, mix64, shuffle_partitions, slices, text_buffer, window_hashes, word_spans
from helmwind.llm.components import connected_components
from helmwind.llm.substring_dedup import BUCKET_NAMES, REQUEST_DDL, _flags, _requests, answered, steps_needed

WIDTH = 5
#: Least similarity, as a fraction.
NUM, DEN = 4, 5
#: Sets and shingles of one side of a comparison of tiles.
TILE, TILE_SHINGLES = 1024, 1 << 20
#: Buckets that a slice of texts sends its shingles to in one step.
FAN = 64


def need(n):
    """Least shingles that a set of ``n`` shares with a linked one."""
    return -(-NUM * n // DEN)


def _common(n):
    return np.maximum(1, n // 4)


def probe_size(n):
    """Shingles of a set that are looked up."""
    return np.minimum(n, n - need(n) + _common(n))


def probe_hits(n):
    """Looked-up shingles that a linked set holds at least, whatever its size."""
    return _common(need(n))


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, a wordless one has none."""
    data, offsets = text_buffer(column)
    starts, ends, at = word_spans(data, offsets)
    words = hash_spans(data, starts, ends)
    runs = window_hashes(words, width)
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        if e - s >= width:
            yield np.unique(runs[s : e - width + 1])
        else:
            yield window_hashes(words[s:e], e - s, seed=e - s) if e > s else np.zeros(0, np.uint64)


def _signature(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _probes(batches: Iterator[pa.RecordBatch], fingerprint: Callable[[bytes], int] | None = None) -> Iterator[pa.RecordBatch]:
    """A row per slice of texts: ids, signatures and sizes of its sets, the shingles to look up, and fingerprints if asked for, else zeros."""
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64())]
    for batch in batches:
        for s, e in slices(batch.column(1)):
            sigs, sizes, probes = [], [], []
            for own in shingle_sets(batch.column(1).slice(s, e - s)):
                sigs.append(_signature(own))
                sizes.append(len(own))
                probes.append(own[np.argsort(mix64(own))[: int(probe_size(np.int64(len(own))))]].tobytes())
            fps = [fingerprint(x.as_buffer().to_pybytes()) if fingerprint else 0 for x in batch.column(1).slice(s, e - s)]
            fps = np.array(fps, dtype=np.uint64).view(np.int64)
            row = [int.from_bytes(os.urandom(8), "little") >> 1, batch.column(0).slice(s, e - s).to_pylist(), sigs, sizes, b"".join(probes), fps]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=["c", "ids", "sigs", "sizes", "probe", "fps"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s, e in slices(batch.column(1)):
            found = list(shingle_sets(batch.column(1).slice(s, e - s)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(s, e - s),
                    pa.array([_signature(x) for x in found], pa.binary()),
                    pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())),
                ],
                names=["doc_id", "sig", "shingles"],
            )


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def link_sets(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, block: int = 4096) -> list[tuple[int, int]]:
    """Positions of linked sets, one of ``first`` and one of ``second``: edges that span the groups they form."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, name, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[name] > 1
    owner, name = owner[shared], (np.cumsum(count > 1) - 1)[name[shared]]
    order = np.argsort(name, kind="stable")
    owner, name = owner[order], name[order]
    both = np.zeros((len(first), len(second)), dtype=np.float32)
    for at in range(0, int(name[-1]) + 1 if len(name) else 0, block):
        s, e = np.searchsorted(name, [at, at + block])
        held = np.zeros((len(sets), block), dtype=np.float32)
        held[owner[s:e], name[s:e] - at] = 1
        both += held[first] @ held[second].T
    common = np.rint(both).astype(np.int64)
    near = DEN * common >= NUM * (sizes[first][:, None] + sizes[second][None, :] - common)
    parent, edges = list(range(len(sets))), []
    for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
        i, j = int(first[i]), int(second[j])
        a, b = _root(parent, i), _root(parent, j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            edges.append((i, j))
    return edges


def _compare(table: pa.Table) -> pa.Table:
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    tile, reps = table.column("tile").to_numpy(), table.column("rep").to_numpy()
    shingles = table.column("shingles").combine_chunks()
    ends = np.cumsum(shingles.value_lengths().to_numpy(zero_copy_only=False))
    sets = np.split(shingles.flatten().to_numpy(), ends[:-1])
    edges = np.array(link_sets(sets, np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)), dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(reps[edges[:, 0]], pa.int64()), "b": pa.array(reps[edges[:, 1]], pa.int64())})


def _candidates(texts: DataFrame, chunks: DataFrame, fan: int = FAN, bucket_names: int = BUCKET_NAMES) -> DataFrame:
    """(rep, shingles) of the classes of which enough looked-up shingles occur in another set as well."""
    senders, total = chunks.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("probe")), F.lit(0))).head()
    steps = steps_needed(total // 8, fan, bucket_names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, probe in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _requests(c, np.frombuffer(probe, np.uint64), None, fan).to_batches()

    def judge(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids = table.column("ids").combine_chunks().flatten()
        sizes = table.column("sizes").combine_chunks().flatten().to_numpy().astype(np.int64)
        flags = _flags(answers, np.frombuffer(table.column("probe")[0].as_py(), np.uint64), None)
        ends = np.cumsum(probe_size(sizes))
        hits = np.diff(np.r_[0, np.cumsum(flags)][np.r_[0, ends]])
        return pa.table({"id": ids.filter(pa.array((sizes > 0) & (hits >= probe_hits(sizes))))})

    answers = answered(chunks.select("c", "probe").mapInArrow(ask, REQUEST_DDL), senders, steps, fan)
    packed = chunks.select("c", "ids", "sizes", "probe")
    alive = materialise(packed.groupBy("c").cogroup(answers.groupBy("c")).applyInArrow(judge, "id long").distinct(), "near-alive")
    sets = texts.join(alive, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(_sets, "doc_id long, sig binary, shingles array<long>")
    return materialise(sets.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("shingles").alias("shingles")).where("size(shingles) > 0"), "near-sets")


def _edges(live: DataFrame) -> DataFrame:
    """Edges (a, b) that span the groups of linked classes of (rep, shingles)."""
    n = shuffle_partitions(live.sparkSession)
    each = live.select("rep", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1")
    held = each.join(often, "shingle").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("held"))
    least = F.ceil(F.col("n") * NUM / F.lit(DEN)).cast("int")
    rare = held.where(F.size("held") >= least).select("rep", F.explode(F.slice("held", F.lit(1), F.size("held") - least + 1)).alias("x"))
    prefix = materialise(rare.select("rep", F.col("x.shingle").alias("shingle")), "near-prefix")
    heads = prefix.groupBy("shingle").agg(F.min("rep").alias("head"))
    groups = connected_components(prefix.join(heads, "shingle").select(F.col("rep").alias("a"), F.col("head").alias("b")), "near-groups")

    tied = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
    member = materialise(live.join(tied, live.rep == tied.node).select("component", "rep", "shingles"), "near-members")
    sizes = member.groupBy("component").agg(F.count("*").alias("sets"), F.sum(F.size("shingles")).alias("all"))
    tiles = F.ceil(F.greatest(F.col("sets") / F.lit(TILE), F.col("all") / F.lit(TILE_SHINGLES))).cast("int")
    tiled = member.join(sizes.select("component", tiles.alias("tiles")).repartition(n), "component")
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    meet = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "component", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "rep", "shingles"
    )
    return meet.repartition(n, "component", "lo", "hi").groupBy("component", "lo", "hi").applyInArrow(_compare, "a long, b long")


def shingle_components(
    docs: DataFrame, fingerprint: Callable[[bytes], int] | None = None, linked: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(doc_id, component_id) of the rows of (doc_id, text) with an id; component_id is the smallest doc_id reachable through links.

    Case is ignored. Null and wordless texts link with each other; repeated rows are kept; texts are read
    whole, a long one as one row of one task; an empty table gives an empty result; other columns are ignored.
    ``fingerprint`` of a text's lower-cased bytes and ``linked``, which takes each fingerprint and its smallest doc_id (fp, rep)
    to edges (a, b) of these, add the links of fingerprints.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    texts = texts.where("doc_id is not null")
    ddl = "c long, ids array<long>, sigs array<binary>, sizes array<int>, probe binary, fps array<long>"
    chunks = materialise(texts.mapInArrow(lambda batches: _probes(batches, fingerprint), ddl), "near-probes")
    rows = chunks.select(F.inline(F.arrays_zip(F.col("ids").alias("doc_id"), F.col("sigs").alias("sig"), F.col("fps").alias("fp"))))
    classes = rows.groupBy("sig").agg(F.min("doc_id").alias("rep"))
    edges = _edges(_candidates(texts, chunks))
    if fingerprint:
        values = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "near-values")
        # A text ties the class of its set to the class of its fingerprint.
        both = rows.select("sig", "fp").distinct().join(classes, "sig").join(values.withColumnRenamed("rep", "other"), "fp")
        ties = both.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b"))
        edges = edges.unionByName(linked(values)).unionByName(ties)
    roots = connected_components(edges, "near-cc")
    labelled = classes.join(roots, classes.rep == roots.node, "left").select("sig", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(materialise(labelled, "near-roots"), "sig").select("doc_id", "component_id")
