"""SimHash near-duplicates: 64-bit fingerprints of word shingles, bit-sliced comparison, components.

Fingerprints are compared once per distinct value. Eight blocks of eight bits:
two values within two bits agree on at least six blocks, so 28 keys of 48 bits
meet every linked pair, and a key's group holds at most 2**16 distinct values
whatever the data. Within a group the differing bits are stored as bit planes
and distances are counted by carry-save counters, 64 values a machine word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwind.llm.common import documents, materialise, shuffle_partitions
from helmwind.llm.components import connected_components
from helmwind.llm.near_dup import shingle_components

SHINGLE = 3
RADIUS = 2
BLOCKS, BLOCK_BITS = 8, 8
XX_SEED = 42


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Bit set where over half of the shingle hashes set it; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), XX_SEED)]
    else:
        line = b" ".join(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        ends = np.cumsum(sizes) - 1
        starts = (ends - sizes + 1)[: len(words) - width + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s:e], XX_SEED) for s, e in zip(starts, ends[width - 1 :].tolist())]
    votes = np.zeros(64, dtype=np.int64)
    every = np.array(hashes, dtype="<u8")
    for at in range(0, len(every), 4096):
        part = every[at : at + 4096]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(every), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        got = np.zeros(len(texts), dtype=np.uint64)
        for i, text in enumerate(texts):
            value = text.as_buffer() if text.is_valid else None
            got[i] = fingerprint(value.to_pybytes()) if value is not None else 0
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): ``fp`` is the fingerprint as a signed 64-bit long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _fingerprints, "doc_id long, fp long"
    )


def _within(values: np.ndarray, radius: int, tile: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions i > j within ``radius`` bits, by bit planes and carry-save counters.

    A block of queries is abandoned as soon as all its distances exceed the radius.
    """
    m = len(values)
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.flatnonzero((bits != bits[0]).any(axis=0))
    words = -(-m // 64)
    padded = np.zeros((words * 64, len(planes)), dtype=np.uint8)
    padded[:m] = bits[:, planes]
    sliced = np.packbits(np.ascontiguousarray(padded.T), axis=1, bitorder="little").view("<u8")  # planes x words
    digits = int(radius).bit_length() + 1
    tile = max(16, min(tile, (1 << 20) // words))
    for at in range(0, m, tile):
        stop = min(m, at + tile)
        used = -(-stop // 64)  # earlier positions only
        counter = [np.zeros((stop - at, used), dtype=np.uint64) for _ in range(digits)]
        over = np.zeros((stop - at, used), dtype=np.uint64)
        flip = -(bits[at:stop][:, planes].astype(np.int64))
        for p in range(len(planes)):
            carry = sliced[p, :used][None, :] ^ flip[:, p].astype(np.uint64)[:, None]
            for k in range(digits):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if p % 8 == 7 and not np.any(~(over | _above(counter, radius))):
                break
        near = ~(over | _above(counter, radius))
        hit = np.unpackbits(np.ascontiguousarray(near).view(np.uint8), axis=1, bitorder="little")
        rows, cols = np.nonzero(hit[:, : min(stop, used * 64)])
        keep = cols < rows + at
        yield rows[keep] + at, cols[keep]


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds ``radius``."""
    out = np.zeros_like(counter[0])
    equal = ~out
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            out = out | (equal & counter[k])
            equal = equal & ~counter[k]
    return out


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def link_group(values: np.ndarray, ids: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges that span the groups of linked values; at most len(values) - 1."""
    parent, edges = np.arange(len(values)), []
    for rows, cols in _within(values, radius):
        for i, j in zip(rows.tolist(), cols.tolist()):
            a, b = _root(parent, i), _root(parent, j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((int(ids[i]), int(ids[j])))
    return edges


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key; a group may run over batch ends, so its tail is carried."""
    tail: list[np.ndarray] | None = None

    def out(edges):
        pairs = np.array(edges, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def groups(key, fp, ids):
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
        edges = []
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            edges += link_group(fp[s:e].view(np.uint64), ids[s:e])
        return edges

    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if tail is not None:
            now = [np.concatenate(x) for x in zip(tail, now)]
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0], now[0][-1]))
        tail = [x[last:].copy() for x in now]
        if last:
            yield out(groups(*(x[:last] for x in now)))
    if tail is not None and len(tail[0]):
        yield out(groups(*tail))


def block_keys(fp: F.Column) -> F.Column:
    """The 28 keys of six agreeing blocks, each as one long."""
    keys = []
    for n, gone in enumerate(combinations(range(BLOCKS), 2)):
        mask = 0
        for b in set(range(BLOCKS)) - set(gone):
            mask |= 0xFF << (b * BLOCK_BITS)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(fp.bitwiseAND(F.lit(signed)), F.lit(n)))
    return F.array(*keys)


def fingerprint_links(values: DataFrame) -> DataFrame:
    """Edges (a, b) between the ``rep`` of distinct fingerprints (fp, rep) that span the groups within the radius."""
    keyed = values.select(F.explode(block_keys(F.col("fp"))).alias("key"), "fp", "rep")
    return keyed.repartition(shuffle_partitions(values.sparkSession), "key").sortWithinPartitions("key", "fp").mapInArrow(_links, "a long, b long")


def simhash_components(docs: DataFrame) -> DataFrame:
    """Fingerprints and near-duplicate components of a table (doc_id, text).

    Returns (doc_id, fp, component_id) for each row; component_id is the smallest
    doc_id reachable through links. Null and wordless texts have fingerprint zero
    and link like others; rows with a null doc_id keep a null component_id and link
    nothing; repeated rows are kept; an empty table gives an empty result. Other columns are ignored. Two masked keys that
    meet by a hash collision only add candidates, each of which is compared.
    """
    rows = materialise(with_fingerprints(docs), "simhash-fp")
    values = materialise(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-values")
    roots = connected_components(fingerprint_links(values), "simhash-cc")
    labelled = materialise(
        values.join(roots, values.rep == roots.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id")),
        "simhash-roots",
    )
    return rows.join(labelled, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every document."""
    found = simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: the one whose doc_id names it.

    Texts link as in op8 where their SimHash fingerprints are within the radius. So small a radius sees all but equal
    texts only; those with four fifths of their five-word shingles in common that it misses link by an exact search.
    Case is ignored, beyond A-Z as well.
    Rows without doc_id are kept; of repeated rows with one doc_id all are kept,
    as nothing tells them apart. Null and wordless texts are one group; texts are read
    whole; an empty table stays empty; columns are returned as they are, whatever
    their names.
    """
    name = "gone"
    while name in docs.columns:
        name += "_"
    found = shingle_components(docs, fingerprint, fingerprint_links).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    gone = materialise(found, "simhash-gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
