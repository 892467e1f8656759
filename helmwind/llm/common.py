"""Helpers shared by the text operators: shared-folder tables, whole-text batches, vectorised word hashes.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which is the pattern
``[^\\x20\\x09-\\x0D]+`` on the text itself because UTF-8 never uses those bytes inside
a longer character.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled by one numpy pass inside a task; bounds a worker's memory.
SLICE_BYTES = 1 << 19

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, ``spark.checkpoint.dir``; where it is unset, a temporary one on one machine, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="helmwind-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/helmwind-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._helmwind_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a frame that :func:`materialise` returned; nothing may read it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._helmwind_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes; one longer text is a range of its own."""
    _, offsets = text_buffer(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        stop = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        stop = min(max(stop, at + 1), n)
        yield at, stop
        at = stop


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and n+1 word offsets of the rows."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    black = ~WHITE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = edge[:-1].copy()
    before[1:] |= ~black[:-1]
    before[0] = True
    after = edge[1:].copy()
    after[:-1] |= ~black[1:]
    after[-1] = True
    starts = np.flatnonzero(black & before)
    ends = np.flatnonzero(black & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span, whole spans of any length, eight bytes a step."""
    length = ends - starts
    out = mix64(length.astype(np.uint64) * _M1 + np.uint64(seed))
    if len(starts) == 0:
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    live = np.flatnonzero(length > 0)
    at = 0
    while len(live):
        left = np.minimum(length[live] - at, 8)
        lane = view[starts[live] + at] & _LOW[left]
        out[live] = mix64((out[live] ^ lane) + _M1)
        at += 8
        live = live[length[live] > at]
    return out


_R, _R_INV = np.uint64(0xD1342543DE82EF95), np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes; length len(words)-width+1."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    salted = mix64(words + np.uint64(seed * int(_M1) & (1 << 64) - 1)) if seed else words
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(salted * _powers(_R, n), out=prefix[1:])
    return mix64((prefix[width:] - prefix[:-width]) * _powers(_R_INV, n - width + 1))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(column: str = "doc_id", modulus: int = 4) -> F.Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)
