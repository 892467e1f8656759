"""Fill-in-middle transformation: cut a text at two boundaries and write its pieces in another order.

A text is decoded to an array of code points. Neighbouring points of different
classes have a boundary between them; classes follow from the unit (every code
point, words and the space between them, or lines). Two boundaries are chosen by
their rank, the pieces are sliced and encoded again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwind.llm.common import documents

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 90, 20
UNITS = ("point", "word", "line")
_WHITE = np.array([0x20, *range(0x09, 0x0E)], dtype=np.uint32)

_RESULT = (
    "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"
)


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """A number for each code point; a unit ends where the next point has another one."""
    if unit == "point":
        return np.arange(len(points))
    if unit == "word":
        return np.isin(points, _WHITE).astype(np.int64)
    if unit == "line":
        ends = np.cumsum(points == 0x0A)
        return ends - (points == 0x0A)
    raise ValueError(f"unit must be one of {UNITS}")


def boundaries(points: np.ndarray, unit: str = "point") -> np.ndarray:
    """Places where a text may be cut: its head, between units, and its end."""
    kind = classes(points, unit)
    inner = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """Four 32-bit numbers of a document, from SHA-256 of the seed and the id (nothing for a null id)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transform(text: str, h: list[int], unit: str = "point", plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT):
    """(output, form, n, prefix length, middle length) in code points; plain texts have no lengths."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    n = len(points)
    if not n or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= plain_percent:
        return text, "plain", n, None, None
    places = boundaries(points, unit)
    low, high = sorted(int(places[x % len(places)]) for x in h[:2])
    prefix, middle, suffix = (points[a:b].tobytes().decode("utf-32-le") for a, b in ((0, low), (low, high), (high, n)))
    if h[3] % 100 < spm_percent:
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", "spm", n, low, high - low
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", "psm", n, low, high - low


def restore(output: str, form: str) -> str:
    """The text of an output. A piece holds no mark and none can begin in a piece and end in a mark, so the first of each is the right one."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return f"{one}{middle}{two}" if form == "psm" else f"{two}{middle}{one}"


def fill_in_middle(
    docs: DataFrame, unit: str = "point", seed: int = 1, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256 of (doc_id, text).

    A null text is empty, and empty texts are plain. Draws follow from the id, so repeated
    rows agree; a null id draws like an empty one. Texts are cut whole, whatever their
    length; an empty table gives an empty result; other columns are ignored.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                made = [[] for _ in range(7)]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    output, form, n, prefix, middle = transform(text or "", draws(doc_id, seed), unit, plain_percent, spm_percent)
                    shas = (hashlib.sha256(x.encode("utf-8")).hexdigest() for x in (output, restore(output, form)))
                    for column, value in zip(made, (n, form, prefix, middle, output, *shas)):
                        column.append(value)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                columns = [part.column(0), *(pa.array(x, kind) for x, kind in zip(made, kinds))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(x.split()[0] for x in _RESULT.split(", "))])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {_RESULT}")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    return fill_in_middle(documents(spark, sf_dir)).drop("output")
