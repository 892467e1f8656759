"""Quality rules: base counts of each text and a calibrated logistic regression on hashed n-grams.

Features are hashed words, word pairs and byte n-grams of the lower-cased text, each
kind averaged over its occurrences, and the base counts as ratios.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwind.llm.common import WHITE, documents, hash_spans, mix64, slices, text_buffer, window_hashes, word_spans
from helmwind.llm.learning import labelled_sample, platt, sigmoid, split

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
BITS = 18
CHAR_GRAMS = (3, 5)
PER_CLASS = 1200
EPOCHS, RATE, RIDGE = 12, 0.5, 1e-7
#: The verdict keeps a text from this probability of label 1 on.
KEEP_FROM = 0.2

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PHI = np.uint64(0x9E3779B97F4A7C15)
KINDS = 2 + len(CHAR_GRAMS)
DENSE = 4


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_window_words(words: np.ndarray, offsets: np.ndarray, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each row in windows of ``width`` words that the row holds twice or more."""
    windows = window_hashes(words, width)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(row[: len(windows)] == row[width - 1 :]) if len(windows) else np.zeros(0, np.int64)
    key = mix64(windows[at] ^ (row[at].astype(np.uint64) * _PHI))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = at[order[np.r_[same, False] | np.r_[False, same]]] if len(at) else at
    mark = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(mark, twice, 1)
    np.add.at(mark, np.minimum(twice + width, len(words)), -1)
    return _per_row(np.cumsum(mark[:-1]) > 0, offsets)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of the rows of a text buffer."""
    starts, ends, at = word_spans(data, offsets)
    words = hash_spans(data, starts, ends)
    raw, dup = data.tobytes(), []
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        lines = [x for x in raw[s:e].split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": np.diff(at),
        "word_chars": _per_row(~WHITE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_row(_SYMBOL[data], offsets),
        "n_dup_lines": np.array(dup, dtype=np.int64),
        "n_repeat_words": repeated_window_words(words, at),
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


def gram_indices(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature, the hashed index of each occurrence and n+1 offsets of the rows; none spans two rows."""
    low = _LOWER[data]
    starts, ends, at = word_spans(low, offsets)
    words = hash_spans(low, starts, ends)
    shift = np.uint64(64 - BITS)
    out = [((words >> shift).astype(np.int32), at)]
    pairs = mix64(words[:-1] * _PHI ^ words[1:]) if len(words) else words
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = np.flatnonzero(row[1:] == row[:-1])
    out.append(((pairs[inside] >> shift).astype(np.int32), np.searchsorted(inside, np.minimum(at, max(len(words) - 1, 0)))))
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    view = np.ndarray((len(low) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))[: len(low)]
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(low))  # bytes of the row from here on
    for n in CHAR_GRAMS:
        code = (view[left >= n] & np.uint64((1 << 8 * n) - 1)) * (_PHI + np.uint64(2 * n))
        out.append(((code >> shift).astype(np.int32), np.r_[0, np.cumsum(np.maximum(np.diff(offsets) - n + 1, 0))]))
    return out


def _row_means(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean of each row's values, summed row by row, so that it does not depend on the other rows; 0 without values."""
    out, size = np.zeros(len(offsets) - 1), np.diff(offsets)
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.add.reduceat(values.astype(np.float64), offsets[:-1][some]) / size[some]
    return out


def dense(counts: dict[str, np.ndarray]) -> np.ndarray:
    words = np.maximum(counts["n_words"], 1)
    return np.stack(
        [
            counts["n_symbols"] / words,
            counts["n_repeat_words"] / words,
            np.minimum(counts["n_dup_lines"], 20) / 20,
            np.log1p(counts["n_words"]) / 10,
        ],
        axis=1,
    )


class NgramRegression:
    """Logistic regression; ``weights`` has a row for each kind of hashed feature."""

    def __init__(self):
        self.weights = np.zeros((KINDS, 1 << BITS), dtype=np.float32)
        self.dense, self.bias, self.slope, self.shift = np.zeros(DENSE), 0.0, 1.0, 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray, counts: dict[str, np.ndarray]) -> np.ndarray:
        out = (dense(counts) * self.dense).sum(axis=1) + self.bias
        for kind, (index, at) in enumerate(gram_indices(data, offsets)):
            out += _row_means(self.weights[kind][index], at)
        return out

    def probabilities(self, data: np.ndarray, offsets: np.ndarray, counts: dict[str, np.ndarray]) -> np.ndarray:
        return sigmoid(self.slope * self.logits(data, offsets, counts) + self.shift)


def train(rows: list, prior: float) -> NgramRegression:
    """Adaptive gradient steps over the training rows, then Platt scaling on the calibration rows."""
    model = NgramRegression()
    fit, calibrate = split(rows)
    if len({r["label"] for r in fit}) < 2:
        p = min(max(prior, 0.01), 0.99)
        model.shift = float(np.log(p / (1 - p)))
        return model
    prepared = []
    for r in fit:
        data, offsets = text_buffer(pa.array([r["text"]]))
        grams = []
        for index, _ in gram_indices(data, offsets):
            index, count = np.unique(index, return_counts=True)
            grams.append((index, (count / max(count.sum(), 1)).astype(np.float32)))
        prepared.append((grams, dense(base_counts(data, offsets))[0], float(r["label"])))
    spread = np.full((KINDS, 1 << BITS), 1e-6, dtype=np.float32)
    spread_dense, spread_bias = np.full(DENSE, 1e-6), 1e-6
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(prepared)).tolist():
            grams, extra, y = prepared[i]
            z = float(extra @ model.dense) + model.bias + sum(float(model.weights[k][ix] @ v) for k, (ix, v) in enumerate(grams))
            g = float(sigmoid(np.array(z))) - y
            for k, (ix, v) in enumerate(grams):
                own = model.weights[k]
                step = g * v + RIDGE * own[ix]
                spread[k][ix] += step * step
                own[ix] -= RATE * step / np.sqrt(spread[k][ix])
            spread_dense += (g * extra) ** 2
            model.dense -= RATE * g * extra / np.sqrt(spread_dense)
            spread_bias += g * g
            model.bias -= RATE * g / spread_bias**0.5
    data, offsets = text_buffer(pa.array([r["text"] for r in calibrate]))
    logits = model.logits(data, offsets, base_counts(data, offsets))
    model.slope, model.shift = platt(logits, np.array([r["label"] for r in calibrate]), prior)
    return model


def quality_rules(docs: DataFrame, model: NgramRegression, keep_from: float = KEEP_FROM) -> DataFrame:
    """Base counts, base_failed, probability and kept of each row of (doc_id, text).

    Null and wordless texts have counts of zero and fail the base; texts of any length
    are read whole; a row's result depends on its text alone, so repeated rows are
    judged alike; a null doc_id is carried along; an empty table gives an empty
    result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s, e in slices(whole.column(1)):
                batch = whole.slice(s, e - s)
                data, offsets = text_buffer(batch.column(1))
                counts = base_counts(data, offsets)
                failed = base_failed(counts)
                p = shared.value.probabilities(data, offsets, counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        *(pa.array(counts[k].astype(np.int64)) for k in names),
                        pa.array(failed),
                        pa.array(~failed & (p >= keep_from)),
                        pa.array(p),
                    ],
                    names=["doc_id", *names, "base_failed", "kept", "probability"],
                )

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean, probability double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = documents(spark, sf_dir)
    rows, prior = labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", PER_CLASS, seed=3)
    return quality_rules(docs, train(rows, prior))
