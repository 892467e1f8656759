"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy.

A word's vector is the sum of two hashed embeddings, of the word and of its first
bytes, so that unseen forms of a stem are not strangers. The first coordinate of
each starts as the smoothed log-odds of its bucket in the training rows. Filters of
several widths slide over the words. Each keeps its maximum in ``PARTS`` interleaved
parts of the whole text; the largest and the mean of these, which tells one chance
word from several, feed a linear head that makes one calibrated probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwind.llm.common import documents, fold, hash_spans, slices, text_buffer, word_spans
from helmwind.llm.learning import Adam, labelled_sample, platt, sigmoid, split

BITS, DIM = 16, 8
WIDTHS, FILTERS, PARTS = (1, 2, 3), 8, 4
STEM_BYTES = 5
#: Documents of either class that every bucket is taken to have been seen in besides.
SMOOTHING = 25.0
PER_CLASS = 2500
EPOCHS, MOST_EPOCHS, BATCH, RATE = 6, 20, 16, 0.01
PREDICT_FROM = 0.3
#: A language needs so many calibration rows for a threshold of its own.
LANGUAGE_ROWS = 30

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(0x21, 0x80) if not chr(b).isalnum()]] = 0x20  # ASCII punctuation parts words


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, of its stem, and n+1 word offsets of the rows."""
    low = _FOLD[data]
    starts, ends, at = word_spans(low, offsets)
    shift = np.uint64(64 - BITS)
    words = hash_spans(low, starts, ends) >> shift
    stems = hash_spans(low, starts, np.minimum(ends, starts + STEM_BYTES), seed=9) >> shift
    return words.astype(np.int32), stems.astype(np.int32), at


class WordCnn:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {
            "word": (rng.standard_normal((1 << BITS, DIM)) * 0.05).astype(np.float32),
            "stem": (rng.standard_normal((1 << BITS, DIM)) * 0.05).astype(np.float32),
            "bias": np.zeros(len(WIDTHS) * FILTERS, np.float32),
            "head": (rng.standard_normal((2, len(WIDTHS) * FILTERS)) * 0.2).astype(np.float32),
            "out": np.zeros(1, np.float32),
        }
        for w in WIDTHS:
            self.p[f"filter{w}"] = (rng.standard_normal((w * DIM, FILTERS)) * 0.3).astype(np.float32)
        self.slope, self.shift, self.thresholds = 1.0, 0.0, {}

    def _embed(self, words: np.ndarray, stems: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of all words, each row followed by zero vectors up to a multiple of PARTS, and the new offsets."""
        size = np.diff(at)
        to = np.r_[0, np.cumsum(-(-(size + max(WIDTHS)) // PARTS) * PARTS)]
        out = np.zeros((to[-1] + max(WIDTHS), DIM), dtype=np.float32)
        out[np.arange(len(words)) + np.repeat(to[:-1] - at[:-1], size)] = self.p["word"][words] + self.p["stem"][stems]
        return out, to

    def _feature_maps(self, vectors: np.ndarray, to: np.ndarray) -> list[np.ndarray]:
        """Values of each width's filters; a place whose words would run into the next row counts as none."""
        maps, n = [], int(to[-1])
        for w in WIDTHS:
            filters = self.p[f"filter{w}"].reshape(w, DIM, FILTERS)
            z = vectors[:n] @ filters[0]
            for k in range(1, w):
                z += vectors[k : n + k] @ filters[k]
                z[to[1:] - k] = -np.inf
            maps.append(z)
        return maps

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) == 1:
            return np.zeros(0)
        vectors, to = self._embed(*word_buckets(data, offsets))
        maps = [z.reshape(-1, PARTS, FILTERS) for z in self._feature_maps(vectors, to)]
        best = np.concatenate([np.maximum.reduceat(z, to[:-1] // PARTS, axis=0) for z in maps], axis=2)
        parts = np.maximum(best + self.p["bias"], 0)
        return parts.max(axis=1) @ self.p["head"][0] + parts.mean(axis=1) @ self.p["head"][1] + self.p["out"][0]

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.logits(data, offsets).astype(float) + self.shift)


def _start_from_odds(model: WordCnn, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[float]) -> None:
    """First coordinates: log-odds of a bucket's documents, smoothed; the first filters read them."""
    y = np.array(labels)
    for name, column in (("word", 0), ("stem", 1)):
        seen = np.zeros((2, 1 << BITS))
        for row, label in zip(rows, labels):
            seen[int(label), np.unique(row[column])] += 1
        share = y.mean()
        odds = np.log((seen[1] / share + SMOOTHING) / (seen[0] / (1 - share) + SMOOTHING))
        odds[seen.sum(axis=0) < 2] = 0
        model.p[name][:, 0] = np.clip(odds, -4, 4) * 0.5
    for w in WIDTHS:
        model.p[f"filter{w}"][np.arange(w) * DIM, : FILTERS // 2] = 0.5


def train(rows: list, prior: float) -> WordCnn:
    """Adam for filters and head, plain steps on the embeddings that win a pool; Platt scaling; thresholds by language."""
    model = WordCnn()
    fit, calibrate = split(rows)
    if len({r["label"] for r in fit}) < 2:
        p = min(max(prior, 0.01), 0.99)
        model.slope, model.shift = 0.0, float(np.log(p / (1 - p)))
        return model
    prepared = []
    for r in fit:
        words, stems, _ = word_buckets(*text_buffer(pa.array([r["text"]])))
        prepared.append((words, stems))
    labels = [float(r["label"]) for r in fit]
    _start_from_odds(model, prepared, labels)
    own = {k: v for k, v in model.p.items() if k not in ("word", "stem")}
    adam, rng, every = Adam(own, RATE), np.random.default_rng(8), np.arange(len(WIDTHS) * FILTERS)
    epochs = max(EPOCHS, min(MOST_EPOCHS, EPOCHS * PER_CLASS // len(fit)))
    for _ in range(epochs):
        order = rng.permutation(len(fit))
        for s in range(0, len(order), BATCH):
            batch = order[s : s + BATCH].tolist()
            grads = {k: np.zeros_like(v) for k, v in own.items()}
            for i in batch:
                words, stems = prepared[i]
                vectors, to = model._embed(words, stems, np.array([0, len(words)]))
                maps = model._feature_maps(vectors, to)
                maps = [z.reshape(-1, PARTS, FILTERS) for z in maps]
                where = [z.argmax(axis=0) * PARTS + np.arange(PARTS)[:, None] for z in maps]  # parts x filters
                parts = np.maximum(np.concatenate([z.max(axis=0) for z in maps], axis=1) + model.p["bias"], 0)
                top = parts.argmax(axis=0)
                pooled = np.stack([parts[top, every], parts.mean(axis=0)])
                g = float(sigmoid(np.array((pooled * model.p["head"]).sum() + model.p["out"][0]))) - labels[i]
                grads["out"] += g
                grads["head"] += g * pooled
                d = np.tile(g * model.p["head"][1] / PARTS, (PARTS, 1))
                d[top, every] += g * model.p["head"][0]
                d *= parts > 0
                grads["bias"] += d.sum(axis=0)
                for n, w in enumerate(WIDTHS):
                    part = d[:, n * FILTERS : (n + 1) * FILTERS]
                    filters = model.p[f"filter{w}"].reshape(w, DIM, FILTERS)
                    for k in range(w):
                        at = where[n] + k
                        grads[f"filter{w}"][k * DIM : (k + 1) * DIM] += np.einsum("pfd,pf->df", vectors[at], part)
                        real = at < len(words)
                        step = (0.05 * part[:, :, None] * filters[k].T[None])[real]
                        np.subtract.at(model.p["word"], words[at[real]], step)
                        np.subtract.at(model.p["stem"], stems[at[real]], step)
            adam.step({k: v / len(batch) for k, v in grads.items()})
    data, offsets = text_buffer(pa.array([r["text"] for r in calibrate]))
    truth = np.array([r["label"] for r in calibrate])
    model.slope, model.shift = platt(model.logits(data, offsets).astype(float), truth, prior)
    p = model.probabilities(data, offsets)
    for lang in sorted({r["lang"] for r in calibrate if r["lang"] is not None}):
        of = np.array([r["lang"] == lang for r in calibrate])
        if of.sum() >= LANGUAGE_ROWS and 0 < truth[of].sum() < of.sum():
            model.thresholds[lang] = best_threshold(p[of], truth[of])
    return model


def best_threshold(p: np.ndarray, truth: np.ndarray) -> float:
    """The threshold of the highest F1; the lowest of equally good ones."""
    candidates = np.unique(np.r_[p, PREDICT_FROM])
    f1 = [2 * (truth[p >= t].sum()) / max((p >= t).sum() + truth.sum(), 1) for t in candidates]
    return float(candidates[int(np.argmax(f1))])


def score(docs: DataFrame, model: WordCnn) -> DataFrame:
    """(doc_id, score, threshold, flagged) of each row of (doc_id, text, lang), whole texts.

    The score reads the text alone; lang only picks the threshold of ``flagged``
    (unknown or null: the common one). Null texts score as empty ones; repeated rows
    are scored each; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s, e in slices(whole.column(2)):
                batch = whole.slice(s, e - s)
                p = shared.value.probabilities(*text_buffer(batch.column(2)))
                limits = np.array([shared.value.thresholds.get(x, PREDICT_FROM) for x in batch.column(1).to_pylist()], dtype=float)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(p, pa.float64()), pa.array(limits), pa.array(p >= limits)],
                    names=["doc_id", "score", "threshold", "flagged"],
                )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, score double, threshold double, flagged boolean")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, and whether its language's threshold flags it."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, prior = labelled_sample(docs, labels, "toxic", PER_CLASS, usable=fold() != 2, seed=5)
    return score(docs, train(rows, prior)).select(
        "doc_id",
        F.coalesce(fold() == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"),
        "threshold",
        "flagged",
    )
