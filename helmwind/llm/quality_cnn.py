"""Quality classifier: a byte-level convolutional network in numpy.

Filters over ``WIDTH`` consecutive bytes are tables of a weight per byte value and
place. A document is padded to blocks; two neighbouring blocks make a chunk, so
chunks overlap by half and cover the whole text. Each filter's maximum in a chunk
passes a ReLU; the chunks' mean, maximum and minimum are combined into one
calibrated probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwind.llm.common import documents, fold, slices, text_buffer
from helmwind.llm.learning import Adam, labelled_sample, platt, sigmoid, split

WIDTH, FILTERS, BLOCK = 5, 24, 128
PER_CLASS = 900
EPOCHS, BATCH, RATE = 5, 8, 0.02
PREDICT_FROM = 0.3
#: Bytes that one convolution pass holds.
PASS_BYTES = 1 << 16


def padded_blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows followed by WIDTH - 1 zero bytes or more, up to whole blocks, so that no filter sees two rows; n+1 block offsets."""
    size = np.diff(offsets)
    blocks = -(-(size + WIDTH - 1) // BLOCK)
    at = np.r_[0, np.cumsum(blocks)]
    out = np.zeros(at[-1] * BLOCK + WIDTH - 1, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(at[:-1] * BLOCK - offsets[:-1], size)] = data
    return out, at


class ByteCnn:
    def __init__(self, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.p = {
            "filters": (rng.standard_normal((WIDTH, 256, FILTERS)) * 0.4).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "head": (rng.standard_normal(3 * FILTERS) * 0.1).astype(np.float32),
            "out": np.zeros(1, np.float32),
        }
        self.slope, self.shift = 1.0, 0.0

    def _convolve(self, padded: np.ndarray, start: int, stop: int) -> np.ndarray:
        filters = self.p["filters"]
        z = filters[0][padded[start:stop]]
        for k in range(1, WIDTH):
            z += filters[k][padded[start + k : stop + k]]
        return z

    def block_maxima(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Each filter's maximum in each block, without the places at a row's end that would see the next row."""
        blocks = int(at[-1])
        out = np.empty((blocks, FILTERS), dtype=np.float32)
        ends = np.zeros(blocks, dtype=bool)
        ends[at[1:] - 1] = True
        step = PASS_BYTES // BLOCK
        for b in range(0, blocks, step):
            e = min(blocks, b + step)
            z = self._convolve(padded, b * BLOCK, e * BLOCK).reshape(e - b, BLOCK, FILTERS)
            z[ends[b:e], BLOCK - WIDTH + 1 :] = -np.inf
            out[b:e] = z.max(axis=1)
        return out

    def _chunks(self, maxima: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ReLU of chunk maxima and n+1 chunk offsets; a row of one block is one chunk."""
        last = np.zeros(len(maxima), dtype=bool)
        last[at[1:] - 1] = True
        single = np.zeros(len(maxima), dtype=bool)
        single[at[:-1][np.diff(at) == 1]] = True
        starts = np.flatnonzero(~last | single)
        nxt = np.where(single[starts], starts, starts + 1)
        chunks = np.maximum(np.maximum(maxima[starts], maxima[nxt]) + self.p["bias"], 0)
        return chunks, np.r_[0, np.cumsum(np.maximum(np.diff(at) - 1, 1))]

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) == 1:
            return np.zeros(0)
        padded, at = padded_blocks(data, offsets)
        chunks, c = self._chunks(self.block_maxima(padded, at), at)
        mean = np.add.reduceat(chunks, c[:-1], axis=0) / np.diff(c)[:, None]
        pooled = np.concatenate([mean, np.maximum.reduceat(chunks, c[:-1], axis=0), np.minimum.reduceat(chunks, c[:-1], axis=0)], axis=1)
        return pooled @ self.p["head"] + self.p["out"][0]

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.logits(data, offsets).astype(float) + self.shift)

    def gradients(self, texts: list[bytes], labels: list[float]) -> dict[str, np.ndarray]:
        """Back-propagation through every pool to the bytes that won it."""
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        head = self.p["head"].reshape(3, FILTERS)
        columns = np.arange(FILTERS)
        for text, y in zip(texts, labels):
            data = np.frombuffer(text, np.uint8)
            padded, at = padded_blocks(data, np.array([0, len(data)]))
            blocks = int(at[-1])
            z = self._convolve(padded, 0, blocks * BLOCK).reshape(blocks, BLOCK, FILTERS)
            z[-1, BLOCK - WIDTH + 1 :] = -np.inf
            where = z.argmax(axis=1) + (np.arange(blocks) * BLOCK)[:, None]
            maxima = z.max(axis=1)
            chunks, c = self._chunks(maxima, at)
            n = len(chunks)
            hi, lo = chunks.argmax(axis=0), chunks.argmin(axis=0)
            pooled = np.stack([chunks.mean(axis=0), chunks[hi, columns], chunks[lo, columns]])
            g = float(sigmoid(np.array((pooled * head).sum() + self.p["out"][0]))) - y
            grads["out"] += g
            grads["head"] += g * pooled.ravel()
            d = np.tile(g * head[0] / n, (n, 1))
            d[hi, columns] += g * head[1]
            d[lo, columns] += g * head[2]
            d *= chunks > 0
            grads["bias"] += d.sum(axis=0)
            left = np.arange(n)
            right = np.minimum(left + 1, blocks - 1)
            winner = np.where(maxima[left] >= maxima[right], where[left], where[right])
            for k in range(WIDTH):
                np.add.at(grads["filters"][k], (padded[winner + k], np.broadcast_to(columns, winner.shape)), d)
        return {k: v / len(texts) for k, v in grads.items()}


def train(rows: list, prior: float) -> ByteCnn:
    """Adam over the training rows, Platt scaling on the calibration rows."""
    model = ByteCnn()
    fit, calibrate = split(rows)
    if len({r["label"] for r in fit}) < 2:
        p = min(max(prior, 0.01), 0.99)
        model.slope, model.shift = 0.0, float(np.log(p / (1 - p)))
        return model
    texts, labels = [r["text"].encode() for r in fit], [float(r["label"]) for r in fit]
    adam, rng = Adam(model.p, RATE), np.random.default_rng(6)
    epochs = max(EPOCHS, min(40, EPOCHS * PER_CLASS // len(texts)))
    for epoch in range(epochs):
        adam.rate = RATE * (1 - 0.8 * epoch / epochs)
        order = rng.permutation(len(texts))
        for s in range(0, len(order), BATCH):
            at = order[s : s + BATCH].tolist()
            adam.step(model.gradients([texts[i] for i in at], [labels[i] for i in at]))
    data, offsets = text_buffer(pa.array([r["text"] for r in calibrate]))
    model.slope, model.shift = platt(model.logits(data, offsets).astype(float), np.array([r["label"] for r in calibrate]), prior)
    return model


def score(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """(doc_id, score) of each row of (doc_id, text), whole texts.

    Null texts score as empty ones; texts of any length are read whole, block by
    block; repeated rows are scored each; an empty table gives an empty result;
    a null doc_id is carried along; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s, e in slices(whole.column(1)):
                batch = whole.slice(s, e - s)
                p = shared.value.probabilities(*text_buffer(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double"
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, prior = labelled_sample(docs, labels, "quality", PER_CLASS, usable=fold(modulus=5) != 0, seed=4)
    return score(docs, train(rows, prior)).select(
        "doc_id",
        F.coalesce(fold(modulus=5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"),
    )
