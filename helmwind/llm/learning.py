"""Bounded labelled samples, Adam steps and Platt scaling shared by the trained classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helmwind.llm.common import discard, materialise

#: Bytes of text that a class sends to the driver; its rows come in the order of a hash until these are full.
TRAIN_BYTES = 48 << 20
#: Every so-many-th drawn row calibrates instead of training.
CALIBRATION_EVERY = 5


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, usable=None, seed: int = 0) -> tuple[list, float]:
    """About ``per_class`` labelled texts of each class, and the share of label 1 among all usable labels.

    ``labels`` has doc_id and ``column`` (0 or 1; other values and nulls are left
    out, repeated rows count once, the larger label wins). ``usable`` is a condition
    on doc_id. Rows are drawn by a hash of doc_id at a rate that follows from the
    class count, whatever their length, and a class stops at the row that fills
    ``TRAIN_BYTES``; so the result is bounded, whatever the table's size, and reruns
    agree. Returns (doc_id, text, lang, label) rows in doc_id order; of repeated
    documents the least text comes once, null texts do not come.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return [], 0.5
    turn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1000 + seed)), F.lit(1 << 24))
    rate = F.when(F.col("label") == 1, F.lit(min(1.0, per_class / counts.get(1, 1)))).otherwise(min(1.0, per_class / counts.get(0, 1)))
    drawn = known.where(turn / F.lit(float(1 << 24)) < rate)  # about 2 * per_class ids: safe to broadcast
    has_lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.col("text").cast("string").alias("text"), has_lang.alias("lang")).alias("own")
    )
    one = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min("own").alias("own"))
    sample = materialise(one.select("doc_id", "own.text", "own.lang", "label", turn.alias("turn")), "learning-sample")
    before = Window.partitionBy("label").orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = sample.select("doc_id", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)).alias("before")).where(f"before < {TRAIN_BYTES}")
    found = sample.join(F.broadcast(rows), "doc_id").select("doc_id", "text", "lang", "label").orderBy("doc_id").collect()
    discard(sample)
    return found, counts.get(1, 0) / sum(counts.values())


def split(rows: list) -> tuple[list, list]:
    """Training and calibration rows."""
    fit = [r for i, r in enumerate(rows) if i % CALIBRATION_EVERY]
    return (fit, [r for i, r in enumerate(rows) if not i % CALIBRATION_EVERY]) if len(rows) >= 40 else (rows, rows)


class Adam:
    """Adam steps on a dictionary of float32 arrays, in place."""

    def __init__(self, parameters: dict[str, np.ndarray], rate: float = 0.01):
        self.p, self.rate, self.t = parameters, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.v = {k: np.zeros_like(v) for k, v in parameters.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.t += 1
        a, b = 1 - 0.9**self.t, 1 - 0.999**self.t
        for k, g in gradients.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / a) / (np.sqrt(self.v[k] / b) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def platt(logits: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift that turn logits into probabilities where label 1 has share ``prior``."""
    y = labels.astype(float)
    if len(y) == 0 or y.min() == y.max():
        return 1.0, 0.0
    # Rows are weighed so that classes have their shares among all labels; targets are smoothed.
    w = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = sigmoid(a * logits + b)
        g, h = w * (p - t), np.maximum(w * p * (1 - p), 1e-9)
        grad = np.array([(g * logits).sum() + 1e-3 * (a - 1), g.sum()])
        hess = np.array([[(h * logits * logits).sum() + 1e-3, (h * logits).sum()], [(h * logits).sum(), h.sum() + 1e-6]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-7:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)
