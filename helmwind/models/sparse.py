"""Sparse jump models: feature weights under a 1-norm bound, with features that must stay."""

from __future__ import annotations

import warnings
from dataclasses import replace

import numpy as np

from helmwind.models.jump import JumpFit, fit_jump

FLOOR, MAX_LOOPS, TOLERANCE = 1e-3, 30, 1e-4


def lasso(scores: np.ndarray, bound: float, pins: np.ndarray | None = None, floor: float = FLOOR, tolerance: float = 1e-8) -> np.ndarray:
    """Unit vector along the scores less a threshold, the smallest that keeps the 1-norm within ``bound``.

    Pinned features are exempt from the threshold and never below ``floor`` times the
    largest score; the bound is that of the unpinned problem. No positive score: all equal.
    """
    s = np.maximum(np.asarray(scores, dtype=float).ravel(), 0)
    pins = np.zeros(len(s), bool) if pins is None else np.asarray(pins, dtype=bool).ravel()
    if len(pins) != len(s):
        raise ValueError("the pins do not fit the features")
    if s.max() <= 0:
        return np.full(len(s), 1 / np.sqrt(len(s)))

    def ratio(t: float) -> float:
        cut = np.maximum(s - t, 0)
        return cut.sum() / np.linalg.norm(cut)

    levels, threshold = np.unique(s), 0.0
    if len(levels) > 1 and levels[-2] >= tolerance and ratio(0.0) > bound:
        low, high = 0.0, float(levels[-2])
        while high - low > tolerance:
            middle = (low + high) / 2
            low, high = (low, middle) if ratio(middle) <= bound else (middle, high)
        threshold = high
    out = np.where(pins, np.maximum(s, floor * s.max()), np.maximum(s - threshold, 0))
    return out / np.linalg.norm(out)


def between_cluster(z: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres in unweighted features and each feature's sum of squares between states."""
    mean = z.mean(axis=0)
    centers = np.array([z[labels == s].mean(axis=0) if (labels == s).any() else np.full(z.shape[1], np.nan) for s in range(k)])
    counts = np.array([(labels == s).sum() for s in range(k)])
    return centers, (counts[:, None] * np.nan_to_num((centers - mean) ** 2)).sum(axis=0)


def fit_sparse(
    z: np.ndarray, ret: np.ndarray, penalty: float, max_feats: float, pins: np.ndarray | None = None, k: int = 2, n_init: int = 10, seed: int = 0
) -> JumpFit:
    """Alternate a jump model on weighted features and the weights; ``weights`` are those of the last fit."""
    p = z.shape[1]
    own_penalty = penalty / np.sqrt(p)
    w, last, fit, start = np.full(p, 1 / np.sqrt(p)), np.full(p, 2.0), None, None
    for _ in range(MAX_LOOPS):
        if np.abs(w - last).sum() / np.abs(last).sum() <= TOLERANCE:
            break
        last, root = w, np.sqrt(w)
        fit = replace(fit_jump(z * root, ret, own_penalty, k, n_init, seed, None if start is None else np.nan_to_num(start) * root), weights=root)
        start, score = between_cluster(z, fit.labels, k)
        if (score <= 0).all():
            break
        w = lasso(score / score.max(), np.sqrt(max_feats), pins)
    return fit


def resolve_max_feats(max_feats: float | None, n_features: int, n_pins: int = 0) -> float:
    """Default max(2, half of the features, pins); at least the pins, at most the features."""
    if max_feats is None:
        max_feats = max(2.0, n_features / 2, float(n_pins))
    if max_feats < 1:
        raise ValueError("max_feats must be 1 or more")
    if max_feats < n_pins:
        warnings.warn(f"max_feats is raised to the {n_pins} pinned features", stacklevel=2)
    if max_feats > n_features:
        warnings.warn(f"max_feats is capped at the {n_features} features", stacklevel=2)
    return float(min(max(max_feats, n_pins), n_features))
