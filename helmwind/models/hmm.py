"""Gaussian hidden Markov models of one variable, all starts fitted at once.

Forward and backward passes are products of small matrices. A window is cut into
about sqrt(n) blocks: the products inside all blocks advance together, then the
blocks are chained, so a pass takes 2*sqrt(n) array steps instead of n.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

VARIANCE_FLOOR = 1e-10


@dataclass(frozen=True)
class HmmFit:
    """States by rising volatility."""

    start: np.ndarray
    transitions: np.ndarray
    means: np.ndarray
    vols: np.ndarray
    loglik: float

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        u = (x[:, None] - self.means) / self.vols
        return -0.5 * (u * u + np.log(2 * np.pi)) - np.log(self.vols)


def _chain(matrices: np.ndarray, first: np.ndarray) -> np.ndarray:
    """first @ M_0 @ ... @ M_t for every t, each scaled to sum 1. matrices: (starts, n, k, k), first: (starts, k)."""
    starts, n, k, _ = matrices.shape
    size = max(1, int(np.sqrt(n)))
    blocks = -(-n // size)
    pad = blocks * size - n
    if pad:
        matrices = np.concatenate([matrices, np.broadcast_to(np.eye(k), (starts, pad, k, k))], axis=1)
    grid = matrices.reshape(starts, blocks, size, k, k)
    inside = np.empty_like(grid)
    product = grid[:, :, 0]
    inside[:, :, 0] = product
    for j in range(1, size):
        product = product @ grid[:, :, j]
        product = product / product.sum(axis=(2, 3), keepdims=True)
        inside[:, :, j] = product
    heads = np.empty((starts, blocks, k))
    head = first
    for b in range(blocks):
        heads[:, b] = head
        head = np.einsum("si,sij->sj", head, inside[:, b, -1])
        head = head / head.sum(axis=1, keepdims=True)
    out = np.einsum("sbi,sbjik->sbjk", heads, inside)
    return (out / out.sum(axis=3, keepdims=True)).reshape(starts, -1, k)[:, :n]


def fit_hmm(
    x: np.ndarray, k: int = 2, n_init: int = 10, n_iter: int = 100, tol: float = 1e-4, seed: int = 0, tied: bool = False
) -> HmmFit | None:
    """Baum-Welch from ``n_init`` starts; the best finite likelihood wins. None if there is none.

    A start leaves the iteration once it has converged. ``tied`` gives all states one variance.
    """
    x = np.asarray(x, dtype=float)
    n, rng = len(x), np.random.default_rng(seed)
    if n < 2 * k or not np.isfinite(x).all() or x.std() == 0:
        return None
    unit = x.std()
    y = (x - x.mean()) / unit
    means = np.stack([np.quantile(y, np.sort(rng.uniform(0.1, 0.9, k))) for _ in range(n_init)])
    variances = np.exp(rng.uniform(np.log(0.2), np.log(3), (n_init, k)))
    if tied:
        variances[:] = variances.mean(axis=1, keepdims=True)
    stay = rng.uniform(0.8, 0.98, (n_init, k))
    moves = (1 - stay)[:, :, None] / max(k - 1, 1) * (1 - np.eye(k)) + stay[:, :, None] * np.eye(k)
    start = np.full((n_init, k), 1 / k)
    floor, last, live = VARIANCE_FLOOR / unit**2 + 1e-6, np.full(n_init, -np.inf), np.arange(n_init)
    best = [np.empty_like(p) for p in (start, moves, means, variances, last)]
    for step_no in range(n_iter):
        logs = -0.5 * ((y[None, :, None] - means[:, None]) ** 2 / variances[:, None] + np.log(2 * np.pi * variances[:, None]))
        top = logs.max(axis=2, keepdims=True)
        b = np.exp(logs - top)
        first = start * b[:, 0]
        forward = np.concatenate([(first / first.sum(1, keepdims=True))[:, None], _chain(moves[:, None] * b[:, 1:, None, :], first)], axis=1)
        step = np.einsum("sti,sij->stj", forward[:, :-1], moves) * b[:, 1:]
        loglik = np.log(first.sum(1)) + np.log(step.sum(2)).sum(1) + top.sum((1, 2))
        for kept, now in zip(best, (start, moves, means, variances, loglik)):
            kept[live] = now
        going = ~((loglik - last < tol) & np.isfinite(last)) & np.isfinite(loglik)
        if not going.any() or step_no == n_iter - 1:
            break
        live, start, moves, means, variances, b, forward, last = (p[going] for p in (live, start, moves, means, variances, b, forward, loglik))
        reverse = np.swapaxes(moves[:, None] * b[:, 1:, None, :], 2, 3)[:, ::-1]
        backward = np.concatenate([_chain(reverse, np.ones((len(live), k)))[:, ::-1], np.full((len(live), 1, k), 1 / k)], axis=1)
        gamma = forward * backward
        gamma /= gamma.sum(axis=2, keepdims=True)
        pair = forward[:, :-1, :, None] * moves[:, None] * (b[:, 1:] * backward[:, 1:])[:, :, None, :]
        pair = (pair / pair.sum(axis=(2, 3), keepdims=True)).sum(axis=1)
        moves = pair / np.maximum(pair.sum(axis=2, keepdims=True), 1e-300)
        start, mass = gamma[:, 0], np.maximum(gamma.sum(axis=1), 1e-12)
        means = np.einsum("stk,t->sk", gamma, y) / mass
        spread = np.einsum("stk,stk->sk", gamma, (y[None, :, None] - means[:, None]) ** 2)
        variances = np.maximum(spread.sum(axis=1, keepdims=True) / n if tied else spread / mass, floor) * np.ones(k)
    start, moves, means, variances, loglik = best
    loglik = loglik - n * np.log(unit)
    if not np.isfinite(loglik).any():
        return None
    i = int(np.nanargmax(np.where(np.isfinite(loglik), loglik, -np.inf)))
    order = np.lexsort((means[i], variances[i]))
    return HmmFit(
        start[i][order], moves[i][np.ix_(order, order)], means[i][order] * unit + x.mean(), np.sqrt(variances[i][order]) * unit, float(loglik[i])
    )


def last_states(fit: HmmFit, x: np.ndarray, ends: np.ndarray, wins: np.ndarray | int) -> np.ndarray:
    """Last state of the best path over the rows that end at each of ``ends``, ``wins`` of them; all windows advance together."""
    with np.errstate(divide="ignore"):
        start, moves = np.log(fit.start), np.log(fit.transitions)
    density = fit.log_densities(x)
    first = ends - wins + 1
    longest = int(np.max(ends - first)) + 1
    value = np.zeros((len(ends), len(start)))
    for back in range(longest - 1, -1, -1):
        row = np.maximum(ends - back, 0)
        later = (value[:, :, None] + moves[None]).max(axis=1)
        value = np.where((row > first)[:, None], later, start) + density[row]
    return value.argmax(axis=1)
