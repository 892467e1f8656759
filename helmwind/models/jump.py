"""Discrete jump models: squared distance to a state's centre plus a penalty per switch."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Days a year in reported parameters, whatever the backtest uses.
YEAR = 252
MAX_ROUNDS, TOLERANCE = 1000, 1e-8


def losses(z: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Half the squared distance of each row to each centre."""
    return 0.5 * ((z[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)


def best_path(loss: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """The cheapest state sequence and its cost; ties go to the lower state."""
    n, k = loss.shape
    if k == 2:
        return _best_path_2(loss, penalty)
    value, came = loss[0].copy(), np.zeros((n, k), dtype=np.int64)
    for t in range(1, n):
        j = int(value.argmin())
        jump = value[j] + penalty
        stay = value <= jump
        came[t] = np.where(stay, np.arange(k), j)
        value = np.where(stay, value, jump) + loss[t]
    path = np.zeros(n, dtype=np.int64)
    path[-1] = value.argmin()
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path, float(value.min())


def _best_path_2(loss: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Two states: only the difference of their costs matters, clamped to the penalty at each step."""
    first, gap = loss[:, 0].tolist(), (loss[:, 1] - loss[:, 0]).tolist()
    d, zero, d_list = gap[0], first[0], [gap[0]]
    for a, g in zip(first[1:], gap[1:]):
        if d < -penalty:
            zero += d + penalty  # state 0 is cheaper reached from state 1
            d = -penalty
        elif d > penalty:
            d = penalty
        zero += a
        d += g
        d_list.append(d)
    state = 1 if d < 0 else 0
    path = [state] * len(d_list)
    for t in range(len(d_list) - 2, -1, -1):
        before = d_list[t]
        if state == 0 and before < -penalty:
            state = 1
        elif state == 1 and before > penalty:
            state = 0
        path[t] = state
    return np.array(path, dtype=np.int64), zero + min(0.0, d)


def online_states(loss: np.ndarray, penalty: float) -> np.ndarray:
    """At each row the last state of the cheapest sequence up to it, so later rows change nothing."""
    if loss.shape[1] == 2:
        out, d = [], 0.0
        for i, g in enumerate((loss[:, 1] - loss[:, 0]).tolist()):
            d = g if i == 0 else min(max(d, -penalty), penalty) + g
            out.append(1 if d < 0 else 0)
        return np.array(out, dtype=np.int64)
    value, out = loss[0].copy(), [int(loss[0].argmin())]
    for row in loss[1:]:
        value = np.minimum(value, value.min() + penalty) + row
        out.append(int(value.argmin()))
    return np.array(out, dtype=np.int64)


def spread_start(z: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ centres."""
    picked = [z[rng.integers(len(z))]]
    for _ in range(1, k):
        distance = np.min([((z - c) ** 2).sum(axis=1) for c in picked], axis=0)
        total = distance.sum()
        picked.append(z[rng.choice(len(z), p=distance / total)] if total > 0 else z[rng.integers(len(z))])
    return np.array(picked)


@dataclass
class JumpFit:
    """A fitted model; state 0 is the one with the highest total training return."""

    centers: np.ndarray
    labels: np.ndarray
    objective: float
    penalty: float
    ret: np.ndarray
    vol: np.ndarray
    transitions: np.ndarray
    weights: np.ndarray | None = None

    def online(self, z: np.ndarray) -> np.ndarray:
        z = z if self.weights is None else z * self.weights
        return online_states(losses(z, self.centers), self.penalty)


def _descend(z: np.ndarray, centers: np.ndarray, penalty: float, rounds: int = MAX_ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Alternate the cheapest path and the states' means until neither moves."""
    last, labels = np.inf, None
    for _ in range(rounds):
        path, cost = best_path(losses(z, centers), penalty)
        if labels is not None and (np.array_equal(path, labels) or last - cost < TOLERANCE):
            return centers, path, cost
        labels, last = path, cost
        centers = np.array([z[path == s].mean(axis=0) if (path == s).any() else centers[s] for s in range(len(centers))])
    return centers, labels, last


def fit_jump(
    z: np.ndarray, ret: np.ndarray, penalty: float, k: int = 2, n_init: int = 10, seed: int = 0, start: np.ndarray | None = None,
    rounds: int = MAX_ROUNDS,
) -> JumpFit:
    """Best of ``n_init`` starts (and ``start``, if given) after ``rounds`` at most, states sorted by total return."""
    rng = np.random.default_rng(seed)
    starts = [spread_start(z, k, rng) for _ in range(n_init)]
    if start is not None:
        starts.insert(0, start)
    centers, labels, cost = min((_descend(z, c, penalty, rounds) for c in starts), key=lambda x: x[2])
    order = np.argsort([-ret[labels == s].sum() for s in range(k)], kind="stable")
    rank = np.empty(k, dtype=np.int64)
    rank[order] = np.arange(k)
    labels, centers = rank[labels], centers[order]
    own = [ret[labels == s] for s in range(k)]
    moves = np.zeros((k, k))
    np.add.at(moves, (labels[:-1], labels[1:]), 1)
    total = moves.sum(axis=1, keepdims=True)
    return JumpFit(
        centers,
        labels,
        cost,
        penalty,
        np.array([r.mean() if len(r) else np.nan for r in own]),
        np.array([r.std(ddof=1) if len(r) > 1 else np.nan for r in own]),
        np.divide(moves, total, out=np.full((k, k), np.nan), where=total > 0),
    )
