"""Clip and standardise a training window; apply the same to later rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Scaler:
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    std: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, clip: float = 3.0) -> Scaler:
        """Bounds at ``clip`` standard deviations; mean and deviation (ddof 0) of the clipped rows. A constant column scales by 1."""
        mean, std = x.mean(axis=0), x.std(axis=0)
        low, high = mean - clip * std, mean + clip * std
        clipped = np.clip(x, low, high)
        scale = clipped.std(axis=0)
        return cls(low, high, clipped.mean(axis=0), np.where(scale > 0, scale, 1.0))

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (np.clip(x, self.low, self.high) - self.mean) / self.std

    def invert(self, z: np.ndarray) -> np.ndarray:
        return z * self.std + self.mean
