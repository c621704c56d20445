"""Follow-the-regularised-leader (proximal, per coordinate, elastic net) for sparse examples, shared by the classifiers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.01


class Leader:
    """Weights of shape (features, outputs) kept as the leader's sums."""

    def __init__(self, shape: tuple[int, ...], rules: Ftrl):
        self.z, self.n, self.rules = np.zeros(shape), np.zeros(shape), rules

    def weights(self, at=slice(None)) -> np.ndarray:
        r, z = self.rules, self.z[at]
        w = -(z - np.sign(z) * r.l1) / ((r.beta + np.sqrt(self.n[at])) / r.alpha + r.l2)
        return np.where(np.abs(z) <= r.l1, 0.0, w)

    def step(self, at, gradient: np.ndarray, w: np.ndarray) -> None:
        n = self.n[at]
        more = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.rules.alpha * w
        self.n[at] = more
