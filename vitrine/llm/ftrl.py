"""Follow-the-regularised-leader with elastic-net penalties for sparse logistic
and multinomial regression. Small helper: the caller fits it on a bounded sample.
"""

from __future__ import annotations

import numpy as np


class Ftrl:
    """``classes`` outputs (1: logistic) over ``dim`` features and a bias, which
    carries no penalty. Per-coordinate steps; weights are zero while the
    accumulated gradient stays within ``l1``."""

    def __init__(self, dim: int, classes: int, alpha: float = 0.3, beta: float = 1.0,
                 l1: float = 1.0, l2: float = 1.0):
        self.z = np.zeros((dim + 1, classes))
        self.n = np.zeros((dim + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bias = dim
        self.classes = classes

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        idx = np.arange(len(self.z))[rows]
        free = (idx == self.bias)[:, None]
        l1 = np.where(free, 0.0, self.l1)
        l2 = np.where(free, 0.0, self.l2)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + l2)
        return np.where(np.abs(z) > l1, w, 0.0)

    def _probabilities(self, logits: np.ndarray) -> np.ndarray:
        if self.classes == 1:
            return 1 / (1 + np.exp(-np.clip(logits, -35, 35)))
        e = np.exp(logits - logits.max())
        return e / e.sum()

    def learn(self, idx: np.ndarray, val: np.ndarray, target: np.ndarray) -> None:
        """One example: distinct feature indices, values, and 0/1 target(s)."""
        rows = np.append(idx, self.bias)
        x = np.append(val, 1.0)
        w = self.weights(rows)
        g = x[:, None] * (self._probabilities(x @ w) - target)[None, :]
        n = self.n[rows]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[rows] += g - sigma * w
        self.n[rows] = n + g * g

    def fit(self, examples: list[tuple], epochs: int, seed: int = 5) -> "Ftrl":
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(examples)):
                self.learn(*examples[i])
        return self


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that gives held-back logits (rows x classes) the least
    cross entropy; golden-section search over its logarithm. Of n rows, 1 / (n + 2)
    of the mass is spread over all classes: that few rows without an error do not
    stand for certainty."""
    if not len(labels):
        return 1.0
    soft = 1 / (len(labels) + 2)

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        logp = x - np.log(np.exp(x).sum(axis=1, keepdims=True))
        hit = logp[np.arange(len(x)), labels]
        return float(-((1 - soft) * hit + soft * logp.mean(axis=1)).mean())

    lo, hi = np.log(0.02), np.log(50.0)
    g = (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        if loss(np.exp(a)) < loss(np.exp(b)):
            hi = b
        else:
            lo = a
    return float(np.exp((lo + hi) / 2))
