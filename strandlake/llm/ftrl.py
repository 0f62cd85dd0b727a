"""Follow-the-regularised-leader training of sparse logistic models, with numpy."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Per-coordinate FTRL-proximal for a weight matrix (features x classes) with elastic-net penalties."""

    def __init__(self, features: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))

    def weights(self, rows: np.ndarray) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, rows: np.ndarray, gradient: np.ndarray, weights: np.ndarray) -> None:
        """``rows`` are distinct; ``weights`` are what ``weights(rows)`` gave."""
        n = self.n[rows]
        grown = n + gradient * gradient
        self.z[rows] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * weights
        self.n[rows] = grown

    def all_weights(self) -> np.ndarray:
        return self.weights(np.arange(len(self.z)))


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray, low: float = 0.05, high: float = 20.0) -> float:
    """The temperature that gives held-back rows the least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels]
        return -float(np.log(np.maximum(p, 1e-12)).mean())

    a, b, ratio = np.log(low), np.log(high), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))
