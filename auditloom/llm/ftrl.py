"""Linear models on sparse rows: follow-the-regularised-leader with elastic-net penalties, and temperature calibration."""

from __future__ import annotations

import numpy as np


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal for a softmax over `classes` (2: logistic regression, as two columns of opposite gradients)."""

    def __init__(self, dims: int, classes: int, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.3, l2: float = 0.3):
        self.z, self.n = np.zeros((dims, classes)), np.zeros((dims, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def step(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        """One row: its different features, their values, its class."""
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], ys: list[int], epochs: int = 3, seed: int = 7) -> np.ndarray:
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                self.step(*rows[i], ys[i])
        return self.weights()


def scores(w: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.array([x @ w[at] for at, x in rows]).reshape(len(rows), w.shape[1])


def temperature(s: np.ndarray, ys: np.ndarray) -> float:
    """The T of softmax(s / T) with the least log loss, by golden-section search over log T."""
    if not len(s):
        return 1.0

    def loss(u: float) -> float:
        p = softmax(s / np.exp(u))
        return -np.log(np.maximum(p[np.arange(len(ys)), ys], 1e-12)).sum()

    a, b, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))
