"""Sparse multinomial logistic regression trained with follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

Rows = Sequence[tuple[np.ndarray, np.ndarray]]


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def ftrl(rows: Rows, y: np.ndarray, dim: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 3, seed: int = 5, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights `(dim, classes)` of rows given as (indices, values); FTRL-proximal
    with an elastic-net penalty, so that most weights are exactly zero."""
    z, n = np.zeros((dim, classes)), np.zeros((dim, classes))

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[y[i]] -= 1.0
            g = x[:, None] * (p if weight is None else p * weight[i])[None, :]
            g2 = g * g
            z[at] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g2
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood on held-back rows."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-300)).mean())

    a, b = np.log(0.05), np.log(20.0)
    g = (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        if loss(np.exp(c)) <= loss(np.exp(d)):
            b = d
        else:
            a = c
    return float(np.exp((a + b) / 2))
