"""Follow-the-regularised-leader (proximal) with per-coordinate rates and elastic-net penalties."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Penalty:
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0


class Ftrl:
    """One linear model over hashed coordinates; the last coordinate is the unpenalised intercept."""

    def __init__(self, size: int, outputs: int, penalty: Penalty):
        self.z = np.zeros((outputs, size + 1))
        self.n = np.zeros((outputs, size + 1))
        self.p = penalty
        self.size = size

    def _solve(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        p = self.p
        w = -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)
        w[np.abs(z) <= p.l1] = 0
        w[:, -1] = -z[:, -1] / ((p.beta + np.sqrt(n[:, -1])) / p.alpha)
        return w

    def step(self, idx: np.ndarray, val: np.ndarray, gradient) -> None:
        """One example: idx, val its coordinates; gradient(scores) gives the loss gradient by output."""
        at = np.append(idx, self.size)
        x = np.append(val, 1.0)
        z, n = self.z[:, at], self.n[:, at]
        w = self._solve(z, n)
        g = np.outer(gradient(w @ x), x)
        n_new = n + g * g
        self.z[:, at] = z + g - (np.sqrt(n_new) - np.sqrt(n)) / self.p.alpha * w
        self.n[:, at] = n_new

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """(outputs x size weights, intercepts)"""
        w = self._solve(self.z, self.n)
        return w[:, :-1], w[:, -1]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def best_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood on held-back rows, by golden-section search."""
    if not len(labels):
        return 1.0

    def loss(log_t):
        p = softmax(scores / np.exp(log_t))[np.arange(len(labels)), labels]
        return -np.log(np.maximum(p, 1e-12)).mean()

    lo, hi = np.log(0.05), np.log(20.0)
    phi = (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - phi * (hi - lo), lo + phi * (hi - lo)
        if loss(a) <= loss(b):
            hi = b
        else:
            lo = a
    return float(np.exp((lo + hi) / 2))
