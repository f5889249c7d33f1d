"""Sparse sums over rows of varying length, for linear models on hashed text."""

from __future__ import annotations

import zlib

import numpy as np


def bucket(token: str, size: int) -> int:
    """The bucket of a token, the same in every process; size is a power of two."""
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) & (size - 1)


class Sparse:
    """Rows of (feature, value) pairs, laid end to end."""

    def __init__(self, rows: list[np.ndarray], values: list[np.ndarray] | None = None):
        lengths = np.array([len(r) for r in rows], np.int64)
        self.n = len(rows)
        self.ids = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
        self.values = np.ones(len(self.ids)) if values is None else np.concatenate([*values, np.empty(0)]).astype(float)
        self.row = np.repeat(np.arange(self.n), lengths)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.ids] * self.values, self.n)

    def gradient(self, of_rows: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.ids, of_rows[self.row] * self.values, size)


class Adam:
    """Adam steps on one parameter vector."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient * gradient - self.v)
        return -self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
