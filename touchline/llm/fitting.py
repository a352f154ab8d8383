"""A small logistic fit, shared by the operators that calibrate a score."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 1.0) -> np.ndarray:
    """Weights (the constant first) by damped Newton steps with a ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return w


class Lookup:
    """Exact table from 64-bit keys to columns of values; absent keys give zeros. `place` deals keys to buckets for speed only."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, place: Callable[[np.ndarray], np.ndarray], buckets: int):
        order = np.argsort(place(keys), kind="stable")
        self.keys, self.place = keys[order], place
        self.values = np.concatenate([values[:, order], np.zeros((len(values), 1), values.dtype)], axis=1)  # the last place is for absent keys
        self.starts = np.searchsorted(place(self.keys), np.arange(buckets + 1))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        cell = self.place(keys)
        at, end = self.starts[cell], self.starts[cell + 1]
        found = np.full(len(keys), len(self.keys))
        left = np.nonzero(at < end)[0]
        while len(left):
            hit = self.keys[at[left]] == keys[left]
            found[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return self.values[:, found]
