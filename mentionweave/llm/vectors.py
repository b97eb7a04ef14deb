"""What the two vector operators share: which vectors count, rotations, and codes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(name: str = "embedding") -> Column:
    """Neither null nor empty, and without null, NaN or infinite components."""
    c = F.col(name)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & ~bad, F.lit(False))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def rotated(x: np.ndarray, seed: int, rounds: int = 3) -> np.ndarray:
    """Pseudo-random rotation: sign flips and Hadamard transforms in turn, padded to a power of two."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng((seed, d))
    for _ in range(rounds):
        y = hadamard(y * rng.choice([-1.0, 1.0], d))
    return y


def cross_polytope(y: np.ndarray, n: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest signed axes of each row, nearest first, and how large those coordinates are."""
    at = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :n]
    v = np.take_along_axis(y, at, 1)
    return 2 * at + (v < 0), np.abs(v)
