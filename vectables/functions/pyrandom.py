"""Driver-side twin of :mod:`vectables.functions.random` for a handful of constants
(one query vector, one filter): same digest, same value, no Spark job needed."""

from __future__ import annotations

import hashlib

import numpy as np

from vectables import SEED

TWO_POW_52 = 4503599627370496.0


def uniform(stream: str, *parts, seed: int = SEED) -> float:
    key = ":".join([str(seed), stream] + [str(p) for p in parts])
    return int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / TWO_POW_52


def uniform_int(stream: str, n: int, *parts, seed: int = SEED) -> int:
    return int(np.floor(uniform(stream, *parts, seed=seed) * n))


def random_vector(stream: str, key, dim: int, seed: int = SEED) -> np.ndarray:
    return np.array([uniform(stream, key, j, seed=seed) * 2.0 - 1.0 for j in range(dim)], dtype=np.float32)


def random_keyword(stream: str, key, n: int, seed: int = SEED) -> str:
    if n <= 0:
        raise ValueError("keyword variants must be positive")
    return f"keyword_{uniform_int(stream, n, key, seed=seed)}"
