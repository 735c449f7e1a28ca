"""Embeddings behind one contract, with an offline provider, and cosine similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts to vectors of one length; an application may pass a model's client instead of the offline provider.
Provider = Callable[[list[str]], np.ndarray]
SIZE = 256


def hashed_ngrams(texts: list[str], size: int = SIZE) -> np.ndarray:
    """The offline provider: counts of character trigrams and words, placed by their MD5; unit length.

    It is deterministic and knows spelling only, so its scores don't compare with a model's.
    """
    out = np.zeros((len(texts), size))
    for row, text in zip(out, texts):
        low = f"  {text.lower()} "
        for g in [low[k : k + 3] for k in range(len(low) - 2)] + low.split():
            row[int.from_bytes(hashlib.md5(g.encode()).digest()[:4], "big") % size] += 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-8)


def similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all rows of a with all rows of b."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
    return unit(np.asarray(a, float)) @ unit(np.asarray(b, float)).T


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors in columns."""
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (row, column) of the assignment with the largest total, by shortest augmenting paths.

    Rectangular matrices leave the larger side's rest out; ties go to the smaller index.
    """
    score = np.asarray(score, float)
    if not score.size:
        return []
    if score.shape[0] > score.shape[1]:
        return sorted((r, c) for c, r in assignment(score.T))
    cost = score.max() - score
    n, m = cost.shape
    u, v, of, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        of[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            free = np.flatnonzero(~used[1:]) + 1
            here = cost[of[j] - 1, free - 1] - u[of[j]] - v[free]
            better = here < least[free]
            least[free[better]], way[free[better]] = here[better], j
            k = free[np.argmin(least[free])]
            step = least[k]
            u[of[used]] += step
            v[used] -= step
            least[~used] -= step
            j = k
            if not of[j]:
                break
        while j:
            of[j], j = of[way[j]], way[j]
    return sorted((int(of[j]) - 1, j - 1) for j in range(1, m + 1) if of[j])
