"""Spectral clustering of one block of vectors (Ng, Jordan and Weiss 2002), in numpy."""

from __future__ import annotations

import numpy as np


def cosine_affinity(x: np.ndarray) -> np.ndarray:
    """Cosines, at most 1, plus 1 + 1e-8: from just above 0 to 2; symmetric."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n > 0, n, 1)
    s = np.minimum(u @ u.T, 1.0) + 1 + 1e-8
    return np.maximum(s, s.T)


def kmeans(x: np.ndarray, k: int, seed: int, starts: int = 8, rounds: int = 60) -> np.ndarray:
    """Labels of the best of several k-means++ starts."""
    rng = np.random.default_rng(seed)
    best, found = np.inf, np.zeros(len(x), int)
    for _ in range(starts):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(rounds):
            d = ((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None])
            label = d.argmin(axis=1)
            moved = np.array([x[label == j].mean(axis=0) if (label == j).any() else c[j] for j in range(k)])
            if np.allclose(moved, c):
                break
            c = moved
        cost = d.min(axis=1).sum()
        if cost < best:
            best, found = cost, label
    return found


def spectral_labels(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Labels 0..k-1 (fewer if there are fewer rows)."""
    k = min(k, len(x))
    if k <= 1:
        return np.zeros(len(x), int)
    a = cosine_affinity(x)
    d = 1 / np.sqrt(a.sum(axis=1))
    vectors = np.linalg.eigh(a * d[:, None] * d[None])[1][:, -k:]
    rows = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return kmeans(rows, k, seed)
