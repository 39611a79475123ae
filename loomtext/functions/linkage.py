"""Average linkage and the order of its leaves, for some hundred rows in numpy."""

from __future__ import annotations

import numpy as np


def leaf_order(distance: np.ndarray) -> list[int]:
    """Leaves from left to right of the average-linkage dendrogram of a square distance matrix: clusters i, j of the
    least mean distance join (ties: the ones made first), the one made first stands left."""
    n = len(distance)
    d = np.asarray(distance, float).copy()
    np.fill_diagonal(d, np.inf)
    groups: dict[int, list[int]] = {i: [i] for i in range(n)}
    while len(groups) > 1:
        live = sorted(groups)
        sub = d[np.ix_(live, live)]
        a, b = np.unravel_index(int(sub.argmin()), sub.shape)
        i, j = sorted((live[a], live[b]))
        x, y = len(groups[i]), len(groups[j])
        merged = (d[i] * x + d[j] * y) / (x + y)
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        groups[i] = groups[i] + groups.pop(j)
    return next(iter(groups.values())) if groups else []


def cosine_distances(x: np.ndarray) -> np.ndarray:
    """1 - cosine of all rows; rows of zeros are at distance 1 from all."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n > 0, n, 1)
    return 1 - np.clip(u @ u.T, -1, 1)
