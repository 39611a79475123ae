"""Extremely randomised trees (Geurts, Ernst and Wehenkel 2006) in numpy, for training sets that fit a task.

A tree grows level by level: every open node draws some features and, for each, one threshold between the least and the
greatest value it holds; the split of the least Gini impurity counts. All nodes of a level are split at once, on arrays of
the rows, so there is no loop over nodes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """Node i asks whether feature[i] is at most threshold[i]; if so left[i] follows, else left[i] + 1. Leaves have a feature of -1
    and the shares of the classes."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    shares: np.ndarray

    def shares_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return self.shares[at]
            node = at[inner]
            at[inner] = self.left[node] + (x[inner, self.feature[node]] > self.threshold[node])


def fit_tree(x: np.ndarray, y: np.ndarray, classes: int, rng: np.random.Generator, tried: int | None = None) -> Tree:
    """One tree on rows x of classes y (0 .. classes - 1), grown until nodes are pure or can't be split. ``tried``: features
    that a node draws, the root of their number by default."""
    dim = x.shape[1]
    tried = min(dim, tried or max(1, int(np.sqrt(dim))))
    feature, threshold, left, shares = [np.zeros(1, np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros((1, classes))]
    feature[0][:] = -1
    rows, node, made = np.arange(len(x)), np.zeros(len(x), np.int64), 1  # node: which of the level
    while True:
        counts = np.bincount(node * classes + y[rows], minlength=0)
        n_nodes = int(node.max()) + 1 if len(node) else 0
        counts = np.pad(counts, (0, n_nodes * classes - len(counts))).reshape(n_nodes, classes)
        if n_nodes:
            shares[-1][:] = counts / counts.sum(axis=1, keepdims=True)
        open_ = (counts > 0).sum(axis=1) > 1
        if not open_.any():
            break
        # rows of open nodes, ordered by node
        keep = np.flatnonzero(open_[node])
        keep = keep[np.argsort(node[keep], kind="stable")]
        r, who = rows[keep], (np.cumsum(open_) - 1)[node[keep]]
        m = int(open_.sum())
        first = np.searchsorted(who, np.arange(m))
        drawn = rng.random((m, dim)).argpartition(tried - 1, axis=1)[:, :tried] if tried < dim else np.tile(np.arange(dim), (m, 1))
        values = x[r[:, None], drawn[who]]
        low, high = np.minimum.reduceat(values, first, axis=0), np.maximum.reduceat(values, first, axis=0)
        cut = low + rng.random((m, tried)) * (high - low)
        right = values > cut[who]
        # impurity: size minus the sum of squares over the size, on both sides
        all_ = counts[open_][:, None, :]
        key = (who[:, None] * tried + np.arange(tried)) * classes + y[r][:, None]
        over = np.bincount(key[right], minlength=m * tried * classes).reshape(m, tried, classes)
        under = all_ - over
        n_over, n_under = over.sum(axis=2), under.sum(axis=2)
        with np.errstate(invalid="ignore", divide="ignore"):
            pure = (over * over).sum(axis=2) / n_over + (under * under).sum(axis=2) / n_under
        pure[(n_over == 0) | (n_under == 0)] = -1
        best = pure.argmax(axis=1)
        splits = pure[np.arange(m), best] >= 0
        at = np.flatnonzero(open_)[splits]
        if not len(at):
            break
        picked = best[splits]
        feature[-1][at] = drawn[np.flatnonzero(splits), picked]
        threshold[-1][at] = cut[np.flatnonzero(splits), picked]
        left[-1][at] = made + 2 * np.arange(len(at))
        made += 2 * len(at)
        place = np.full(m, -1)
        place[splits] = np.arange(len(at))
        goes = place[who] >= 0
        node = 2 * place[who][goes] + right[np.flatnonzero(goes), best[who][goes]]
        rows = r[goes]
        feature.append(np.full(2 * len(at), -1))
        threshold.append(np.zeros(2 * len(at)))
        left.append(np.zeros(2 * len(at), np.int64))
        shares.append(np.zeros((2 * len(at), classes)))
    return Tree(np.concatenate(feature).astype(np.int32), np.concatenate(threshold), np.concatenate(left).astype(np.int32), np.concatenate(shares).astype(np.float32))


def fit_forest(x: np.ndarray, y: np.ndarray, classes: int, trees: int, seed: int) -> list[Tree]:
    return [fit_tree(x, y, classes, np.random.default_rng((seed, i))) for i in range(trees)]


def forest_shares(forest: list[Tree], x: np.ndarray) -> np.ndarray:
    """Mean of the trees' shares of the classes for every row."""
    return sum((t.shares_of(x) for t in forest), np.zeros((len(x), forest[0].shares.shape[1]), np.float32)) / np.float32(len(forest))
