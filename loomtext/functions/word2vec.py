"""Word vectors (Mikolov et al. 2013) trained on encoded texts in numpy: continuous bag of words or skip-gram, with
hierarchical softmax or negative samples. Positions are taken in small batches; within a batch the gradients of a row are
added up, and bounded where very many meet (the upper nodes of the tree)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np

FIRST_RATE, LAST_RATE = 0.025, 0.0001
#: Positions of a batch, gradients of one row that a batch counts in full.
BATCH, FULL = 128, 16
#: Positions whose rows are gathered once and multiplied as a matrix: near each other in the tree, in the text.
SIDE, NEAR = 16, 32


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, codes) of the way from the root to every word, words x longest way, padded by -1. Ties: the earlier made."""
    n = len(counts)
    parent, bit = np.zeros(max(1, 2 * n - 1), np.int64), np.zeros(max(1, 2 * n - 1), np.int64)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    for made in range(n, 2 * n - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = made
        bit[y] = 1
        heapq.heappush(heap, (a + b, made))
    ways = []
    for i in range(n):
        way, at = [], i
        while at != 2 * n - 2:
            way.append((parent[at] - n, bit[at]))
            at = parent[at]
        ways.append(way[::-1])
    longest = max(map(len, ways), default=0)
    nodes, codes = np.full((n, longest), -1, np.int64), np.full((n, longest), -1, np.int64)
    for i, way in enumerate(ways):
        if way:
            nodes[i, : len(way)], codes[i, : len(way)] = zip(*way, strict=True)
    return nodes, codes


@dataclass(frozen=True)
class Plan:
    """How to train: counts of the words, ways of the tree (None: negative samples, so many), and the sizes."""

    counts: np.ndarray
    ways: tuple[np.ndarray, np.ndarray] | None
    negative: int
    window: int
    skip_gram: bool
    sample: float

    @property
    def kept(self) -> np.ndarray:
        """Chance of a word to be kept when frequent words are thinned out."""
        if self.sample <= 0:
            return np.ones(len(self.counts))
        x = self.sample * self.counts.sum() / np.maximum(self.counts, 1)
        return np.minimum(1, np.sqrt(x) + x)


def _positions(flat: np.ndarray, sizes: np.ndarray, plan: Plan, chance: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(words, contexts padded by -1) of all positions that have a context, of texts of these sizes one after another; windows
    are shortened at random."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    kept = rng.random(len(flat)) < chance[flat]
    flat, text = flat[kept], text[kept]
    width = rng.integers(1, plan.window + 1, len(flat))
    around = np.full((len(flat), 2 * plan.window), -1, np.int64)
    for k, step in enumerate([*range(-plan.window, 0), *range(1, plan.window + 1)]):
        here, there = (slice(step, None), slice(None, -step)) if step > 0 else (slice(None, step), slice(-step, None))
        ok = (width[there] >= abs(step)) & (text[here] == text[there])
        np.copyto(around[there, k], flat[here], where=ok)
    if plan.skip_gram:
        where = np.nonzero(around >= 0)
        return flat[where[0]], around[where][:, None]
    some = (around >= 0).any(axis=1)
    return flat[some], around[some]


def _distinct(at: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, the place of every row among them); ``slot`` has room for a number a row."""
    every = np.arange(len(at))
    slot[at] = every
    rows = at[slot[at] == every]
    slot[rows] = np.arange(len(rows))
    return rows, slot[at]


@dataclass(frozen=True)
class _Rows:
    """The rows of a model that the positions of a batch use: every ``side`` positions have each of theirs once (``at``), in the
    order of these blocks. ``use``: for every use of a row its place in ``at``; ``each``, ``owner``: distinct rows, and the place of ``at`` in them."""

    at: np.ndarray
    use: np.ndarray
    block: np.ndarray
    each: np.ndarray
    owner: np.ndarray
    parts: list[tuple[slice, slice]]
    side: int

    @staticmethod
    def of(row: np.ndarray, to: np.ndarray, size: int, n: int, side: int, slot: np.ndarray) -> _Rows:
        """Of ``n`` positions; ``row`` is the position of every use, rising, ``to`` its row of a model with ``size`` of them."""
        seen, use = _distinct(to + row // side * size, slot)
        block, at = np.divmod(seen, size)
        ends = np.searchsorted(block, np.arange(-(-n // side) + 1)).tolist()
        parts = [(slice(a, b), slice(k * side, min(n, (k + 1) * side))) for k, (a, b) in enumerate(pairwise(ends))]
        return _Rows(at, use, block, *_distinct(at, slot), parts, side)

    def weights(self, row: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        """For every row and position of its block the sum of the weights (or the number) of its uses."""
        place = self.use * self.side + row % self.side
        return np.bincount(place, weight, minlength=len(self.at) * self.side).astype(np.float32).reshape(-1, self.side)

    def put(self, model: np.ndarray, rows: np.ndarray, weight: np.ndarray, by: np.ndarray, change: np.ndarray) -> None:
        """Add to the ``rows`` gathered from the model what ``weight`` takes of ``by``, bounded where many meet; put them back."""
        met = np.bincount(self.owner[self.use], minlength=len(self.each))
        if met.max(initial=0) > FULL:
            weight *= np.minimum(1, FULL / met).astype(np.float32)[self.owner, None]
        for part, mine in self.parts:
            np.matmul(weight[part, : mine.stop - mine.start], by[mine], out=change[part])
        times = np.bincount(self.owner, minlength=len(self.each))
        common, again = np.flatnonzero(times > 1), np.flatnonzero(times[self.owner] > 1)
        spread = np.zeros((len(common), len(self.parts), self.side), np.float32)
        spread[(np.cumsum(times > 1) - 1)[self.owner[again]], self.block[again]] = weight[again]
        common = self.each[common]
        total = model[common] + spread.reshape(len(common), len(self.parts) * self.side)[:, : len(by)] @ by
        rows += change
        model[self.at] = rows
        model[common] = total  # rows of several blocks


def _step(h: np.ndarray, outer: np.ndarray, row: np.ndarray, to: np.ndarray, sign: np.ndarray, rate: np.float32, slot: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Change the rows ``to`` of ``outer`` by the positions ``row`` (in rising order), towards (sign 1) or away from (-1) their
    context ``h``; returns what the contexts change by."""
    r = _Rows.of(row, to, len(outer), len(h), SIDE, slot)
    rows, change = held[:, : len(r.at)]
    np.take(outer, r.at, axis=0, out=rows, mode="clip")
    wanted, x, across = r.weights(row, sign), np.zeros((len(r.at), SIDE), np.float32), np.ascontiguousarray(h.T)
    for part, mine in r.parts:
        np.matmul(rows[part], across[:, mine], out=x[part, : mine.stop - mine.start])
    g = wanted * rate / (1 + np.exp(np.clip(np.sign(wanted) * x, -30, 30)))  # of a row drawn twice, two
    back = np.empty_like(h)
    for part, mine in r.parts:
        np.matmul(g[part, : mine.stop - mine.start].T, rows[part], out=back[mine])
    r.put(outer, rows, g, h, change)
    return back


def train(texts: Iterator[tuple[np.ndarray, np.ndarray]], inner: np.ndarray, outer: np.ndarray, plan: Plan, rates: tuple[float, float], total: int, rng: np.random.Generator) -> None:
    """One pass over the texts, in groups (their words, the sizes of the texts), changing ``inner`` (words) and ``outer`` (nodes or words) in place; the rate goes
    from the first to the second over ``total`` words."""
    table = None if plan.ways else np.cumsum(plan.counts**0.75)
    # words in the order of the tree, so that positions with common nodes meet
    rank = np.argsort(np.lexsort(plan.ways[1].T[::-1])) if plan.ways and plan.ways[1].size else np.arange(len(inner))
    signs = 1 - 2 * plan.ways[1] if plan.ways else None
    slot = np.zeros(max(-(-BATCH // NEAR) * len(inner), -(-BATCH // SIDE) * len(outer)), np.int64)
    held = np.empty((2, BATCH * max(2 * plan.window, plan.ways[0].shape[1] if plan.ways else 1 + plan.negative), inner.shape[1]), np.float32)
    chance = plan.kept
    done = 0
    for flat, sizes in texts:
        words, around = _positions(flat, sizes, plan, chance, rng)
        share = done / max(1, total)
        rate = np.float32(rates[0] + (rates[1] - rates[0]) * min(1.0, share))
        done += len(flat)
        for a in range(0, len(words), BATCH):
            w, ctx = words[a : a + BATCH], around[a : a + BATCH]
            known = np.flatnonzero(ctx >= 0)
            row = known // ctx.shape[1]
            r = _Rows.of(row, ctx.ravel()[known], len(inner), len(w), NEAR, slot)
            window, vectors = r.weights(row), inner[r.at]
            h = np.empty((len(w), inner.shape[1]), np.float32)
            for part, mine in r.parts:
                np.matmul(window[part, : mine.stop - mine.start].T, vectors[part], out=h[mine])
            h /= np.bincount(row, minlength=len(w))[:, None].astype(np.float32)
            if plan.ways:
                order = np.argsort(rank[w])
                to, sign = plan.ways[0][w[order]], signs[w[order]]
                used = to >= 0
            else:
                order = np.arange(len(w))
                drawn = np.searchsorted(table, rng.random((len(w), plan.negative)) * table[-1], "right")
                to = np.concatenate([w[:, None], np.minimum(drawn, len(table) - 1)], axis=1)
                sign = np.full(to.shape, -1)
                sign[:, 0] = 1
                used = np.ones(to.shape, bool)
                used[:, 1:] = to[:, 1:] != w[:, None]
            at = np.flatnonzero(used)
            back = np.empty_like(h)
            back[order] = _step(h[order], outer, at // max(1, to.shape[1]), to.ravel()[at], sign.ravel()[at], rate, slot, held)
            r.put(inner, vectors, window, back, held[0, : len(vectors)])
