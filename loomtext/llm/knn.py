"""Most similar vectors (problem 7): leaves, score-aware four-bit codes, scans of the codes, exact reranking.

The index is fitted on the driver on a bounded sample (``SAMPLE`` vectors, taken by the hash of the id) and applied to
every vector: k-means leaves, and per subspace 16 codewords for what is left of a vector after its leaf's centroid, chosen
by the anisotropic loss of Guo et al. (2020), which weighs the part of the error that is parallel to the vector more, as
only that part shifts large inner products. The parallel error of the subspaces done is carried into the choice for
the next, so it cancels. The vectors are laid out by leaf. Summing a query's tables of inner products over the codes is
the product of the query with the decoded codes, and numpy does that product faster than any gather from tables.

Pairs above a threshold t (``similar_pairs``): only codes are laid out and shuffled, 4 bits a dimension; exact vectors are
joined to the pairs that pass, and decide. Nothing is lost. Let x have the decoded form y, e = x - y, p = x.e and o the
length of the rest of e. For q with q.x = c >= t, q.e = c p + sqrt(1 - c^2) u.e with u orthogonal to x, so q.e <= P =
max(t p, p) + sqrt(1 - t^2) o, and the inner product of the decoded forms is t - P - P' - |e| |e'| at least. Nor does the
choice of leaves lose any: the way from q to x of another leaf crosses the plane that bisects the two leaves, so one of
them lies within half the angle arccos(t) of that plane. As every vector is a query in each leaf whose plane with its own
is that near, one of the two meets the other. Leaves are two levels: those that are laid out grow with the collection (up
to ``PAIR_LEAF`` vectors), so that a vector visits few; inside its task a large one is divided into cells, chosen by the
same planes with the errors added (those that ask from elsewhere are not asked in turn: for them the whole way counts).

Neighbours (``nearest_neighbours``): queries are few, so their exact vectors and those of the stored rows are laid out with
the codes; the best by code are reranked on the exact vectors where they are.

A leaf that would hold more than ``BLOCK`` vectors, by its share of the sample, is cut into blocks, and all pairs of its
blocks are tasks of their own. Exact copies are collapsed before and expanded afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.components import linked_rows
from loomtext.llm.pairs import expand, pairs_within
from loomtext.llm.vectors import binary, matrix, unit_vectors
from loomtext.llm.words import slices
from loomtext.plans.shared import materialize, small

#: Vectors that the index is fitted on: the first number, and more where the leaves need them, up to the other (256 MB of 64
#: dimensions at the driver); those that the codewords are fitted on.
SAMPLE, MOST, CODED = 20_000, 1_000_000, 8_192
#: Vectors a leaf shall hold; sampled vectors that a leaf needs.
LEAF, PER_LEAF = 1024, 24
#: Where pairs are sought, vectors a leaf shall hold: the first number while there are few leaves, then up to the other. The
#: larger the leaves, the fewer a vector must visit.
SMALL_LEAF, FEW_LEAVES, PAIR_LEAF = 4096, 64, 16384
BLOCK = 32768
#: A block of more vectors is divided once more inside its task, into cells of so many; a query visits those that it can
#: have a pair in.
DIVIDE, CELL = 6144, 512
#: Share of the nearest vectors whose leaves a neighbour search shall open, and the sampled queries that tell how many.
RECALL, PILOT = 0.98, 512
#: Four-bit codes: codewords each, dimensions of a subspace (for pairs, for neighbours), weight of the parallel error.
WORDS, PAIR_WIDTH, WIDTH, PARALLEL = 16, 1, 4, 4.0
#: Pairs that are broadcast to fetch their vectors, at most; beyond it the joins are shuffled.
PAIR_ROWS = 200_000


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        best = np.concatenate([(x[i : i + 8192] @ c.T).argmax(axis=1) for i in range(0, len(x), 8192)])
        order = np.argsort(best, kind="stable")
        got, start = np.unique(best[order], return_index=True)
        c = c.copy()
        sums = np.add.reduceat(x[order], start)
        c[got] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


#: Centroids that are fitted at once; more are fitted in two levels.
FLAT = 1024


def _centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centroids (a few more or fewer in two levels: those of the second are shared out by the size of the first's)."""
    if k <= FLAT:
        return _kmeans(x, k, rng)
    first = _kmeans(x, math.ceil(math.sqrt(k)), rng)
    home = np.concatenate([(x[i : i + 8192] @ first.T).argmax(axis=1) for i in range(0, len(x), 8192)])
    parts = [x[home == i] for i in range(len(first))]
    return np.concatenate([_kmeans(p, min(len(p), max(1, round(k * len(p) / len(x)))), rng) for p in parts if len(p)])


class Index:
    """Centroids of the leaves, codewords, number of blocks of each leaf. ``width``: dimensions of a subspace, or the
    next smaller divisor of their number."""

    def __init__(self, sample: np.ndarray, total: int, leaf: int = LEAF, width: int = WIDTH, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        n, self.dim = sample.shape
        self.leaves = _centres(sample, max(1, min(math.ceil(total / leaf), n // PER_LEAF)), rng)
        self.rows = max(64, (1 << 23) // len(self.leaves))  # vectors whose products with all leaves fit a task
        self.width = next(w for w in range(min(width, self.dim), 0, -1) if self.dim % w == 0)
        self.subspaces = self.dim // self.width
        best = np.concatenate([self.nearest(sample[i : i + self.rows], 1)[:, 0] for i in range(0, n, self.rows)])
        some = rng.permutation(n)[:CODED]
        self.words = self._codewords(sample[some], sample[some] - self.leaves[best[some]], rng)
        share = np.bincount(best, minlength=len(self.leaves)) / n * total
        self.blocks = np.maximum(1, np.ceil(share / BLOCK)).astype(np.int32)

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The leaves with the greatest inner products, best first."""
        cos = x @ self.leaves.T
        probes = min(probes, cos.shape[1])
        part = np.argpartition(-cos, probes - 1, axis=1)[:, :probes]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(cos, part, axis=1), axis=1, kind="stable"), axis=1)

    def apart(self, home: np.ndarray) -> np.ndarray:
        """Distances of the centroids ``home`` from all, rounded up."""
        some, at = np.unique(home, return_inverse=True)
        square = (self.leaves * self.leaves).sum(axis=1)
        return np.sqrt(np.maximum(square[some, None] + square - 2 * self.leaves[some] @ self.leaves.T, 0) + 1e-6)[at]

    def _codewords(self, x: np.ndarray, left: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Per subspace 16 codewords: alternately each part takes the word of the least anisotropic loss (the parallel
        direction is that of the vector), and each word becomes the minimiser of the loss over the parts it got."""
        words = np.zeros((self.subspaces, WORDS, self.width), np.float32)
        for s in range(self.subspaces):
            p, d = left[:, s * self.width : (s + 1) * self.width], x[:, s * self.width : (s + 1) * self.width]
            c = p[rng.choice(len(p), WORDS, replace=len(p) < WORDS)]
            for _ in range(6):
                got = self._choose(p, d, c, 0)[0]
                order = np.argsort(got, kind="stable")
                edges = np.searchsorted(got[order], np.arange(WORDS + 1))
                for w in range(WORDS):
                    at = order[edges[w] : edges[w + 1]]
                    if len(at):
                        # minimise sum |a - c|^2 + (eta - 1) (b . (a - c))^2
                        a, b = p[at].astype(np.float64), d[at].astype(np.float64)
                        lhs = len(a) * np.eye(self.width) + (PARALLEL - 1) * b.T @ b
                        rhs = a.sum(axis=0) + (PARALLEL - 1) * b.T @ (a * b).sum(axis=1)
                        c[w] = np.linalg.solve(lhs, rhs)
            words[s] = c
        return words

    @staticmethod
    def _choose(p: np.ndarray, d: np.ndarray, c: np.ndarray, carried: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """(word of the least loss, the parallel error with what is carried from earlier subspaces)."""
        across = (c * c).sum(axis=1) - 2 * p @ c.T  # |p - c|^2 without |p|^2
        along = ((p * d).sum(axis=1) + carried)[:, None] - d @ c.T
        got = (across + (PARALLEL - 1) * along * along).argmin(axis=1)
        return got, along[np.arange(len(p)), got]

    def encode(self, x: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Codes of vectors of the leaves, two in a byte."""
        left = x - self.leaves[leaf]
        codes = np.zeros((len(x), self.subspaces + self.subspaces % 2), np.uint8)
        carried = np.zeros(len(x), np.float32)
        for s in range(self.subspaces):
            at = slice(s * self.width, (s + 1) * self.width)
            codes[:, s], carried = self._choose(left[:, at], x[:, at], self.words[s], carried)
        return codes[:, ::2] << 4 | codes[:, 1::2]

    def decode(self, packed: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        codes = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)[:, : self.subspaces]
        return self.words[np.arange(self.subspaces), codes].reshape(len(packed), self.dim) + self.leaves[leaf]


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of a binary column of equal lengths."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _across(cos: np.ndarray, home: np.ndarray, apart: np.ndarray, sine: np.ndarray | float) -> np.ndarray:
    """Which cells a vector is near to, queries x cells: the sine of its angle with the plane that bisects the cell and
    its own is ``sine`` at most. ``cos`` holds its inner products with the centres, ``apart`` their distances from its own."""
    return np.take_along_axis(cos, home[:, None], axis=1) - cos <= sine * apart + 1e-5


def _spread(index: Index, leaf: np.ndarray, ids: np.ndarray, stored: bool, columns: dict[str, np.ndarray | pa.Array]) -> Iterator[pa.RecordBatch]:
    """Rows of a leaf for each pair (i, j) of its blocks that they belong to: stored rows have the block i, queries j."""
    blocks = index.blocks[leaf]
    mine = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks
    rows = np.repeat(np.arange(len(ids)), blocks)
    other = np.arange(len(rows)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    i, j = (mine[rows], other) if stored else (other, mine[rows])
    for a in range(0, len(rows), 16384):
        at, part = rows[a : a + 16384], slice(a, a + 16384)
        more = [binary(c[at]) if c.ndim == 2 else pa.array(c[at]) for c in columns.values()]
        yield pa.RecordBatch.from_arrays([pa.array(leaf[at].astype(np.int32)), pa.array(i[part].astype(np.int32)), pa.array(j[part].astype(np.int32)), pa.array(ids[at]), pa.array(np.full(len(at), stored)), *more], ["leaf", "i", "j", "id", "stored", *columns])


_PAIR_ROWS = "leaf int, i int, j int, id long, stored boolean, home int, wide float, error float, code binary"


def _pair_rows(index: Index, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows for the leaves: each vector stored in its nearest (where that is one block, the stored row is the query too)
    and as a query in all that can hold one of its pairs. ``wide`` is the bound P, ``error`` the length of the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half, sine = math.sqrt((1 - threshold) / 2), math.sqrt(1 - threshold**2)
        for whole in batches:
            for b in slices(whole, 1, 2 << 20, index.rows):
                ids, x = b.column(0).to_numpy(), matrix(b.column(1), index.dim)
                cos = x @ index.leaves.T
                home = cos.argmax(axis=1)
                code = index.encode(x, home)
                e = x - index.decode(code, home)
                p = (x * e).sum(axis=1)
                wide = np.maximum(threshold * p, p) + sine * np.linalg.norm(e - p[:, None] * x, axis=1)
                held = {"home": home.astype(np.int32), "wide": wide.astype(np.float32), "error": np.linalg.norm(e, axis=1).astype(np.float32), "code": code}
                yield from _spread(index, home, ids, True, held)
                near = _across(cos, home, index.apart(home), half)
                near[np.arange(len(ids)), home] = index.blocks[home] > 1
                who, to = np.nonzero(near)
                for at in range(0, len(who), 16384):
                    w = who[at : at + 16384]
                    yield from _spread(index, to[at : at + 16384], ids[w], False, {k: v[w] for k, v in held.items()})

    return run


_NEAR_ROWS = "leaf int, i int, j int, id long, stored boolean, code binary, vec binary"


def _near_rows(index: Index, probes: int, every: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows for the leaves: each vector stored in its nearest; those whose ids ``every`` divides are queries in ``probes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1, 2 << 20, index.rows):
                ids, x = b.column(0).to_numpy(), matrix(b.column(1), index.dim)
                home = index.nearest(x, 1)[:, 0]
                yield from _spread(index, home, ids, True, {"code": index.encode(x, home), "vec": x})
                ask = ids % every == 0
                if ask.any():
                    leaves = index.nearest(x[ask], probes)
                    who = np.repeat(np.flatnonzero(ask), leaves.shape[1])
                    yield from _spread(index, leaves.ravel(), ids[who], False, {"code": np.zeros((len(who), 0), np.uint8), "vec": x[who]})

    return run


def _cells(y: np.ndarray, error: np.ndarray, asking: np.ndarray, kept: np.ndarray, stored: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, places in ``kept`` they are held against): all at once for a small block; a large one is divided into
    cells, and a query goes to those that can hold one of its pairs. Decoded vectors of a pair are no farther apart than
    the vectors and their errors are long."""
    if len(kept) <= DIVIDE:
        yield asking, np.arange(len(kept))
        return
    rng = np.random.default_rng(len(kept))
    cells = max(1, len(kept) // CELL)
    sample = y[kept[rng.choice(len(kept), min(len(kept), cells * 48), replace=False)]]
    centres = _kmeans(sample, cells, rng, 5)
    square = (centres * centres).sum(axis=1)
    apart = np.sqrt(np.maximum(square[:, None] + square - 2 * centres @ centres.T, 0) + 1e-6)
    home = np.concatenate([(y[kept[i : i + 8192]] @ centres.T).argmax(axis=1) for i in range(0, len(kept), 8192)])
    far = (math.sqrt(2 - 2 * threshold) + error[asking] + error[kept].max()) * np.where(stored[asking], 0.5, 1.0)
    goes = np.zeros((len(asking), cells), bool)
    for i in range(0, len(asking), 8192):
        cos = y[asking[i : i + 8192]] @ centres.T
        own = cos.argmax(axis=1)
        goes[i : i + 8192] = _across(cos, own, apart[own], far[i : i + 8192, None])
    order = np.argsort(home, kind="stable")
    edges = np.searchsorted(home[order], np.arange(cells + 1))
    for c in range(cells):
        if edges[c] < edges[c + 1] and goes[:, c].any():
            yield asking[goes[:, c]], order[edges[c] : edges[c + 1]]


def _near_pairs(index: Index, threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Pairs of the rows of a leaf whose decoded vectors are as near as those of a pair must be."""

    def run(t: pa.Table) -> pa.Table:
        stored, ids = t.column("stored").to_numpy(), t.column("id").to_numpy()
        wide, error = t.column("wide").to_numpy(), t.column("error").to_numpy()
        kept = np.flatnonzero(stored)
        asking = np.arange(len(ids)) if index.blocks[t.column("leaf")[0].as_py()] == 1 else np.flatnonzero(~stored)
        out = [np.zeros((0, 2), np.int64)]
        if len(kept) and len(asking):
            y = index.decode(_bytes(t.column("code")), t.column("home").to_numpy())
            one = np.ones(len(ids), np.float32)
            # decoded product + product of the errors + both bounds - threshold, as one product
            left, right = np.column_stack([y, error, one, wide - np.float32(threshold)]), np.column_stack([y, error, wide, one])
            for q, part in _cells(y, error, asking, kept, stored, threshold):
                against, who = right[kept[part]].T, ids[kept[part]]
                for at in range(0, len(q), 512):
                    some = q[at : at + 512]
                    a, b = np.nonzero(left[some] @ against >= -1e-4)
                    a, b = ids[some][a], who[b]
                    out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b])
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return run


def _cosines(dim: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            exact = np.einsum("ij,ij->i", matrix(b.column("va"), dim), matrix(b.column("vb"), dim), dtype=np.float64)
            yield b.select(["a", "b"]).filter(pa.array(exact >= threshold))

    return run


def _nearest_rows(index: Index, k: int, rerank: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        leaf = t.column("leaf")[0].as_py()
        stored = t.column("stored").to_numpy()
        ids = t.column("id").to_numpy()
        x = matrix(pa.concat_arrays(t.column("vec").chunks), index.dim)
        kept, asking = np.flatnonzero(stored), np.flatnonzero(~stored)
        who, to, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(kept) and len(asking):
            y = index.decode(_bytes(t.column("code").filter(t.column("stored"))), np.full(len(kept), leaf)).T
            for at in range(0, len(asking), 512):
                q = asking[at : at + 512]
                rough = x[q] @ y
                some = min(rerank, len(kept))
                best = np.argpartition(-rough, some - 1, axis=1)[:, :some]
                exact = np.round(np.einsum("qd,qkd->qk", x[q].astype(np.float64), x[kept][best]), 7)
                exact[ids[kept][best] == ids[q][:, None]] = -np.inf
                few = min(k, some)
                order = np.lexsort((ids[kept][best], -exact), axis=1)[:, :few]
                good = np.isfinite(np.take_along_axis(exact, order, axis=1))
                who.append(np.repeat(ids[q], few)[good.ravel()])
                to.append(ids[kept][np.take_along_axis(best, order, axis=1)][good])
                score.append(np.take_along_axis(exact, order, axis=1)[good])
        return pa.table({"id": np.concatenate(who), "near": np.concatenate(to), "cosine": np.concatenate(score)})

    return run


def _probes(index: Index, sample: np.ndarray, k: int, least: int) -> int:
    """So many leaves hold ``RECALL`` of the k nearest of sampled vectors, ``least`` at least. In a sample the nearest are
    farther off than in the collection, so the number is rather too large."""
    if len(index.leaves) <= least or len(sample) <= k:
        return least
    home = np.concatenate([index.nearest(sample[i : i + index.rows], 1)[:, 0] for i in range(0, len(sample), index.rows)])
    asking = np.random.default_rng(7).choice(len(sample), min(PILOT, len(sample)), replace=False)
    ranks = []
    for at in range(0, len(asking), 64):
        q = asking[at : at + 64]
        cos = sample[q] @ sample.T
        cos[np.arange(len(q)), q] = -np.inf
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        place = np.argsort(index.nearest(sample[q], len(index.leaves)), axis=1)
        ranks.append(np.take_along_axis(place, home[near], axis=1))
    return max(least, int(np.quantile(np.concatenate(ranks), RECALL, method="higher")) + 1)


def _sampled(units: DataFrame, total: int, dim: int, sample: int, leaf: int) -> np.ndarray:
    """As many vectors as the leaves need, ``sample`` at least and ``MOST`` at most (or ``sample``, if that is more)."""
    wanted = max(sample, min(MOST, total // leaf * PER_LEAF))
    share = min(1.0, wanted / max(1, total))
    picked = units.where((F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40)) < int(share * (1 << 40))) | F.lit(share == 1.0))
    table = picked.select("vec").toArrow()
    return np.concatenate([matrix(c, dim) for c in table.column("vec").chunks] or [np.zeros((0, dim), np.float32)])[:wanted]


def _pair_leaf(total: int) -> int:
    """Vectors of a leaf where pairs are sought."""
    return min(PAIR_LEAF, max(SMALL_LEAF, math.ceil(total / FEW_LEAVES)))


def _linked(df: DataFrame, ident: str, vector: str, dim: int, threshold: float, sample: int) -> tuple[DataFrame, DataFrame]:
    """(members: id, rep of its class of exact copies; pairs: a, b of classes)."""
    spark = df.sparkSession
    units = unit_vectors(df, ident, vector, dim).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(7919), "vec")})
    classes = materialize(units.groupBy("h1", "h2").agg(F.min(F.struct("id", "vec")).alias("r")).select("h1", "h2", "r.id", "r.vec"), "vectors")
    members = units.select("h1", "h2", "id").distinct().join(classes.select("h1", "h2", F.col("id").alias("rep")), ["h1", "h2"])
    members = materialize(members.select("id", "rep"), "members")
    vectors = classes.select("id", "vec")
    total = vectors.count()
    rows = _sampled(vectors, total, dim, sample, _pair_leaf(total))
    if not len(rows):
        return members, spark.createDataFrame([], "a long, b long")
    index = Index(rows, total, _pair_leaf(total), PAIR_WIDTH)
    laid = vectors.mapInArrow(_pair_rows(index, threshold), _PAIR_ROWS)
    near = materialize(laid.groupBy("leaf", "i", "j").applyInArrow(_near_pairs(index, threshold), "a long, b long").distinct(), "near")
    held = small(near, PAIR_ROWS).join(vectors.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a")
    if near.limit(PAIR_ROWS + 1).count() <= PAIR_ROWS:
        held = F.broadcast(held)
    both = held.join(vectors.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b").select("a", "b", "va", "vb")
    return members, materialize(both.mapInArrow(_cosines(dim, threshold), "a long, b long"), "pairs")


def similar_pairs(df: DataFrame, ident: str = "_ref", vector: str = "v", dim: int = 64, threshold: float = 0.97, sample: int = SAMPLE) -> DataFrame:
    """Pairs (ref_a, ref_b), ref_a < ref_b, of different ids whose usable vectors (``dim`` finite numbers, not all zero)
    have a cosine of ``threshold`` at least. Repeated rows count once; empty input gives no rows."""
    members, pairs = _linked(df, ident, vector, dim, threshold, sample)
    copies = pairs_within(members, ["rep"], "id").select(F.col("a").alias("ref_a"), F.col("b").alias("ref_b"))
    wide = expand(expand(pairs, "a", members, "rep", "id", "x"), "b", members, "rep", "id", "y")
    return copies.unionAll(wide.select(F.least("x", "y").alias("ref_a"), F.greatest("x", "y").alias("ref_b")).where("ref_a < ref_b")).distinct()


def similar_groups(df: DataFrame, ident: str = "_ref", vector: str = "v", dim: int = 64, threshold: float = 0.97, sample: int = SAMPLE) -> DataFrame:
    """One row per id with a usable vector and class: (id, class_id: the least id of its exact copies, n_links: other
    classes at a cosine of ``threshold`` at least, group_id: the least id that a chain of links leads to). No pairs of copies
    are made."""
    return linked_rows(*_linked(df, ident, vector, dim, threshold, sample))


def nearest_neighbours(df: DataFrame, ident: str = "_ref", vector: str = "v", dim: int = 64, k: int = 10, every: int = 50, probes: int = 16, rerank: int = 800, sample: int = SAMPLE) -> DataFrame:
    """(id, rank, near, cosine): for every id divisible by ``every`` the k most similar other ids of the whole collection
    (ties, at seven digits: the least id), searched in ``probes`` leaves at least, and in as many as hold ``RECALL`` of the
    neighbours in the sample. An id counts once. Queries of less than k other vectors get what
    there is."""
    units = materialize(unit_vectors(df, ident, vector, dim).groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
    total = units.count()
    rows = _sampled(units, total, dim, sample, LEAF)
    if not len(rows):
        return df.sparkSession.createDataFrame([], "id long, rank int, near long, cosine double")
    index = Index(rows, total)
    laid = units.mapInArrow(_near_rows(index, _probes(index, rows, k, probes), every), _NEAR_ROWS)
    found = laid.groupBy("leaf", "i", "j").applyInArrow(_nearest_rows(index, k, rerank), "id long, near long, cosine double")
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "near")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id", "rank", "near", "cosine")
