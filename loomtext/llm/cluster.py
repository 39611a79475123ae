"""Similarity clusters of records (problem 6): spherical k-means with parallel oversampled seeding.

Every pass over the vectors is one narrow job that returns sums per cluster, added up in the cluster; the driver holds
only centroids and the seeding's candidates (their number depends on k alone). Seeding is k-means|| (Bahmani et al.
2012): in each round the points race with exponential keys whose rate is their squared distance from the candidates so
far, and the first ones become candidates; weighted by the points they attract they are clustered from several starts, each a task of
its own, and the best starts are compared on all vectors. Points farther than ``floor`` from every mean
direction belong to no cluster and don't pull one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.terms import counted, records
from loomtext.llm.vectors import binary, matrix, unit_vectors
from loomtext.llm.words import mix, slices
from loomtext.plans.shared import materialize

ROUNDS, OVERSAMPLING, STARTS, TRIES, COMPARED, SETTLE, MOST_PASSES, STILL = 5, 8, 60, 5, 6, 3, 30, 1e-4
#: Inner products that a task holds at once; starts are fewer for more clusters, down to so many.
PRODUCTS, FEWEST_STARTS = 1 << 23, 6
#: Clusters whose sums are made as products; hashes of terms are counted in so many buckets.
FEW, BUCKETS = 64, 1 << 20
#: Centroids whose sums are added up together.
ROWS = 256
_Batches = Iterator[pa.RecordBatch]


def _blocks(batches: _Batches, dim: int, against: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors, so many that their products with ``against`` others fit a task."""
    for whole in batches:
        for b in slices(whole, 1, rows=max(64, PRODUCTS // max(1, against))):
            yield b.column(0).to_numpy(), matrix(b.column(1), dim)


def _race(candidates: np.ndarray, seed: int, first: int) -> Callable[[_Batches], _Batches]:
    dim = candidates.shape[1]

    def run(batches: _Batches) -> _Batches:
        keys, rows = np.zeros(0), np.zeros((0, dim), np.float32)
        for ids, x in _blocks(batches, dim, len(candidates)):
            far = np.maximum(1 - (x @ candidates.T).max(axis=1), 0) if len(candidates) else np.ones(len(x))
            u = (mix(ids.view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).astype(np.float64) + 1) / 2.0**64
            with np.errstate(divide="ignore"):
                key = np.where(far > 1e-6, -np.log(u) / far, np.inf)
            keys, rows = np.concatenate([keys, key]), np.concatenate([rows, x])
            if len(keys) > first:
                best = np.argpartition(keys, first - 1)[:first]
                keys, rows = keys[best], rows[best]
        keep = np.isfinite(keys)
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), binary(rows[keep])], ["key", "vec"])

    return run


def _sums(sets: list[np.ndarray], floor: float) -> Callable[[_Batches], _Batches]:
    """For every set of centroids and every centroid: points, sum of cosines, sum of vectors of the points it gets."""
    dim = sets[0].shape[1]

    def run(batches: _Batches) -> _Batches:
        n = [np.zeros(len(c), np.int64) for c in sets]
        near = [np.zeros(len(c)) for c in sets]
        total = [np.zeros((len(c), dim)) for c in sets]
        for _, x in _blocks(batches, dim, max(map(len, sets))):
            for i, c in enumerate(sets):
                cos = x @ c.T
                best = cos.argmax(axis=1)
                cos = cos[np.arange(len(x)), best]
                ok = cos >= floor
                best, cos, held = (best, cos, x) if ok.all() else (best[ok], cos[ok], x[ok])
                n[i] += np.bincount(best, minlength=len(c))
                near[i] += np.bincount(best, cos, len(c))
                if len(c) <= FEW:  # a product with the indicators of the clusters is the faster for few
                    total[i] += (best[:, None] == np.arange(len(c))).astype(np.float32).T @ held
                    continue
                order = np.argsort(best, kind="stable")
                got, start = np.unique(best[order], return_index=True)
                if len(got):
                    total[i][got] += np.add.reduceat(held[order].astype(np.float64), start)
        for i in range(len(sets)):
            table = np.column_stack([n[i], near[i], total[i]])
            for j in range(0, len(table), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([table[j : j + ROWS].tobytes()], pa.binary())], ["s", "c", "part"])

    return run


def _added(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in t.column("part").to_pylist())
    return pa.table({"s": t.column("s")[:1], "c": t.column("c")[:1], "part": pa.array([total.tobytes()], pa.binary())})


def _pass(vectors: DataFrame, sets: list[np.ndarray], floor: float) -> list[tuple[np.ndarray, float, np.ndarray]]:
    """(points, sum of cosines, vector sums) for each set of centroids. The tasks' sums are added in the cluster, some
    centroids at a time; the driver gets one row for each of these."""
    schema = "s int, c int, part binary"
    added = vectors.mapInArrow(_sums(sets, floor), schema).groupBy("s", "c").applyInArrow(_added, schema)
    out = [np.zeros((len(c), 2 + c.shape[1])) for c in sets]
    for r in added.collect():
        rows = np.frombuffer(r.part, np.float64).reshape(-1, out[r.s].shape[1])
        out[r.s][r.c : r.c + len(rows)] = rows
    return [(t[:, 0].astype(np.int64), float(t[:, 1].sum()), t[:, 2:]) for t in out]


def _directions(sums: np.ndarray, points: np.ndarray, before: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.where((points[:, None] > 0) & (norm > 0), sums / np.where(norm > 0, norm, 1), before).astype(np.float32)


def _start(points: np.ndarray, weight: np.ndarray, k: int, floor: float, rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """Greedy weighted k-means++ and Lloyd on the candidates; the sum of cosines reached and the centroids."""
    c = points[[rng.choice(len(points), p=weight / weight.sum())]]
    near = points @ c[0]
    while len(c) < k:
        d = weight * np.maximum(1 - near, 0)
        tries = rng.choice(len(points), TRIES, p=d / d.sum()) if d.sum() > 0 else rng.integers(len(points), size=1)
        with_it = np.maximum(near, points[tries] @ points.T)
        best = int((with_it @ weight).argmax())  # of a few draws the one that helps most
        c, near = np.vstack([c, points[tries[best]]]), with_it[best]
    rows = max(64, PRODUCTS // k)

    def nearest(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [(cos.argmax(axis=1), cos.max(axis=1)) for i in range(0, len(points), rows) for cos in [points[i : i + rows] @ c.T]]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    for _ in range(25):
        best, near = nearest(c)
        w = weight * (near >= floor)
        order = np.argsort(best, kind="stable")
        got, first = np.unique(best[order], return_index=True)
        sums = np.zeros(c.shape)
        sums[got] = np.add.reduceat(points[order] * w[order][:, None], first)
        c = _directions(sums, np.bincount(best, w, k), c)
    near = nearest(c)[1]
    return float((weight * np.where(near >= floor, near, 0)).sum()), c


def _started(points: np.ndarray, weight: np.ndarray, k: int, floor: float, seed: int) -> Callable[[_Batches], _Batches]:
    def run(batches: _Batches) -> _Batches:
        for b in batches:
            for i in b.column(0).to_pylist():
                score, c = _start(points, weight, k, floor, np.random.default_rng((seed, i)))
                yield pa.RecordBatch.from_arrays([pa.array([score]), binary(c.astype(np.float32).reshape(1, -1))], ["score", "centres"])

    return run


def _starts(vectors: DataFrame, points: np.ndarray, weight: np.ndarray, k: int, floor: float, seed: int) -> list[np.ndarray]:
    """Centroids of every start, the best first. Starts are tasks, so the driver does none of their work."""
    n = max(FEWEST_STARTS, min(STARTS, STARTS * 100 // k))
    rows = vectors.sparkSession.range(0, n, 1, n).mapInArrow(_started(points, weight, k, floor, seed), "score double, centres binary").collect()
    return [np.frombuffer(r.centres, np.float32).reshape(k, -1) for r in sorted(rows, key=lambda r: -r.score)]


def spherical_kmeans(vectors: DataFrame, k: int, dim: int, floor: float = -2.0, seed: int = 7, still: float = STILL) -> np.ndarray:
    """Mean directions (at most k x dim) of the clusters of ``vectors`` (id, vec), ordered by size. ``vectors`` is read
    some twenty times, until no element of a direction moves by ``still``: give a materialised table. Fewer than k different vectors give fewer clusters, none give none."""
    take = OVERSAMPLING * k
    candidates = np.zeros((0, dim), np.float32)
    for i in range(ROUNDS + 1):
        first = take if i else 1
        won = vectors.mapInArrow(_race(candidates, seed + i, first), "key double, vec binary").orderBy("key").limit(first).collect()
        if won:
            candidates = np.vstack([candidates, np.stack([np.frombuffer(r.vec, np.float32) for r in won])])
    if not len(candidates):
        return candidates
    # a candidate stands for the mean direction of the points it attracts, which is less noisy than a point
    points, _, sums = _pass(vectors, [candidates], -2.0)[0]
    candidates = _directions(sums, points, candidates)
    k = min(k, len(candidates))
    sets: list[np.ndarray] = []
    for c in _starts(vectors, candidates, points + 1e-9, k, floor, seed):
        if len(sets) < COMPARED and not any(np.allclose(np.sort((c @ s.T).max(axis=1)), 1, atol=1e-3) for s in sets):
            sets.append(c)
    for step in range(MOST_PASSES):
        got = _pass(vectors, sets, floor)
        moved = [_directions(sums, n, c) for c, (n, _, sums) in zip(sets, got, strict=True)]
        if step == SETTLE:  # the starts have settled on all vectors; now the best goes on
            best = max(range(len(sets)), key=lambda i: got[i][1])
            sets, moved, got = [sets[best]], [moved[best]], [got[best]]
        move = max(float(np.abs(a - b).max()) for a, b in zip(sets, moved, strict=True))
        sets = moved
        if move < still and step >= SETTLE:
            break
    n = got[0][0]
    return sets[0][np.argsort(-n, kind="stable")][: int((n > 0).sum())]


def _assigned(centroids: np.ndarray, floor: float) -> Callable[[_Batches], _Batches]:
    dim = centroids.shape[1]

    def run(batches: _Batches) -> _Batches:
        for ids, x in _blocks(batches, dim, len(centroids)):
            cos = x @ centroids.T
            best = cos.argmax(axis=1)
            cos = cos[np.arange(len(x)), best]
            ok = cos >= floor
            yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(best[ok].astype(np.int32)), pa.array(cos[ok].astype(np.float64))], ["id", "cluster", "cosine"])

    return run


def assign(vectors: DataFrame, centroids: np.ndarray, floor: float) -> DataFrame:
    """(id, cluster, cosine): the mean direction with the greatest cosine (ties: the first), if it is ``floor`` at least."""
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "id long, cluster int, cosine double")
    return vectors.mapInArrow(_assigned(centroids, floor), "id long, cluster int, cosine double")


def distinct_vectors(df: DataFrame, ident: str, vector: str, dim: int) -> DataFrame:
    """Materialised (id, vec), each id once; of several usable vectors of an id the least in bytes counts."""
    units = unit_vectors(df, ident, vector, dim)
    return materialize(units.groupBy("id").agg(F.min("vec").alias("vec")), "vectors")


def labelled_clusters(df: DataFrame, labels: DataFrame, k: int, dim: int = 64, floor: float = 0.55, ident: str = "_ref", vector: str = "v", label: str = "meta_labels") -> tuple[DataFrame, DataFrame]:
    """(members: id, cluster, cosine, label: the stored one or null; right: cluster, right: the label that most of its
    records carry, ties to the least). Repeated label rows count once; null labels don't count."""
    return labelled_members(distinct_vectors(df, ident, vector, dim), labels, k, dim, floor, ident, label)


def labelled_members(vectors: DataFrame, labels: DataFrame, k: int, dim: int, floor: float, ident: str = "_ref", label: str = "meta_labels", still: float = STILL) -> tuple[DataFrame, DataFrame]:
    """The same of materialised (id, vec), each id once."""
    members = assign(vectors, spherical_kmeans(vectors, k, dim, floor, still=still), floor)
    stored = labels.select(F.col(ident).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null").distinct()
    members = materialize(members.join(stored, "id", "left"), "members")
    votes = members.where("label is not null").groupBy("cluster", "label").count()
    right = votes.groupBy("cluster").agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("right"))
    return members, right


def mislabelled(members: DataFrame, right: DataFrame) -> DataFrame:
    """(id, cluster_id): records whose stored label isn't the right one of their cluster, with the right one."""
    return members.join(F.broadcast(right), "cluster").where("label <> right").select("id", F.col("right").alias("cluster_id")).distinct()


def described(members: DataFrame, right: DataFrame, desc: DataFrame, typical: int = 5) -> DataFrame:
    """One row per cluster: its right label, size, mean cosine, the ids of its most typical members (nearest its mean
    direction; ties: the least id), the records stored under its label, and the sum of ``counts`` of ``desc``."""
    once = members.select("cluster", "id", "cosine").distinct()
    # the nearest are found per block of ids first, so a hot cluster is ranked in parallel
    block = Window.partitionBy("cluster", "part").orderBy(F.desc("cosine"), "id")
    near = once.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("at", F.row_number().over(block)).where(F.col("at") <= typical)
    ranked = Window.partitionBy("cluster").orderBy(F.desc("cosine"), "id")
    near = near.withColumn("at", F.row_number().over(ranked)).where(F.col("at") <= typical)
    near = near.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("typical"))
    sizes = once.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("cosine").alias("mean_cosine"))
    stored = members.where("label is not null").select("id", "label").distinct().groupBy(F.col("label").alias("right")).agg(F.count(F.lit(1)).alias("stored_members"))
    counts = desc.groupBy(F.col("cluster_id").alias("right")).agg(F.sum("counts").alias("stored_counts"))
    out = sizes.join(near, "cluster").join(right, "cluster", "left").join(stored, "right", "left").join(counts, "right", "left")
    return out.select(F.col("right").alias("cluster_id"), "size", "mean_cosine", "typical", "stored_members", "stored_counts")


def _hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, place of the record, hash of the term, occurrences) of a batch's records and their terms."""
    ids, words, rec, word, times = counted(batch)
    return ids, rec, hash_array(words.to_numpy(zero_copy_only=False), categorize=False)[word] if len(words) else np.zeros(0, np.uint64), times


def _holders(batches: _Batches) -> _Batches:
    """(bucket, n): pairs of a record and a term of each bucket in the task; bucket -1 has the records with any term."""
    held = np.zeros(BUCKETS + 1, np.int64)
    for whole in batches:
        for b in slices(whole, 1):
            _, rec, h, _ = _hashed(b)
            held[:-1] += np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            held[-1] += len(np.unique(rec))
    some = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(np.where(some == BUCKETS, -1, some).astype(np.int32)), pa.array(held[some])], ["bucket", "n"])


def _features(weight: np.ndarray, dim: int) -> Callable[[_Batches], _Batches]:
    def run(batches: _Batches) -> _Batches:
        for whole in batches:
            for b in slices(whole, 1, 4 << 20, 4096):
                ids, rec, h, times = _hashed(b)
                x = times * weight[(h % np.uint64(BUCKETS)).astype(np.int64)]
                rest = h // np.uint64(BUCKETS)  # of other bits than the bucket: sign and place
                at = (rest // np.uint64(2) % np.uint64(dim)).astype(np.int64)
                rows = np.bincount(rec * dim + at, np.where(rest % np.uint64(2), x, -x), len(ids) * dim).reshape(len(ids), dim)
                most = np.abs(rows).max(axis=1) if len(rows) else np.zeros(0)
                small = np.rint(rows[most > 0] * (127 / most[most > 0, None])).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(ids[most > 0], pa.int64()), binary(small)], ["id", "vec"])

    return run


def hashed_vectors(df: DataFrame, ident: str, text: str, dim: int = 512, least: int = 5) -> DataFrame:
    """Materialised (id, vec) of texts, a byte a dimension: signed feature hashing of the terms, weighted by tf * ln(N / (d + 1)); for
    clustering texts that have no vectors yet. The records d that hold a term are counted by ``BUCKETS`` hashes, so the
    table of weights has a bound whatever the vocabulary. Terms that fewer than ``least`` records hold say little
    about similarity and much noise, and count nothing. Texts without terms that count have no row."""
    texts = records(df, ident, text, None)
    counts = texts.mapInArrow(_holders, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = counts.column("bucket").to_numpy(), counts.column("n").to_numpy()
    held = np.zeros(BUCKETS)
    held[bucket[bucket >= 0]] = n[bucket >= 0]
    total = int(n[bucket < 0].sum())
    weight = np.where(held >= least, np.log(max(1, total) / (held + 1)), 0.0)
    return materialize(texts.mapInArrow(_features(weight, dim), "id long, vec binary"), "features")
