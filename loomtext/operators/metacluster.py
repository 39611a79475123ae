"""Metaclusters: spectral clusters of many samples, clustered again.

Samples (chunks of about m records) are clustered side by side, one task each; their centroids, some per chunk, are
clustered once more; every record then takes the nearest of the final centroids. Only centroids meet in one place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.linkage import cosine_distances, leaf_order
from loomtext.functions.rank import hash_rank
from loomtext.functions.spectral import spectral_labels
from loomtext.functions.vector import dot, l2_normalize, matrix, norm, packed, sums

#: Centroids that the second clustering takes at once, at most; more chunks are clustered in a further level.
CENTROIDS = 4000


def subset_chunks(vectors: DataFrame, m: int, repeats: int = 1, seed: int = 0, ident: str = "_ref") -> DataFrame:
    """(repeat, chunk, ident): per repeat a permutation by md5 of seed, repeat and id, cut into max(1, N // m) chunks
    of nearly equal size, the first ones a row longer."""
    ids = vectors.select(ident)
    n = ids.count()
    k = max(1, n // m)
    small, longer = n // k, n % k
    parts = []
    for r in range(repeats):
        ranked = hash_rank(ids, F.md5(F.concat(F.lit(f"{seed}:{r}:"), F.col(ident).cast("string"))), ident)
        edge = longer * (small + 1)
        chunk = F.when(F.col("rank") < edge, F.floor(F.col("rank") / (small + 1))).otherwise(longer + F.floor((F.col("rank") - edge) / max(small, 1)))
        parts.append(ranked.select(F.lit(r).alias("repeat"), chunk.cast("int").alias("chunk"), ident))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def cosine_affinity(vectors: DataFrame, ident: str = "_ref", vec: str = "vec", by: list[str] | None = None) -> DataFrame:
    """(by, a, b, affinity) of all pairs of vectors of the same chunk (columns ``by``, of bounded size; none: one chunk),
    without zero rows: cosine, at most 1, plus 1 + 1e-8. Clustering computes it in numpy, chunk by chunk."""
    by = by or []
    v = vectors.select(*by, F.col(ident).alias("a"), F.col(vec).alias("x"), norm(F.col(vec)).alias("nx")).where("nx > 0")
    w = v.select(*by, F.col("a").alias("b"), F.col("x").alias("y"), F.col("nx").alias("ny"))
    s = F.least(dot(F.col("x"), F.col("y")) / (F.col("nx") * F.col("ny")), F.lit(1.0)) + 1 + 1e-8
    return v.join(w, by or F.lit(True)).select(*by, "a", "b", s.alias("affinity"))


def _chunk_centroids(k: int, dim: int, seed: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        x = matrix(t.column("vec").combine_chunks(), dim)
        r, c = t.column("repeat")[0].as_py(), t.column("chunk")[0].as_py()
        label = spectral_labels(x, k, seed + 1000 * r + c)
        rows = []
        for j in np.unique(label):
            v = x[label == j].mean(axis=0)
            n = np.linalg.norm(v)
            rows.append((v / n if n > 0 else v).tolist())
        return pa.table({"repeat": pa.array([r] * len(rows), pa.int32()), "chunk": pa.array([c] * len(rows), pa.int32()), "label": pa.array(range(len(rows)), pa.int32()), "vec": pa.array(rows, pa.list_(pa.float64()))})

    return run


def centroids(members: DataFrame, dim: int, by: str = "cluster_id", vec: str = "vec") -> DataFrame:
    """(by, vec): mean of each group at length one."""
    added = members.groupBy(by).agg(*sums(F.lit(1.0), F.col(vec), dim))
    return added.select(by, l2_normalize(packed(dim)).alias("vec"))


def chunk_centroids(vectors: DataFrame, dim: int, m: int, kn: int, repeats: int = 1, seed: int = 0) -> DataFrame:
    """(repeat, chunk, label, vec): normalised means of the spectral clusters of every chunk; zero vectors are left out."""
    nonzero = vectors.where(norm(F.col("vec")) > 0).select("_ref", "vec")
    chunked = subset_chunks(nonzero, m, repeats, seed).join(nonzero, "_ref")
    return chunked.select("repeat", "chunk", "vec").groupBy("repeat", "chunk").applyInArrow(_chunk_centroids(kn, dim, seed), "repeat int, chunk int, label int, vec array<double>")


def meta_centroids(found: DataFrame, dim: int, k: int, seed: int = 0) -> np.ndarray:
    """The centroids of chunks clustered into k, ordered by the leaves of their dendrogram. While there are more than
    ``CENTROIDS`` of them, they are clustered in chunks of that size first."""
    level = 0
    while found.count() > CENTROIDS:
        ids = found.select(F.xxhash64("repeat", "chunk", "label").alias("_ref"), "vec")
        found = chunk_centroids(ids, dim, CENTROIDS // 2, max(k, 25), 1, seed + level)
        level += 1
    x = np.array([r.vec for r in found.orderBy("repeat", "chunk", "label").select("vec").collect()]).reshape(-1, dim)
    if not len(x):
        return np.zeros((0, dim))
    label = spectral_labels(x, k, seed)
    c = np.array([x[label == j].mean(axis=0) for j in np.unique(label)])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c[leaf_order(cosine_distances(c))]


def _nearest(c: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    unit = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), c.shape[1])
            n = np.linalg.norm(x, axis=1)
            cos = (x / np.where(n > 0, n, 1)[:, None]) @ unit.T
            label = np.where(n > 0, np.round(1 - cos, 12).argmin(axis=1), 0)
            near = np.where(n > 0, cos[np.arange(len(x)), label], 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label.astype(np.int32)), pa.array(near)], ["_ref", "cluster_id", "cosine"])

    return run


def assign_labels(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    """(_ref, cluster_id, cosine): nearest centroid by cosine distance (ties: the first); zero vectors get cluster 0. The
    centroids, k x dim, go along with the tasks."""
    if not len(c):
        raise ValueError("no centroids")
    return vectors.select(F.col("_ref").cast("long").alias("_ref"), "vec").mapInArrow(_nearest(c), "_ref long, cluster_id int, cosine double")


def label_histogram(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("counts"))


def centroid_spread(labels: DataFrame) -> DataFrame:
    """(cluster_id, mean, std (population), min) of the cosines of the members with their centroid."""
    return labels.groupBy("cluster_id").agg(F.avg("cosine").alias("mean"), F.stddev_pop("cosine").alias("std"), F.min("cosine").alias("min"))


def metacluster(vectors: DataFrame, dim: int, m: int = 2000, kn: int = 25, pcut: float = 0.8, repeats: int = 1, seed: int = 0) -> dict[str, DataFrame]:
    """centroids (cluster_id, vec), labels (_ref, cluster_id, cosine), spread, of (_ref, vec)."""
    c = meta_centroids(chunk_centroids(vectors, dim, m, kn, repeats, seed), dim, max(1, int(pcut * kn)), seed)
    labels = assign_labels(vectors, c)
    table = vectors.sparkSession.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "cluster_id int, vec array<double>")
    return {"centroids": table, "labels": labels, "spread": centroid_spread(labels)}
