"""Reports on clusters: size, spread, dispersion, nearest words.

Mean distances between all pairs of records have a closed form on the sums of unit vectors, so no pair is ever made. Zero
vectors are left out of distances."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.linkage import leaf_order
from loomtext.functions.vector import cosine, dot, l2_normalize, matrix, norm, packed, sums
from loomtext.plans.shared import materialize, small


def members(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(_ref, cluster_id, vec)."""
    return vectors.select("_ref", "vec").join(labels.select("_ref", "cluster_id"), "_ref")


def centroid_distance(held: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cluster_id, avg_centroid_distance): mean cosine distance of members to the centroid."""
    c = centroids.select("cluster_id", F.col("vec").alias("c"))
    return held.join(small(c), "cluster_id").groupBy("cluster_id").agg(F.avg(1 - cosine(F.col("vec"), F.col("c"))).alias("avg_centroid_distance"))


def dispersion(held: DataFrame, dim: int) -> DataFrame:
    """(a, b, dispersion) for clusters a <= b: mean cosine distance of all pairs of different members (a = b; null for
    one member) or of all members of a with all of b. With S the sum and n the number of unit vectors, the mean cosine is
    (S.S - n) / (n (n - 1)) within a cluster and S.T / (n m) between two."""
    unit = held.where(norm(F.col("vec")) > 0).select("cluster_id", l2_normalize(F.col("vec")).alias("u"))
    added = unit.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), *sums(F.lit(1.0), F.col("u"), dim))
    added = materialize(added.select("cluster_id", "n", packed(dim).alias("s")), "sums")
    a = added.select(F.col("cluster_id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    b = added.select(F.col("cluster_id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    both = a.join(small(b), F.col("a") <= F.col("b"))
    s = dot(F.col("sa"), F.col("sb"))
    within = F.when(F.col("na") > 1, (s - F.col("na")) / (F.col("na") * (F.col("na") - 1)))
    return both.select("a", "b", (1 - F.when(F.col("a") == F.col("b"), within).otherwise(s / (F.col("na") * F.col("nb")))).alias("dispersion"))


def dispersion_order(matrix: DataFrame | None, clusters: DataFrame) -> DataFrame:
    """(cluster_id, dispersion_order): place among the leaves of the dendrogram of the dispersions, or among the sorted
    ids where dispersion is off. There is a row per cluster, so this runs on the driver."""
    ids = sorted(r[0] for r in clusters.select("cluster_id").distinct().collect())
    order = list(range(len(ids)))
    if matrix is not None and len(ids) > 1:
        at = {c: i for i, c in enumerate(ids)}
        d = np.ones((len(ids), len(ids)))
        for r in matrix.collect():
            if r.a in at and r.b in at and r.dispersion is not None:
                d[at[r.a], at[r.b]] = d[at[r.b], at[r.a]] = r.dispersion
        order = leaf_order(d)
    rows = [(int(ids[leaf]), place) for place, leaf in enumerate(order)]
    return clusters.sparkSession.createDataFrame(rows, "cluster_id int, dispersion_order int")


def _best_words(names: list[int], c: np.ndarray, topn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    unit = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), c.shape[1])
            n = np.linalg.norm(x, axis=1)
            words = np.array(b.column(0).to_pylist(), object)[n > 0]
            cos = np.round((x[n > 0] / n[n > 0, None]) @ unit.T, 12)
            for j, name in enumerate(names):
                # whatever ties with the last of the best goes on too
                edge = np.partition(-cos[:, j], topn - 1)[topn - 1] if len(words) > topn else np.inf
                best = np.flatnonzero(-cos[:, j] <= edge)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(best), pa.int32()), pa.array(words[best].tolist(), pa.string()), pa.array(cos[best, j])], ["cluster_id", "word", "cos"])

    return run


def top_words(centroids: DataFrame, embedding: DataFrame, topn: int = 10) -> DataFrame:
    """(cluster_id, word2vec_description): the words nearest each centroid by cosine (rounded to 12 digits; ties by
    word), joined by spaces. The centroids are few and go along with the tasks; only the best words of a batch move."""
    held = centroids.select(F.col("cluster_id").cast("int"), "vec").orderBy("cluster_id").collect()
    if not held:
        return centroids.select(F.col("cluster_id").cast("int"), F.lit("").alias("word2vec_description"))
    near = embedding.select("word", "vec").mapInArrow(_best_words([r[0] for r in held], np.array([r[1] for r in held], float), topn), "cluster_id int, word string, cos double")
    whole = Window.partitionBy("cluster_id").orderBy(F.desc("cos"), "word")
    near = near.withColumn("at", F.row_number().over(whole)).where(F.col("at") <= topn)
    words = F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])
    return near.groupBy("cluster_id").agg(F.array_join(words, " ").alias("word2vec_description"))


def cluster_desc(vectors: DataFrame, labels: DataFrame, centroids: DataFrame, embedding: DataFrame, dim: int, compute_dispersion: bool = False, topn: int = 10) -> DataFrame:
    """One row per cluster that has members: cluster_id, dispersion_order, counts, avg_centroid_distance,
    intra_document_dispersion (-1 where off), word2vec_description."""
    held = members(vectors, labels)
    counts = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("counts"))
    spread = materialize(dispersion(held, dim), "spread") if compute_dispersion else None
    intra = spread.where("a = b").select(F.col("a").alias("cluster_id"), F.col("dispersion").alias("intra")) if spread is not None else None
    out = counts.join(dispersion_order(spread, counts), "cluster_id").join(centroid_distance(held, centroids), "cluster_id", "left")
    out = out.join(intra, "cluster_id", "left") if intra is not None else out.withColumn("intra", F.lit(-1.0))
    out = out.join(top_words(centroids, embedding, topn), "cluster_id", "left")
    return out.select("cluster_id", "dispersion_order", "counts", "avg_centroid_distance", F.col("intra").alias("intra_document_dispersion"), "word2vec_description")


def master_labels(originals: DataFrame, labels: DataFrame, order: DataFrame, columns: list[str]) -> DataFrame:
    """(_ref, cluster_id, dispersion_order, the named source columns) of every source record; -1 as the order of
    clusters without one."""
    got = originals.select("_ref", *columns).join(labels.select("_ref", "cluster_id"), "_ref", "left").join(small(order), "cluster_id", "left")
    return got.select("_ref", "cluster_id", F.coalesce("dispersion_order", F.lit(-1)).alias("dispersion_order"), *columns)


def without_dispersion(desc: DataFrame) -> DataFrame:
    """The report as shown when dispersion is off."""
    return desc.drop("intra_document_dispersion", "dispersion_order")
