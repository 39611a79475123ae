"""Words that tell two close clusters apart (LIME, Ribeiro et al. 2016)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.trees import fit_forest, forest_shares
from loomtext.functions.vector import cosine, matrix
from loomtext.plans.shared import materialize, small

#: Score shares below this are dropped from an explanation.
LEAST_SHARE = 0.005


def close_pairs(centroids: DataFrame, threshold: float) -> DataFrame:
    """(i, j, similarity) of centroids i < j with a cosine above ``threshold``. There is a row per cluster on each side."""
    a = centroids.select(F.col("cluster_id").alias("i"), F.col("vec").alias("x"))
    b = centroids.select(F.col("cluster_id").alias("j"), F.col("vec").alias("y"))
    return a.join(small(b), F.col("i") < F.col("j")).select("i", "j", cosine(F.col("x"), F.col("y")).alias("similarity")).where(F.col("similarity") > threshold)


def pair_members(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, y, _ref): records of each pair's clusters, y = 0 for i and 1 for j."""
    sides = pairs.select("i", "j", F.explode(F.array(F.struct(F.col("i").alias("c"), F.lit(0).alias("y")), F.struct(F.col("j").alias("c"), F.lit(1).alias("y")))).alias("s")).select("i", "j", "s.c", "s.y")
    return labels.select("_ref", F.col("cluster_id").alias("c")).join(small(sides), "c").select("i", "j", "y", "_ref")


def even_subset(held: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """As many records of either class of a pair: the least of both sizes and ``n``, chosen by md5. The first n of parts
    of a class are taken before they are ranked together."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_ref").cast("string")))
    d = held.withColumn("k", key)
    sizes = held.groupBy("i", "j", "y").agg(F.count(F.lit(1)).alias("n")).groupBy("i", "j").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("sides")).where("sides = 2")
    sizes = materialize(sizes, "sizes")
    part = Window.partitionBy("i", "j", "y", F.substring("k", 1, 2)).orderBy("k", "_ref")
    d = d.withColumn("at", F.row_number().over(part)).where(F.col("at") <= n)
    d = d.withColumn("at", F.row_number().over(Window.partitionBy("i", "j", "y").orderBy("k", "_ref")))
    return d.join(small(sizes), ["i", "j"]).where(F.col("at") <= F.least("least", F.lit(n))).select("i", "j", "y", "_ref")


def normalise_scores(scores: DataFrame) -> DataFrame:
    """(negative_class, positive_class, word, score): shares of the sum of absolute scores of a pair; those of at most
    0.005 go, the others are made to add up to 100."""
    pair = Window.partitionBy("i", "j")
    d = scores.withColumn("score", F.try_divide(F.col("score"), F.sum(F.abs("score")).over(pair))).where(F.abs("score") > LEAST_SHARE)
    d = d.withColumn("score", 100 * F.col("score") / F.sum(F.abs("score")).over(pair))
    return d.select(F.col("i").alias("negative_class"), F.col("j").alias("positive_class"), "word", "score")


def _ridge(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Weighted ridge of one text's perturbations x (1 where a word is left in) on the probabilities p: how each word raises
    them. It is solved over the perturbations, which are few, not over the words."""
    weight = np.sqrt(np.exp(-((1 - np.sqrt(x.mean(axis=1))) ** 2) / 0.25**2))
    xc, pc = x - np.average(x, axis=0, weights=weight), p - np.average(p, weights=weight)
    root = np.sqrt(weight)
    xw = xc * root[:, None]
    return xw.T @ np.linalg.solve(xw @ xw.T + np.eye(len(x)), root * pc)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _explained(dim: int, samples: int, features: int, trees: int, seed: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("_ref", "ascending"), ("y", "ascending"), ("word", "ascending")])
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        ref, y, words = t.column("_ref").to_numpy(), t.column("y").to_numpy(), t.column("word").to_pylist()
        vecs = matrix(t.column("vec").combine_chunks(), dim)
        edges = np.append(np.flatnonzero(np.concatenate([[True], (ref[1:] != ref[:-1]) | (y[1:] != y[:-1])])), len(ref))
        texts = list(zip(edges[:-1], edges[1:], strict=True))
        forest = fit_forest(_unit(np.array([vecs[a:b].sum(axis=0) for a, b in texts])), y[edges[:-1]].astype(np.int64), 2, trees, seed)
        total: dict[str, float] = {}
        for a, b in texts:
            if words[a] is None:
                continue
            rng = np.random.default_rng((seed, int(ref[a]) % (1 << 63)))
            # each copy has its own share of words left; copy 0 is whole
            x = (rng.random((samples, b - a)) < rng.random((samples, 1))).astype(float)
            x[0] = 1
            coef = _ridge(x, forest_shares(forest, _unit(x @ vecs[a:b]))[:, 1].astype(np.float64))
            for k in np.argsort(-np.abs(coef), kind="stable")[:features]:
                total[words[a + k]] = total.get(words[a + k], 0.0) + float(coef[k])
        names = sorted(total)
        return pa.table({"i": pa.array([i] * len(names), pa.int32()), "j": pa.array([j] * len(names), pa.int32()), "word": pa.array(names, pa.string()), "score": pa.array([total[w] / len(texts) for w in names], pa.float64())})

    return run


def explain_pairs(members: DataFrame, embedding: DataFrame, dim: int, samples: int = 25, features: int = 50, trees: int = 50, seed: int = 0) -> DataFrame:
    """(i, j, word, score) of every pair of clusters in ``members`` (i, j, y, _ref, tokens), each pair a task of its own: a
    forest of extremely randomised trees learns the pair from sums of distinct words' vectors; each text is taken
    ``samples`` times with words left out, the forest's probabilities are explained by its words, and the scores are
    added over the texts and divided by their number. A pair's texts are few (see ``even_subset``). Words without a vector
    count as zeros."""
    words = members.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "y", F.col("_ref").cast("long").alias("_ref"), F.explode_outer(F.array_distinct("tokens")).alias("word"))
    zero = F.array_repeat(F.lit(0.0), dim)
    rows = words.join(embedding.select("word", "vec"), "word", "left").select("i", "j", "y", "_ref", "word", F.coalesce("vec", zero).alias("vec"))
    return rows.groupBy("i", "j").applyInArrow(_explained(dim, samples, features, trees, seed), "i int, j int, word string, score double")
