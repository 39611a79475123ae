from __future__ import annotations

import numpy as np
import pytest
from conftest import rows

from loomtext.functions.linkage import cosine_distances, leaf_order
from loomtext.functions.rank import global_rank
from loomtext.functions.spectral import cosine_affinity, spectral_labels
from loomtext.operators import analyze, metacluster


def planted(n=120, k=4, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:k]
    x = centres[np.arange(n) % k] + 0.15 * rng.normal(size=(n, dim))
    return x, np.arange(n) % k


@pytest.fixture(scope="module")
def vectors(spark):
    x, _ = planted()
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, [0.0] * 8)]
    return spark.createDataFrame(data, "_ref long, vec array<double>")


def test_chunks(spark, vectors):
    got = metacluster.subset_chunks(vectors.limit(10), 3, repeats=2)
    sizes = got.groupBy("repeat", "chunk").count().orderBy("repeat", "chunk").collect()
    assert [r["count"] for r in sizes] == [4, 3, 3] * 2
    assert got.select("repeat", "_ref").distinct().count() == 20
    again = metacluster.subset_chunks(vectors.limit(10).repartition(5), 3, repeats=2)
    assert rows(got) == rows(again)
    assert metacluster.subset_chunks(vectors.limit(2), 3).select("chunk").distinct().count() == 1


def test_affinity(spark):
    x = np.array([[1.0, 0], [2, 0], [0, 1], [-1, 0]])
    a = cosine_affinity(x)
    assert np.allclose(a[0], [2 + 1e-8, 2 + 1e-8, 1 + 1e-8, 1e-8], atol=1e-12) and (a >= 0).all()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9, [0.0, 0.0])], "_ref long, vec array<double>")
    got = {(r.a, r.b): r.affinity for r in metacluster.cosine_affinity(df).collect()}
    assert len(got) == 16 and np.allclose([got[0, j] for j in range(4)], a[0])


def test_spectral_finds_planted():
    x, truth = planted()
    got = spectral_labels(x, 4, 0)
    assert len({(a, b) for a, b in zip(got, truth, strict=True)}) == 4


def test_linkage():
    x = np.array([[1.0, 0.02], [0.0, 1.0], [1.0, 0.0], [0.05, 1.0]])
    assert leaf_order(cosine_distances(x)) in ([0, 2, 1, 3], [1, 3, 0, 2])
    assert leaf_order(np.zeros((0, 0))) == [] and leaf_order(np.zeros((1, 1))) == [0]


def test_metacluster_finds_planted(spark, vectors):
    got = metacluster.metacluster(vectors, 8, m=40, kn=5, pcut=0.8)
    labels = {r._ref: r for r in got["labels"].collect()}
    assert len(labels) == 121 and labels[500].cluster_id == 0
    assert len({(labels[i].cluster_id, i % 4) for i in range(120)}) == 4
    assert all(np.isclose(np.linalg.norm(r.vec), 1) for r in got["centroids"].collect())
    again = metacluster.metacluster(vectors.repartition(3), 8, m=40, kn=5, pcut=0.8)
    assert {r._ref: r.cluster_id for r in again["labels"].collect()} == {k: v.cluster_id for k, v in labels.items()}


def test_spread(spark):
    d = spark.createDataFrame([(1, 0, 1.0), (2, 0, 0.5)], "_ref long, cluster_id int, cosine double")
    assert rows(metacluster.centroid_spread(d)) == [(0, 0.75, 0.25, 0.5)]


def test_dispersion_is_that_of_all_pairs(spark):
    x, truth = planted(40)
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, truth, strict=True))] + [(99, 7, x[0].tolist()), (98, 0, [0.0] * 8)], "_ref long, cluster_id int, vec array<double>")
    got = {(r.a, r.b): r.dispersion for r in analyze.dispersion(df, 8).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    a, b = truth == 0, truth == 1
    inner = d[np.ix_(a, a)]
    assert np.isclose(got[0, 0], inner.sum() / (len(inner) * (len(inner) - 1))) and np.isclose(got[0, 1], d[np.ix_(a, b)].mean())
    assert got[7, 7] is None


def test_reports(spark, vectors):
    got = metacluster.metacluster(vectors, 8, m=40, kn=5, pcut=0.8)
    emb = spark.createDataFrame([(f"w{i}", v.tolist()) for i, v in enumerate(planted()[0][:12])], "word string, vec array<double>")
    desc = analyze.cluster_desc(vectors, got["labels"], got["centroids"], emb, 8, compute_dispersion=True, topn=3)
    held = desc.collect()
    assert sum(r.counts for r in held) == 121 and {len(r.word2vec_description.split()) for r in held} == {3}
    assert sorted(r.dispersion_order for r in held) == list(range(4)) and all(0 < r.intra_document_dispersion < 1 for r in held)
    off = analyze.cluster_desc(vectors, got["labels"], got["centroids"], emb, 8)
    assert {r.intra_document_dispersion for r in off.collect()} == {-1.0}
    assert "intra_document_dispersion" not in analyze.without_dispersion(off).columns
    originals = spark.createDataFrame([(0, "a"), (777, None)], "_ref long, pmid string")
    m = {r._ref: r for r in analyze.master_labels(originals, got["labels"], desc.select("cluster_id", "dispersion_order"), ["pmid"]).collect()}
    assert m[777].cluster_id is None and m[777].dispersion_order == -1 and m[0].dispersion_order >= 0


def test_global_rank_within_groups(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "g") for i in range(100)], "k int, g string").repartition(6)
    got = {r.k: r["rank"] for r in global_rank(df, ["k"], ["g"]).collect()}
    for part in ([i for i in range(100) if i % 3 == 0], [i for i in range(100) if i % 3]):
        assert [got[i] for i in part] == list(range(len(part)))
