from __future__ import annotations

import numpy as np
import pyarrow as pa

from loomtext.llm import cluster, knn
from loomtext.llm.vectors import binary


def planted(n=600, k=5, dim=64, seed=1, noise=0.09):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(k, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    truth = rng.choice(k, n, p=np.array([5, 3, 1, 1, 1]) / 11)
    return c[truth] + noise * rng.normal(size=(n, dim)), truth


ODD = [(9000, None), (9001, [0.0] * 64), (9002, [1.0] * 63), (9003, [float("nan")] + [1.0] * 63), (9004, [float("inf")] + [1.0] * 63), (None, [1.0] * 64), (9005, [None] + [1.0] * 63)]


def frame(spark, x, extra=()):
    data = [(i, [float(y) for y in v]) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame([(*r, 3, "c") for r in data], "_ref long, v array<float>, id int, vec string")


def test_clusters(spark):
    x, truth = planted()
    rng = np.random.default_rng(9)
    x[:10] = rng.normal(size=(10, 64))  # in no cluster
    df = frame(spark, x * rng.uniform(0.1, 9, (600, 1)), [(0, x[0].tolist()), *ODD])
    wrong = {20: 4, 21: 0, 22: 1}
    wrong = {i: v for i, v in wrong.items() if truth[i] != v}
    labels = [(i, wrong.get(i, int(t)), i) for i, t in enumerate(truth) if i not in (30, 31)] + [(31, None, 1), (40, int(truth[40]), 1), (8888, 2, 1)]
    lab = spark.createDataFrame(labels, "_ref long, meta_labels int, cluster int")
    members, right = cluster.labelled_clusters(df, lab, 5)
    assert {(r.id, r.cluster_id) for r in cluster.mislabelled(members, right).collect()} == {(i, int(truth[i])) for i in wrong}
    desc = spark.createDataFrame([(0, 0, 7), (1, 0, 8), (0, 1, None)], "batch int, cluster_id int, counts long")
    got = {r.cluster_id: r for r in cluster.described(members, right, desc).collect()}
    inside = {int(t): int(((truth == t) & (np.arange(600) >= 10)).sum()) for t in range(5)}
    assert {c: r["size"] for c, r in got.items()} == inside and got[0].stored_counts == 15 and all(len(r.typical) == 5 for r in got.values())
    empty, none = cluster.labelled_clusters(df.limit(0), lab, 5)
    assert empty.count() == 0 and none.count() == 0
    few, _ = cluster.labelled_clusters(frame(spark, x[:1].repeat(4, axis=0)), lab, 5)
    assert few.count() == 4


def test_hashed_vectors(spark):
    topics = ["heart rate rhythm beat pulse", "gene protein cell membrane"]
    texts = [(i, f"{topics[i % 2]} {topics[i % 2].split()[i % 4]} own{i}") for i in range(40)] + [(90, None), (91, ""), (92, "rare words"), (None, topics[0]), (3, topics[1])]
    v = cluster.hashed_vectors(spark.createDataFrame([(*r, 1) for r in texts], "_ref long, text string, vec int"), "_ref", "text", 32)
    assert sorted(r.id for r in v.collect()) == list(range(40)) and {len(r.vec) for r in v.collect()} == {32}
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)], "_ref long, meta_labels int")
    members, right = cluster.labelled_members(v, lab, 2, 32, 0.0)
    assert members.count() == 40 and cluster.mislabelled(members, right).count() == 0
    assert cluster.hashed_vectors(spark.createDataFrame([], "_ref long, text string"), "_ref", "text").count() == 0


def brute_pairs(x, t):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= t, 1))
    return set(zip(a.tolist(), b.tolist(), strict=True))


def test_similar_pairs(spark, monkeypatch):
    x, _ = planted(800)
    rng = np.random.default_rng(2)
    for i in range(0, 200, 2):
        x[i + 1] = x[i] + rng.uniform(0, 0.04) * rng.normal(size=64)
    x[300:330] = x[299]
    df = frame(spark, x, [(5, x[5].tolist()), *ODD])
    expected = brute_pairs(x.astype(np.float32).astype(float), 0.97)
    found = {tuple(r) for r in knn.similar_pairs(df).collect()}
    assert found == expected and len(expected) > 450
    groups = {r.id: r for r in knn.similar_groups(df).collect()}
    assert set(groups) == set(range(800)) and all(groups[a].group_id == groups[b].group_id for a, b in expected)
    assert {groups[i].class_id for i in range(299, 330)} == {299} and groups[400].n_links == len({p for p in expected if 400 in p})
    monkeypatch.setattr(knn, "BLOCK", 60)  # hot leaves are cut into blocks
    monkeypatch.setattr(knn, "PAIR_LEAF", 400)
    again = knn.similar_pairs(df).collect()
    assert len(again) == len({tuple(r) for r in again}) and {tuple(r) for r in again} == expected
    monkeypatch.undo()
    monkeypatch.setattr(knn, "DIVIDE", 100)  # large blocks are divided into cells
    monkeypatch.setattr(knn, "CELL", 40)
    divided = {tuple(r) for r in knn.similar_pairs(df).collect()}
    assert divided == expected
    assert knn.similar_pairs(df.limit(0)).count() == 0 and knn.similar_pairs(frame(spark, x[:1])).count() == 0


def test_bound_of_decoded_products_loses_nothing():
    x, _ = planted(2000, noise=0.05)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    for width, dim in ((1, 64), (4, 64), (4, 30)):
        u = x[:, :dim] / np.linalg.norm(x[:, :dim], axis=1, keepdims=True)
        index = knn.Index(u, 2000, 300, width)
        home = index.nearest(u, 1)[:, 0]
        code = index.encode(u, home)
        assert code.shape[1] == -(-dim // index.width // 2) and code.dtype == np.uint8
        y = index.decode(code, home)
        e, exact, t = u - y, u @ u.T, 0.9
        p = (u * e).sum(axis=1)
        assert np.abs(p).mean() < 0.2 * np.linalg.norm(e, axis=1).mean()  # score-aware: little of the error is parallel
        wide = np.maximum(t * p, p) + np.sqrt(1 - t * t) * np.linalg.norm(e - p[:, None] * u, axis=1)
        length = np.linalg.norm(e, axis=1)
        least = t - wide[:, None] - wide - length[:, None] * length
        assert (exact >= t).sum() > 2000 and ((y @ y.T)[exact >= t] >= least[exact >= t] - 1e-4).all()


def test_leaves_of_two_levels(monkeypatch):
    monkeypatch.setattr(knn, "FLAT", 30)
    x, _ = planted(4000, noise=0.05)
    rng = np.random.default_rng(6)
    for i in range(0, 3000, 2):
        x[i + 1] = x[i] + np.linalg.norm(x[i]) * 0.24 / 8 * rng.normal(size=64)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    index = knn.Index(u, 4000, 40, 1)
    assert 90 <= len(index.leaves) <= 110
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), binary(u)], ["id", "vec"])
    laid = pa.Table.from_batches(knn._pair_rows(index, 0.97)(iter([batch])))
    got, leaf = set(), laid.column("leaf").to_numpy()
    for i in np.unique(leaf):
        t = knn._near_pairs(index, 0.97)(laid.filter(pa.array(leaf == i)).combine_chunks())
        got |= set(zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True))
    assert got >= brute_pairs(u.astype(float), 0.97)


def test_neighbours_recall(spark):
    x, _ = planted(3000, noise=0.15)
    df = frame(spark, x, [(50, x[50].tolist()), *ODD])
    u = x.astype(np.float32)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    got = {}
    for r in knn.nearest_neighbours(df, k=10).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.near
    assert set(got) == set(range(0, 3000, 50)) | set()
    hits = 0
    for q, near in got.items():
        s = u @ u[q]
        s[q] = -9
        assert sorted(near) == list(range(1, 11))
        hits += len(set(np.argsort(-s)[:10].tolist()) & set(near.values()))
    assert hits >= 0.9 * 10 * len(got)
    assert knn.nearest_neighbours(df.limit(0)).count() == 0


def test_neighbours_recall_in_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(knn, "LEAF", 24)
    monkeypatch.setattr(knn.Index.__init__, "__defaults__", (24, 4, 11))
    x, _ = planted(6000, noise=0.15)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    assert len(knn.Index(u, 6000).leaves) == 250
    got = knn.nearest_neighbours(frame(spark, x), k=10).collect()
    hits = 0
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:10].tolist()) & {r.near for r in got if r.id == q})
    assert hits >= 0.9 * 10 * 120


def test_leaves_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(knn, "PAIR_LEAF", 24)
    x, _ = planted(4000, noise=0.05)
    rng = np.random.default_rng(6)
    for i in range(0, 3000, 2):
        x[i + 1] = x[i] + np.linalg.norm(x[i]) * 0.24 / 8 * rng.normal(size=64)
    expected = brute_pairs(x.astype(np.float32).astype(float), 0.97)
    found = {tuple(r) for r in knn.similar_pairs(frame(spark, x)).collect()}
    assert len(expected) > 1000 and found == expected


def test_cells_lose_no_pair(monkeypatch):
    monkeypatch.setattr(knn, "DIVIDE", 100)  # in this process: workers import the module anew
    monkeypatch.setattr(knn, "CELL", 12)
    x, _ = planted(3000, noise=0.03)
    rng = np.random.default_rng(6)
    for i in range(0, 3000, 2):
        x[i + 1] = x[i] + np.linalg.norm(x[i]) * 0.235 / 8 * rng.normal(size=64)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    index = knn.Index(u, 3000, 4000, 1)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), binary(u)], ["id", "vec"])
    got = knn._near_pairs(index, 0.97)(pa.Table.from_batches(knn._pair_rows(index, 0.97)(iter([batch]))))
    expected = brute_pairs(u.astype(float), 0.97)
    assert len(expected) > 700 and set(zip(got.column("a").to_pylist(), got.column("b").to_pylist(), strict=True)) >= expected


def test_many_clusters(spark):
    rng = np.random.default_rng(4)
    c = rng.normal(size=(150, 64))
    truth = np.arange(3000) % 150
    x = c[truth] + 0.25 * rng.normal(size=(3000, 64))
    vectors = cluster.distinct_vectors(frame(spark, x), "_ref", "v", 64)
    centres = cluster.spherical_kmeans(vectors, 150, 64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = (u @ centres.T).argmax(axis=1)
    whole = sum(len(set(label[truth == t].tolist())) == 1 for t in range(150))
    assert len(centres) == 150 and whole >= 135
