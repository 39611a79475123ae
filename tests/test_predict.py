from __future__ import annotations

import numpy as np
import pytest
from conftest import rows

from loomtext.functions import trees
from loomtext.operators import explain, predict
from loomtext.plans import pipeline
from loomtext.sources import tables
from loomtext.plans.config import Analyze, Config, Embed, Explain, Import, Metacluster, Parse, Predict, Score


def test_classes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "y string")
    assert rows(predict.class_balance(df, "y")) == [("a", 1, 1 / 3), ("b", 2, 2 / 3)]
    assert predict.majority_baseline(df, "y").first()[0] == 2 / 3
    assert sorted(r.y_truth for r in predict.label_encode(df, "y").collect()) == [0, 1, 1]


def test_folds(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(25)], "_ref long, y_truth int")
    got = predict.stratified_folds(df, folds=5).collect()
    by = {(r.y_truth, r.fold): [] for r in got}
    for r in got:
        by[r.y_truth, r.fold].append(r._ref)
    assert [len(by[0, f]) for f in range(5)] == [3, 3, 3, 2, 2]
    assert max(by[0, 0]) < min(by[0, 1])


def test_metrics_and_disagreement(spark):
    p = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 1, 1), (2, 0, 1, 0)], "_ref long, fold int, y_truth int, y_pred int")
    m = predict.fold_metrics(p).first()
    assert np.isclose(m.accuracy, 2 / 3) and np.isclose(m.f1, 2 / 3)
    macro = predict.fold_metrics(p, "macro").first()
    assert np.isclose(macro.f1, (2 / 3 + 2 / 3) / 2)
    with pytest.raises(ValueError):
        predict.fold_metrics(p, "micro")
    t = spark.createDataFrame([(0, 0, 0, 0), (1, 1, 1, 0), (2, 1, 0, 1)], "_ref long, y_truth int, A int, B int")
    assert rows(predict.disagreement(t, ["A", "B"])) == [("A", 2, 1), ("B", 1, 2)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    y = np.array([0] * 30 + [1] * 12 + [2] * 1)
    x = rng.normal(size=(43, 3)) * 0.2 + np.eye(3)[y]
    return x, y, spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "_ref long, vec array<double>, y_truth int")


def test_smote(spark, labelled, monkeypatch):
    x, y, df = labelled
    monkeypatch.setattr(predict, "BLOCK", 7)  # classes of several blocks
    got = predict.class_neighbours(df, 3, 2).collect()
    for i in range(42):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[(y != y[i]) | (np.arange(43) == i)] = np.inf
        assert [r.near for r in sorted((r for r in got if r._ref == i), key=lambda r: r["rank"])] == list(np.argsort(d)[:2])
    made = predict.smote(df, 3, 2).collect()
    assert len([r for r in made if r.y_truth == 1]) == 30 and len([r for r in made if r.y_truth == 2]) == 1
    lo, hi = x[y == 1].min(axis=0), x[y == 1].max(axis=0)
    assert all((np.array(r.vec) >= lo - 1e-9).all() and (np.array(r.vec) <= hi + 1e-9).all() for r in made if r.y_truth == 1)
    assert len({r._ref for r in made}) == len(made)


def test_cross_validation(spark, labelled, monkeypatch):
    _, _, df = labelled
    df = df.where("y_truth < 2")
    got = predict.cross_validate(df, lambda a, b: predict.centroid_predict(a, b, 3), 3)
    assert got.count() == 42 and got.where("y_truth = y_pred").count() > 38
    once = predict.centroid_cross_validate(df, 3, 3)
    assert rows(once) == rows(got.select(once.columns)) and predict.centroid_cross_validate(df.limit(0), 3, 3).count() == 0
    alone = df.unionAll(spark.createDataFrame([(90, [9.0, 9.0, 9.0], 2)], df.schema))
    assert predict.centroid_cross_validate(alone, 3, 3).where("_ref = 90").first().y_pred in (0, 1)
    forest = predict.cross_validate(df, lambda a, b: predict.forest_predict(a, b, 5), 2, lambda t: predict.smote(t, 3, 2))
    whole = predict.forest_predict(df.limit(0), df)
    assert whole.count() == 0 and whole.columns == ["_ref", "y_pred", "y_prob"]
    monkeypatch.setattr(predict, "TRAIN_BYTES", 10)
    large = predict.forest_predict(df, df, 10).join(df, "_ref")
    assert large.where("y_truth = y_pred").count() > 38 and large.columns[:3] == ["_ref", "y_pred", "y_prob"]
    assert all(np.isclose(sum(r.y_prob), 1) and np.argmax(r.y_prob) == r.y_pred for r in forest.collect())
    assert forest.count() == 42 and forest.where("y_truth = y_pred").count() > 36
    meta = predict.meta_features([df, df.withColumnRenamed("_ref", "_ref")])
    assert {len(r.vec) for r in meta.collect()} == {6}
    table = predict.prediction_table({"c": got}, spark.createDataFrame([(0, "x")], "_ref long, extra string"), ["extra"])
    assert table.count() == 42 and table.columns == ["_ref", "y_truth", "c", "extra"]
    with pytest.raises(Exception, match="not predicted"):
        predict.cross_validate(df, lambda a, b: predict.centroid_predict(a, b.limit(1), 3), 2).collect()


def test_explanations(spark):
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0])], "cluster_id int, vec array<double>")
    pairs = explain.close_pairs(c, 0.8)
    assert [(r.i, r.j) for r in pairs.collect()] == [(0, 1)]
    labels = spark.createDataFrame([(i, 0 if i < 10 else 1) for i in range(14)] + [(99, 2)], "_ref long, cluster_id int")
    sub = explain.even_subset(explain.pair_members(labels, pairs), 25).collect()
    assert sorted(r.y for r in sub) == [0] * 4 + [1] * 4
    s = spark.createDataFrame([(0, 1, "a", 3.0), (0, 1, "b", -1.0), (0, 1, "c", 0.001)], "i int, j int, word string, score double")
    assert rows(explain.normalise_scores(s)) == [(0, 1, "a", 75.0), (0, 1, "b", -25.0)]
    emb = spark.createDataFrame([("red", [1.0, 0.0]), ("blue", [0.0, 1.0]), ("the", [0.1, 0.1])], "word string, vec array<double>")
    texts = spark.createDataFrame([(0, 1, i, i % 2, ["the", "unknown", "blue" if i % 2 else "red"]) for i in range(12)] + [(0, 1, 50, 1, [])], "i int, j int, _ref long, y int, tokens array<string>")
    got = {r.word: r.score for r in explain.explain_pairs(texts, emb, 2, samples=20, trees=10).collect()}
    assert got["blue"] > 0 > got["red"] and abs(got["unknown"]) < min(got["blue"], -got["red"])


def test_ridge_over_perturbations_equals_that_over_words():
    rng = np.random.default_rng(3)
    x, p = (rng.random((30, 7)) < 0.5).astype(float), rng.random(30)
    x[0] = 1
    w = np.sqrt(np.exp(-((1 - np.sqrt(x.mean(axis=1))) ** 2) / 0.25**2))
    xc, pc = x - np.average(x, axis=0, weights=w), p - np.average(p, weights=w)
    assert np.allclose(explain._ridge(x, p), np.linalg.solve((xc * w[:, None]).T @ xc + np.eye(7), (xc * w[:, None]).T @ pc))


def test_randomised_trees():
    rng = np.random.default_rng(1)
    c, y = rng.normal(size=(4, 12)), rng.integers(0, 4, 600)
    x = c[y] + 0.8 * rng.normal(size=(600, 12))
    forest = trees.fit_forest(x[:400], y[:400], 4, 40, 2)
    assert (trees.forest_shares(forest, x[:400]).argmax(axis=1) == y[:400]).mean() > 0.99
    shares = trees.forest_shares(forest, x[400:])
    assert (shares.argmax(axis=1) == y[400:]).mean() > 0.8 and np.allclose(shares.sum(axis=1), 1)
    order = rng.permutation(400)
    assert np.allclose(trees.forest_shares(trees.fit_forest(x[:400][order], y[:400][order], 4, 40, 2), x[400:]), shares)
    alike = trees.fit_tree(np.ones((5, 3)), np.array([0, 1, 1, 0, 1]), 2, rng)
    assert np.allclose(alike.shares_of(np.zeros((2, 3))), [[0.4, 0.6]] * 2)


def test_every_close_pair_is_explained(spark):
    words = ["red", "blue", "green"]
    emb = spark.createDataFrame([(w, [float(w == x) for x in words]) for w in words], "word string, vec array<double>")
    data = [(i, j, y, 10 * (i, j)[y] + k, [words[(i, j)[y]]]) for i, j in [(0, 1), (0, 2), (1, 2)] for y in (0, 1) for k in range(4)]
    members = spark.createDataFrame(data, "i int, j int, y int, _ref long, tokens array<string>")
    got = {(r.i, r.j, r.word): r.score for r in explain.explain_pairs(members, emb, 3, samples=10, trees=5).collect()}
    assert {(i, j) for i, j, _ in got} == {(0, 1), (0, 2), (1, 2)}
    assert all(got[i, j, words[j]] > 0 > got[i, j, words[i]] for i, j in [(0, 1), (0, 2), (1, 2)])
    assert explain.explain_pairs(members.limit(0), emb, 3).count() == 0


def test_whole_pipeline(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    topics = (["heart rate rhythm pulse beat", "cardiology ward"], ["gene protein cell membrane enzyme", "genomics lab"])
    lines = ["title,abstract,journal"]
    for i in range(40):
        a, b = topics[i % 2]
        lines.append(f'"{b} {i}","{" ".join((a + " ") * 4)} Heart Rate (HR) study",J{i % 2}')
    (src / "a.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    out = str(tmp_path / "out")
    config = Config(Import(), Parse(functions=("unidecoder", "decaps_text")), Embed(size=6, min_count=5, epochs=4, sample=0.0), Score(methods=("unique_IDF", "simple"), reduced=True, components=2), Metacluster(m=20, kn=3), Analyze(True, 3, ("journal",)), Explain(-1.0, samples=10, trees=5), Predict("journal", ("unique_IDF", "simple"), 2, 5, True, True, ("title",)))
    pipeline.import_data(spark, [str(src)], out, config)
    for stage in pipeline.STAGES.values():
        stage(spark, out, config)
    assert sorted(r._ref for r in spark.read.parquet(f"{out}/corpus").collect()) == list(range(40))
    assert spark.read.parquet(f"{out}/cluster_master_labels").count() == 40
    assert spark.read.parquet(f"{out}/cluster_desc").agg({"counts": "sum"}).first()[0] == 40
    table = spark.read.parquet(f"{out}/journal_prediction")
    assert table.count() == 40 and set(table.columns) == {"_ref", "y_truth", "unique_IDF", "simple", "meta", "title"}
    assert table.where("y_truth = meta").count() > 30
    assert spark.read.parquet(f"{out}/cluster_LIME").count() > 0
    assert all(np.isclose(sum(r.y_prob), 1) for r in spark.read.parquet(f"{out}/journal_probabilities_meta").collect())
    reports = {p.name for p in (tmp_path / "out" / "reports").iterdir()}
    assert reports == {"abbreviations", "cluster_desc", "cluster_master_labels", "cluster_LIME", "journal_prediction", "journal_disagreement"}
    assert tables.read_csv(spark, f"{out}/reports/cluster_master_labels", ["_ref", "journal"]).count() == 40
