from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import rows

from loomtext.functions.word2vec import huffman
from loomtext.operators import counts, embedding, scoring
from loomtext.operators.reduce import reduce_vectors
from loomtext.plans import config
from loomtext.sources import tables
from loomtext.streaming.scoring import score_stream

V1, V2 = np.array([1.0, 0.0, 2.0]), np.array([0.0, 3.0, -1.0])


@pytest.fixture(scope="module")
def toy(spark):
    docs = counts.document_tokens(spark.createDataFrame([(0, "cat cat dog"), (1, "dog bird"), (2, None), (3, "fish"), (4, "")], "_ref long, text string"), "_ref")
    emb = spark.createDataFrame([("cat", V1.tolist()), ("dog", V2.tolist())], "word string, vec array<double>")
    return docs, emb


def unit(v):
    return v / np.linalg.norm(v)


def vec(df, ref):
    return np.array(df.where(f"_ref = {ref}").first().vec)


def test_scores_of_the_worked_example(spark, toy):
    docs, emb = toy
    tdf = counts.term_document_frequency(docs)
    vocab = scoring.scoring_vocabulary(emb, tdf, 5)
    f1, f2 = math.log(5 / 2), math.log(5 / 3)
    expected = {"simple": 2 * V1 + V2, "unique": V1 + V2, "simple_IDF": 2 * V1 * f1 + V2 * f2, "unique_IDF": V1 * f1 + V2 * f2}
    for m, e in expected.items():
        got = scoring.METHODS[m](docs, vocab, 3)
        assert np.allclose(vec(got, 0), unit(e))
        assert got.count() == 5
        for ref in (2, 3, 4):
            assert not vec(got, ref).any()
    both = scoring.score(docs, emb, 3, ("simple", "unique"))
    assert sorted({r.method for r in both.collect()}) == ["simple", "unique"]
    with pytest.raises(ValueError):
        scoring.score(docs, emb, 3, ("other",))


def test_common_component(spark, toy):
    docs, emb = toy
    vocab = scoring.scoring_vocabulary(emb, counts.term_document_frequency(docs), 5)
    got = scoring.score_idf_common_component_removal(docs, vocab, 3)
    m = np.stack([V1 * math.log(5 / 2), V2 * math.log(5 / 3)])
    top = np.linalg.svd(m)[2][0]
    assert np.allclose(np.abs(vec(got, 0) @ unit((m - np.outer(m @ top, top)).sum(axis=0))), 1)
    assert abs(vec(got, 0) @ top) < 1e-9 and not vec(got, 2).any()


def test_large_vocabularies_are_joined_by_a_shuffle(spark, toy, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(rng.choice(words, rng.integers(0, 90)))) for i in range(50)] + [(90, None), (91, "unknown only"), (92, "w1 " * 3000)]
    docs = counts.document_tokens(spark.createDataFrame(texts, "_ref long, text string"), "_ref")
    emb = spark.createDataFrame([(w, rng.normal(size=6).tolist()) for w in words[:50]], "word string, vec array<double>")
    vocab = scoring.scoring_vocabulary(emb, counts.term_document_frequency(docs), 53, {"w3": 0.2})
    for name, method in scoring.METHODS.items():
        monkeypatch.undo()
        near = {r._ref: r.vec for r in method(docs, vocab, 6).collect()}
        monkeypatch.setattr(scoring, "VOCABULARY_BYTES", 100)
        far = {r._ref: r.vec for r in method(docs, vocab, 6).collect()}
        assert set(near) == set(far) == {r[0] for r in texts}
        assert all(np.allclose(near[i], far[i], atol=1e-7) for i in near), name
    monkeypatch.undo()
    assert scoring.METHODS["simple"](docs, vocab.limit(0), 6).where("exists(vec, x -> x <> 0)").count() == 0


def test_common_component_against_singular_vectors(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(rng.choice(words, n))) for i, n in enumerate([1, 2, 2, 3, 5, 8, 30, 200])]
    docs = counts.document_tokens(spark.createDataFrame(texts, "_ref long, text string"), "_ref")
    emb = {w: rng.normal(size=6) for w in words[:35]}
    tdf = counts.term_document_frequency(docs)
    vocab = scoring.scoring_vocabulary(spark.createDataFrame([(w, v.tolist()) for w, v in emb.items()], "word string, vec array<double>"), tdf, len(texts))
    df = {r.word: r["count"] for r in tdf.collect()}
    got = {r._ref: np.array(r.vec) for r in scoring.score_idf_common_component_removal(docs, vocab, 6).collect()}
    for i, text in texts:
        m = np.array([emb[w] * math.log(len(texts) / (df[w] + 1)) for w in sorted(set(text.split())) if w in emb]).reshape(-1, 6)
        if len(m) > 1:
            u, s, v = np.linalg.svd(m, full_matrices=False)
            m = m - s[0] * np.outer(u[:, 0], v[0])
        total = m.sum(axis=0)
        assert np.allclose(got[i], total / np.linalg.norm(total) if np.linalg.norm(total) > 1e-9 else 0 * total, atol=1e-6), i


def test_counts_and_idf(spark, toy):
    docs, _ = toy
    assert rows(counts.term_frequency(docs)) == [("bird", 1), ("cat", 2), ("dog", 2), ("fish", 1)]
    assert rows(counts.term_document_frequency(docs)) == [("bird", 1), ("cat", 1), ("dog", 2), ("fish", 1)]
    tdf = spark.createDataFrame([("all", 4), ("most", 3), ("some", 1)], "word string, count long")
    got = {r.word: r.idf for r in counts.inverse_document_frequency(tdf, 4).collect()}
    assert got["all"] < 0 and got["most"] == 0 and math.isclose(got["some"], math.log(2))
    assert rows(counts.vocabulary(tdf, 3)) == [("all", 4), ("most", 3)]


def test_downsampling(spark, toy):
    _, emb = toy
    n = {r.word: r.n for r in scoring.downsample_weights(emb, {"cat": 0.1, "gone": 5.0}).collect()}
    assert math.isclose(n["cat"], math.exp(-0.1 * V1 @ V1)) and n["dog"] == 1.0  # a negative product is clipped
    assert {r.n for r in scoring.downsample_weights(emb, {"cat": 0.0}).collect()} == {1.0}


def test_embedding_modes_and_norm(spark):
    rng = np.random.default_rng(2)
    topics = [[f"a{i}" for i in range(8)], [f"b{i}" for i in range(8)]]
    texts = [(i, " ".join(rng.choice(topics[i % 2], 30))) for i in range(80)] + [(900, None), (901, ""), (902, "rare words")]
    df = spark.createDataFrame(texts, "_ref long, text string")
    for bad in ({"skip_gram": 2}, {"negative": 5}, {"hierarchical_softmax": 2}, {"hierarchical_softmax": 0}):
        with pytest.raises(ValueError):
            embedding.fit_embedding(df, "_ref", **bad)
    for mode in ({"skip_gram": 0}, {"skip_gram": 1}, {"skip_gram": 0, "hierarchical_softmax": 0, "negative": 5}, {"skip_gram": 1, "hierarchical_softmax": 0, "negative": 5, "partitions": 3}, {"skip_gram": 0, "sample": 0.05, "partitions": 2}):
        given = {"size": 8, "min_count": 5, "epochs": 12, "sample": 0.0} | mode
        got = {r.word: np.array(r.vec) for r in embedding.fit_embedding(df, "_ref", **given).collect()}
        assert set(got) == {w for t in topics for w in t} and all(math.isclose(np.linalg.norm(v), 1, rel_tol=1e-5) for v in got.values())
        within = np.mean([got[f"a{i}"] @ got[f"a{j}"] + got[f"b{i}"] @ got[f"b{j}"] for i in range(8) for j in range(i)]) / 2
        across = np.mean([got[f"a{i}"] @ got[f"b{j}"] for i in range(8) for j in range(8)])
        assert within > across + 0.3, (mode, within, across)
    same = [embedding.fit_embedding(df, "_ref", size=4, min_count=5, epochs=1).orderBy("word").collect() for _ in range(2)]
    assert same[0] == same[1]
    assert embedding.fit_embedding(df.limit(0), "_ref").count() == 0


def test_huffman_ways():
    nodes, codes = huffman(np.array([8.0, 4, 2, 1, 1]))
    assert [int((r >= 0).sum()) for r in nodes] == [1, 2, 3, 4, 4]
    ways = {tuple((n, c) for n, c in zip(a, b, strict=True) if n >= 0) for a, b in zip(nodes.tolist(), codes.tolist(), strict=True)}
    assert len(ways) == 5 and nodes.max() == 3
    assert huffman(np.array([3.0]))[0].shape == (1, 0)


def test_reduced_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1] + 7
    got, model = reduce_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "_ref long, vec array<double>"), 2)
    y = np.array([r.vec_reduced for r in got.orderBy("_ref").collect()])
    assert np.allclose(y.mean(axis=0), 0, atol=1e-9)
    top = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(y[:, 0]), np.abs((x - x.mean(axis=0)) @ top[2][0]))
    ratios = [r.explained_variance_ratio for r in model.orderBy("component").collect()]
    assert ratios[0] > ratios[1] > 0


def test_stores(spark, tmp_path, toy):
    path = str(tmp_path / "vectors")
    v = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 1, [0.0, 1.0])], "method string, _ref long, vec array<double>")
    tables.save_vectors(v, path)
    tables.save_vectors(v.where("method = 'a'").withColumn("_ref", v["_ref"] + 1), path)
    assert tables.score_methods(spark, path) == ["a", "b"]
    assert rows(tables.load_vectors(spark, path, "a")) == [(2, [1.0, 0.0])] and tables.load_vectors(spark, path, "b").count() == 1
    with pytest.raises(ValueError):
        tables.load_vectors(spark, path, "c")
    with pytest.raises(Exception, match="NaN"):
        tables.save_vectors(spark.createDataFrame([("a", 1, [float("nan")])], v.schema), path)
    words = spark.createDataFrame([("nan", 3), ("NULL", 2), ('q"x', 1)], "word string, count long")
    tables.write_counts(words, 9, str(tmp_path / "tdf"))
    back, n = tables.read_counts(spark, str(tmp_path / "tdf"))
    assert n == 9 and rows(back) == rows(words)
    with pytest.raises(ValueError):
        tables.require_columns(words, ["missing"])


def test_csv_source(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text('title,abstract\n"A ""q""","line\none"\n,x\n', encoding="utf-8")
    (folder / "b.txt").write_text("title,abstract\nno,no\n", encoding="utf-8")
    got = tables.read_csv(spark, str(folder), ["title", "abstract"])
    assert rows(got) == [("", "x", "a.csv"), ('A "q"', "line\none", "a.csv")]
    assert tables.csv_columns(spark, str(folder / "a.csv")) == ["title", "abstract"]
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(folder), ["pmid"])
    with pytest.raises(ValueError):
        tables.read_sources(spark, [])


def test_streamed_scores_equal_batch(spark, toy, tmp_path):
    docs, emb = toy
    vocab = scoring.scoring_vocabulary(emb, counts.term_document_frequency(docs), 5)
    src = spark.createDataFrame([(0, "cat cat dog"), (1, "dog bird"), (2, None)], "_ref long, text string")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    out = []
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, vocab, 3, lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    expected = {r._ref: r.vec for r in scoring.score_unique_idf(docs, vocab, 3).collect()}
    assert len(out) == 3 and all(np.allclose(r.vec, expected[r._ref]) for r in out)


def test_config(tmp_path):
    path = tmp_path / "c.ini"
    path.write_text("[embed]\nsize = 7\n[score]\nmethods = simple, unique\ndownsample_weights = cat:0.5\n[analyze]\ncompute_dispersion = true\n")
    c = config.load_config(str(path))
    assert c.embed.size == 7 and c.score.methods == ("simple", "unique") and c.score.downsample_weights == {"cat": 0.5} and c.analyze.compute_dispersion
    for bad in ("[other]\nx = 1\n", "[embed]\nsiz = 7\n", "[embed]\nsize = x\n", "[analyze]\ncompute_dispersion = maybe\n"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            config.load_config(str(path))
    with pytest.raises(FileNotFoundError):
        config.load_config(str(tmp_path / "none.ini"))
