"""Training held against the rule written out plainly: every position gathers its own rows."""

import os
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from loomtext.functions import word2vec as w2v
from loomtext.operators import embedding
from loomtext.plans import shared


def plain(words, around, inner, outer, plan, rate, drawn):
    """A batch, row by row gathered and added up by row."""
    known = around >= 0
    h = (inner[around] * known[:, :, None]).sum(axis=1) / known.sum(axis=1, keepdims=True).astype(np.float32)
    if plan.ways:
        to, wanted = plan.ways[0][words], 1 - plan.ways[1][words]
        used = to >= 0
    else:
        to = np.concatenate([words[:, None], drawn], axis=1)
        wanted = np.zeros(to.shape, np.int64)
        wanted[:, 0] = 1
        used = np.ones(to.shape, bool)
        used[:, 1:] = to[:, 1:] != words[:, None]
    target = outer[to]
    g = ((wanted - 1 / (1 + np.exp(-np.clip(np.einsum("bd,bld->bl", h, target), -30, 30)))) * used * rate).astype(np.float32)
    back = np.einsum("bl,bld->bd", g, target)
    for rows, at, change in ((outer, to[used], (g[:, :, None] * h[:, None, :])[used]), (inner, around[known], np.broadcast_to(back[:, None, :], (*around.shape, back.shape[1]))[known])):
        if not len(at):
            continue
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        times = np.diff(np.append(first, len(at)))
        rows[at[first]] += np.add.reduceat(change[order], first, axis=0) * np.minimum(1, w2v.FULL / times)[:, None].astype(np.float32)


def plainly(groups, inner, outer, plan, rates, total, rng):
    table, done = None if plan.ways else np.cumsum(plan.counts**0.75), 0
    for flat, sizes in groups:
        words, around = w2v._positions(flat, sizes, plan, plan.kept, rng)
        rate = np.float32(rates[0] + (rates[1] - rates[0]) * min(1.0, done / max(1, total)))
        done += len(flat)
        for a in range(0, len(words), w2v.BATCH):
            w = words[a : a + w2v.BATCH]
            drawn = None if plan.ways else np.minimum(np.searchsorted(table, rng.random((len(w), plan.negative)) * table[-1], "right"), len(table) - 1)
            plain(w, around[a : a + w2v.BATCH], inner, outer, plan, rate, drawn)


def made(v, n, size, tree, negative=0, skip_gram=False, sample=1e-3):
    rng = np.random.default_rng(3)
    flat = np.concatenate([np.minimum((v * rng.random(n) ** 3).astype(np.int64), v - 1), np.arange(v)])
    counts = np.bincount(flat, minlength=v).astype(float)
    plan = w2v.Plan(counts, w2v.huffman(counts) if tree else None, negative, 5, skip_gram, sample)
    model = [rng.normal(scale=0.1, size=(rows, size)).astype(np.float32) for rows in (v, max(1, v - 1) if tree else v)]
    groups = [(x, np.array([1, 0, len(x) - 4, 3])) for x in np.array_split(flat, max(1, len(flat) // 5000))]
    return groups, model, plan


@pytest.mark.parametrize("given", [{"tree": True}, {"tree": True, "skip_gram": True}, {"tree": False, "negative": 5}, {"tree": False, "negative": 5, "skip_gram": True}, {"tree": True, "v": 2}, {"tree": True, "v": 1}, {"tree": False, "negative": 4, "v": 3}])
def test_training_follows_the_rule(given):
    groups, model, plan = made(**({"v": 300, "n": 4000, "size": 12, "sample": 0.0} | given))
    got, expected = [x.copy() for x in model], [x.copy() for x in model]
    w2v.train(iter(groups), *got, plan, (0.05, 0.01), 4000, np.random.default_rng(1))
    plainly(groups, *expected, plan, (0.05, 0.01), 4000, np.random.default_rng(1))
    for a, b, before in zip(got, expected, model, strict=True):
        assert np.allclose(a, b, atol=2e-5)
    assert given.get("v") == 1 or not np.allclose(expected[0], model[0], atol=1e-3)


def timed():
    groups, model, plan = made(3000, 60_000, 300, True)

    def seconds(run):
        mine, began = [x.copy() for x in model], time.process_time()
        run(iter(groups), *mine, plan, (0.025, 0.02), 60_000, np.random.default_rng(1))
        return time.process_time() - began

    return min(seconds(w2v.train) for _ in range(3)) / min(seconds(plainly) for _ in range(3))


def test_training_shares_what_positions_gather():
    """Of 300 numbers and a deep tree: less than 0.6 of the CPU time of the rule written out, on one thread as in tasks."""
    run = "import sys; sys.path[:0] = sys.argv[1:]; import test_word2vec; print(test_word2vec.timed())"
    here = Path(__file__).parent
    said = subprocess.run([sys.executable, "-c", run, str(here), str(here.parent)], env=os.environ | {"OMP_NUM_THREADS": "1"}, capture_output=True, text=True, check=True, timeout=300)
    assert float(said.stdout) < 0.6


def test_groups_of_texts(monkeypatch):
    monkeypatch.setattr(embedding, "GROUP", 10)
    texts = [np.arange(n, dtype=np.int32) for n in (4, 0, 6, 25, 1, 2, 0, 9, 3)]
    batches = [pa.RecordBatch.from_arrays([pa.array([0] * len(x), pa.int32()), pa.array([t.tobytes() for t in x], pa.binary())], ["part", "ids"]) for x in (texts[:2], [], texts[2:5], texts[5:])]
    got = [(flat.tolist(), sizes.tolist()) for flat, sizes in embedding._groups(iter(batches))]
    assert [s for _, s in got] == [[4, 0, 6], [25], [1, 2, 0, 9], [3]]
    assert [x for f, _ in got for x in f] == [x for t in texts for x in t.tolist()]


def test_large_models_are_read_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 40}" for k in range(1, 30))) for i in range(40)], "_ref long, text string")
    given = {"size": 8, "min_count": 2, "epochs": 2, "sample": 0.0, "partitions": 2}
    at_once = sorted(map(tuple, embedding.fit_embedding(df, "_ref", **given).collect()))
    monkeypatch.setattr(embedding, "AT_ONCE", 0)
    in_parts = sorted(map(tuple, embedding.fit_embedding(df, "_ref", **given).collect()))
    assert [w for w, _ in at_once] == [w for w, _ in in_parts] and np.allclose([v for _, v in at_once], [v for _, v in in_parts], atol=1e-6)


def test_shuffles_of_an_epoch_are_dropped(spark):
    """The setting holds while the model is trained and is as before afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with shared.shuffles_dropped(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before
