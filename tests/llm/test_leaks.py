from __future__ import annotations

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import leaks
from loomtext.llm.normalize import canonical


def words(t):
    return re.findall(r"[^\W_]+", (canonical(t) or "").lower())


def brute(docs, items):
    runs = {}
    for k, t in items:
        w = words(t)
        for i in range(len(w) - 11):
            runs.setdefault(tuple(w[i : i + 12]), set()).add(k)
    return {(d, k) for d, t in docs if d is not None for w in [words(t)] for i in range(len(w) - 11) for k in runs.get(tuple(w[i : i + 12]), ())}


def made(seed, n_docs=120):
    rnd = random.Random(seed)
    vocab = [f"term{i}" for i in range(300)] + ["the", "of", "and"] * 30
    some = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(some(rnd.randint(8, 40)))) for k in range(40)]
    items += [(100, items[20][1] + " tail words"), (101, None), (102, ""), (103, "too few words")]
    docs = []
    for d in range(n_docs):
        w = some(rnd.randint(0, 400))
        if rnd.random() < 0.6:
            item = words(rnd.choice(items)[1])
            n = rnd.randint(8, 20)
            a = rnd.randint(0, max(0, len(item) - n))
            at = rnd.randint(0, len(w))
            w[at:at] = item[a : a + n]
        sep = rnd.choice([" ", ", ", "\n", " ​"])
        docs.append((d, sep.join(x.upper() if rnd.random() < 0.1 else x for x in w)))
    docs += [(900, None), (901, ""), (None, items[20][1]), (902, "ｔ" + items[20][1][1:]), (903, ("filler words here " * 30_000) + items[21][1])]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = made(3)
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item int")
    ev = spark.createDataFrame([(*r, "s") for r in items], "item_id long, text string, runs string")
    expected = brute(docs, items)
    got = {(r.id, r.item) for r in leaks.leaked_items(df, ev).collect()}
    assert got == expected and len(expected) > 30
    runs = sorted(map(tuple, leaks.leaked_items(df, ev).collect()))
    monkeypatch.setattr(leaks, "KEYS", 10)  # more keys than go along with the tasks: all joins are shuffled
    monkeypatch.setattr(leaks, "PASSAGES", 10)
    assert sorted(map(tuple, leaks.leaked_items(df, ev).collect())) == runs
    assert leaks.leaked_items(df.limit(0), ev).count() == 0 and leaks.leaked_items(df, ev.limit(0)).count() == 0
    monkeypatch.undo()
    assert leaks.leaked_items(df.limit(0), ev).count() == 0 and leaks.leaked_items(df, ev.limit(0)).count() == 0


def test_many_items_in_one_scan(spark):
    rnd = random.Random(5)
    items = [(k, " ".join(f"q{rnd.randrange(5000)}" for _ in range(20))) for k in range(10_000)]
    docs = [(d, "lead " * 30 + " ".join(items[d * 7][1].split()[3:15]) + " tail" * 30) for d in range(200)]
    got = leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == {(d, d * 7, 1) for d in range(200)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Union") == 0


@given(st.lists(st.integers(0, 30), min_size=1, max_size=40), st.integers(1, 12))
@settings(deadline=None)
def test_sliding_minimum(values, length):
    x = np.array(values, np.uint64)
    got = leaks._least(x, length)
    assert got.tolist() == [min(values[i : i + length]) for i in range(len(values) - length + 1)]


def test_windows_of_a_passage_have_its_key():
    rnd = random.Random(1)
    passage = [f"p{i}" for i in range(12)]
    texts = [" ".join(passage)] + [" ".join([f"x{rnd.random()}" for _ in range(n)] + passage + ["y"] * n) for n in range(1, 30)] + [None, "", " ".join(passage[:11])]
    owner, key, run = leaks._windows(texts)
    for i in range(1, 30):
        at = np.flatnonzero((owner == i) & (run == run[0]))
        assert len(at) == 1 and key[at[0]] == key[0]
    assert owner.max() == 29
