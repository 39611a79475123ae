from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from loomtext.llm import neardup
from loomtext.llm.components import components
from loomtext.llm.normalize import canonical
from loomtext.llm.superminhash import bands, multiset_elements, signatures
from loomtext.llm.words import word_hashes


def test_signatures_estimate_similarity():
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base)] + [" ".join(base[: 100 - k] + [f"v{k}{i}" for i in range(k)]) for k in (0, 5, 20, 50, 100)] + ["", "one", "one one"]
    h, o = word_hashes(texts)
    e, owner = multiset_elements(h, o)
    sig = signatures(e, owner, len(texts), 320)
    for i, k in enumerate((0, 5, 20, 50, 100), 1):
        assert abs((sig[0] == sig[i]).mean() - (100 - k) / (100 + k)) < 0.08
    assert (sig[6] == 0xFFFFFFFF).all()
    assert 0.3 < (sig[7] == sig[8]).mean() < 0.7  # multisets: one of two
    shuffled = base[:]
    rnd.shuffle(shuffled)
    h2, o2 = word_hashes([" ".join(shuffled)])
    assert (signatures(*multiset_elements(h2, o2), 1, 320)[0] == sig[0]).all()
    keys = bands(sig, 40, 8)
    assert (keys[0] == keys[1]).all() and len({int(k) & 255 for k in keys[0]}) == 40 and keys.max() < 1 << 48


def brute(data, similarity=0.8, least=20):
    held = [(i, Counter(re.findall(r"[^\W_]+", (canonical((a or "") + " " + (b or "")) or "").lower()))) for i, a, b in data if i is not None]
    held = [(i, c) for i, c in held if sum(c.values()) >= least]
    out = set()
    for (i, a), (j, b) in combinations(held, 2):
        if i != j and sum((a & b).values()) >= similarity * max(sum(a.values()), sum(b.values())) - 1e-9:
            out.add((min(i, j), max(i, j)))
    return out


def made(seed=4, n=60):
    rnd = random.Random(seed)
    vocab = [f"term{i}" for i in range(400)]
    data, ref = [], 0
    for _ in range(n):
        words = rnd.choices(vocab, k=rnd.randint(20, 120))
        for _ in range(rnd.choice([1, 1, 1, 2, 4])):
            w = words[:]
            for _ in range(rnd.randint(0, len(w) // 12)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            if rnd.random() < 0.3:
                rnd.shuffle(w)
            data.append((ref, " ".join(w[:5]), " ".join(w[5:])))
            ref += 1
    return data


def test_pairs_and_groups(spark):
    data = made()
    long_text = "word " * 60_000
    data += [(900, None, data[0][1] + " " + data[0][2]), (901, data[0][1].upper(), data[0][2] + " ​"), (902, None, None), (903, "short text", ""), (None, data[0][1], data[0][2]), (904, long_text, "x"), (905, long_text, "y"), data[0]]
    df = spark.createDataFrame([(*r, 1, "q") for r in data], "_ref long, title string, abstract string, id int, key string")
    expected = brute(data)
    got = neardup.near_duplicate_pairs(df, "_ref", ["title", "abstract"])
    found = {tuple(r) for r in got.collect()}
    assert found <= expected and len(found) >= 0.98 * len(expected) and (900, 901) in found and (904, 905) in found and got.count() == len(found)
    groups = {r.id: r for r in neardup.near_duplicate_groups(df, "_ref", ["title", "abstract"]).collect()}
    assert set(groups) == {i for i, a, b in data if i is not None and i not in (902, 903)}
    for a, b in found:
        assert groups[a].group_id == groups[b].group_id
    lonely = set(groups) - {x for p in found for x in p}
    assert all(groups[i].group_id == i and groups[i].n_links == 0 for i in lonely)
    assert neardup.near_duplicate_pairs(df.limit(0), "_ref", ["title", "abstract"]).count() == 0
    assert neardup.near_duplicate_groups(df.limit(0), "_ref", ["title", "abstract"]).count() == 0


def test_many_copies(spark):
    text = " ".join(f"w{i}" for i in range(30))
    data = [(i, text, "") for i in range(60)] + [(100 + i, text + f" extra{i}", "") for i in range(20)]
    df = spark.createDataFrame(data, "_ref long, title string, abstract string")
    assert {tuple(r) for r in neardup.near_duplicate_pairs(df, "_ref", ["title", "abstract"]).collect()} == brute(data)


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(80)] + [(5, 5), (None, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    expected = sorted(((x, find(x)) for x in root), key=repr)
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    assert rows(components(df, "a", "b")) == expected
    assert components(df.limit(0), "a", "b").count() == 0


def test_pairs_at_the_edge(spark):
    """One fifth of the words replaced, in records of several lengths: similarity 0.8 exactly."""
    rnd = random.Random(6)
    data, sizes = [], {}
    for k in range(800):
        n = (20, 50, 100, 200)[k % 4]
        words = [f"r{k}x{i}" for i in range(n)]
        other = words[:]
        for i in rnd.sample(range(n), n // 5):
            other[i] = f"new{k}x{i}"
        data += [(2 * k, "", " ".join(words)), (2 * k + 1, "", " ".join(other))]
        sizes[2 * k] = n
    df = spark.createDataFrame(data, "_ref long, title string, abstract string")
    found = {tuple(r) for r in neardup.near_duplicate_pairs(df, "_ref", ["title", "abstract"]).collect()}
    assert found <= {(2 * k, 2 * k + 1) for k in range(800)}
    for n in (20, 50, 100, 200):
        assert sum(sizes[a] == n for a, _ in found) >= 0.95 * 200


def test_hot_band_keys(spark, monkeypatch):
    """Keys that many records hold are spread over tasks, with the same result; so are lengths beyond what a key holds."""
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    data = [(i, "", " ".join([*rnd.sample(base, 57), f"own{i}"])) for i in range(150)] + [(1000 + i, "", f"{i} " + "long text " * 20_000) for i in range(2)]
    df = spark.createDataFrame(data, "_ref long, title string, abstract string")
    assert neardup._hot(df.select(F.col("_ref").alias("id"), "title", "abstract"), 152, 20, (64, 7)).count() > 0
    found = {tuple(r) for r in neardup.near_duplicate_pairs(df, "_ref", ["title", "abstract"]).collect()}
    assert found == brute(data)
    monkeypatch.setattr(neardup, "HOT", 1 << 30)
    monkeypatch.setattr(neardup, "CELL", 10)  # many cells
    assert {tuple(r) for r in neardup.near_duplicate_pairs(df, "_ref", ["title", "abstract"]).collect()} == found
