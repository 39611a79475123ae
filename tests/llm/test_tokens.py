from __future__ import annotations

import random

import pytest
import tiktoken  # noqa: F401
from pyspark.sql import functions as F

from loomtext.llm import split as sp
from loomtext.llm import tokens as tk

TEXTS = [
    None, "", " ", "\n", "\n\n \n", "Hello  world", "It's they've 10⁵ naïve x", "a\x1cb \x85 c", "<|endoftext|>", "日本語 текст 😀👩‍🔬", "x" * 5000, " " * 3000 + "y", "tab\t\tend \n", "é �", "word " * 20_000, "'s 'S 'll", "a_b __ --", "  z", "1234567 1,234.5",
]


def frame(spark):
    data = [(i, t) for i, t in enumerate(TEXTS)] + [(5, "Hello  world"), (None, "lost")]
    return spark.createDataFrame([(*r, 1, "q") for r in data], "doc_id long, text string, ids int, block string")


def test_ids_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    got = {}
    for r in tk.encode_corpus(frame(spark)).collect():
        got.setdefault(r.id, []).append(r.ids)
    assert set(got) == set(range(len(TEXTS))) and len(got[5]) == 2
    own = tk.encoder(tk.ranks_file())
    other = Tokenizer.from_file(tk.TOKENIZER.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    for i, t in enumerate(TEXTS):
        assert got[i][0] == (own.encode_ordinary(t) if t else []), t
        assert got[i][0] == (other.encode(t, add_special_tokens=False).ids if t else []), t
    assert tk.encode_corpus(frame(spark).limit(0)).count() == 0


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tk, "BLOCK", 2000)  # many blocks
    ids = tk.encode_corpus(frame(spark))
    back = tk.decode_corpus(ids.unionAll(spark.createDataFrame([(99, None)], ids.schema)))
    got = {r.id: r.text for r in back.collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)} | {99: ""}


def made(rnd, n):
    out = []
    while len(out) < n:
        out.append(rnd.choice(["alpha", "beta,", "gamma.", "neuroectomy", "x9", "Émile", "end.\n", "para.\n\n"]))
    return " ".join(out)


def test_pieces(spark):
    rnd = random.Random(7)
    texts = TEXTS + [made(rnd, n) for n in (300, 700, 1500, 4000, 9000)] + ["z" * 20_000, "日本語" * 3000, "😀" * 2000, "\n" * 9000, "a-" * 5000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "word " * 5000, 0)], "doc_id long, text string, piece int")
    own = tk.encoder(tk.ranks_file())
    n = {i: len(own.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    got = {}
    for r in sp.split_oversized(df).collect():
        got.setdefault(r.id, []).append(r)
    assert set(got) - {None} == {i for i, k in n.items() if k > 1024}
    for i, pieces in got.items():
        if i is None:
            continue
        t, pieces = texts[i], sorted(pieces, key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and pieces[0].start == 0 and pieces[-1].end == len(t)
        for a, b in zip([None, *pieces], pieces, strict=False):
            assert b.text == t[b.start : b.end] and len(own.encode_ordinary(b.text)) == b.n_tokens <= 1024 and b.n_repeated <= 64
            if a is not None:
                assert a.start < b.start <= a.end < b.end and len(own.encode_ordinary(t[b.start : a.end])) == b.n_repeated
                if t.startswith(("alpha", "word", "beta")):
                    assert b.n_repeated >= 48 and (t[a.end : a.end + 1].isspace() or t[a.end - 1].isspace())
        if "para" in t:  # where there are paragraph ends near, they are taken
            assert all(t[p.end - 1] == "\n" for p in pieces[:-1])
        if sum(c.isspace() for c in t) > 100 and "para" in t:
            assert max(p.n_tokens for p in pieces) - min(p.n_tokens for p in pieces) < 300
    bare = sp.split_oversized(df, texts=False)
    assert bare.where(F.col("text").isNotNull()).count() == 0 and bare.count() == sum(map(len, got.values()))
    assert sp.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sp.split_oversized(df, limit=64, overlap=64)


def test_far_boundaries_are_taken(spark):
    """A stretch without a boundary is cut only where no piece could end outside of it."""
    rnd = random.Random(3)
    stretch = "".join(rnd.choice("acgt") for _ in range(1200))
    texts = [made(rnd, n).replace("para.\n\n", "para") + " " + stretch + " " + made(rnd, m).replace("para.\n\n", "para") for n, m in ((300, 300), (420, 300), (100, 500), (500, 60), (10, 900))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sp.split_oversized(df).collect()
    assert {r.id for r in found} == set(range(5))
    for r in found:
        t = texts[r.id]
        assert r.n_tokens <= 1024 and (r.end == len(t) or t[r.end].isspace() or t[r.end - 1].isspace())
