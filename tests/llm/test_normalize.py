from __future__ import annotations

import random
import re
from itertools import combinations

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.llm import normalize as nz
from loomtext.llm import pairs as pr
from loomtext.llm.lookalike import _fingerprints, canonical_columns, lookalike_groups, lookalike_pairs
from loomtext.llm.normalize import canonical, canonical_text
from loomtext.llm.words import slices, word_hashes

SAME = [
    ("ｔｒіａｌ", "trial"), ("café", "café"), ("a­b  c　", "ab c"), ("тeрапия", "терапия"), ("ﬁbro​sis", "fibrosis"), ("µ", "μ"),
    ("x‑y", "x-y"), ("е́", "é"), ("νirus", "virus"), ("≠", "≠"), ("ΑBC", "ABC"), ("Ⅲ", "III"), ("Å", "Å"), ("a\n\t b", "a b"), ("e​́", "é"), ("…", "..."), ("", " ​\n"),
    ("օrgan", "organ"), ("cⲟde", "code"), ("ᎪBC", "ABC"), ("ꓮBC", "ABC"), ("ρrotein", "protein"), ("tυmor", "tumor"), ("Ά", "Á"), ("cжп", "сжп"), ("ԚꓴᎬꓢꓔ", "QUEST"), ("сор", "cop"), ("漢字 ﷺ", "漢字 صلى الله عليه وسلم"), ("豈", "豈"), ("각", "각"),
]
DIFFERENT = ["Trial", "trial", "trіals", "naive", "naïve", "10⁵", "105", "10₅", "a-b", "a–b", "a—b", "“a”", '"a"', "α", "a", "β", "ß", "γ", "y", "δ", "κ", "k", "μ", "u", "рак", "pak"]


def test_same_and_different():
    for a, b in SAME:
        assert canonical(a) == canonical(b), (a, b)
    for a, b in combinations(DIFFERENT, 2):
        assert canonical(a) != canonical(b), (a, b)
    assert canonical(None) is None


TEXT = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcоеарЖяйѐїΆόօⲟᎪꓮ漢ハ豈가각 αβγ  ​́̈­ﬁ‐-ＡΑ각각≠")), max_size=30)


@settings(max_examples=600, deadline=None)
@given(TEXT)
def test_splicing_equals_normalising_whole_texts(text):
    whole = " ".join(x for x in nz._normal_segment.__wrapped__(text).split(" ") if x)
    assert canonical(text) == whole
    assert canonical(whole) == whole


def test_quick_check_misses_nothing(spark):
    rnd = random.Random(1)
    texts = [a for p in SAME for a in p] + ["plain text", " lead", "two  spaces", "tab\there", None, "x" * 300_000 + "​"] + ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x500), rnd.randrange(0x2000, 0x2070)])) for _ in range(12)) for _ in range(500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(canonical_text(F.col("t"))).collect()]
    assert got == [canonical(t) for t in texts]


def test_pairs(spark):
    data = [(1, "A  title", "n/a"), (2, "A title", "N/A "), (3, "A title", None), (4, "Ａ title", "[no abstract]"), (5, None, "[no  abstract]"), (6, "", " "), (7, "other", ""), (7, "other", ""), (8, "оther", "x"), (9, "A tıtle", "ｘ")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], "_ref long, title string, abstract string, field string, id int")
    expected = {("title", a, b) for a, b in [(1, 2), (1, 3), (1, 4), (2, 4), (3, 4), (7, 8)]} | {("abstract", 8, 9)}
    got = lookalike_pairs(df, "_ref", ["title", "abstract"])
    assert {tuple(r) for r in got.collect()} == expected and got.count() == len(expected)
    assert lookalike_pairs(df.limit(0), "_ref", ["title", "abstract"]).count() == 0
    links = {}
    for f, a, b in expected:
        links[f, a], links[f, b] = links.get((f, a), 0) + 1, links.get((f, b), 0) + 1
    groups = {(r.field, r.id): r for r in lookalike_groups(df, "_ref", ["title", "abstract"]).collect()}
    assert {k: r.n_links for k, r in groups.items() if r.n_links} == links and groups["title", 4].class_id == 1 and groups["abstract", 9].class_id == 8
    assert lookalike_groups(df.limit(0), "_ref", ["title", "abstract"]).count() == 0
    # the form of each text is made once, for both fields
    assert _fingerprints(df, "_ref", ["title", "abstract"])._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    kept = canonical_columns(df, ["title"])
    assert kept.columns == df.columns and kept.where("_ref = 4").first().title == "A title"


def test_hot_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(pr, "BLOCK", 7)
    ids = list(range(40))
    members = spark.createDataFrame([(i % 2 if i < 60 else 9, i) for i in range(61)], "g int, id long")
    got = rows(pr.pairs_within(members, ["g"], "id"))
    assert got == sorted(((g, a, b) for g in (0, 1) for a, b in combinations(range(g, 60, 2), 2)), key=repr)
    both = spark.createDataFrame([(0, 1)], "a int, b int")
    wide = pr.expand(pr.expand(both, "a", members, "g", "id", "x"), "b", members, "g", "id", "y")
    assert wide.count() == wide.distinct().count() == 900 and len(ids) == 40


def test_word_hashes():
    texts = ["The cell-line β2 ", None, "", "the CELL", "a" * 3_000_000 + " b", "x_y 10⁵ ｔｈｅ"]
    h, o = word_hashes(texts)
    words = [re.findall(r"[^\W_]+", (canonical(t) or "").lower()) for t in texts]
    assert list(o[1:] - o[:-1]) == [len(w) for w in words]
    flat = [x for w in words for x in w]
    assert len({(a, int(b)) for a, b in zip(flat, h, strict=True)}) == len(set(flat)) == len(set(h.tolist()))


def test_slices_lose_nothing():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([None if i % 7 == 0 else "y" * i * 10 for i in range(50)])], ["i", "t"])
    parts = list(slices(b, 1, 900))
    assert len(parts) > 5 and [x for p in parts for x in p.column(0).to_pylist()] == list(range(50))
    assert list(slices(b.slice(0, 0), 1)) == []
