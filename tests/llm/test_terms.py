from __future__ import annotations

import math
from collections import Counter

from conftest import rows
from pyspark.sql import functions as F

from loomtext.llm import terms

DATA = [
    (1, "a a a a b\nc", 1), (1, "a a a a b\nc", 2), (2, "b c nan NULL", 1), (3, None, 1), (4, "", 5), (5, "  ", 1), (6, "old", 1), (6, "new words b", 2), (7, "tie x", None), (7, "tie y", None), (None, "lost", 1), (8, "long " * 50_000, 1), (9, "b c", 1), (9, "b c", 1),
]
RECORDS = {1: "a a a a b\nc", 2: "b c nan NULL", 6: "new words b", 7: "tie y", 8: "long " * 50_000, 9: "b c"}


def frame(spark):
    return spark.createDataFrame([(*r, 7, "s") for r in DATA], "_ref long, text string, parsed_at int, occ int, word string")


def test_scores(spark):
    counts = {i: Counter(t.split()) for i, t in RECORDS.items()}
    occ = sum(counts.values(), Counter())
    d = Counter(w for c in counts.values() for w in c)
    total, n = sum(occ.values()), len(counts)
    got = {(r.id, r.word): r for r in terms.distinctive_terms(frame(spark)).collect()}
    assert set(got) == {(i, w) for i, c in counts.items() for w in c}
    for (i, w), r in got.items():
        c, length = counts[i][w], sum(counts[i].values())
        assert (r.c, r.length, r.occ, r.d, r.n_records) == (c, length, occ[w], d[w], n)
        assert math.isclose(r.weight, c * math.log(n / (d[w] + 1)), abs_tol=1e-9)
        g = 0.0
        for k, row, col in ((c, length, occ[w]), (occ[w] - c, total - length, occ[w]), (length - c, length, total - occ[w]), (total - length - occ[w] + c, total - length, total - occ[w])):
            g += 2 * k * math.log(k * total / (row * col)) if k else 0
        assert math.isclose(abs(r.score), abs(g), abs_tol=1e-6) and (r.score >= -1e-9) == (c * total >= occ[w] * length or abs(g) < 1e-9)
    few = {(r.id, r.word): r.weight for r in terms.distinctive_terms(frame(spark), least=4).collect()}
    assert few == {k: r.weight for k, r in got.items() if r.c >= 4}
    assert terms.distinctive_terms(frame(spark).limit(0)).count() == 0


def test_without_broadcast(spark, monkeypatch):
    expected = rows(terms.distinctive_terms(frame(spark)))
    monkeypatch.setattr(terms, "HOT_ROWS", 0)
    assert rows(terms.distinctive_terms(frame(spark))) == expected


def test_marks(spark):
    stored = [(1, "f", "b", 2), (1, "f", "b", 2), (2, "f", "b", 2), (1, "f", "c", 9), (1, "f", None, 3), (1, "f", "a", None), (1, "f", "unheld", 4), (1, "g", "nan", 1)]
    tdf = spark.createDataFrame([(*r, "x") for r in stored], "batch int, src_file string, word string, count long, occ string")
    got = {r.word: r for r in terms.marked_terms(frame(spark), tdf, rare=2, common=0.5).collect()}
    assert got["b"].recs == 4 and got["b"].occ == 4 and got["b"].marks == ["common"]
    assert got["c"].marks == ["miscounted"] and got["a"].marks == ["rare", "miscounted"] and got["nan"].marks == ["rare"]
    assert got["long"].occ == 50_000 and "unheld" not in got and len(got) == len({w for t in RECORDS.values() for w in t.split()})
    assert terms.marked_terms(frame(spark).limit(0), tdf).count() == 0
    # of six records one is more than 15 of 100
    assert {tuple(r.marks) for r in terms.marked_terms(frame(spark), tdf.limit(0)).collect()} == {("rare", "common", "miscounted"), ("common", "miscounted")}


def test_hot_term_over_several_ranges(spark):
    df = spark.range(3000).select(F.col("id").alias("_ref"), F.concat(F.lit("hot hot t"), F.col("id") % 10).alias("text"), F.lit(1).alias("parsed_at")).repartition(8)
    got, n = terms.term_frequencies(df)
    assert n == 3000 and rows(got) == sorted([("hot", 6000, 3000)] + [(f"t{i}", 300, 300) for i in range(10)], key=repr)


def test_weight_implies_no_bound_on_the_ratio(spark):
    """A term far above the weight's threshold may be rarer in the record than elsewhere: the ratio can't preselect."""
    docs = [(0, "x " * 4 + "filler " * 9996), (1, "x " * 8 + "y y")] + [(i, "a b c") for i in range(2, 1002)]
    got = terms.distinctive_terms(spark.createDataFrame([(*r, None) for r in docs], "_ref long, text string, parsed_at timestamp"))
    row = got.where("id = 0 and word = 'x'").first()
    assert row.weight >= 3.05 * math.log(row.n_records) and row.score < 0


def test_records_of_many_repeated_ids(spark, monkeypatch):
    few = rows(terms.records(frame(spark), "_ref", "text", "parsed_at"))
    assert [r for r in few if r[0] in RECORDS] == sorted(RECORDS.items(), key=repr) and [r[0] for r in few] == sorted({i for i, *_ in DATA if i is not None})
    monkeypatch.setattr(terms, "REPEATED", 1)
    assert rows(terms.records(frame(spark), "_ref", "text", "parsed_at")) == few
