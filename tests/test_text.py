from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.operators import importing, parse, phrases


def one(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("text"))).collect()]


def test_tokens_are_those_of_python(spark):
    texts = [None, "", " \n", "a b", "a b c　", "\x1ca\x85b", "x" * 100_000]
    assert one(spark, tx.tokens, *texts) == [None if t is None else t.split() for t in texts]
    assert one(spark, tx.strip, *texts) == [None if t is None else t.strip() for t in texts]


def test_chain_functions(spark):
    assert one(spark, tx.unidecoder, "naïve α-café “x” ﬁsh straße é", None) == ['naive a-cafe "x" fish strasse e', None]
    assert one(spark, tx.dedash, "inhi-\n bition well-known") == ["inhibition well-known"]
    assert one(spark, tx.titlecaps, "ALL BIG. Not THIS one. OK!") == ["all big. Not THIS one. ok!"]
    assert one(spark, tx.separated_parenthesis, "A (short) b (long enough text) c.", "none", None) == ["A b c. long enough text.", "none", None]
    assert one(spark, tx.token_replacement, "a & b 5% > c") == ["a and b 5 percent greater than c"]
    assert one(spark, tx.decaps_text, "The DNA McCoy Word", "") == ["the DNA McCoy word", ""]
    assert one(spark, tx.pos_tokenizer, "The cell, of 12 mice; grows -- fast.") == ["cell mice grows fast"]


def test_chain_order_and_unknown_names(spark):
    df = spark.createDataFrame([(1, "THE CAFÉ.", "kept")], "_ref int, text string, other string")
    assert rows(parse.parse_chain(df, ["unidecoder", "titlecaps"])) == [(1, "the cafe.", "kept")]
    with pytest.raises(ValueError, match="unknown"):
        parse.parse_chain(df, ["nothing"])


def test_merge(spark):
    df = spark.createDataFrame([(0, "A", "  b! "), (1, "", "b"), (2, None, None), (3, " x,", "y")], "i int, title string, abstract string")
    assert [r.text for r in importing.merge_columns(df, ["title", "abstract"]).orderBy("i").collect()] == ["A.\nb!", "b.", "", "x,\ny."]
    for bad in ([], "title", ["missing"]):
        with pytest.raises(ValueError):
            importing.merge_columns(df, bad)
    with pytest.raises(ValueError):
        importing.merge_columns(df, ["title"], target="abstract")


def test_refs_are_contiguous(spark):
    df = spark.createDataFrame([(i * 7919 % 501, i % 3) for i in range(501)], "k int, g int").repartition(7)
    got = importing.assign_refs(df, ["k"]).orderBy("k").collect()
    assert [r._ref for r in got] == list(range(501))
    assert importing.assign_refs(df.limit(0), ["k"]).count() == 0


def test_abbreviations(spark):
    texts = ["slow heart rate (HR) and heart rates (HRS)", "Heart rate (HR).", "no (abc) or X (X)", None, "", "beta blocker trial (BBT) beta blocker trial (BBT)"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    pairs = phrases.abbreviation_pairs(df)
    assert rows(pairs) == [("Heart rate", "HR", 1), ("beta blocker trial", "BBT", 2), ("heart rate", "HR", 1)]
    held = spark.createDataFrame([("Heart Rate", "HR", 3), ("heart rates", "HRS", 1), ("glass", "G", 1)], "phrase string, abbr string, count long")
    assert rows(phrases.dedupe_abbreviations(held)) == [("Heart Rate", "HR", 4), ("glass", "G", 1)]
    assert phrases.dedupe_abbreviations(held.limit(0)).count() == 0


def test_acronyms_and_dictionary(spark, monkeypatch):
    held = spark.createDataFrame([("heart rate", "HR", 3), ("hot rod", "HR", 1), (None, "X", 1), ("no abbr", None, 2)], "phrase string, abbr string, count long")
    docs = spark.createDataFrame([(1, "the HR of  HR hr"), (2, None), (3, ""), (4, "Heart Rate\nheart"), (5, "slow heart rate rate")], "_ref long, text string")
    words = spark.createDataFrame([("heart attack", "Infarction"), ("heart", "Heart"), ("heart attack of", "Long one"), ("of heart", "zz"), (None, "x"), ("x", None), ("heart", "Zed"), ("", "empty")], "phrase string, term string")
    more = spark.createDataFrame([(1, "a Heart attack of heart"), (2, None), (3, " "), (4, "heart attack heart"), (5, "attack of heart heart")], "_ref long, text string")
    for rows_ in (parse.DICTIONARY_ROWS, 0):  # with the tasks, and joined by a shuffle
        monkeypatch.setattr(parse, "DICTIONARY_ROWS", rows_)
        got = parse.replace_acronyms(docs, held, prefix="PHRASE", suffix="")
        assert rows(got) == [(1, "the PHRASE_heart_rate of PHRASE_heart_rate hr"), (2, None), (3, ""), (4, "PHRASE_heart_rate heart"), (5, "slow PHRASE_heart_rate rate")]
        got = parse.replace_from_dictionary(more, words)
        assert rows(got) == [(1, "a Long_one_MeSH Heart_MeSH"), (2, None), (3, ""), (4, "Infarction_MeSH Heart_MeSH"), (5, "attack zz_MeSH Heart_MeSH")]
        assert parse.replace_from_dictionary(more, words.limit(0)).where("text = 'heart attack heart'").count() == 1
    assert rows(parse.replace_acronyms(docs, held).where("_ref = 5")) == [(5, "slow heart_rate_ABBR rate")]


def test_tables_within_the_chain(spark):
    held = spark.createDataFrame([("heart rate", "HR", 3)], "phrase string, abbr string, count long")
    words = spark.createDataFrame([("heart attack", "Infarction")], "phrase string, term string")
    docs = spark.createDataFrame([(1, "The HR (heart attack cases).")], "_ref long, text string")
    chain = ["replace_acronyms", "separated_parenthesis", "replace_from_dictionary", "pos_tokenizer"]
    got = parse.parse_chain(docs, chain, tables={"replace_acronyms": held, "replace_from_dictionary": words})
    assert rows(got) == [(1, "heart_rate_ABBR Infarction_MeSH cases")]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(parse.parse_chain(docs, chain[:2] + chain[3:])) == [(1, "HR heart attack cases")]


def test_word_classes(spark):
    text = "The cell, of 12 mice; was -- & very fast."
    assert one(spark, lambda c: tx.pos_tokenizer(c, ["cardinal"]), text) == ["The cell, of mice; was -- & very fast."]
    assert one(spark, lambda c: tx.pos_tokenizer(c, ["verb", "adverb", "symbol"]), text) == ["The cell, of 12 mice; -- fast."]
    assert one(spark, lambda c: tx.pos_tokenizer(c, ["punctuation", "connector"]), text) == ["cell 12 mice was & very fast"]
    with pytest.raises(ValueError, match="word classes"):
        tx.pos_tokenizer(F.lit("x"), ["noun"])
