"""Records whose texts look the same (problem 1): canonical columns and the pairs that differ only in characters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.normalize import canonical_text, changed, fingerprint
from loomtext.llm.pairs import expand, pairs_within
from loomtext.plans.shared import materialize


def canonical_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the named text columns in their one form (see ``normalize``); other columns untouched.
    Null stays null, blank becomes ''."""
    return df.withColumns({c: canonical_text(F.col(c)) for c in columns})


def is_placeholder(col: F.Column) -> F.Column:
    """A text in its form that stands for a missing one: wholly in brackets, or n/a."""
    return (F.lower(col) == "n/a") | col.rlike(r"\A\[[^\]]*\]\z")


def _fingerprints(df: DataFrame, ident: str, columns: list[str]) -> DataFrame:
    """One row for each text that counts: field, ident, hashes of its form (c1, c2) and of its characters (r1, r2)."""
    texts = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("raw")) for c in columns]))
    d = df.select(F.col(ident).alias("id"), texts.alias("t")).select("id", "t.field", "t.raw").where("raw is not null")
    # a generator of one row, below which no filter is pushed: the form is made once for each text
    d = d.withColumn("new", changed(F.col("raw"))).select("id", "field", "raw", F.explode(F.array("new")).alias("new"))
    d = d.select("id", "field", "raw", F.coalesce("new", "raw").alias("form")).where((F.col("form") != "") & ~is_placeholder(F.col("form")))
    (c1, c2), (r1, r2) = fingerprint(F.col("form")), fingerprint(F.col("raw"))
    return d.select("field", "id", c1.alias("c1"), c2.alias("c2"), r1.alias("r1"), r2.alias("r2"))


def lookalike_pairs(df: DataFrame, ident: str, columns: list[str]) -> DataFrame:
    """Pairs (field, ref_a, ref_b), ref_a < ref_b, of records whose text in ``field`` looks the same but isn't equal
    code point by code point. Null, blank and placeholder texts don't count; rows of equal characters are never
    paired, so a hot text costs no more than its rows. Empty input gives no rows. Only hashes (128 bits) move."""
    fp = materialize(_fingerprints(df, ident, columns), "lookalike")
    key = ["field", "c1", "c2"]
    raw = F.struct("r1", "r2")
    mixed = fp.groupBy(*key).agg(F.min(raw).alias("lo"), F.max(raw).alias("hi")).where("lo <> hi").select(*key)
    held = fp.join(mixed.hint("shuffle_hash"), key, "left_semi")
    held = materialize(held.select(*key, F.struct("field", "c1", "c2", "r1", "r2").alias("variant"), "id").distinct(), "variants")
    pairs = pairs_within(held.select(*key, "variant").distinct(), key, "variant").select("field", "a", "b")
    pairs = expand(pairs, "a", held, "variant", "id", "x")
    pairs = expand(pairs, "b", held, "variant", "id", "y")
    return pairs.select("field", F.least("x", "y").alias("ref_a"), F.greatest("x", "y").alias("ref_b")).where("ref_a < ref_b").distinct()


def lookalike_groups(df: DataFrame, ident: str, columns: list[str]) -> DataFrame:
    """One row for each record and text that counts: (field, id, class_id: the least id whose text in the field looks the
    same, n_links: records whose text looks the same but has other characters). No pairs are made. A record that comes
    again with the same texts counts once."""
    fp = materialize(_fingerprints(df, ident, columns).distinct(), "lookalike")
    key, raw = ["field", "c1", "c2"], ["r1", "r2"]
    variants = materialize(fp.groupBy(*key, *raw).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")), "variants")
    classes = variants.groupBy(*key).agg(F.sum("n").alias("total"), F.min("least").alias("class_id"))
    held = variants.join(classes, key).select(*key, *raw, "class_id", (F.col("total") - F.col("n")).alias("n_links"))
    return fp.join(held, [*key, *raw]).select("field", "id", "class_id", "n_links")
