"""Abbreviations and the phrases they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to twelve words before a parenthesis that holds one token with a capital.
FOUND = r"((?:[\w'-]+ +){1,12})\(([A-Za-z0-9-]*[A-Z][A-Za-z0-9-]*)\)"


def abbreviation_pairs(df: DataFrame, text: str = "text") -> DataFrame:
    """(phrase, abbr, count): for each ``(ABBR)`` of two letters or more, the words before it, as many as it has letters,
    if their initials are these letters. Null and other texts give nothing."""
    whole = F.regexp_extract_all(F.col(text), F.lit(FOUND), F.lit(0))
    rows = df.select(F.explode(whole).alias("m"))
    rows = rows.select(F.split(F.rtrim(F.substring_index("m", "(", 1)), " +").alias("words"), F.substring_index(F.substring_index("m", "(", -1), ")", 1).alias("abbr"))
    letters = F.upper(F.regexp_replace("abbr", "[^A-Za-z]", ""))
    rows = rows.withColumn("letters", letters).where((F.length("letters") >= 2) & (F.size("words") >= F.length("letters")))
    taken = F.slice("words", F.size("words") - F.length("letters") + 1, F.length("letters"))
    rows = rows.withColumn("taken", taken).where(F.upper(F.array_join(F.transform("taken", lambda w: F.left(w, F.lit(1))), "")) == F.col("letters"))
    return rows.groupBy(F.array_join("taken", " ").alias("phrase"), "abbr").agg(F.count(F.lit(1)).alias("count"))


def dedupe_abbreviations(pairs: DataFrame) -> DataFrame:
    """Phrases that are equal in lower case, without final s, become one: the counts are added, phrase and abbreviation
    are those of the most frequent (ties: phrase, then abbreviation). An empty table stays one."""
    key = F.rtrim(F.lower(F.trim("phrase")), F.lit("s"))
    best = F.min_by(F.struct("phrase", "abbr"), F.struct(-F.col("count"), F.col("phrase"), F.col("abbr")))
    grouped = pairs.groupBy(key.alias("key")).agg(best.alias("b"), F.sum("count").alias("count"))
    return grouped.select("b.phrase", "b.abbr", "count")


def most_frequent(pairs: DataFrame, n: int = 5) -> DataFrame:
    return pairs.orderBy(F.desc("count"), "phrase", "abbr").limit(n)
