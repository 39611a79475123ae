"""Term counts and inverse document frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import tokens


def document_tokens(df: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """(_ref, tokens), an empty list for null and blank texts."""
    return df.select(F.col(ident).alias("_ref"), F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("tokens"))


def term_frequency(docs: DataFrame) -> DataFrame:
    """(word, count) of all tokens; counted per task before the shuffle."""
    return docs.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def term_document_frequency(docs: DataFrame) -> DataFrame:
    """(word, count): documents that hold the word."""
    return docs.select(F.explode(F.array_distinct("tokens")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def inverse_document_frequency(tdf: DataFrame, n: int) -> DataFrame:
    """(word, count, idf = ln(N / (count + 1))): below zero for a word of all documents, zero for all but one."""
    return tdf.select("word", "count", F.log(F.lit(float(n)) / (F.col("count") + 1)).alias("idf"))


def vocabulary(tf: DataFrame, min_count: int = 10) -> DataFrame:
    return tf.where(F.col("count") >= min_count)
