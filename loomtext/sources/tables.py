"""Sources and sinks: CSV corpora, term tables, stored vectors and clusters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The row of an exported term table that carries the number of documents.
DOCUMENT_COUNTER = "__pipeline_document_counter"


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    """``df`` itself; ValueError naming both lists if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {missing}; it has {df.columns}")
    return df


def read_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, glob: str = "*.csv", folder: str | None = None) -> DataFrame:
    """CSV files with a header as columns of text, plus ``src_file``. Quoted newlines, doubled quotes and fields of any
    length are read; an empty cell is ''. The files of a folder are those that match ``glob``. ``folder`` names the
    column that ``write_csv`` laid out as folders, if it did; its values come back as text."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).option("pathGlobFilter", glob)
    df = reader.csv(path)
    df = require_columns(df, [*(columns or []), *([folder] if folder else [])], f"CSV {path}")
    picked = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in (columns or [c for c in df.columns if c != folder])]
    return df.select(*picked, *([F.col(f"`{folder}`").cast("string").alias(folder)] if folder else []), F.col("_metadata.file_name").alias("src_file"))


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """The header alone; AnalysisException if there is no such file."""
    return spark.read.option("header", True).option("multiLine", True).csv(path).columns


def read_sources(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Several folders together; columns missing in one are null. ValueError without folders."""
    if not paths:
        raise ValueError("no input folders")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (read_csv(spark, p, columns) for p in paths))


def read_corpus(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """(_ref long, text, src_file) of an imported or parsed corpus in CSV."""
    df = read_csv(spark, path, ["_ref", text])
    return df.select(F.col("_ref").cast("long").alias("_ref"), F.col(text), "src_file")


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """CSV with a header, overwriting; a folder per value of the partition columns (one per source file, say)."""
    df.write.mode("overwrite").partitionBy(*partition_by).option("header", True).option("escape", '"').csv(path)


def save_reports(reports: dict[str, DataFrame], path: str) -> None:
    """Named reports as tables, and as CSV under ``reports``. Lists are written as their elements between spaces."""
    save_tables(reports, path)
    for name in reports:
        df = reports[name].sparkSession.read.parquet(f"{path}/{name}")
        flat = [F.array_join(F.col(f"`{f.name}`").cast("array<string>"), " ").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in df.schema]
        write_csv(df.select(*flat), f"{path}/reports/{name}")


def write_counts(counts: DataFrame, n: int, path: str) -> None:
    """(word, count), most frequent first, with the document counter's row."""
    counter = counts.sparkSession.createDataFrame([(DOCUMENT_COUNTER, n)], "word string, count long")
    write_csv(counts.select("word", "count").unionAll(counter).orderBy(F.desc("count"), "word"), path)


def read_counts(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(counts without the counter's row, number of documents). Words such as nan or NULL stay words."""
    df = spark.read.schema("word string, count long").option("header", True).option("escape", '"').option("nullValue", "\x00").csv(path)
    n = df.where(F.col("word") == DOCUMENT_COUNTER).agg(F.max("count")).first()[0]
    return df.where(F.col("word") != DOCUMENT_COUNTER), int(n or 0)


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """(phrase, abbr, count, words) of stored abbreviations."""
    df = spark.read.schema("phrase string, abbr string, count long").option("header", True).option("escape", '"').csv(path)
    return df.withColumn("words", F.split("phrase", " "))


def save_vectors(vectors: DataFrame, path: str) -> None:
    """Stored document vectors (method, _ref, vec, ...), one partition per method; methods written again are replaced,
    others stay. A null or NaN element is an error."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x))
    checked = vectors.withColumn("vec", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("a vector has null or NaN elements"))).otherwise(F.col("vec")))
    checked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method").parquet(path)


def score_methods(spark: SparkSession, path: str) -> list[str]:
    """The stored methods, in order; AnalysisException if nothing is stored."""
    return sorted(r[0] for r in spark.read.parquet(path).select("method").distinct().collect())


def load_vectors(spark: SparkSession, path: str, method: str, use_reduced: bool = False) -> DataFrame:
    """(_ref, vec) of one method (only its partition is read), reduced ones if asked for. ValueError if it isn't stored."""
    df = spark.read.parquet(path).where(F.col("method") == method)
    if not df.limit(1).count():
        raise ValueError(f"no vectors of method {method}; stored are {score_methods(spark, path)}")
    return df.select("_ref", F.col("vec_reduced" if use_reduced else "vec").alias("vec"))


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Named tables side by side, overwritten (a cluster store: centroids, labels, spread)."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


#: Schema of an imported corpus.
CORPUS = T.StructType([T.StructField("_ref", T.LongType(), False), T.StructField("text", T.StringType())])
