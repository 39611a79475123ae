"""Import: several columns become one text, every record gets a contiguous id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.rank import global_rank
from loomtext.functions.text import strip
from loomtext.sources.tables import require_columns


def merged(columns: Sequence[str]) -> Column:
    """Each column stripped; blank and null ones left out; a full stop after those that don't end in ``.?!,``; joined
    by newlines. All blank gives ''."""
    parts = []
    for c in columns:
        v = strip(F.col(f"`{c}`").cast("string"))
        parts.append(F.when(v == "", None).when(F.right(v, F.lit(1)).isin(".", "?", "!", ","), v).otherwise(F.concat(v, F.lit("."))))
    return F.concat_ws("\n", *parts)


def merge_columns(df: DataFrame, columns: Sequence[str], target: str = "text") -> DataFrame:
    """``df`` with ``target``. ValueError if ``columns`` is no list or empty, one is missing, or ``target`` exists."""
    if isinstance(columns, str) or not columns:
        raise ValueError("name a list of columns to merge")
    require_columns(df, columns, "source")
    if target in df.columns:
        raise ValueError(f"the source has a column {target} already")
    return df.withColumn(target, merged(columns))


def assign_refs(df: DataFrame, order: Sequence[str], into: str = "_ref") -> DataFrame:
    """``df`` with ids 0, 1, 2 ... in the given total order."""
    return global_rank(require_columns(df, order), list(order), into=into)


def import_corpus(df: DataFrame, columns: Sequence[str], order: Sequence[str], target: str = "text") -> tuple[DataFrame, DataFrame]:
    """((_ref, target), originals with their _ref): the corpus, and the source columns to join to it on _ref later."""
    numbered = assign_refs(merge_columns(df, columns, target), order)
    return numbered.select("_ref", target), numbered.drop(target)
