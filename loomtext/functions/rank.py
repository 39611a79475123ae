"""Global ranks without a single task that sorts everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.plans.shared import materialize


def global_rank(df: DataFrame, order: list[str], within: list[str] | None = None, into: str = "rank") -> DataFrame:
    """``df`` with the 0-based rank of each row by the columns ``order`` (in all, or within groups). Rows are range-
    partitioned by the order; ranks within the ranges get the counts of the earlier ranges added, so neither all rows
    nor a hot group meet in one task. Ties are broken arbitrarily: give a total order."""
    within = within or []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_range", *within).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", *within, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range", *within).orderBy(*order)
    ranked = ranged.withColumn("_in", F.row_number().over(inside) - 1)
    joined = ranked.join(offsets, [ranked["_range"] == offsets["_range"], *[ranked[c].eqNullSafe(offsets[c]) for c in within]])
    return joined.select(*[ranked[c] for c in df.columns], (F.col("_in") + F.col("_before")).alias(into))


def hash_rank(df: DataFrame, key: F.Column, ident: str, into: str = "rank") -> DataFrame:
    """Rank by a hexadecimal hash column expression, ties by ``ident``: the hash's first three digits are the ranges,
    so nothing need be sampled or written."""
    keyed = df.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, 3))
    counts = keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over 4,096 rows at most
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = keyed.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy("_key", ident)) - 1)
    return ranked.join(F.broadcast(offsets), "_range").withColumn(into, F.col("_in") + F.col("_before")).drop("_key", "_range", "_in", "_before")
