"""Pairs inside groups, whatever the size of a group: large groups are cut into blocks and every pair of blocks is a
key of its own, so that no task holds a whole hot group and no pair is lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a group that one block holds on average.
BLOCK = 512


def _blocks(n: str) -> F.Column:
    return F.ceil(F.col(n) / BLOCK).cast("int")


def pairs_within(members: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Each unordered pair of different ``ident`` in the same group once: columns keys, a, b with a < b.
    ``members`` holds each (keys, ident) once and is read twice, so give a materialised or a cheap table."""
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    m = members.select(*keys, ident).join(sizes.hint("shuffle_hash"), keys)
    m = m.withColumn("_k", _blocks("_n")).withColumn("_at", F.pmod(F.xxhash64(ident), F.col("_k")).cast("int"))
    left = m.select(*keys, F.col(ident).alias("_x"), F.col("_at").alias("_i"), F.explode(F.expr("sequence(_at, _k - 1)")).alias("_j"))
    right = m.select(*keys, F.col(ident).alias("_y"), F.explode(F.expr("sequence(0, _at)")).alias("_i"), F.col("_at").alias("_j"))
    both = left.join(right, [*keys, "_i", "_j"]).where("_i < _j or _x < _y")
    return both.select(*keys, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))


def expand(pairs: DataFrame, side: str, members: DataFrame, key: str, ident: str, into: str) -> DataFrame:
    """Replace the class in column ``side`` of ``pairs`` by each of its members (column ``into``). Large classes are
    spread over blocks, so a hot class is no single task."""
    sizes = members.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_k"))
    p = pairs.join(sizes.withColumnRenamed(key, side), side).withColumn("_at", F.explode(F.expr("sequence(0, _k - 1)"))).drop("_k")
    m = members.select(F.col(key).alias(side), F.col(ident).alias(into)).join(sizes.withColumnRenamed(key, side), side)
    m = m.select(side, into, F.pmod(F.xxhash64(into), F.col("_k")).cast("int").alias("_at"))
    return p.join(m, [side, "_at"]).drop(side, "_at")
