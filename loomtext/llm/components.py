"""Connected components by union-find that never leaves the cluster: each partition joins its own links with
union-find first, then rounds of large-star and small-star (Kiveris et al. 2014) join what is left."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.plans.shared import discard, materialize

#: Links a partition holds at once in its union-find; more are joined in several forests, which later rounds merge.
FOREST = 1_000_000


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (p := root.get(top, top)) != top:
            top = p
        while (p := root.get(x, x)) != top:
            root[x] = top
            x = p
        return top

    def out() -> pa.RecordBatch:
        held = [(x, r) for x in root if (r := find(x)) != x]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.int64()), pa.array([r for _, r in held], pa.int64())], ["u", "v"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
                root.setdefault(min(x, y), min(x, y))
        if len(root) > FOREST:
            yield out()
    yield out()


def _toward_least(links: DataFrame, only_smaller: bool) -> DataFrame:
    """One star: every neighbour (all larger ones, or all smaller ones and the node itself) points to the least."""
    both = links.select("u", "v") if only_smaller else links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.join(least, "u")
    if only_smaller:
        return near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(near.select("u", F.col("m").alias("v"))).where("u > v").distinct()
    return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) of every id that has a link to another; component is the least id. Links of an id with itself
    or with null count for nothing. The driver only sees counts."""
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = materialize(edges.mapInArrow(_local_forest, "u long, v long"), "links")
    while True:
        after = materialize(_toward_least(_toward_least(edges, False), True), "links")
        # a star forest: every node points to a root that points nowhere, once
        loose = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        many = after.groupBy("u").count().where("count > 1").limit(1).count()
        discard(edges)
        edges = after
        if not loose and not many:
            break
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionAll(edges.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component")))


def linked_rows(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, class_id, n_links, group_id) of every (id, rep) of ``members``: its class, the number of other classes that
    ``pairs`` (a, b of classes, each pair once) links it to, and the least class that links lead to."""
    ends = pairs.select(F.col("a").alias("rep")).unionAll(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    comp = components(pairs, "a", "b").select(F.col("id").alias("rep"), "component")
    out = members.join(ends.hint("shuffle_hash"), "rep", "left").join(comp.hint("shuffle_hash"), "rep", "left")
    return out.select("id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("group_id"))
