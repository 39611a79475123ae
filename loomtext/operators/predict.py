"""Prediction of a categorical field from document vectors, with cross-validated metrics."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.rank import global_rank
from loomtext.functions.trees import Tree, fit_tree, forest_shares
from loomtext.functions.vector import dot, matrix, sums
from loomtext.plans.shared import materialize, small

#: Rows of a class whose neighbours are sought in one block; larger classes are cut into blocks by hash.
BLOCK = 4096
#: Bytes of training vectors, and of a forest, that go along with the tasks, at most; trees that a task grows.
TRAIN_BYTES, FOREST_BYTES, TREES = 64 << 20, 256 << 20, 25


def class_balance(df: DataFrame, column: str) -> DataFrame:
    """(y, count, share) of every class that isn't null."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("y")).agg(F.count(F.lit(1)).alias("count"))
    whole = Window.partitionBy(F.lit(0))  # over a row per class
    return counts.select("y", "count", (F.col("count") / F.sum("count").over(whole)).alias("share"))


def majority_baseline(df: DataFrame, column: str) -> DataFrame:
    """(baseline): share of the most frequent class."""
    return class_balance(df, column).agg(F.max("share").alias("baseline"))


def label_encode(df: DataFrame, column: str, into: str = "y_truth") -> DataFrame:
    """Classes in order as 0 .. k-1; null rows are left out. The classes are few and ranked by themselves."""
    classes = df.select(F.col(column).alias("_y")).where("_y is not null").distinct()
    coded = materialize(classes.select("_y", (F.row_number().over(Window.orderBy("_y")) - 1).alias(into)), "classes")
    return df.join(small(coded), F.col(column) == F.col("_y")).drop("_y")


def stratified_folds(df: DataFrame, y: str = "y_truth", folds: int = 10, ident: str = "_ref") -> DataFrame:
    """``df`` with ``fold``: the records of each class, by id, in ``folds`` stretches of nearly equal length, the first
    ones a record longer; without shuffling."""
    ranked = global_rank(df, [ident], [y], "_rank")
    sizes = materialize(ranked.groupBy(y).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    d = ranked.join(small(sizes), y)
    size, longer = F.floor(F.col("_n") / folds), F.col("_n") % folds
    edge = longer * (size + 1)
    fold = F.when(F.col("_rank") < edge, F.floor(F.col("_rank") / (size + 1))).otherwise(longer + F.floor((F.col("_rank") - edge) / F.greatest(size, F.lit(1))))
    return d.withColumn("fold", fold.cast("int")).drop("_rank", "_n")


def centroid_predict(train: DataFrame, test: DataFrame, dim: int) -> DataFrame:
    """(_ref, y_pred): class of the nearest class mean (squared distance; ties: the least class). Of (_ref, vec, y_truth)."""
    means = train.groupBy("y_truth").agg(*[F.avg(F.get("vec", F.lit(i))).alias(f"_{i}") for i in range(dim)])
    c = [(r[0], [float(x) for x in r[1:]]) for r in means.orderBy("y_truth").collect()]  # a row per class
    score = [F.struct(F.round(F.lit(sum(x * x for x in v)) - 2 * dot(F.col("vec"), F.array(*[F.lit(x) for x in v])), 9).alias("d"), F.lit(y).alias("y")) for y, v in c]
    return test.select("_ref", F.array_min(F.array(*score))["y"].alias("y_pred"))


def _grown(x: np.ndarray, y: np.ndarray, classes: int, trees: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                forest = [fit_tree(x, y, classes, np.random.default_rng((seed, t))) for t in range(i * TREES, min(trees, (i + 1) * TREES))]
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pickle.dumps(forest)], pa.binary())], ["block", "forest"])

    return run


def _voted(forest: list[Tree], dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shares = forest_shares(forest, matrix(b.column(1), dim)).astype(np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(shares) + 1, dtype=np.int32) * shares.shape[1]), pa.array(shares.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shares.argmax(axis=1).astype(np.int32)), lists], ["_ref", "y_pred", "y_prob"])

    return run


def forest_predict(train: DataFrame, test: DataFrame, trees: int = 200, seed: int = 0) -> DataFrame:
    """(_ref, y_pred, y_prob: probability of each class from 0) of a forest on (_ref, vec, y_truth), classes 0 .. k - 1.
    Extremely randomised trees, grown side by side in tasks, while the training rows and the forest, by their counted
    size, are within ``TRAIN_BYTES`` and ``FOREST_BYTES``; beyond that a random forest that Spark grows on all rows."""
    size = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"), F.max("y_truth").alias("top")).first()
    dim, classes = size["dim"] or 1, (size["top"] or 0) + 1
    if size["n"] and (size["n"] * dim * 8 > TRAIN_BYTES or size["n"] * trees * (32 + 8 * classes) > FOREST_BYTES):
        fit = RandomForestClassifier(featuresCol="f", labelCol="y_truth", numTrees=trees, seed=seed)
        model = fit.fit(train.select("y_truth", array_to_vector("vec").alias("f")))
        found = model.transform(test.select("_ref", array_to_vector("vec").alias("f")))
        return found.select("_ref", F.col("prediction").cast("int").alias("y_pred"), vector_to_array("probability").alias("y_prob"))
    schema = f"_ref {test.schema['_ref'].dataType.simpleString()}, y_pred int, y_prob array<double>"
    if not size["n"]:
        return train.sparkSession.createDataFrame([], schema)
    held = train.select("y_truth", "vec").toArrow().combine_chunks()
    x, y = matrix(held.column("vec").chunk(0), dim), held.column("y_truth").to_numpy().astype(np.int64)
    blocks = -(-trees // TREES)
    grown = train.sparkSession.range(0, blocks, 1, blocks).mapInArrow(_grown(x, y, classes, trees, seed), "block long, forest binary").collect()
    forest = [t for r in sorted(grown, key=lambda r: r.block) for t in pickle.loads(r.forest)]  # noqa: S301 - made by the tasks above
    return test.select("_ref", "vec").mapInArrow(_voted(forest, dim), schema)


def _neighbours(k: int, dim: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        ids, query = t.column("_ref").to_numpy(), t.column("asks").to_numpy()
        x = matrix(t.column("vec").combine_chunks(), dim)
        x = x - x.mean(axis=0)  # distances stay, and cancel less in the products
        kept, asking = np.flatnonzero(~query), np.flatnonzero(query)
        square, stored = (x * x).sum(axis=1), x[kept]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(asking), 256):
            q = asking[at : at + 256]
            rough = square[q, None] + square[kept] - 2 * x[q] @ stored.T
            rough[ids[kept] == ids[q][:, None]] = np.inf
            few = min(k, len(kept))
            # those as near as the k-th by the products, but for their error, are measured exactly
            edge = np.partition(rough, few - 1, axis=1)[:, few - 1] if few else np.zeros(len(q))
            a, b = np.nonzero((rough <= edge[:, None] + 1e-9 * (1 + square[q, None] + square[kept])) & np.isfinite(rough))
            d = np.round(((stored[b] - x[q][a]) ** 2).sum(axis=1), 12)
            order = np.lexsort((ids[kept][b], d, a))
            a, b, d = a[order], b[order], d[order]
            first = np.searchsorted(a, np.arange(len(q)))
            best = np.arange(len(a)) - first[a] < k
            out.append((ids[q][a[best]], ids[kept][b[best]], d[best]))
        return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(("_ref", "near", "d"), zip(*out, strict=True), strict=True)})

    return run


def class_neighbours(df: DataFrame, dim: int, k: int = 5, y: str = "y_truth") -> DataFrame:
    """(_ref, rank, near): the k nearest records of the same class by squared distance (ties: the least id). Exact. A class
    is cut into blocks by its size; a record asks in every block of its class, and the answers are merged."""
    sizes = materialize(df.groupBy(y).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_k")), "sizes")
    d = df.select("_ref", y, "vec").join(small(sizes), y)
    held = d.select(y, F.pmod(F.xxhash64("_ref"), F.col("_k")).cast("int").alias("b"), F.lit(0).alias("c"), F.lit(False).alias("asks"), "_ref", "vec", "_k")
    held = held.withColumn("c", F.explode(F.expr("sequence(0, _k - 1)"))).drop("_k")
    asks = d.withColumn("b", F.explode(F.expr("sequence(0, _k - 1)"))).select(y, "b", F.pmod(F.xxhash64("_ref", F.lit(1)), F.col("_k")).cast("int").alias("c"), F.lit(True).alias("asks"), "_ref", "vec")
    found = held.unionAll(asks).groupBy(y, "b", "c").applyInArrow(_neighbours(k, dim), "_ref long, near long, d double")
    best = Window.partitionBy("_ref").orderBy("d", "near")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("_ref", "rank", "near")


def smote(train: DataFrame, dim: int, k: int = 5, seed: int = 0) -> DataFrame:
    """(_ref, vec, y_truth) of the training rows and of made-up ones that bring every class to the size of the largest
    (Chawla et al. 2002): x + u (neighbour - x), u and neighbour drawn by hash. Made-up rows have negative ids. A class
    of one record stays."""
    sizes = materialize(train.groupBy("y_truth").agg(F.count(F.lit(1)).alias("n")), "sizes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    lacking = train.join(small(sizes.where(F.col("n") < most).select("y_truth")), "y_truth", "left_semi")  # the largest class needs no neighbours
    near = class_neighbours(lacking, dim, k).groupBy("_ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "near"))), lambda x: x["near"]).alias("nears"))
    rows = lacking.join(small(sizes), "y_truth").join(near, "_ref")
    ranked = global_rank(rows, ["_ref"], ["y_truth"], "at")
    lack = F.lit(most) - F.col("n")
    times = F.floor(lack / F.col("n")) + F.when(F.col("at") < lack % F.col("n"), 1).otherwise(0)
    made = ranked.withColumn("times", times.cast("int")).where("times > 0").withColumn("copy", F.explode(F.expr("sequence(1, times)")))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_ref").cast("string"), F.col("copy").cast("string")))
    digits = lambda start: F.conv(F.substring(digest, start, 7), 16, 10).cast("long")
    made = made.withColumn("near", F.get("nears", (digits(1) % F.size("nears")).cast("int"))).withColumn("u", digits(9) / float(1 << 28))
    other = train.select(F.col("_ref").alias("near"), F.col("vec").alias("w"))
    ident = -1 - (F.col("_ref") * most + F.col("copy"))
    made = made.join(other, "near").select(ident.alias("_ref"), F.zip_with("vec", "w", lambda a, b: a + F.col("u") * (b - a)).alias("vec"), "y_truth")
    return train.select("_ref", "vec", "y_truth").unionAll(made)


def cross_validate(df: DataFrame, predictor: Callable[[DataFrame, DataFrame], DataFrame], folds: int = 10, oversample: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(_ref, fold, y_truth, y_pred, and what else the predictor gives): every row of (_ref, vec, y_truth) predicted once, by
    a model that hasn't seen its fold; only training rows are oversampled. A row without a prediction is an error."""
    held = materialize(stratified_folds(df.select("_ref", "vec", "y_truth"), folds=folds), "folds")
    parts = []
    for i in range(folds):
        train, test = held.where(F.col("fold") != i), held.where(F.col("fold") == i)
        parts.append(predictor(oversample(train) if oversample else train, test.select("_ref", "vec")))
    predicted = reduce(DataFrame.unionAll, parts)
    out = held.select("_ref", "fold", "y_truth").join(predicted, "_ref", "left")
    return out.withColumn("y_pred", F.when(F.col("y_pred").isNull(), F.raise_error(F.lit("a row was not predicted"))).otherwise(F.col("y_pred")))


def _nearest_mean(classes: list[int], means: dict[int, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(classes, np.int32)
        for b in batches:
            fold = b.column("fold").to_numpy()
            x, pred = matrix(b.column("vec"), next(iter(means.values())).shape[1]), np.zeros(b.num_rows, np.int32)
            for f in np.unique(fold):
                c, at = means[int(f)], np.flatnonzero(fold == f)
                pred[at] = names[np.nan_to_num(np.round((c * c).sum(axis=1) - 2 * x[at] @ c.T, 9), nan=np.inf).argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([b.column("_ref"), b.column("fold"), b.column("y_truth"), pa.array(pred)], ["_ref", "fold", "y_truth", "y_pred"])

    return run


def centroid_cross_validate(df: DataFrame, dim: int, folds: int = 10) -> DataFrame:
    """(_ref, fold, y_truth, y_pred) as of ``cross_validate`` with ``centroid_predict``. The sums of every fold and class
    are made once; a fold's class means are those of all rows without its own, and all rows are predicted in one pass."""
    held = materialize(stratified_folds(df.select("_ref", "vec", "y_truth"), folds=folds), "folds")
    added = held.groupBy("fold", "y_truth").agg(F.count(F.lit(1)).alias("n"), *sums(F.lit(1.0), F.col("vec"), dim)).collect()  # a row per fold and class
    classes = sorted({r.y_truth for r in added})
    n, total = np.zeros((folds, len(classes), 1)), np.zeros((folds, len(classes), dim))
    for r in added:
        at = r.fold, classes.index(r.y_truth)
        n[at], total[at] = r.n, r[3:]
    with np.errstate(invalid="ignore", divide="ignore"):
        means = (total.sum(axis=0) - total) / (n.sum(axis=0) - n)  # NaN where a class lies wholly in the fold
    kinds = {f.name: f.dataType.simpleString() for f in held.schema}
    rows = held.select("_ref", "fold", "y_truth", "vec")
    return rows.mapInArrow(_nearest_mean(classes, {f: means[f] for f in range(folds)}), f"_ref {kinds['_ref']}, fold int, y_truth {kinds['y_truth']}, y_pred int")


def fold_metrics(predicted: DataFrame, average: str = "binary") -> DataFrame:
    """(fold, accuracy, f1): F1 of class 1 (binary) or the mean of the classes' F1 (macro); a class that is neither there
    nor predicted counts 0."""
    if average not in ("binary", "macro"):
        raise ValueError("average is binary or macro")
    acc = predicted.groupBy("fold").agg(F.avg((F.col("y_truth") == F.col("y_pred")).cast("double")).alias("accuracy"))
    sides = predicted.select("fold", F.explode(F.array(F.struct(F.col("y_truth").alias("y"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("y_truth") == F.col("y_pred")).cast("int").alias("tp")), F.struct(F.col("y_pred").alias("y"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")))).alias("s"))
    per = sides.groupBy("fold", "s.y").agg(F.sum("s.tp").alias("tp"), F.sum("s.t").alias("t"), F.sum("s.p").alias("p"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("t") + F.col("p")), F.lit(0.0))
    per = per.where("y = 1") if average == "binary" else per
    scores = per.groupBy("fold").agg(F.avg(f1).alias("f1"))
    return acc.join(scores, "fold", "left").select("fold", "accuracy", F.coalesce("f1", F.lit(0.0)).alias("f1"))


def meta_features(vectors: Sequence[DataFrame]) -> DataFrame:
    """(_ref, vec): the vectors of all methods of each record, end to end; records that lack one are left out."""
    parts = [v.select("_ref", F.col("vec").alias(f"v{i}")) for i, v in enumerate(vectors)]
    joined = reduce(lambda a, b: a.join(b, "_ref"), parts)
    return joined.select("_ref", F.concat(*[F.col(f"v{i}") for i in range(len(parts))]).alias("vec"))


def prediction_table(predictions: dict[str, DataFrame], originals: DataFrame | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """(_ref, y_truth, a column per method, extra columns of the source): one row per record."""
    parts = [p.select("_ref", "y_truth", F.col("y_pred").alias(m)) for m, p in predictions.items()]
    out = reduce(lambda a, b: a.join(b.drop("y_truth"), "_ref"), parts)
    return out.join(originals.select("_ref", *extra), "_ref", "left") if originals is not None and extra else out


def disagreement(table: DataFrame, methods: Sequence[str]) -> DataFrame:
    """(b, a column per method a): how many records a has right and b wrong; where a = b, how many it has right."""
    right = {m: F.col(m).eqNullSafe(F.col("y_truth")) for m in methods}
    counts = table.agg(*[F.sum((right[a] if a == b else right[a] & ~right[b]).cast("long")).alias(f"{a}\x1f{b}") for a in methods for b in methods])
    rows = F.array(*[F.struct(F.lit(b).alias("b"), *[F.coalesce(F.col(f"`{a}\x1f{b}`"), F.lit(0)).alias(a) for a in methods]) for b in methods])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


