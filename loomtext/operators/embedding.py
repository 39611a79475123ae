"""Word embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.vector import l2_normalize
from loomtext.functions.word2vec import FIRST_RATE, LAST_RATE, Plan, huffman, train
from loomtext.operators.counts import document_tokens, term_frequency, vocabulary
from loomtext.plans.shared import discard, materialize, shuffles_dropped

#: Bytes of a model, which is held by the driver and every task, at most.
MODEL_BYTES = 1 << 30
#: Rows of a model that are averaged together, tokens that are trained between two looks at the rate.
ROWS, GROUP = 256, 10_000
#: Bytes of averaged changes that the driver takes at once, at most.
AT_ONCE = 128 << 20


def _encoded(words: pa.Array) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = pc.index_in(pc.list_flatten(b.column(1)), value_set=words)
            owner = pc.list_parent_indices(b.column(1)).to_numpy()
            known = place.is_valid().to_numpy(zero_copy_only=False)
            ids, at = pc.drop_null(place).to_numpy().astype(np.int32), np.searchsorted(owner[known], np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ids[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["_ref", "ids"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of texts one after another, and the sizes of these texts: ``GROUP`` words and the rest of the last text."""
    flat, sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        held = b.column(1).to_pylist()
        flat = np.concatenate([flat, np.frombuffer(b"".join(held), np.int32)])
        sizes = np.concatenate([sizes, np.array([len(x) // 4 for x in held], np.int64)])
        ends = np.cumsum(sizes)
        start = first = 0
        while (last := int(np.searchsorted(ends, start + GROUP))) < len(ends):
            yield flat[start : ends[last]], sizes[first : last + 1]
            start, first = int(ends[last]), last + 1
        flat, sizes = flat[start:], sizes[first:]
    if len(sizes):
        yield flat, sizes


def _trained(model: Broadcast, plan: Broadcast, rates: tuple[float, float], total: int, seed: int, epoch: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a partition's texts change in the model, in blocks of rows: (kind, block, rows changed, their changes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        part = int(first.column(0)[0].as_py()) if first.num_rows else 0
        mine = [x.copy() for x in model.value]
        train(_groups(chain([first], batches)), *mine, plan.value, rates, total, np.random.default_rng((seed, epoch, part)))
        for kind, (new, old) in enumerate(zip(mine, model.value, strict=True)):
            for a in range(0, len(new), ROWS):
                change = new[a : a + ROWS] - old[a : a + ROWS]
                touched = np.flatnonzero((change != 0).any(axis=1))
                if len(touched):
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([a // ROWS], pa.int32()), pa.array([touched.astype(np.int32).tobytes()], pa.binary()), pa.array([change[touched].tobytes()], pa.binary())], ["kind", "block", "rows", "change"])

    return run


def _averaged(size: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        total, times = np.zeros((ROWS, size), np.float64), np.zeros(ROWS, np.int64)
        for r, c in zip(t.column("rows").to_pylist(), t.column("change").to_pylist(), strict=True):
            at = np.frombuffer(r, np.int32)
            total[at] += np.frombuffer(c, np.float32).reshape(len(at), size)
            times[at] += 1
        at = np.flatnonzero(times)
        mean = (total[at] / times[at, None]).astype(np.float32)
        return pa.table({"kind": t.column("kind")[:1], "block": t.column("block")[:1], "rows": pa.array([at.astype(np.int32).tobytes()], pa.binary()), "change": pa.array([mean.tobytes()], pa.binary())})

    return run


def _taken(mean: DataFrame, size: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """The averaged blocks, at once or, of a large model, written by all tasks together and then read one part after another."""
    if size <= AT_ONCE:
        for b in mean.toArrow().to_batches():
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)
        return
    held = materialize(mean, "changes")
    yield from held.toLocalIterator()
    discard(held)


def _fit(docs: DataFrame, size: int, window: int, min_count: int, epochs: int, skip_gram: bool, tree: bool, negative: int, sample: float, seed: int, partitions: int) -> DataFrame:
    """In every epoch each partition trains a copy of the model on its texts, and the changes of a row are averaged over the
    partitions that touched it, in the cluster."""
    spark = docs.sparkSession
    known = vocabulary(term_frequency(docs), min_count).orderBy(F.desc("count"), "word").toArrow()
    words, counts = known.column("word").combine_chunks(), known.column("count").to_numpy().astype(np.float64)
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    if len(words) * size * 8 > MODEL_BYTES:
        raise ValueError(f"a model of {len(words)} words of {size} numbers is larger than {MODEL_BYTES} bytes; raise min_count")
    if not len(words):
        return spark.createDataFrame([], "word string, vec array<double>")
    rng = np.random.default_rng(seed)
    inner = ((rng.random((len(words), size)) - 0.5) / size).astype(np.float32)
    outer = np.zeros((max(1, len(words) - 1) if tree else len(words), size), np.float32)
    plan = Plan(counts, huffman(counts) if tree else None, negative, window, skip_gram, sample)
    spread = docs.repartition(partitions, "_ref") if partitions > 1 else docs.coalesce(1)
    texts = materialize(spread.sortWithinPartitions("_ref").mapInArrow(_encoded(words), f"_ref {docs.schema['_ref'].dataType.simpleString()}, ids binary").select(F.spark_partition_id().alias("part"), "ids"), "texts")
    total = int(counts.sum() / partitions)
    shared_plan = spark.sparkContext.broadcast(plan)
    for epoch in range(epochs):
        rates = tuple(FIRST_RATE + (LAST_RATE - FIRST_RATE) * (epoch + x) / epochs for x in (0, 1))
        model = spark.sparkContext.broadcast((inner, outer))
        changed = texts.mapInArrow(_trained(model, shared_plan, rates, total, seed, epoch), "kind int, block int, rows binary, change binary")
        mean = changed.groupBy("kind", "block").applyInArrow(_averaged(size), "kind int, block int, rows binary, change binary")
        for kind, block, at, change in _taken(mean, inner.nbytes + outer.nbytes):
            at = np.frombuffer(at, np.int32) + block * ROWS
            (inner, outer)[kind][at] += np.frombuffer(change, np.float32).reshape(len(at), size)
        model.destroy()
    shared_plan.destroy()
    discard(texts)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * size), pa.array(inner.astype(np.float64).ravel()))
    return spark.createDataFrame(pa.table({"word": words, "vec": flat})).select("word", l2_normalize(F.col("vec")).alias("vec"))


def fit_embedding(
    df: DataFrame, ident: str, text: str = "text", size: int = 300, window: int = 5, min_count: int = 10, epochs: int = 30, skip_gram: int = 0,
    hierarchical_softmax: int = 1, negative: int = 0, sample: float = 1e-5, seed: int = 0, partitions: int = 1, longest: int = 100_000,
) -> DataFrame:
    """(word, vec) at length one, of the words that stand ``min_count`` times or more. ``skip_gram`` 0 is the continuous bag of
    words; the output is a tree (hierarchical softmax) or ``negative`` samples. ``sample`` > 0 thins out frequent words.
    Skip-gram with a tree and without thinning is Spark's own; the others are trained here (see ``_fit``). One
    partition gives the same vectors for the same seed; more train in parallel. ``ident`` must be unique. Null and blank
    texts teach nothing; without words there is an empty table."""
    if skip_gram not in (0, 1) or hierarchical_softmax not in (0, 1):
        raise ValueError("skip_gram and hierarchical_softmax are 0 or 1")
    if hierarchical_softmax and negative > 0:
        raise ValueError("hierarchical softmax takes no negative samples")
    if not hierarchical_softmax and negative <= 0:
        raise ValueError("without hierarchical softmax there must be negative samples")
    docs = document_tokens(df, ident, text)
    if not skip_gram or not hierarchical_softmax or sample > 0:
        with shuffles_dropped(df.sparkSession):
            return _fit(docs, size, window, min_count, epochs, bool(skip_gram), bool(hierarchical_softmax), negative, sample, seed, partitions)
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed, numPartitions=partitions, maxSentenceLength=longest, inputCol="tokens", outputCol="_").fit(docs)
    return model.getVectors().select("word", l2_normalize(vector_to_array("vector")).alias("vec"))
