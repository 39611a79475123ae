"""Documents as weighted sums of their words' vectors.

A vocabulary within ``VOCABULARY_BYTES`` (counted) goes along with the tasks, and a method is one pass over the documents
in Arrow batches without a shuffle: words are looked up once per distinct word of a batch, and the weighted vectors are
added up by document. Beyond that bound tokens are joined with the vocabulary by a shuffle, and added up element by
element as columns with partial sums before the next; adaptive execution splits the frequent words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.vector import dot, l2_normalize, matrix, packed, sums
from loomtext.operators.counts import inverse_document_frequency, term_document_frequency

VOCABULARY_BYTES = 128 << 20
#: Tokens, and rows of vectors, that a task works on at once; a longer document is worked on alone.
TOKENS, ROWS = 1 << 20, 1 << 13


@dataclass(frozen=True)
class Vocabulary:
    """What all methods share, in the order of the words: vectors, weights n, idf (0 where it isn't known)."""

    words: pa.Array
    vectors: np.ndarray
    n: np.ndarray
    idf: np.ndarray


def hold(vocab: DataFrame | Vocabulary, dim: int) -> Vocabulary | None:
    """The vocabulary as it goes along with tasks, or None if it is too large for that."""
    if isinstance(vocab, Vocabulary):
        return vocab
    most = VOCABULARY_BYTES // (dim * 8 + 64)
    if vocab.limit(most + 1).count() > most:
        return None
    t = vocab.select("word", F.col("vec").cast("array<double>").alias("vec"), F.col("n").cast("double").alias("n"), F.coalesce("idf", F.lit(0.0)).alias("idf")).where("word is not null and vec is not null").toArrow().combine_chunks()
    column = lambda name: t.column(name).chunk(0) if t.num_rows else t.column(name).combine_chunks()
    return Vocabulary(column("word"), matrix(column("vec"), dim), column("n").to_numpy(zero_copy_only=False), column("idf").to_numpy(zero_copy_only=False))


def downsample_weights(embedding: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """``embedding`` (word, vec) with n = product over the weighted words i of min(1, exp(-alpha_i * v . v_i)). Weighted words
    without a vector are left out; no weights give 1. The weighted words are few: they are named one by one."""
    if not weights:
        return embedding.withColumn("n", F.lit(1.0))
    named = embedding.where(F.col("word").isin(*weights)).collect()
    total = F.lit(0.0)
    for row in named:
        total = total + F.least(F.lit(0.0), -F.lit(float(weights[row.word])) * dot(F.col("vec"), F.array(*[F.lit(float(x)) for x in row.vec])))
    return embedding.withColumn("n", F.exp(total))


def scoring_vocabulary(embedding: DataFrame, tdf: DataFrame | None, n: int, weights: dict[str, float] | None = None) -> DataFrame:
    """(word, vec, n, idf): what all methods share; words that the counts lack have an idf of 0."""
    vocab = downsample_weights(embedding, weights)
    if tdf is None:
        return vocab.withColumn("idf", F.lit(None).cast("double"))
    return vocab.join(inverse_document_frequency(tdf, n).select("word", "idf"), "word", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``TOKENS`` tokens, a document at least."""
    ends = batch.column(1).offsets.to_numpy()[1:] - batch.column(1).offsets[0].as_py()
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + TOKENS, "right")))
        yield batch.slice(at, end - at)
        at = end


def _found(docs: pa.RecordBatch, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the document, of the word in the vocabulary, occurrences), by document; words without a vector left out."""
    owner, flat = pc.list_parent_indices(docs.column(1)).to_numpy(), pc.list_flatten(docs.column(1))
    coded = flat.dictionary_encode()
    place = pc.fill_null(pc.index_in(coded.dictionary, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    place = place[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
    known = place >= 0
    size = max(1, len(words))
    key, times = np.unique(owner[known].astype(np.int64) * size + place[known], return_counts=True)
    return key // size, key % size, times


def _added(docs: int, owner: np.ndarray, place: np.ndarray, coef: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((docs, vectors.shape[1]))
    for a in range(0, len(owner), ROWS):
        o = owner[a : a + ROWS]
        first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        out[o[first]] += np.add.reduceat(coef[a : a + ROWS, None] * vectors[place[a : a + ROWS]], first)
    return out


def _unit(rows: np.ndarray) -> pa.Array:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    rows = np.where(length > 0, rows / np.where(length > 0, length, 1), rows)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _scored(v: Vocabulary, distinct: bool, idf: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = v.n * v.idf if idf else v.n
        for whole in batches:
            for b in _parts(whole):
                owner, place, times = _found(b, v.words)
                coef = weight[place] if distinct else weight[place] * times
                yield pa.RecordBatch.from_arrays([b.column(0), _unit(_added(b.num_rows, owner, place, coef, v.vectors))], ["_ref", "vec"])

    return run


def _documents(docs: DataFrame) -> tuple[DataFrame, str]:
    kind = docs.schema["_ref"].dataType.simpleString()
    return docs.select("_ref", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")), f"_ref {kind}, vec array<double>"


def _weighted(docs: DataFrame, vocab: DataFrame | Vocabulary, dim: int, distinct: bool, idf: bool) -> DataFrame:
    held = hold(vocab, dim)
    if held is not None:
        given, schema = _documents(docs)
        return given.mapInArrow(_scored(held, distinct, idf), schema)
    words = F.array_distinct("tokens") if distinct else F.col("tokens")
    coef = F.col("n") * F.col("idf") if idf else F.col("n")
    rows = docs.select("_ref", F.explode_outer(words).alias("word")).join(vocab, "word", "left")
    added = rows.groupBy("_ref").agg(*sums(coef, F.col("vec"), dim))
    return added.select("_ref", l2_normalize(packed(dim)).alias("vec"))


def score_simple(docs: DataFrame, vocab: DataFrame | Vocabulary, dim: int) -> DataFrame:
    """(_ref, vec) = sum of c n v at length one, c the occurrences. Documents without known words have zeros. ``_ref`` is
    unique, as import makes it."""
    return _weighted(docs, vocab, dim, False, False)


def score_unique(docs: DataFrame, vocab: DataFrame | Vocabulary, dim: int) -> DataFrame:
    """Sum of n v over distinct words."""
    return _weighted(docs, vocab, dim, True, False)


def score_simple_idf(docs: DataFrame, vocab: DataFrame | Vocabulary, dim: int) -> DataFrame:
    """Sum of idf c n v."""
    return _weighted(docs, vocab, dim, False, True)


def score_unique_idf(docs: DataFrame, vocab: DataFrame | Vocabulary, dim: int) -> DataFrame:
    """Sum of idf n v over distinct words."""
    return _weighted(docs, vocab, dim, True, True)


def _deflated(m: np.ndarray) -> np.ndarray:
    """Sum of the rows without their leading direction, at length one."""
    if len(m) > 1:
        if len(m) < m.shape[1]:  # the smaller of the two Gram matrices has the same leading direction
            top = m.T @ np.linalg.eigh(m @ m.T)[1][:, -1]
            top /= max(np.linalg.norm(top), 1e-300)
        else:
            top = np.linalg.eigh(m.T @ m)[1][:, -1]
        v = m.sum(axis=0)
        scale = np.linalg.norm(v)
        v = v - (v @ top) * top
    else:
        v, scale = m.sum(axis=0), 0.0
    length = np.linalg.norm(v)
    return v / length if length > max(1e-12, 1e-12 * scale) else v * 0


def _without_common(v: Vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = v.vectors * (v.n * v.idf)[:, None]
        for whole in batches:
            for b in _parts(whole):
                owner, place, _ = _found(b, v.words)
                edges = np.searchsorted(owner, np.arange(b.num_rows + 1))
                out = np.zeros((b.num_rows, rows.shape[1]))
                for i in np.flatnonzero(np.diff(edges)):
                    out[i] = _deflated(rows[place[edges[i] : edges[i + 1]]])
                yield pa.RecordBatch.from_arrays([b.column(0), _unit(out)], ["_ref", "vec"])

    return run


def _sorted_without_common(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same over rows of vectors sorted by document; a task holds those of a batch and of one document more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs, rows = [], np.zeros((0, dim))
        for last, b in _with_last(batches):
            refs += b.column(0).to_pylist()
            rows = np.concatenate([rows, matrix(b.column(1), dim)])
            starts = [0] + [i for i in range(1, len(refs)) if refs[i] != refs[i - 1]] if refs else []
            done = starts if last else starts[:-1]
            ends = [*starts[1:], len(refs)]
            vecs = [_deflated(rows[a:e]).tolist() for a, e in zip(done, ends, strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([refs[a] for a in done], b.column(0).type), pa.array(vecs, pa.list_(pa.float64()))], ["_ref", "vec"])
            at = len(refs) if last or not starts else starts[-1]
            refs, rows = refs[at:], rows[at:]

    return run


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    held = None
    for b in batches:
        if held is not None:
            yield False, held
        held = b
    if held is not None:
        yield True, held


def score_idf_common_component_removal(docs: DataFrame, vocab: DataFrame | Vocabulary, dim: int) -> DataFrame:
    """As unique_idf, after the leading direction of the document's word rows is taken out of them."""
    held = hold(vocab, dim)
    given, schema = _documents(docs)
    if held is not None:
        return given.mapInArrow(_without_common(held), schema)
    rows = docs.select("_ref", F.explode(F.array_distinct("tokens")).alias("word")).join(vocab, "word")
    rows = rows.select("_ref", F.transform("vec", lambda x: x * F.col("n") * F.col("idf")).alias("row"))
    done = rows.repartition("_ref").sortWithinPartitions("_ref").mapInArrow(_sorted_without_common(dim), schema)
    zero = F.array_repeat(F.lit(0.0), dim)
    return docs.select("_ref").join(done, "_ref", "left").select("_ref", F.coalesce("vec", zero).alias("vec"))


METHODS: dict[str, Callable[[DataFrame, DataFrame | Vocabulary, int], DataFrame]] = {
    "simple": score_simple, "unique": score_unique, "simple_IDF": score_simple_idf, "unique_IDF": score_unique_idf,
    "IDF_common_component_removal": score_idf_common_component_removal,
}


def score(docs: DataFrame, embedding: DataFrame, dim: int, methods: tuple[str, ...] = ("unique_IDF",), weights: dict[str, float] | None = None) -> DataFrame:
    """(method, _ref, vec) of all named methods. ``docs`` is (_ref, tokens); counts and vocabulary are made once."""
    unknown = [m for m in methods if m not in METHODS]
    if unknown or not methods:
        raise ValueError(f"unknown methods {unknown}; there are {sorted(METHODS)}")
    vocab = scoring_vocabulary(embedding, term_document_frequency(docs), docs.count(), weights)
    given = hold(vocab, dim) or vocab
    parts = [METHODS[m](docs, given, dim).select(F.lit(m).alias("method"), "_ref", "vec") for m in methods]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
