"""Evaluation passages that stand in training texts (problem 9).

A document leaks an item if its words hold ``RUN`` consecutive words of the item. Method: MinHash containment search, then
exact containment of the shingle of ``RUN`` words.

The queries are the passages of ``RUN`` words of the items, as sets of five-word shingles (``RUN`` - 4 each). The domains
are windows of the documents. A containment search over domains of several sizes has a partition for each size, as the
Jaccard similarity that a contained query has with a domain of u shingles falls as (RUN - 4) / u and the number of hash
functions must grow against it. Here all queries are of one size, so the windows are cut to that size: a contained passage
is its window, their similarity is 1, and one hash function meets it for certain. It is also the cheapest size: windows
that follow each other mostly share their minimum, so a text has about 0.22 keys a word, where windows of 20
shingles need 14 functions and a key a word to miss one passage in a thousand.

1. The passages of all items become a table of (key, run, item): the minimum of the shingles' hashes, the hash of the run.
2. One scan of the documents, whatever the number of items: the windows' keys are held against those of the items. Where
   the items have at most ``KEYS`` distinct ones (counted), these go along with the tasks; beyond that, keys and items' keys
   are joined by a shuffle.
3. The windows that met are joined with the passages on the exact runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.words import mix, slices, word_hashes
from loomtext.plans.shared import materialize, small

RUN, SHINGLE = 12, 5
#: Distinct keys of items that go along with the tasks, at most (8 bytes each); passages that are broadcast, at most.
KEYS, PASSAGES = 1_000_000, 500_000
_Batches = Iterator[pa.RecordBatch]


def _runs(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words (those that cross the end of a text must be left out by the caller)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, length):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += words[i : i + n]
    return mix(out)


def _least(values: np.ndarray, length: int) -> np.ndarray:
    """Minimum of every ``length`` consecutive values, none if there are fewer; widths are doubled, and the last two overlap."""
    if len(values) < length:
        return values[:0]
    out, width = values, 1
    while width < length:
        step = min(width, length - width)
        out = np.minimum(out[: len(out) - step], out[step:])
        width += step
    return out


def _windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the text, key, hash of the run) of every run of ``RUN`` words."""
    hashes, offsets = word_hashes(texts)
    each = np.maximum(np.diff(offsets) - RUN + 1, 0)
    owner = np.repeat(np.arange(len(texts)), each)
    start = offsets[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    if not len(start):
        return owner, np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = mix(_least(_runs(hashes, SHINGLE), RUN - SHINGLE + 1))
    return owner, keys[start].view(np.int64), _runs(hashes, RUN)[start].view(np.int64)


def _passages(batches: _Batches) -> _Batches:
    for whole in batches:
        for b in slices(whole, 1, 2 << 20):
            owner, key, run = _windows(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(run), b.column(0).take(pa.array(owner))], ["key", "run", "item"])


def _met(keys: np.ndarray) -> Callable[[_Batches], _Batches]:
    """(id, run) of the windows whose key is one of ``keys`` (sorted)."""

    def run(batches: _Batches) -> _Batches:
        some = np.zeros(1 << 24, bool)
        some[keys.view(np.uint64) >> np.uint64(40)] = True
        for whole in batches:
            for b in slices(whole, 1, 2 << 20):
                owner, key, runs = _windows(b.column(1).to_pylist())
                at = np.flatnonzero(some[key.view(np.uint64) >> np.uint64(40)])
                place = np.searchsorted(keys, key[at])
                at = at[keys[np.minimum(place, len(keys) - 1)] == key[at]] if len(keys) else at[:0]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner[at])), pa.array(runs[at])], ["id", "run"])

    return run


def _stretches(batches: _Batches) -> _Batches:
    """(id, key, runs): a row for each stretch of windows of the same key."""
    for whole in batches:
        for b in slices(whole, 1, 2 << 20):
            owner, key, runs = _windows(b.column(1).to_pylist())
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(first)
            ends = np.append(at[1:], len(key)) if len(at) else at
            held = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], ends * 8]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(runs))])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner[at])), pa.array(key[at]), held], ["id", "key", "runs"])


def _unpacked(batches: _Batches) -> _Batches:
    for b in batches:
        runs = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
        owner = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(np.concatenate([np.zeros(0, np.int64), *runs]))], ["id", "run"])


def leaked_items(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, runs): documents whose words hold at least 12 consecutive words of an item, with the number of such
    runs found. Null and short texts on either side leak nothing; a text that comes under several ids counts for each;
    an id that comes in several rows has its runs added."""
    corpus = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    asked = items.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    passages = materialize(asked.mapInArrow(_passages, "key long, run long, item long"), "passages")
    keys = passages.select("key").distinct()
    if keys.limit(KEYS + 1).count() <= KEYS:
        met = corpus.mapInArrow(_met(np.sort(keys.toArrow().column("key").to_numpy())), "id long, run long")
    else:
        met = corpus.mapInArrow(_stretches, "id long, key long, runs binary").join(keys.hint("shuffle_hash"), "key", "left_semi").select("id", "runs").mapInArrow(_unpacked, "id long, run long")
    return met.join(small(passages.select("run", "item"), PASSAGES), "run").groupBy("id", "item").agg(F.count(F.lit(1)).alias("runs"))
