"""Counts of terms over a collection (problem 4) and how distinctive a term is of a record (problem 3).

A term is a piece of a record's text between white space, as written. A record is an id; of several rows with the same
id the one parsed last counts (ties: the greatest text), so a record parsed twice counts once. Null ids are no records;
null and blank texts have no terms and don't count as records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.words import slices
from loomtext.plans.shared import materialize

#: A word that more than 1 of so many records hold is joined by broadcast: there are at most this many times the mean
#: number of distinct terms per record of them, whatever the size of the collection.
HOT = 1000
#: Checked bound of that broadcast; beyond it all words go through the shuffled join.
HOT_ROWS = 500_000


#: Ids that come in several rows and are broadcast to tell these rows from the others, at most.
REPEATED = 1_000_000


def records(df: DataFrame, ident: str, text: str, at: str | None) -> DataFrame:
    """(id, text), one row per record. Only the rows of ids that come again are brought together; where those are too many
    to be broadcast (counted), all rows are."""
    d = df.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"), (F.col(at) if at else F.lit(0)).alias("at")).where("id is not null")
    last = lambda rows: rows.groupBy("id").agg(F.max(F.struct("at", "text")).alias("last")).select("id", "last.text")
    again = materialize(d.groupBy("id").count().where("count > 1").select("id"), "repeated")
    if again.limit(REPEATED + 1).count() > REPEATED:
        return last(d)
    again = F.broadcast(again)
    return d.join(again, "id", "left_anti").select("id", "text").unionAll(last(d.join(again, "id", "left_semi")))


def counted(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Record ids, the batch's distinct words, and for every pair of record and word: place of the record, of the
    word, and how often it stands there; ordered by record."""
    lists = pc.utf8_split_whitespace(pc.fill_null(batch.column(1), ""))
    owner, flat = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
    full = pc.not_equal(flat, "")
    owner, flat = owner[full.to_numpy(zero_copy_only=False)], flat.filter(full)
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    words = coded.dictionary
    key = owner.astype(np.int64) * max(1, len(words)) + coded.indices.to_numpy()
    key, times = np.unique(key, return_counts=True)
    return batch.column(0).to_numpy(zero_copy_only=False), words, key // max(1, len(words)), key % max(1, len(words)), times


def _score_rows(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["word", "id", "c", "length", "recs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                ids, words, rec, word, times = counted(batch)
                if not len(times):
                    continue
                occ = np.bincount(word, times, len(words)).astype(np.int64)
                recs = np.bincount(word, minlength=len(words))
                length = np.bincount(rec, times, len(ids)).astype(np.int64)
                nulls = lambda n: pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([words, nulls(len(words)), pa.array(occ), nulls(len(words)), pa.array(recs)], names)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), nulls(1), pa.array([int(times.sum())]), nulls(1), pa.array([int((length > 0).sum())])], names)
                keep = times >= least
                if keep.any():
                    rec, word, times = rec[keep], word[keep], times[keep]
                    yield pa.RecordBatch.from_arrays([words.take(pa.array(word)), pa.array(ids[rec]), pa.array(times.astype(np.int64)), pa.array(length[rec]), nulls(len(rec))], names)

    return run


def log_likelihood_ratio(c: Column, length: Column, occ: Column, total: Column) -> Column:
    """G squared of the two-by-two table: the term in the record (c of length) against in the remaining collection
    (occ - c of total - length). Negative when the term is rarer in the record than elsewhere."""
    c, length, occ, total = (x.cast("double") for x in (c, length, occ, total))

    def part(seen: Column, row: Column, column: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * total / (row * column))).otherwise(F.lit(0.0))

    rest, other = total - length, total - occ
    g = 2 * (part(c, length, occ) + part(occ - c, rest, occ) + part(length - c, length, other) + part(rest - (occ - c), rest, other))
    return F.when(c * total < occ * length, -g).otherwise(g)


def distinctive_terms(df: DataFrame, ident: str = "_ref", text: str = "text", at: str | None = "parsed_at", least: int = 1) -> DataFrame:
    """One row for each record and term that stands at least ``least`` times in it: (id, word, c, length: terms of the
    record, occ: of the term in the collection, d: records that hold it, n_records, score: the signed log-likelihood
    ratio, weight: c * ln(N / (d + 1))). Counts cover the whole collection whatever ``least`` is. Empty input gives
    no rows."""
    rows = materialize(records(df, ident, text, at).mapInArrow(_score_rows(least), "word string, id long, c long, length long, recs long"), "terms")
    total, n = rows.where("word is null").agg(F.sum("c"), F.sum("recs")).first()
    total, n = total or 0, n or 0
    stats = materialize(rows.where("id is null and word is not null").groupBy("word").agg(F.sum("c").alias("occ"), F.sum("recs").alias("d")), "stats")
    found = rows.where("id is not null").select("word", "id", "c", "length")
    hot = stats.where(F.col("d") > n / HOT)
    if hot.limit(HOT_ROWS + 1).count() <= HOT_ROWS:
        near = found.join(F.broadcast(hot), "word", "left")
        cold = near.where("d is null").drop("occ", "d").join(stats.where(F.col("d") <= n / HOT), "word")
        joined = near.where("d is not null").unionByName(cold)
    else:
        joined = found.join(stats, "word")
    return joined.select(
        "id", "word", "c", "length", "occ", "d", F.lit(n).cast("long").alias("n_records"),
        log_likelihood_ratio(F.col("c"), F.col("length"), F.col("occ"), F.lit(total)).alias("score"),
        (F.col("c") * F.log(F.lit(float(n)) / (F.col("d") + 1))).alias("weight"),
    )


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of term and record of a batch, sorted; those of one term are packed in a row (refs: ascending int64)."""
    for whole in batches:
        for batch in slices(whole, 1):
            ids, words, rec, word, times = counted(batch)
            if not len(times):
                continue
            ref = ids[rec]
            order = np.lexsort((ref, word))
            word, ref, times = word[order], ref[order], times[order]
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            ends = np.append(start[1:], len(word))
            offsets = np.concatenate([[0], ends * 8]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ref))])
            yield pa.RecordBatch.from_arrays([words.take(pa.array(word[start])), pa.array(ref[start]), pa.array(np.add.reduceat(times, start).astype(np.int64)), packed], ["word", "first", "occ", "refs"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([len(np.unique(rec))]), pa.nulls(1, pa.binary())], ["word", "first", "occ", "refs"])


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of sorted postings: occurrences and distinct records of every run of a term."""
    for b in batches:
        if not b.num_rows:
            continue
        runs = pc.run_end_encode(b.column(0))
        ends = runs.run_ends.to_numpy()
        starts = np.concatenate([[0], ends[:-1]])
        refs = b.column(3)
        sizes = pc.binary_length(refs).to_numpy() // 8
        run = np.repeat(np.repeat(np.arange(len(ends)), ends - starts), sizes)
        ref = np.frombuffer(b"".join(refs.to_pylist()), np.int64)
        order = np.lexsort((ref, run))
        run, ref = run[order], ref[order]
        fresh = np.concatenate([[True], (run[1:] != run[:-1]) | (ref[1:] != ref[:-1])])
        recs = np.bincount(run[fresh], minlength=len(ends))
        yield pa.RecordBatch.from_arrays([runs.values, pa.array(np.add.reduceat(b.column(2).to_numpy(), starts)), pa.array(recs)], ["word", "occ", "recs"])


def term_frequencies(df: DataFrame, ident: str = "_ref", text: str = "text", at: str | None = "parsed_at") -> tuple[DataFrame, int]:
    """((word, occ: occurrences, recs: records that hold it) of every term, number of records with a term).

    Method: the pairs of term and record are range-partitioned by term and record, sorted externally within the ranges,
    and scanned for runs. Pairs are packed per term and batch before they move; a term held by a great part of all
    records spreads over as many ranges as its records need, and the parts of its runs are added at the end."""
    packed = materialize(records(df, ident, text, at).mapInArrow(_postings, "word string, first long, occ long, refs binary"), "postings")
    n = packed.where("word is null").agg(F.sum("occ")).first()[0] or 0
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = packed.where("word is not null").repartitionByRange(parts, "word", "first").sortWithinPartitions("word", "first")
    runs = ranged.mapInArrow(_scan_runs, "word string, occ long, recs long")
    return runs.groupBy("word").agg(F.sum("occ").alias("occ"), F.sum("recs").alias("recs")), n


def marked_terms(df: DataFrame, stored: DataFrame, rare: int = 3, common: float = 0.15) -> DataFrame:
    """Every term with its counts and ``marks``: ``rare`` if fewer than ``rare`` records hold it, ``common`` if more
    than the share ``common`` do, ``miscounted`` if the sum of ``count`` over the distinct rows of ``stored`` (0 if there
    is none; null counts add nothing) isn't the number of records that hold it. Terms of ``stored`` that no record
    holds are left out."""
    terms, n = term_frequencies(df)
    kept = stored.select("batch", "src_file", "word", "count").where("word is not null").repartition("word").distinct()
    kept = kept.groupBy("word").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("stored"))
    out = terms.join(kept, "word", "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    marks = F.array_compact(F.array(
        F.when(F.col("recs") < rare, F.lit("rare")),
        F.when(F.col("recs") > F.lit(common) * n, F.lit("common")),
        F.when(F.col("recs") != F.col("stored"), F.lit("miscounted")),
    ))
    return out.select("word", "occ", "recs", "stored", marks.alias("marks"))


