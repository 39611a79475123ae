"""Groups of records that are nearly the same (problem 2).

Similarity of two records: the words that their fields have in common, with multiplicity, divided by the number of words
of the longer one. Method: SuperMinHash over the multiset of words, banding, verification, union-find.

1. One pass makes for every record the number of words, a 128-bit hash of its multiset of words (which is the class of
   exact copies) and 256 parity bits; another makes the band keys. Copies fall together by their class before pairing.
2. Classes that share a band key are candidates. Lossless filters inside the JVM: lengths, then the parity bits, whose
   Hamming distance can't exceed the symmetric difference of the multisets.
3. The survivors are verified exactly on their words.
4. Pairs of classes go out expanded to records, or as groups with their number of links.

Bands: 64 of 7 slots. A pair of Jaccard similarity J (of multisets) is met with probability 1 - (1 - J^7)^64 nearly: 0.979
at 0.667, the least that a similarity of 0.8 allows (equal lengths, edits everywhere). The shape is a parameter: unlike
records of similarity j meet with about 64 j^7.

A band key that a great part of the records holds is told from a bounded sample and spread over ``SALTS`` tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.components import linked_rows
from loomtext.llm.pairs import expand, pairs_within
from loomtext.llm.superminhash import bands, multiset_elements, signatures
from loomtext.llm.words import mix, slices, word_hashes
from loomtext.plans.shared import materialize, small

BANDS, WIDTH = 64, 7
#: Slots of a signature, at most; bands share them where they need more.
SLOTS = 512
SIMILARITY, LEAST_WORDS = 0.8, 20
#: Most records that are broadcast to pick those to verify; beyond that the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Records of the sample that tells hot band keys, at most; classes that hold a hot key in it, at least; tasks for each.
SAMPLE, HOT, SALTS = 5_000, 64, 256
#: Records whose words a cell of the comparison holds on either side, on average; cells on a side, at least.
CELL, FEWEST_CELLS = 16_384, 4
#: A band row is a key and, in the low bits, the number of words; the greatest stands for itself and all above.
_BITS, _MOST = 15, (1 << 15) - 1
#: Records whose signatures are made at once.
STEP = 2000


def _texts(batch: pa.RecordBatch) -> list[str]:
    """The fields after the first, joined by a space; nulls are empty."""
    fields = [c.to_pylist() for c in batch.columns[1:]]
    return [" ".join(x for x in row if x) for row in zip(*fields, strict=True)]


def _elements(batch: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids of the records with enough words, offsets of their elements, the elements, their owners."""
    hashes, offsets = word_hashes(_texts(batch))
    counts = np.diff(offsets)
    keep = counts >= least
    hashes = hashes[np.repeat(keep, counts)]
    offsets = np.concatenate([[0], np.cumsum(counts[keep])]).astype(np.int64)
    elements, owner = multiset_elements(hashes, offsets)
    return batch.column(0).to_numpy(zero_copy_only=False)[keep], offsets, elements, owner


def _class_hash(elements: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(elements):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = np.add.reduceat(mix(elements), offsets[:-1])
    two = np.add.reduceat(mix(elements ^ np.uint64(0x5851F42D4C957F2D)), offsets[:-1])
    return mix(one).view(np.int64), mix(two).view(np.int64)


def _profile(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.num_columns - 1, rows=STEP * 2):
                ids, offsets, elements, owner = _elements(batch, least)
                c1, c2 = _class_hash(elements, offsets)
                odd = np.bincount(owner * 256 + (elements >> np.uint64(56)).astype(np.int64), minlength=256 * len(ids)) & 1
                parity = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(len(ids), 4)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, np.diff(offsets).astype(np.int32), c1, c2, *np.ascontiguousarray(parity.T))], ["id", "n", "c1", "c2", "p0", "p1", "p2", "p3"])

    return run


def _banded(least: int, count: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.num_columns - 1, rows=STEP):
                _, offsets, elements, owner = _elements(batch, least)
                c1, _ = _class_hash(elements, offsets)
                c1, first = np.unique(c1, return_index=True)  # copies within the batch fall together here
                n = np.diff(offsets)[first]
                keep = np.zeros(len(offsets) - 1, bool)
                keep[first] = True
                place = np.cumsum(keep) - 1
                mine = keep[owner]
                order = np.argsort(first)
                sig = signatures(elements[mine], place[owner[mine]], len(first), min(count * width, SLOTS))
                keys = bands(sig, count, width)
                who = c1[order]
                keys = keys << _BITS | np.minimum(n[order], _MOST).astype(np.int64)[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(who, count))], ["row", "c1"])

    return run


def _words_for(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.num_columns - 1):
                ids, offsets, elements, _ = _elements(batch, least)
                data = np.sort(elements) if len(ids) == 1 else elements
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["id", "e"])

    return run


def _overlaps(t: pa.Table) -> pa.Table:
    """Common elements of the pairs (a, b) of a cell, whose records are the rows with an id."""
    held = t.filter(t.column("id").is_valid())
    words = {i: np.frombuffer(e, np.uint64) for i, e in zip(held.column("id").to_pylist(), held.column("e").to_pylist(), strict=True)}
    pairs = t.filter(t.column("a").is_valid()).select(["a", "b"])
    common = [len(np.intersect1d(words[a], words[b], assume_unique=True)) for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True)]
    return pairs.append_column("common", pa.array(common, pa.int32()))


def _compared(pairs: DataFrame, words: DataFrame, records: int) -> DataFrame:
    """(a, b, common) of the pairs. They fall into cells by the hashes of both ends, and a record goes once into each cell
    that holds a pair of it, so that in a group of many alike records no record travels with every pair."""
    cells = max(FEWEST_CELLS, -(-records // CELL))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(cells)).cast("int")
    p = pairs.select(at("a").alias("x"), at("b").alias("y"), "a", "b")
    need = p.select("x", "y", F.col("a").alias("id")).unionAll(p.select("x", "y", F.col("b").alias("id"))).distinct()
    rows = p.unionByName(need.join(words, "id"), allowMissingColumns=True)
    return rows.groupBy("x", "y").applyInArrow(_overlaps, "a long, b long, common int")


def _needed(similarity: float) -> Column:
    """Least number of common words of two records, of na and nb words."""
    return F.ceil(F.greatest("na", "nb") * F.lit(similarity) - F.lit(1e-9))


def _hot(source: DataFrame, total: int, least: int, shape: tuple[int, int]) -> DataFrame:
    """The band keys that many of the sampled records hold; their number is bounded by the sample's size."""
    share = int(min(1.0, SAMPLE / max(1, total)) * (1 << 40))
    some = source.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 40)) < share).mapInArrow(_banded(least, *shape), "row long, c1 long")
    return some.select(_key("row"), "c1").distinct().groupBy("key").count().where(F.col("count") >= HOT).select("key")


def _key(row: str) -> Column:
    return F.shiftright(row, _BITS).alias("key")


def _meeting(hot: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, c1, n) of rows sorted by key whose key more than one class holds, each class once. Rows of ``hot`` keys, which
    other tasks hold too, are all kept."""

    def met(row: np.ndarray, c1: np.ndarray) -> pa.RecordBatch:
        key = row >> _BITS
        first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        size = np.diff(np.append(first, len(key)))
        some = np.repeat((size > 1) | np.isin(key[first], hot), size)
        row, c1, key = row[some], c1[some], key[some]
        order = np.lexsort((c1, key))
        row, c1, key = row[order], c1[order], key[order]
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (c1[1:] != c1[:-1])
        row, c1, key = row[once], c1[once], key[once]
        first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        size = np.diff(np.append(first, len(key)))
        some = np.repeat((size > 1) | np.isin(key[first], hot), size)
        return pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(c1[some]), pa.array((row[some] & _MOST).astype(np.int32))], ["key", "c1", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, c1 = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            row, c1 = np.concatenate([row, b.column(0).to_numpy()]), np.concatenate([c1, b.column(1).to_numpy()])
            if len(row):  # the last key may go on in the next batch
                cut = int(np.searchsorted(row, row[-1] >> _BITS << _BITS))
                if cut:
                    yield met(row[:cut], c1[:cut])
                    row, c1 = row[cut:], c1[cut:]
        if len(row):
            yield met(row, c1)

    return run


def _candidates(source: DataFrame, total: int, least: int, similarity: float, shape: tuple[int, int]) -> DataFrame:
    """Pairs (c1 < d1) of class hashes that share a band key and whose lengths allow the similarity."""
    rows = source.mapInArrow(_banded(least, *shape), "row long, c1 long")
    hot = sorted(r.key for r in _hot(source, total, least, shape).collect())
    at: list[Column] = [_key("row")]
    if hot:
        keys = F.broadcast(source.sparkSession.createDataFrame([(k,) for k in hot], "key long"))
        rows = rows.join(keys.withColumn("hot", F.lit(True)), _key("row") == F.col("key"), "left")
        at.append(F.when(F.col("hot"), F.pmod("c1", F.lit(SALTS))))
    met = rows.repartition(*at).select("row", "c1").sortWithinPartitions("row").mapInArrow(_meeting(np.array(hot, np.int64)), "key long, c1 long, n int")
    met = materialize(met.select("key", F.struct("c1", "n").alias("c")), "met")
    two = pairs_within(met, ["key"], "c").selectExpr("a.c1 as c1", "b.c1 as d1", "a.n as na", "b.n as nb")
    fits = f"least(na, nb) >= greatest(na, nb) * {similarity} - 1e-9"
    return two.where(fits).select("c1", "d1").distinct()


def _class_pairs(df: DataFrame, ident: str, fields: list[str], similarity: float, least: int, shape: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(members: id, rep; pairs: a, b, common, na, nb of class representatives)."""
    source = df.select(F.col(ident).cast("long").alias("id"), *[F.col(f) for f in fields]).where("id is not null")
    profile = materialize(source.mapInArrow(_profile(least), "id long, n int, c1 long, c2 long, p0 long, p1 long, p2 long, p3 long"), "profile")
    classes = profile.groupBy("c1", "c2", "n").agg(F.min("id").alias("rep"), *[F.first(f"p{i}").alias(f"p{i}") for i in range(4)])
    classes = materialize(classes, "classes")
    members = profile.join(classes.select("c1", "c2", "n", "rep"), ["c1", "c2", "n"]).select("id", "rep")

    def side(key: str, rep: str, n: str, p: str) -> DataFrame:
        return classes.select(F.col("c1").alias(key), F.col("rep").alias(rep), F.col("n").alias(n), *[F.col(f"p{i}").alias(f"{p}{i}") for i in range(4)])

    pairs = _candidates(source, profile.count(), least, similarity, shape).join(side("c1", "ra", "na", "p"), "c1").join(side("d1", "rb", "nb", "q"), "d1")
    differ = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"q{i}"))) for i in range(4)), F.lit(0))
    pairs = pairs.where(differ <= F.col("na") + F.col("nb") - 2 * _needed(similarity))
    pairs = materialize(pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "candidates")
    chosen = materialize(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct(), "chosen")
    words = materialize(source.join(small(chosen, BROADCAST_ROWS), "id", "left_semi").mapInArrow(_words_for(least), "id long, e binary"), "words")
    checked = _compared(pairs, words, chosen.count())
    n = classes.select("rep", "n")
    checked = checked.join(n.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b")
    return members, checked.where(F.col("common") >= _needed(similarity))


def near_duplicate_pairs(df: DataFrame, ident: str, fields: list[str], similarity: float = SIMILARITY, least: int = LEAST_WORDS, shape: tuple[int, int] = (BANDS, WIDTH)) -> DataFrame:
    """Pairs (ref_a, ref_b), ref_a < ref_b, of records at least ``similarity`` alike; exact copies count. Records with
    fewer than ``least`` words (null and empty fields have none) are in no pair; an id that comes again with the
    same words counts once. Empty input gives no rows."""
    members, pairs = _class_pairs(df, ident, fields, similarity, least, shape)
    members = materialize(members.distinct(), "members")
    pairs = materialize(pairs.select("a", "b"), "pairs")
    copies = pairs_within(members, ["rep"], "id").select(F.col("a").alias("ref_a"), F.col("b").alias("ref_b"))
    other = expand(expand(pairs, "a", members, "rep", "id", "x"), "b", members, "rep", "id", "y")
    return copies.unionAll(other.select(F.least("x", "y").alias("ref_a"), F.greatest("x", "y").alias("ref_b")).where("ref_a < ref_b")).distinct()


def near_duplicate_groups(df: DataFrame, ident: str, fields: list[str], similarity: float = SIMILARITY, least: int = LEAST_WORDS, shape: tuple[int, int] = (BANDS, WIDTH)) -> DataFrame:
    """One row per record with enough words: (id, class_id: its class of exact copies, n_links: the number of other
    classes it is linked to, group_id: the least id of its group). A record like no other is its own group."""
    members, pairs = _class_pairs(df, ident, fields, similarity, least, shape)
    members = materialize(members.distinct(), "members")
    pairs = materialize(pairs.select("a", "b"), "pairs")
    return linked_rows(members, pairs)
