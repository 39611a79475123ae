"""The chain of text functions, and those that need tables: acronyms and dictionaries.

Both replace runs of words by a token: at each word the longest entry that starts there, from left to right. A table within
``DICTIONARY_ROWS`` (counted) goes along with the tasks, so a chain stays one projection without a shuffle: whole batches of
words are looked up in Arrow, and only where an entry may begin are the words looked at one by one. For a larger table the
runs of words are joined with it, and the entries found go back to their texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.functions.let import once
from loomtext.functions.text import CHAIN, tokens

#: Entries of a table that goes along with the tasks, at most.
DICTIONARY_ROWS = 500_000
#: The functions that need a table, by name.
TABLES = ("replace_acronyms", "replace_from_dictionary")


def parse_chain(
    df: DataFrame, names: Sequence[str] = tuple(CHAIN), text: str = "text", options: dict[str, dict] | None = None,
    tables: dict[str, DataFrame] | None = None, ident: str = "_ref",
) -> DataFrame:
    """``text`` folded through the named functions in order. ``tables`` holds the abbreviations of ``replace_acronyms`` and
    the dictionary of ``replace_from_dictionary``; without its table such a function leaves the text as it is.
    ValueError for an unknown name. Null stays null."""
    unknown = [n for n in names if n not in CHAIN and n not in TABLES]
    if unknown:
        raise ValueError(f"unknown functions {unknown}; there are {sorted([*CHAIN, *TABLES])}")
    for n in names:
        given = (options or {}).get(n, {})
        if n in CHAIN:
            df = df.withColumn(text, CHAIN[n](F.col(text), **given))
        elif n in (tables or {}):
            df = {"replace_acronyms": replace_acronyms, "replace_from_dictionary": replace_from_dictionary}[n](df, tables[n], text=text, ident=ident, **given)
    return df


def best_phrases(abbreviations: DataFrame) -> DataFrame:
    """(abbr, phrase): the most frequent phrase of every abbreviation (ties: the least phrase)."""
    return abbreviations.groupBy("abbr").agg(F.min_by("phrase", F.struct(-F.col("count"), F.col("phrase"))).alias("phrase"))


@dataclass(frozen=True)
class _Entries:
    """Single words in their own case with their tokens, and runs of words in lower case by their first word."""

    words: pa.Array
    tokens: pa.Array
    runs: dict[str, list[tuple[tuple[str, ...], str]]] = field(default_factory=dict)

    @staticmethod
    def of(rows: Sequence[tuple[str, str, bool]]) -> _Entries:
        """From (phrase, token, in its own case)."""
        exact = sorted({(p, t) for p, t, own in rows if own})
        runs: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        for p, t in {(p, t) for p, t, own in rows if not own}:
            words = tuple(p.lower().split())
            if words:
                runs.setdefault(words[0], []).append((words, t))
        for found in runs.values():
            found.sort(key=lambda x: (-len(x[0]), x))
        return _Entries(pa.array([p for p, _ in exact], pa.string()), pa.array([t for _, t in exact], pa.string()), runs)


def _joined(lists: pa.ListArray, hits: list[tuple[int, int, str]], flat: pa.Array) -> pa.Array:
    """The lists' words joined by spaces; the words of each hit (place in ``flat``, length, token) are its token."""
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    keep, hit = np.ones(len(flat), bool), np.zeros(len(flat), bool)
    for at, length, _ in hits:
        keep[at + 1 : at + length] = False
        hit[at] = True
    flat = pc.replace_with_mask(flat, pa.array(hit), pa.array([t for *_, t in hits], pa.string())) if hits else flat
    places = np.concatenate([[0], np.cumsum(keep)])[offsets].astype(np.int32)
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(places), flat.filter(pa.array(keep))), " ")
    return pc.if_else(lists.is_valid(), text, None)


def _flat(lists: pa.Array) -> tuple[pa.ListArray, pa.Array]:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    if lists.null_count and np.diff(lists.offsets.to_numpy())[lists.is_null().to_numpy(zero_copy_only=False)].any():  # nulls with values
        lists = pa.array(lists.to_pylist(), pa.list_(pa.string()))
    first, last = lists.offsets[0].as_py(), lists.offsets[len(lists)].as_py()
    return lists, lists.values.slice(first, last - first)


def _replaced(lists: pa.Array, entries: _Entries) -> pa.Array:
    lists, flat = _flat(lists)
    low = pc.utf8_lower(flat)
    begins = pc.is_valid(pc.index_in(low, value_set=pa.array(list(entries.runs), pa.string()))).to_numpy(zero_copy_only=False)
    ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
    hits, busy = [], 0
    for at in np.flatnonzero(begins):
        if at < busy:
            continue
        end = ends[np.searchsorted(ends, at, "right")]
        here = entries.runs[low[at].as_py()]
        words = tuple(low.slice(at, min(max(len(w) for w, _ in here), end - at)).to_pylist())
        found = next(((w, t) for w, t in here if words[: len(w)] == w), None)
        if found:
            busy = int(at) + len(found[0])
            hits.append((int(at), len(found[0]), found[1]))
    place = pc.index_in(flat, value_set=entries.words)
    flat = pc.if_else(pc.is_valid(place), pc.take(entries.tokens, place), flat) if len(entries.words) else flat
    return _joined(lists, hits, flat)


def replacer(rows: Sequence[tuple[str, str, bool]]) -> Callable[[Column], Column]:
    """A column function on lists of words that replaces the phrases of (phrase, token, in its own case) by tokens and joins
    the words by spaces; a phrase in its own case is a single word."""
    entries = _Entries.of(rows)

    @F.arrow_udf(T.StringType())
    def replace(lists: pa.Array) -> pa.Array:
        return _replaced(lists, entries)

    return replace


@F.arrow_udf(T.StringType())
def _with_hits(lists: pa.Array, found: pa.Array) -> pa.Array:
    """The same where the entries that begin at each word are known: (place, length, token), of one list."""
    lists, flat = _flat(lists)
    hits, start = [], lists.offsets.to_numpy() - lists.offsets[0].as_py()
    for base, here in zip(start, found.to_pylist(), strict=False):
        busy = -1
        for h in sorted(here or (), key=lambda h: (h["at"], -h["n"], h["token"])):
            if h["at"] >= busy:
                busy = h["at"] + h["n"]
                hits.append((int(base) + h["at"], h["n"], h["token"]))
    return _joined(lists, hits, flat)


def _replace(df: DataFrame, table: DataFrame, text: str, ident: str) -> DataFrame:
    """``text`` with the entries of ``table`` (phrase, token, own) replaced; see the module. ``ident`` is unique (used for
    large tables alone)."""
    words = tokens(F.col(text))
    if table.limit(DICTIONARY_ROWS + 1).count() <= DICTIONARY_ROWS:
        return once(df, text, replacer([tuple(r) for r in table.select("phrase", "token", "own").collect()])(words))
    folded = F.array_join(tokens(F.lower("phrase")), " ")
    table = table.select(F.when(F.col("own"), F.col("phrase")).otherwise(folded).alias("g"), "token", "own").where("g <> ''")
    sizes = [r[0] for r in table.select(F.size(F.split("g", " ")).alias("n")).distinct().orderBy("n").collect()]  # a few lengths
    listed = df.select(ident, words.alias("_w"))
    run = lambda n: F.transform(F.sequence(F.lit(0), F.size("_w") - n), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("_w", i + 1, n), " ").alias("g")))
    runs = F.concat(*[F.when(F.size("_w") >= n, run(n)).otherwise(F.array().cast("array<struct<at:int,n:int,g:string>>")) for n in sizes])
    grams = listed.select(ident, F.explode(runs).alias("r")).select(ident, "r.at", "r.n", F.explode(F.array(F.struct(F.col("r.g").alias("g"), F.lit(True).alias("own")), F.struct(F.lower("r.g").alias("g"), F.lit(False).alias("own")))).alias("k"))
    found = grams.select(ident, "at", "n", "k.g", "k.own").join(table, ["g", "own"]).groupBy(ident).agg(F.collect_list(F.struct("at", "n", "token")).alias("_hits"))
    return df.join(found, ident, "left").withColumn(text, _with_hits(words, F.col("_hits"))).drop("_hits")


def replace_acronyms(df: DataFrame, abbreviations: DataFrame, ident: str = "_ref", text: str = "text", prefix: str = "", suffix: str = "ABBR") -> DataFrame:
    """``df`` with ``text`` in which known abbreviations (in their own case), and their most frequent phrases (in any case),
    are prefix_word_word_suffix of that phrase. Words end up between single spaces; null stays null."""
    sides = [x for x in (prefix, "{}", suffix) if x]
    best = best_phrases(abbreviations.where("phrase is not null and abbr is not null"))
    token = F.concat_ws("_", *[F.replace(F.col("phrase"), F.lit(" "), F.lit("_")) if s == "{}" else F.lit(s) for s in sides])
    both = F.explode(F.array(F.struct(F.col("abbr").alias("phrase"), F.lit(True).alias("own")), F.struct("phrase", F.lit(False).alias("own"))))
    table = best.select(token.alias("token"), both.alias("e")).groupBy("e.phrase", "e.own").agg(F.min("token").alias("token"))
    return _replace(df, table, text, ident)


def replace_from_dictionary(df: DataFrame, dictionary: DataFrame, text: str = "text", suffix: str = "_MeSH", prefix: str = "", ident: str = "_ref") -> DataFrame:
    """``df`` with ``text`` in which the phrases of (phrase, term), in any case, are prefix + term + suffix, spaces as
    underscores; of several terms of a phrase the least counts. Null stays null."""
    rows = dictionary.where("phrase is not null and term is not null").groupBy(F.lower("phrase").alias("phrase")).agg(F.min("term").alias("term"))
    token = F.concat(F.lit(prefix), F.replace(F.col("term"), F.lit(" "), F.lit("_")), F.lit(suffix))
    return _replace(df, rows.select("phrase", token.alias("token"), F.lit(False).alias("own")), text, ident)
