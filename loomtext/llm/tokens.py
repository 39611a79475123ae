"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8).

The tokenizer first cuts a text into words by a pattern, and each word is encoded by itself. So: the texts are cut into
words block by block, each block holding its distinct words and, per document, their positions among them; the distinct
words of all blocks are brought together and each is encoded once; the ids go back to the blocks by position, where they
are put in the places of the words. Decoding joins ids with the table of pieces.

Special tokens are never produced: their strings are ordinary text. Null and empty texts have an empty list of ids.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.words import slices
from loomtext.plans.shared import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: Fixed value: how the tokenizer cuts texts into words, with white space spelt out (Unicode's White_Space).
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Bytes of text in a block.
BLOCK = 6 << 20


def ranks_file(path: str = TOKENIZER) -> bytes:
    """The vocabulary as it stands in its file; of fixed size, so it can go along with the tasks."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def encoder(ranks: bytes) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("public", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=1)
def word_pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


class _Places(dict):
    """Words to their places in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


_BLOCKED = "block long, words array<string>, ids binary, sizes binary, places binary"


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find, block = word_pattern().findall, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
    for whole in batches:
        for b in slices(whole, 1, BLOCK):
            places = _Places()
            found = [list(map(places.__getitem__, find(t))) if t else [] for t in b.column(1).to_pylist()]
            flat = np.fromiter((p for doc in found for p in doc), np.uint32, sum(map(len, found)))
            if len(places) <= 1 << 16:
                flat = flat.astype(np.uint16)
            sizes = np.fromiter(map(len, found), np.int32, len(found))
            yield pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), pa.array([list(places)], pa.list_(pa.string())),
                pa.array([b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()), pa.array([sizes.tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary()),
            ], ["block", "words", "ids", "sizes", "places"])
            block += 1


def _encoded(ranks: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks).encode_ordinary
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(encode(w), np.int32).tobytes() for w in words], pa.binary())], ["word", "code"])

    return run


def _put_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for many in batches:
        for i in range(many.num_rows):
            row = {k: many.column(k)[i].as_py() for k in ("ids", "sizes", "places", "codes")}
            ids, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int32)
            words = int(sizes.sum())
            places = np.frombuffer(row["places"], np.uint16 if len(row["places"]) == 2 * words else np.uint32).astype(np.int64)
            codes = row["codes"] or []
            length = np.fromiter((len(c) // 4 for c in codes), np.int64, len(codes))
            pool = np.frombuffer(b"".join(codes), np.int32)
            start = np.cumsum(length) - length
            # every word becomes a stretch of the pool
            each = length[places]
            ends = np.cumsum(each)
            total = int(ends[-1]) if words else 0
            at = np.arange(total) + np.repeat(start[places] - (ends - each), each) if words else np.zeros(0, np.int64)
            bounds = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(sizes)]]).astype(np.int32)
            for a in range(0, len(ids), 512):
                b = min(a + 512, len(ids))
                lists = pa.ListArray.from_arrays(pa.array(bounds[a : b + 1] - bounds[a]), pa.array(pool[at[bounds[a] : bounds[b]]]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]), lists], ["id", "ids"])


def encode_corpus(df: DataFrame, ident: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, ids) for every row: the ids of ``text`` without special tokens; empty for null and empty texts. Rows with a
    null id are left out; equal ids give a row each."""
    docs = df.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    blocks = materialize(docs.mapInArrow(_blocked, _BLOCKED), "blocks")
    seen = materialize(blocks.select("block", F.posexplode("words").alias("at", "word")), "seen")
    codes = seen.select("word").distinct().mapInArrow(_encoded(ranks_file(tokenizer)), "word string, code binary")
    # the distinct words of a block are bounded by its bytes, so they may come together
    back = seen.join(codes, "word").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("held"))
    held = blocks.select("block", "ids", "sizes", "places").join(back.select("block", F.col("held.code").alias("codes")), "block", "left")
    return held.select("ids", "sizes", "places", "codes").mapInArrow(_put_back, "id long, ids array<int>")


def decode_corpus(ids: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, text) of (id, ids): each id is joined with its piece of bytes, and the pieces of a list are put together.
    Ids that are no piece give an error; bytes that are no UTF-8 become U+FFFD."""
    lines = [line.split() for line in ranks_file(tokenizer).splitlines() if line]
    pieces = [b""] * len(lines)
    for a, b in lines:
        pieces[int(b)] = base64.b64decode(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(pieces, pa.binary())
        for b in batches:
            lists = b.column(1)
            offsets = lists.offsets.to_numpy()
            at = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), table.take(at)), b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())], ["id", "text"])

    return ids.select("id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "id long, text string")
