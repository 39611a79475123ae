"""Splitting texts of too many tokens at natural boundaries (problem 10).

Method: balanced targets. From the tokens of a text the least number of pieces follows; targets of equal length are
placed, each is moved to the strongest boundary near it (paragraph, then sentence, then word end; where there is none near,
to the nearest in all that the piece may hold), and when a piece would exceed the limit one piece is added and the targets
are placed anew. A piece repeats the end of the one before.

Units are the words of the tokenizer's pattern, whose numbers of tokens add up; words of many tokens are cut into units
of at most ``UNIT`` tokens, so a text without any boundary is cut too. The pieces without their overlaps, put together,
are the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.tokens import TOKENIZER, encoder, ranks_file, word_pattern
from loomtext.llm.words import slices

LIMIT, OVERLAP = 1024, 64
#: Tokens of a unit at most, tokens on either side of a target in which the strongest boundary is looked for, words
#: whose numbers of tokens a worker remembers.
UNIT, NEAR, REMEMBERED = 16, 96, 500_000
_SENTENCE = (".", "!", "?", "。", "！", "？", '."', ".)", ".”")


class _Tokens(dict):
    """Number of tokens of each word; encodes a word when it is first asked for."""

    def __init__(self, ranks: bytes) -> None:
        super().__init__()
        self.encode = encoder(ranks).encode_ordinary

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = n = len(self.encode(word))
        return n


def _units(words: list[str], tokens: _Tokens) -> list[str]:
    """Words, those of more than UNIT tokens cut into stretches of characters (each character has 4 tokens at most)."""
    out = []
    for w in words:
        if tokens[w] <= UNIT:
            out.append(w)
        else:
            out += [w[i : i + UNIT // 4] for i in range(0, len(w), UNIT // 4)]
    return out


def _strength(before: str, after: str) -> int:
    """Of a boundary between two units: 3 paragraph, 2 sentence, 1 word, 0 none."""
    if "\n" in before and not before.strip():
        return 3
    if after[:1].isspace():
        return 2 if before.endswith(_SENTENCE) else 1
    return 1 if before[-1:].isspace() else 0


def _cuts(units: list[str], ends: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(first unit, unit after the last) of every piece; ends[i]: tokens of the first i units."""
    total = int(ends[-1])
    pieces = max(1, -(-(total - overlap) // (limit - overlap)))
    while True:
        length = (total + (pieces - 1) * overlap) / pieces
        out, start, last = [], 0, 0
        for i in range(1, pieces + 1):
            if i == pieces:
                cut = len(units)
            else:
                target = i * length - (i - 1) * overlap
                most = int(np.searchsorted(ends, ends[start] + limit, "right")) - 1
                low = max(int(np.searchsorted(ends, target - NEAR)), last + 1)
                high = min(int(np.searchsorted(ends, target + NEAR, "right")) - 1, most, len(units) - 1)
                if high < low:
                    low = high = max(last + 1, min(int(np.searchsorted(ends, target)), most, len(units) - 1))
                # the strongest; of equal ones the nearest to the target
                near = lambda u: -abs(float(ends[u]) - target)
                cut = max(range(low, high + 1), key=lambda u: (_strength(units[u - 1], units[u]), near(u)))
                if not _strength(units[cut - 1], units[cut]):
                    # a piece of the overlap alone would not get on: what ends behind it is taken
                    wide = [u for u in range(last + 1, min(most, len(units) - 1) + 1) if ends[u] - ends[start] > overlap and _strength(units[u - 1], units[u])]
                    cut = max(wide, key=near, default=cut)
            if ends[cut] - ends[start] > limit or cut <= last:
                break
            out.append((start, cut))
            last = cut
            start = int(np.searchsorted(ends, ends[cut] - overlap))
        else:
            return out
        pieces += 1
        if pieces > len(units):
            raise ValueError("the limit is too small for the units of this text")


def split_text(text: str, tokens: _Tokens, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, repeated tokens) of the pieces of a text, in code points; none if it is within the limit."""
    words = word_pattern().findall(text)
    counts = np.fromiter(map(tokens.__getitem__, words), np.int64, len(words))
    if counts.sum() <= limit:
        return []
    if counts.max() > UNIT:
        words = _units(words, tokens)
        counts = np.fromiter(map(tokens.__getitem__, words), np.int64, len(words))
    ends = np.concatenate([[0], np.cumsum(counts)])
    chars = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
    allowed = limit
    while True:
        out, done, most = [], 0, 0
        for a, b in _cuts(words, ends, allowed, overlap):
            # units of a word that is cut may encode to other tokens together than one by one: what counts is the text
            while a < done and len(tokens.encode(text[chars[a] : chars[done]])) > overlap:
                a += 1
            start, end = int(chars[a]), int(chars[b])
            n = len(tokens.encode(text[start:end]))
            most = max(most, n)
            out.append((start, end, n, len(tokens.encode(text[start : int(chars[done])])) if done else 0))
            done = b
        if most <= limit:
            return out
        allowed -= most - limit


def _split(ranks: bytes, limit: int, overlap: int, texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["id", "piece", "start", "end", "n_tokens", "n_repeated", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(ranks)
        for whole in batches:
            for b in slices(whole, 1):
                rows = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    rows += [(i, k, *p, t[p[0] : p[1]] if texts else None) for k, p in enumerate(split_text(t, tokens, limit, overlap))]
                cols = list(zip(*rows, strict=True)) or [()] * len(names)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def split_oversized(df: DataFrame, ident: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = TOKENIZER, texts: bool = True) -> DataFrame:
    """The pieces of every text of more than ``limit`` tokens: (id, piece from 0, start, end in code points, n_tokens at
    most ``limit``, n_repeated at most ``overlap``, text, which is null without ``texts``). Texts within the limit, null
    and empty ones have none. A token has a byte at least, so shorter texts are passed over in the JVM."""
    if not 2 * UNIT <= overlap + 2 * UNIT <= limit:
        raise ValueError(f"the limit must exceed the overlap by {2 * UNIT} tokens")
    docs = df.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text")).where(F.octet_length("text") > limit)
    return docs.mapInArrow(_split(ranks_file(tokenizer), limit, overlap, texts), "id long, piece int, start long, end long, n_tokens int, n_repeated int, text string")
