"""Words of texts as arrays of hashes, a whole batch at a time.

The words of a text are the maximal runs of letters and digits of its canonical form in lower case. A batch is laid out
as one array of code points; a prefix sum of a polynomial over mixed code points gives the 64-bit hash of every run at
once, so no Python object is made per word. Equal words have equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomtext.llm.normalize import canonical

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Code points that are laid out at once; a longer text is laid out alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values in which every bit depends on every other."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: does it stand in words, and its mixed value."""
    inside = np.zeros(0x110000, bool)
    for o in range(0x110000):
        if not 0xD800 <= o < 0xE000:
            inside[o] = chr(o).isalnum()
    return inside, mix(np.arange(1, 0x110001, dtype=np.uint64))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(CHUNK, n)
        _powers.clear()
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


def _lay_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("ascii"), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside, values = _letters()
    is_in = inside[points]
    padded = np.zeros(len(points) + 2, np.int8)
    padded[1:-1] = is_in
    edges = np.diff(padded)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    power, inverse = _power_tables(len(points))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(values[points] * power[: len(points)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths + 1, out=first[1:])
    return hashes, np.searchsorted(starts, first)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the hashes of the words of text i are hashes[offsets[i]:offsets[i + 1]], in their order.
    Null and blank texts have no words."""
    parts, bounds, held, size = [], [np.zeros(1, np.int64)], [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            h, o = _lay_out(held)
            parts.append(h)
            bounds.append(o[1:] + bounds[-1][-1])
            held, size = [], 0

    for t in texts:
        low = (canonical(t) or "").lower()
        if size + len(low) > CHUNK:
            flush()
        held.append(low)
        size += len(low) + 1
    flush()
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(bounds)


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``most`` bytes in ``column``, one row at least, so that very long texts don't
    pile up in a worker."""
    col = batch.column(column)
    n = batch.num_rows
    sizes = col.nbytes
    if sizes <= most and n <= rows:
        if n:
            yield batch
        return
    lengths = np.cumsum(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        base = lengths[at - 1] if at else 0
        end = min(max(at + 1, int(np.searchsorted(lengths, base + most, "right"))), at + rows, n)
        yield batch.slice(at, end - at)
        at = end
