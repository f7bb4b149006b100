"""Vectorised text primitives over Arrow string buffers.

Everything here works on the UTF-8 bytes of a whole batch at once, so no Python
string is made per word.  Words are maximal runs of bytes other than U+0020 and
U+0009..U+000D.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_pow = np.ones(1, U64)
_inv = np.ones(1, U64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def give_back() -> None:
    """Return freed memory to the system, so that a worker waiting for its next task doesn't hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers that depend on ``seed`` only."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed)) | U64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        m = max(n, min(2 * len(_pow), 1 << 20))
        a, b = np.full(m, _R, U64), np.full(m, _R_INV, U64)
        a[0] = b[0] = 1
        _pow, _inv = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _pow, _inv


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, one after another, and ``len + 1`` offsets; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)
    off = off[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of runs of rows of about ``most`` bytes; a row is never cut."""
    buf, off = buffers(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each document the number of words before it (``len + 1``)."""
    n = len(buf)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(off), np.int64)
    word = ~SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, equal for equal bytes wherever they stand."""
    n = len(buf)
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * power[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h ^ ((ends - starts).astype(U64) * U64(0x9FB21C651E98DF25)))


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``k`` words from each position on; the last ``k - 1`` positions have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.zeros(n, U64)
    for j, c in enumerate(odd_constants(k, seed + k)):
        h += words[j : j + n] * c
    return mix(h)


def inside(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """For the positions of :func:`gram_hashes`: whether all ``k`` words belong to one document."""
    ok = np.ones(max(0, n - k + 1), bool)
    for j in range(1, k):
        at = bounds[1:-1] - j
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def owners(bounds: np.ndarray) -> np.ndarray:
    """Document number of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + counts[i] - 1`` of all i, in order."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document.

    A document of 1 to ``k - 1`` words has one shingle, its whole word sequence;
    a document without words has none.
    """
    starts, ends, bounds = word_spans(buf, off)
    words = span_hashes(buf, starts, ends)
    grams = gram_hashes(words, k)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(mix(gram_hashes(words[a:b], int(b - a)) + U64(int(b - a))))
        else:
            out.append(np.zeros(0, U64))
    return out
