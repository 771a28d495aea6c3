"""Vectorized word shingles: numpy over the UTF-8 bytes of a block of texts.

Words are runs of characters other than space and \\x09-\\x0D after lower-casing A-Z. A word's
hash is a polynomial over 64-bit values drawn for each byte; a shingle's hash mixes its words'
hashes in order. Equal shingles always get equal hashes; two different ones collide with a
probability near 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20   # text handled at once, whatever the size of an Arrow batch
SHINGLE_WORDS = 5

_rng = np.random.default_rng(20240229)
_fold = np.arange(256)
_fold[65:91] += 32
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)[_fold]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """base^0 .. base^n, kept between calls."""
    global _POWERS
    if len(_POWERS) <= n:
        p = np.full(max(n + 1, BLOCK_BYTES + 1), _BASE, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix, a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into row ranges of about ``limit`` bytes (a longer text stands alone):
    (first row, end row, the bytes, the offsets of its rows in them). A NULL counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and the index of the first word of each row.
    ``outside`` marks the bytes between words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~outside[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = cut[cut > 0] - 1
    last[cut] = inside[cut]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash a word: sum of byte value x base^(place counted from the word's end)."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[n - 1::-1][:n] if n else data, out=total[1:])
    # total[e] - total[s] is scaled by base^(n - e): multiply to one common scale instead of dividing
    return mix((total[ends] - total[starts]) * _inverse_powers(n)[n - ends])


_INVERSE = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _INVERSE
    if len(_INVERSE) <= n:
        p = np.full(max(n + 1, BLOCK_BYTES + 1), pow(int(_BASE), -1, 2**64), np.uint64)
        p[0] = 1
        _INVERSE = np.multiply.accumulate(p)
    return _INVERSE


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """For each row of a block the sorted distinct hashes of its k-word shingles. A row with fewer
    words has its whole sequence as one shingle; a row without words has none."""
    starts, ends, rows = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    if len(words) >= k:
        grams = np.zeros(len(words) - k + 1, np.uint64)
        for i in range(k):
            grams = grams * _WORD + words[i:i + len(grams)]
        grams = mix(grams)
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if b - a >= k:
            got = np.sort(grams[a:b - k + 1])
            keep = np.ones(len(got), bool)
            keep[1:] = got[1:] != got[:-1]
            yield got[keep]
        elif b > a:
            one = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    one = one * _WORD + w
                yield mix(np.array([one + np.uint64(b - a)]))
        else:
            yield np.zeros(0, np.uint64)
