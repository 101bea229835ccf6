"""Vectorised word and shingle hashes over Arrow text buffers.

Words are runs of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return; only A-Z are lower-cased.  A word's hash is a
polynomial over a table of random 64-bit values, taken from prefix sums of the
whole buffer, then mixed; no Python object is made per word.  Two different
words or shingles share a hash with a chance near 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.Philox(20240229))
_TABLE = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]  # A-Z hash as a-z
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: With these, words are runs of ASCII letters, digits and all bytes beyond ASCII.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_CHUNK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP: np.ndarray | None = None
_DOWN: np.ndarray | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word of a buffer of UTF-8 bytes;
    `space` says which bytes stand between words."""
    global _UP, _DOWN
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    n = len(data)
    if _UP is None or len(_UP) < n + 1:
        size = max(_CHUNK + 1, n + 1)
        _UP, _DOWN = _powers(_BASE, size), _powers(_INVERSE, size)
    inside = ~space[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _UP[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * _DOWN[start]
    if n > 64 * _CHUNK:  # do not hold tables of the size of one huge text
        _UP, _DOWN = None, None
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start, end


def texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of consecutive rows of a string column: (first row, end row, bytes,
    offsets).  A block has about 64 KB, or one longer text.  Null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _CHUNK, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def rows_of_words(column: pa.Array, space: np.ndarray = SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row: (row, word hashes, word starts, word ends, bytes of the text)."""
    for i, j, data, off in texts(column):
        # a separator between texts keeps words of neighbours apart
        if j - i > 1:
            joined = np.full(len(data) + (j - i), 32, np.uint8)
            place = np.arange(len(data)) + np.repeat(np.arange(j - i), np.diff(off))
            joined[place] = data
            off2 = off + np.arange(j - i + 1)
        else:
            joined, off2 = data, off
        h, s, e = word_hashes(joined, space)
        cut = np.searchsorted(s, off2)
        for k in range(j - i):
            a, b = cut[k], cut[k + 1]
            yield i + k, h[a:b], s[a:b] - off2[k], e[a:b] - off2[k], data[off[k] : off[k + 1]]


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, in order, repeats included."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out += words[k : k + m] * np.uint64(pow(_BASE, 2 * k + 3, 2**64) | 1)
    return mix(out)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; of fewer words, the whole sequence as one; of none, empty."""
    if len(words) == 0:
        return words
    if len(words) < n:
        return ngrams(words, len(words))
    out = ngrams(words, n)
    out.sort()
    keep = np.empty(len(out), bool)
    keep[0] = True
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    return out[keep]
