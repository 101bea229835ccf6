"""Simple-8b: integers packed into 64-bit words under a 4-bit selector.

Selector s in the top 4 bits says how many values of how many bits fill the low
60.  Values are cut into blocks; a block's words are followed by its escapes
(values of more than 60 bits, whose word holds only an index), and the offsets
of both are kept, so that a whole file is decoded by a few array operations
per selector.
"""

from __future__ import annotations

import numpy as np

#: (values in a word, bits of each) by selector; selector 1 is the escape.
PACKINGS = ((240, 0), (1, 60), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 1
BLOCK = 4096
_COUNTS = np.array([c for c, _ in PACKINGS], np.int64)
_POWERS = np.uint64(1) << np.arange(1, 64, dtype=np.uint64)
#: A width that no word takes.
_NEVER = 127


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value; none for 0."""
    bits = np.frexp(values.astype(np.float64))[1].astype(np.int8)
    wide = np.flatnonzero(values >> np.uint64(53))  # beyond what a float tells apart
    bits[wide] = np.searchsorted(_POWERS, values[wide], "right") + 1
    return bits


def _selectors(values: np.ndarray, block: int) -> np.ndarray:
    """For each place, the selector of the word that would start there: the one
    with most values that all fit and all lie in the place's block."""
    n, most = len(values), _COUNTS.max()
    blocks = -(-n // block)
    bits = _widths(values)
    own = np.full(blocks * block, _NEVER, np.int8)
    own[:n] = bits
    padded = np.full((blocks, block + most), _NEVER, np.int8)  # nothing fits across a block's end
    padded[:, :block] = own.reshape(blocks, block)
    widest = {1: padded}

    def over(count: int) -> np.ndarray:
        """The greatest width of `count` values from each place, of two overlapping halves."""
        if count not in widest:
            half = over((count + 1) // 2)
            rest = count // 2
            out = half.copy()
            np.maximum(half[:, :-rest], half[:, rest:], out=out[:, :-rest])
            widest[count] = out
        return widest[count]

    chosen = np.where(padded > 60, np.int8(ESCAPE), np.int8(len(PACKINGS) - 1))
    for s in range(len(PACKINGS) - 2, -1, -1):
        count, width = PACKINGS[s]
        if s != ESCAPE and (bits <= width).any():
            chosen[over(count) <= width] = s
    return chosen[:, :block].ravel()[:n]


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, and for each block the place of its first word and of its first
    escape; both offset arrays have one more entry, the end."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)
    chosen = _selectors(values, block)
    step, starts, i = _COUNTS.astype(np.uint8)[chosen].tobytes(), [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts, np.int64)
    sel = chosen[at]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        count, width = PACKINGS[s]
        if s == ESCAPE or width == 0:
            continue
        own = np.flatnonzero(sel == s)
        base = at[own]
        packed = values[base]
        for k in range(1, count):
            packed |= values[base + k] << np.uint64(k * width)
        words[own] |= packed
    of_block = at // block
    n_words = np.bincount(of_block, minlength=blocks)
    raw_at = np.flatnonzero(sel == ESCAPE)
    n_raw = np.bincount(of_block[raw_at], minlength=blocks)
    total = n_words + n_raw
    first = np.concatenate(([0], np.cumsum(total)))
    out = np.zeros(first[-1], np.uint64)
    place = np.arange(len(words)) + (np.cumsum(n_raw) - n_raw)[of_block]
    if len(raw_at):
        b = of_block[raw_at]
        index = np.arange(len(raw_at)) - (np.cumsum(n_raw) - n_raw)[b]
        words[raw_at] |= index.astype(np.uint64)
        out[first[b] + n_words[b] + index] = values[at[raw_at]]
    out[place] = words
    return out, first, np.concatenate((first[:-1] + n_words, [first[-1]]))


def decode(words: np.ndarray, first: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The values of `encode`."""
    if not len(words):
        return np.zeros(0, np.uint64)
    blocks = len(first) - 1
    n_words = escapes[:-1] - first[:-1]
    of_block = np.repeat(np.arange(blocks), n_words)
    place = np.arange(len(of_block)) - (np.cumsum(n_words) - n_words)[of_block] + first[:-1][of_block]
    packed = words[place]
    sel = (packed >> np.uint64(60)).astype(np.int8)
    count = _COUNTS[sel]
    at = np.cumsum(count) - count
    out = np.zeros(at[-1] + count[-1], np.uint64)
    for s in np.unique(sel):
        c, width = PACKINGS[s]
        own = np.flatnonzero(sel == s)
        if s == ESCAPE:
            index = (packed[own] & np.uint64((1 << 60) - 1)).astype(np.int64)
            out[at[own]] = words[escapes[of_block[own]] + index]
        elif width:
            mask = np.uint64((1 << width) - 1)
            for k in range(c):
                out[at[own] + k] = (packed[own] >> np.uint64(k * width)) & mask
    return out
