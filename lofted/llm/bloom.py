"""Blocked Bloom filters built by executors and probed in vectorised batches.

A filter has 2**log2_blocks blocks of 512 bits (one cache line); a key sets
8 bits in one block.  The size is chosen from the count of keys and is never
above `max_log2_blocks`, so what is broadcast has a fixed bound; beyond it only
the share of false positives grows, and every user joins the hits exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BITS = 8
MAX_LOG2_BLOCKS = 20  # 64 MB


def size_for(keys: int, bits_per_key: int = 16, max_log2_blocks: int = MAX_LOG2_BLOCKS) -> int:
    """log2 of the blocks for so many keys, within the bound."""
    need = max(1, -(-keys * bits_per_key // 512))
    return min(max_log2_blocks, max(0, int(need - 1).bit_length()))


def _bits(h: np.ndarray, log2_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash and its 8 bit places in the block."""
    block = (h >> np.uint64(64 - log2_blocks)).astype(np.int64) if log2_blocks else np.zeros(len(h), np.int64)
    low = (h * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    places = np.stack([(low >> np.uint64(k * 7)) & np.uint64(511) for k in range(BITS)], axis=1).astype(np.int64)
    return block, places


def add(words: np.ndarray, hashes: np.ndarray, log2_blocks: int) -> None:
    """Adds hashes (int64 or uint64) to the filter, an array of 16 uint32 words a block."""
    block, places = _bits(hashes.view(np.uint64), log2_blocks)
    at = block[:, None] * 16 + (places >> 5)
    np.bitwise_or.at(words, at.ravel(), (np.uint32(1) << (places & 31).astype(np.uint32)).ravel())


def might_have(words: np.ndarray, hashes: np.ndarray, log2_blocks: int) -> np.ndarray:
    """False where a hash is certainly not in the filter."""
    block, places = _bits(hashes.view(np.uint64), log2_blocks)
    got = words[block[:, None] * 16 + (places >> 5)] >> (places & 31).astype(np.uint32)
    return (got & 1).all(axis=1)


def build(keys: DataFrame, hash_column: str, log2_blocks: int) -> np.ndarray:
    """The filter of a column of 64-bit hashes.

    Hashes are dealt by the high bits that choose the block, so each task makes
    its own stretch of the filter and the driver only gathers the stretches,
    whose total size is the bound above.
    """
    stretch_bits = min(log2_blocks, 8)
    stretches = 1 << stretch_bits

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        span = 16 << (log2_blocks - stretch_bits)
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            block, places = _bits(h, log2_blocks)
            at = block[:, None] * 16 + (places >> 5)
            which = block >> (log2_blocks - stretch_bits)
            value = np.uint32(1) << (places & 31).astype(np.uint32)
            for s in np.unique(which):
                own = which == s
                part = parts.setdefault(int(s), np.zeros(span, np.uint32))
                np.bitwise_or.at(part, (at[own] - int(s) * span).ravel(), value[own].ravel())
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([p.tobytes() for p in parts.values()], pa.binary())], ["s", "bits"])

    dealt = keys.select(F.col(hash_column).alias("h")).where("h is not null").withColumn("s", F.shiftrightunsigned("h", 64 - stretch_bits) if stretch_bits else F.lit(0).cast("long"))
    made = dealt.repartition("s").select("h").mapInArrow(make, "s int, bits binary")
    words = np.zeros(16 << log2_blocks, np.uint32)
    span = 16 << (log2_blocks - stretch_bits)
    for r in made.collect():  # at most `stretches` rows, of the bounded size in all
        words[r.s * span : (r.s + 1) * span] |= np.frombuffer(r.bits, np.uint32)
    assert stretches >= 1
    return words
