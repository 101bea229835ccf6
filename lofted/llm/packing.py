"""Best-fit packing by minimum bin slack over the histogram of lengths.

Only lengths matter to a packing, and there are at most `capacity` of them.
The driver plans on that histogram: it fills a bin round its largest remaining
item with the fullest feasible combination, found by subset sums over a bitset,
takes it out as many times as it fits, and goes on.  Pieces then find their
place by their rank among those of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import default_path, encoder

CAPACITY = 2048
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def fullest(counts: dict[int, int], slack: int) -> dict[int, int]:
    """The multiset of available lengths whose sum is as near below `slack` as
    can be, long ones first: {length: copies}."""
    reach, steps = 1, []
    mask = (1 << (slack + 1)) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= slack), reverse=True):
        steps.append((length, reach))
        left, take = min(counts[length], slack // length), 1
        while left:
            take = min(take, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> slack & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        copies = 0
        while not before >> at & 1:
            at -= length
            copies += 1
        if copies:
            used[length] = copies
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, dict[int, int]]]:
    """Patterns (first bin, bins, {length: copies in each bin}) that use up the histogram."""
    left, out, bins = {x: n for x, n in histogram.items() if n}, [], 0
    while left:
        top = max(left)
        left[top] -= 1
        pattern = fullest(left, capacity - top)
        left[top] += 1
        pattern[top] = pattern.get(top, 0) + 1
        times = min(left[x] // n for x, n in pattern.items())
        out.append((bins, times, pattern))
        bins += times
        for x, n in pattern.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


def slots(patterns: list[tuple[int, int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first bin, copies per bin, offset in the bin), by rank."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    for first, times, pattern in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            out.setdefault(length, []).append((taken.get(length, 0), first, n, offset))
            taken[length] = taken.get(length, 0) + n * times
            offset += n * length
    return {x: np.array(rows, np.int64) for x, rows in out.items()}


def pieces(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each document's ids with the end id, cut at `capacity`; `nth`
    counts a task's pieces of equal length.  Save it before use."""
    path = tokenizer_path or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc.encode(text.as_py()) + end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, int(seen[length])))
                    seen[length] += 1
            if rows:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, _PIECES)


def pack(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Packs `docs` (doc_id, text; other columns are ignored) into sequences of
    at most `capacity` tokens.

    Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Null and empty texts are the end id alone; null doc_ids stay null; repeated
    rows are pieces of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.save(pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.save(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")), "base")
    histogram = {r.length: r.n for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    where = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        lengths, ranks = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order])) + 1
        for own in np.split(order, edges) if len(order) else []:
            size = int(lengths[own[0]])
            table = where.value[size]
            row = table[np.searchsorted(table[:, 0], ranks[own], "right") - 1]
            q = ranks[own] - row[:, 0]
            seq[own], off[own] = row[:, 1] + q // row[:, 2], row[:, 3] + (q % row[:, 2]) * size
        return pa.StructArray.from_arrays([pa.array(seq), pa.array(off)], ["sequence_id", "offset"])

    ranked = cut.join(base.select("part", "length", "base"), ["part", "length"]).withColumn("place", place("length", F.col("nth") + F.col("base")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
