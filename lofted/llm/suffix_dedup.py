"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes when a string of `LENGTH` bytes over it also starts earlier in the
corpus.  Texts lie in units of some MB in a table bucketed by unit, so what is
found out about a unit goes back to its texts without moving them.

1. Every window of LENGTH bytes names an anchor, the least hash of the grams of
   GRAM bytes in it.  Equal windows name the same gram at the same place, so
   only windows whose gram occurs twice in the corpus go on.
2. Windows in a row that name one anchor make a context.  Equal contexts of a
   unit collapse to the first; the others are later copies throughout.
3. Contexts meet by gram in order of place.  Equal ones collapse again; where
   one gram has several, a suffix array of their windows gives the previous and
   next smaller positions and with them each window's longest previous factor.

Grams of over HOT occurrences (a passage in a third of all texts, each time in
other surroundings) do not meet by gram: their windows meet one by one, by 128
bits of hash, one row a unit and window.  So no group grows with the corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, q

LENGTH = 100
GRAM = 32
#: Bytes of text in a unit; a longer text is a unit of its own.
UNIT_BYTES = 8 << 20
#: Windows hashed at once.
BLOCK = 1 << 19
#: Occurrences of a gram from which its windows meet one by one.
HOT = 2048
#: Bytes of contexts in one suffix array.
ARRAY_BYTES = 1 << 20

_SPAN = LENGTH - GRAM + 1
_INDEX = np.uint64((1 << 21) - 1)
#: Odd multipliers of the words of a window, two sets.
_FACTORS = np.random.default_rng(20_240_229).integers(1, 1 << 63, (2, LENGTH // 8 + 4), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Where the eight-byte words of a window begin; the last ends with it.
_STEPS = [*range(0, LENGTH - 8, 8), LENGTH - 8]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each position as a number; zeros lie beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), f"{order}u8", padded, strides=(1,)).astype("u8")


def _window_hash(mixed: np.ndarray, at: np.ndarray, which: int) -> np.ndarray:
    total = np.zeros(len(at), np.uint64)
    for k, step in enumerate(_STEPS):
        total += mixed[at + step] * _FACTORS[which, k]
    return _mix(total)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column in a row and where each value begins, and the end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def _runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows in a row with one anchor: first and last window, anchor, hash of its gram."""
    found = []
    for begin in range(0, max(0, len(data) - LENGTH + 1), BLOCK):
        part = data[begin : begin + BLOCK + LENGTH - 1]
        if len(part) < LENGTH:
            break
        mixed, n = _mix(_words(part)), len(part) - GRAM + 1
        grams = np.zeros(n, np.uint64)
        for k in range(GRAM // 8):
            grams += mixed[8 * k : 8 * k + n] * _FACTORS[0, k]
        grams = _mix(grams)
        least, have = (grams & ~_INDEX) | np.arange(n, dtype=np.uint64), 1
        while 2 * have <= _SPAN:
            least, have = np.minimum(least[:-have], least[have:]), 2 * have
        if have < _SPAN:
            least = np.minimum(least[: have - _SPAN], least[_SPAN - have :])
        anchor = (least & _INDEX).astype(np.int64)
        # windows over the end of a text are none
        low, high = np.maximum(ends[:-1], ends[1:] - LENGTH + 1) - begin, ends[1:] - begin
        here = (high > 0) & (low < len(anchor))
        out = np.zeros(len(anchor) + 1, np.int32)
        np.add.at(out, np.maximum(low[here], 0), 1)
        np.add.at(out, np.minimum(high[here], len(anchor)), -1)
        at = np.flatnonzero(np.cumsum(out[:-1]) == 0)
        if not len(at):
            continue
        named = anchor[at]
        new = np.flatnonzero(np.r_[True, (named[1:] != named[:-1]) | (at[1:] != at[:-1] + 1)])
        last = np.r_[new[1:], len(at)] - 1
        found.append((at[new] + begin, at[last] + begin, named[new] + begin, grams[named[new]].view(np.int64)))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _later(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Whether each row is not the first of its keys; `order` says what comes first."""
    by = np.lexsort([order, *keys])
    same = np.ones(max(0, len(by) - 1), bool)
    for key in keys:
        same &= key[by][1:] == key[by][:-1]
    out = np.zeros(len(by), bool)
    out[by[1:]] = same
    return out


def _merged(start: np.ndarray, end: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges that overlap or touch in one text, made one."""
    if not len(start):
        return start, end, text
    by = np.argsort(start, kind="stable")
    start, end, text = start[by], end[by], text[by]
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.r_[True, (start[1:] > reach[:-1]) | (text[1:] != text[:-1])])
    return start[new], reach[np.r_[new[1:], len(start)] - 1], text[new]


_CONTEXT = "gram long, single boolean, doc_id long, unit long, idx int, start long, size long, place int, bytes binary"
_CONTEXT_ARROW = pa.schema([("gram", pa.int64()), ("single", pa.bool_()), ("doc_id", pa.int64()), ("unit", pa.int64()), ("idx", pa.int32()), ("start", pa.int64()), ("size", pa.int64()), ("place", pa.int32()), ("bytes", pa.binary())])
_RANGE = "unit long, idx int, start long, size long"
_RANGE_ARROW = pa.schema([("unit", pa.int64()), ("idx", pa.int32()), ("start", pa.int64()), ("size", pa.int64())])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deals texts to units and numbers them there."""
    from pyspark import TaskContext

    unit, size, idx = TaskContext.get().partitionId() << 32, 0, 0
    for batch in batches:
        ends, cut, low = _flat(batch.column(1))[1], [], 0
        numbers, units = np.empty(batch.num_rows, np.int32), np.empty(batch.num_rows, np.int64)
        for k, n in enumerate(np.diff(ends).tolist()):
            if size and size + n > UNIT_BYTES or idx >= 1 << 20:
                cut.append(k)
                unit, size, idx = unit + 1, 0, 0
            numbers[k], units[k], size, idx = idx, unit, size + n, idx + 1
        for high in [*cut, batch.num_rows]:
            if high > low:
                part = slice(low, high)
                yield pa.record_batch([pa.array(units[part]), pa.array(numbers[part]), batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low)], names=["unit", "idx", "doc_id", "bytes"])
            low = high


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each unit's grams and how often they are anchors there."""
    for batch in batches:
        units = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(units[1:] != units[:-1]) + 1).tolist(), len(units)]
        for low, high in zip(edges, edges[1:], strict=False):
            if high > low:
                gram, n = np.unique(_runs(*_flat(batch.column(1).slice(low, high - low)))[3], return_counts=True)
                yield pa.record_batch([pa.array(gram), pa.array(np.full(len(gram), units[low])), pa.array(n.astype(np.int64))], names=["gram", "unit", "n"])


def _contexts(texts: pa.Table, grams: pa.Table) -> pa.Table:
    """The first of each context of a unit around repeated grams; ranges of later copies have no bytes."""
    if not texts.num_rows or not grams.num_rows:
        return _CONTEXT_ARROW.empty_table()
    data, ends = _flat(texts["bytes"])
    low, high, anchor, gram = _runs(data, ends)
    wanted = grams["gram"].to_numpy()
    by = np.argsort(wanted)
    wanted, hot = wanted[by], grams["hot"].to_numpy(zero_copy_only=False)[by]
    at = np.minimum(np.searchsorted(wanted, gram), len(wanted) - 1)
    keep = wanted[at] == gram
    low, high, anchor, gram, hot = low[keep], high[keep], anchor[keep], gram[keep], hot[at[keep]]
    ids, idx, unit = texts["doc_id"], texts["idx"].to_numpy(), texts["unit"][0].as_py()
    known = np.array(ids.is_valid())
    rank = np.empty(len(idx), np.int64)
    rank[np.lexsort([idx, ids.fill_null(0).to_numpy(), known])] = np.arange(len(idx))
    mixed = _mix(_words(data))

    def text_of(x: np.ndarray) -> np.ndarray:
        return np.searchsorted(ends, x, "right") - 1

    def place(x: np.ndarray) -> np.ndarray:
        return (rank[text_of(x)] << 40) + x

    rows, gone = [], []
    cold = np.flatnonzero(~hot)
    a, b = low[cold], high[cold]
    shape = ((b - a) << 8) + anchor[cold] - a
    later = _later([shape, _window_hash(mixed, a, 0), _window_hash(mixed, b, 0), _window_hash(mixed, a, 1), _window_hash(mixed, b, 1)], place(a))
    gone.append((a[later], b[later] + LENGTH))
    a, b, which = a[~later], b[~later], cold[~later]
    whole = data.tobytes()
    rows.append((gram[which], False, a, b + LENGTH - a, anchor[which] - a, [whole[x:y] for x, y in zip(a.tolist(), (b + LENGTH).tolist(), strict=True)]))
    if hot.any():
        a, count = low[hot], (high - low + 1)[hot]
        single = np.repeat(a - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        one, two = _window_hash(mixed, single, 0), _window_hash(mixed, single, 1)
        later = _later([one, two], place(single))
        gone.append((single[later], single[later] + LENGTH))
        single, one, two = single[~later], one[~later], two[~later]
        rows.append((one.view(np.int64), True, single, np.full(len(single), LENGTH), np.zeros(len(single), np.int64), [x.tobytes() for x in two]))
    start, end = (np.concatenate(x) for x in zip(*gone, strict=True))
    start, end, _ = _merged(start, end, text_of(start))
    rows.append((_mix(start.astype(np.uint64) + np.uint64(unit)).view(np.int64), False, start, end - start, np.zeros(len(start), np.int64), None))
    tables = []
    for key, alone, start, size, offset, held in rows:
        text, n = text_of(start), len(start)
        tables.append(pa.table([
            pa.array(key), pa.array(np.full(n, alone)), ids.take(pa.array(text)).cast(pa.int64()), pa.array(np.full(n, unit, np.int64)), pa.array(idx[text].astype(np.int32)),
            pa.array(start - ends[text]), pa.array(size.astype(np.int64)), pa.array(offset.astype(np.int32)), pa.nulls(n, pa.binary()) if held is None else pa.array(held, pa.binary()),
        ], schema=_CONTEXT_ARROW))
    return pa.concat_tables(tables)


def previous_factors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each suffix (at `starts`, ascending, `length` bytes long at least) the
    longest previous factor: how many bytes, `length` at most, it has in common
    with a suffix of `starts` before it.  Values under `length` may be too small:
    the search for a smaller position ends where the common prefix falls short.
    """
    if len(starts) < 2:
        return np.zeros(len(starts), np.int64)
    steps = [*range(0, length - 8, 8), length - 8] if length > 8 else [0]
    words = _words(data, ">")
    keys = [words[starts + s] for s in steps]
    order = np.lexsort(keys[::-1])  # stable: equal ones stay in order of position
    position = starts[order]
    # common prefix of each suffix with the one above it
    common, open_ = np.zeros(len(order), np.int64), np.ones(len(order), bool)
    open_[0] = False
    for step, key in zip(steps, keys, strict=True):
        key = key[order]
        apart = key ^ np.r_[key[:1], key[:-1]]
        differs = open_ & (apart != 0)
        zeros = np.zeros(len(order), np.int64)
        for byte in range(1, 8):  # leading bytes that agree
            zeros += (apart >> np.uint64(64 - 8 * byte)) == 0
        common[differs] = step + zeros[differs]
        open_ &= ~differs
    common[open_] = length
    common = np.minimum(common, length)
    best = np.zeros(len(order), np.int64)
    for side in (-1, 1):
        here = np.arange(len(order))
        to = here + side
        shared = common.copy() if side < 0 else np.r_[common[1:], 0]
        there = (to >= 0) & (to < len(order))
        shared[~there] = 0
        while len(go := np.flatnonzero(there & (shared >= length) & (position[np.clip(to, 0, len(order) - 1)] > position))):
            # all between a suffix and its pointer start later than it, and so do those between that and its own pointer
            shared[go], to[go] = np.minimum(shared[go], shared[to[go]]), to[to[go]]
            there = (to >= 0) & (to < len(order))
            shared[~there] = 0
        best = np.maximum(best, shared)
    out = np.empty(len(order), np.int64)
    out[order] = best
    return out


def _copied(held: list[bytes]) -> list[tuple[int, int, int]]:
    """Ranges (which, start, end) of `held`, in order of place, that earlier ones hold too."""
    sizes = np.array([len(x) for x in held])
    data, begins = np.frombuffer(b"".join(held), np.uint8), np.r_[0, np.cumsum(sizes)[:-1]]
    count = sizes - LENGTH + 1
    starts = np.repeat(begins - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    key = _window_hash(_mix(_words(data)), starts, 0)
    value, back, n = np.unique(key, return_inverse=True, return_counts=True)
    starts = starts[n[back] > 1]  # a window alone has no earlier copy
    starts = starts[previous_factors(data, starts) >= LENGTH]
    which = np.searchsorted(begins, starts, "right") - 1
    low, high, which = _merged(starts, starts + LENGTH, which)
    return list(zip(which.tolist(), (low - begins[which]).tolist(), (high - begins[which]).tolist(), strict=True))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of later copies, from contexts sorted by gram and place."""
    out: list[tuple[int, int, int, int]] = []
    waiting: list[tuple[int, int, int, bytes]] = []
    group: list[tuple[int, int, int, bytes]] = []
    key, seen, size = None, set(), 0

    def resolved() -> None:
        for k, low, high in _copied([x[3] for x in waiting]):
            unit, idx, start, _ = waiting[k]
            out.append((unit, idx, start + low, high - low))
        waiting.clear()

    def table() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _RANGE_ARROW, strict=True)], schema=_RANGE_ARROW)
        out.clear()
        return made

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6, 7, 8)]
        for gram, single, unit, idx, start, length, place, held in zip(*columns, strict=True):
            if held is None:
                out.append((unit, idx, start, length))
                continue
            if (gram, single) != key:
                if len(group) > 1 and not key[1]:
                    waiting += group
                    size += sum(len(x[3]) for x in group)
                    if size > ARRAY_BYTES:
                        resolved()
                        size = 0
                key, seen, group = (gram, single), set(), []
            if (place, held) in seen:
                out.append((unit, idx, start, length))
            else:
                seen.add((place, held))
                group.append((unit, idx, start, held))
        if len(out) >= 10_000:
            yield table()
    if len(group) > 1 and not key[1]:
        waiting += group
    if waiting:
        resolved()
    if out:
        yield table()


_KEPT = "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, end: long>>"
_KEPT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _cut(texts: pa.Table, ranges: pa.Table) -> pa.Table:
    """What is left of each text of a unit, and the maximal runs removed."""
    if not texts.num_rows:
        return _KEPT_ARROW.empty_table()
    data, ends = _flat(texts["bytes"])
    row = np.empty(int(texts["idx"].to_numpy().max()) + 1, np.int64)
    row[texts["idx"].to_numpy()] = np.arange(texts.num_rows)
    edge = np.zeros(len(data) + 1, np.int32)
    if ranges.num_rows:
        start = ends[row[ranges["idx"].to_numpy()]] + ranges["start"].to_numpy()
        np.add.at(edge, start, 1)
        np.add.at(edge, start + ranges["size"].to_numpy(), -1)
    gone = np.cumsum(edge[:-1]) > 0
    first = np.zeros(len(data) + 1, bool)
    first[ends] = True
    opens = np.flatnonzero(gone & (np.r_[True, ~gone[:-1]] | first[:-1])) if len(data) else np.zeros(0, np.int64)
    closes = np.flatnonzero(gone & (np.r_[~gone[1:], True] | first[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    text = np.searchsorted(ends, opens, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(opens - ends[text]), pa.array(closes - ends[text])], ["start", "end"])
    kept = np.r_[0, np.cumsum(~gone)][ends]
    left = pa.Array.from_buffers(pa.binary(), texts.num_rows, [None, pa.py_buffer(kept.astype(np.int32).tobytes()), pa.py_buffer(data[~gone].tobytes())])
    return pa.table([texts["doc_id"].combine_chunks(), pa.array(np.diff(ends)), left, pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(texts.num_rows + 1)).astype(np.int32)), spans)], schema=_KEPT_ARROW)


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_bytes (of the text in UTF-8), kept
    (the bytes that stay, in order) and spans (maximal removed runs: start, end).

    Strings are judged on the input.  Earlier means a smaller id (null before
    all), then, among rows of one id, the order of the table's files, then an
    earlier start; of repeated rows of LENGTH bytes or more one stays and the
    others lose all bytes.  A null text is empty; texts under LENGTH bytes stay
    whole; an empty table gives no rows.  Other columns are not read, whatever
    their names.  Matches never cross rows.
    """
    spark = docs.sparkSession
    scratch, source = Scratch(spark, "suffix"), docs.select(q(id_col).cast("long").alias("doc_id"), F.coalesce(q(text_col), F.lit("")).cast("binary").alias("bytes"))
    buckets = min(50_000, max(8, 2 * source.rdd.getNumPartitions()))
    name = f"texts_{uuid.uuid4().hex}"
    dealt = source.mapInArrow(_units, "unit long, idx int, doc_id long, bytes binary")
    dealt.write.bucketBy(buckets, "unit").option("compression", "zstd").option("path", f"{scratch.path}/texts").saveAsTable(name)
    texts = spark.table(name)
    grams = texts.select("unit", "bytes").mapInArrow(_grams, "gram long, unit long, n long")
    total = F.sum("n").over(Window.partitionBy("gram"))
    asked = grams.withColumn("total", total).where("total > 1").select("unit", "gram", (F.col("total") > HOT).alias("hot"))
    contexts = texts.groupBy("unit").cogroup(asked.groupBy("unit")).applyInArrow(_contexts, _CONTEXT)
    met = contexts.repartition("gram").sortWithinPartitions("gram", "single", "doc_id", "unit", "idx", "start")
    ranges = scratch.save(met.mapInArrow(_judge, _RANGE), "ranges")
    return texts.groupBy("unit").cogroup(ranges.groupBy("unit")).applyInArrow(_cut, _KEPT)


def digests(docs: DataFrame) -> DataFrame:
    """`dedupe` of (doc_id, text), in numbers and a digest of what stays."""
    return dedupe(docs).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
