"""Exact n-gram Jaccard join of documents by grouped prefixes.

A document is the set of its distinct 5-word shingles, ordered by how common
they are.  Documents that are similar enough share a shingle among their first
few (the prefix).  Documents of one set are one member; members of one prefix
and size are one group.  Groups meet in the postings of their prefix shingles;
pairs of groups are filtered by size, by place in the prefix and, by sketches of
the prefixes, by the number of shared prefix shingles, then expanded to members, which are verified on
their whole texts.

No bucket gives all its pairs.  Each group is first tried against the pivots it
shares most shingles with, which joins the large clusters in a few rounds; after
that only pairs from different components are made, and the filters drop none
that could link.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .common import Scratch, components, fresh, q
from .shingles import rows_of_words, shingle_set

WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
#: log2 of the counters that order shingles: the least and the most (64 MB in a task).
COUNTER_BITS = (16, 24)
#: Groups in a posting above which its shingle is dealt to several.
POSTING = 1024
#: Pairs that one copy of a text is verified against, on average.
HUB_PAIRS = 256
#: Bits of a prefix's sketch, in words of 64.
SKETCH = 512
_BLOCKS = 64


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles that a set of n must share with any set it links to."""
    return -(-NUMERATOR * n // DENOMINATOR)


def pair_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shingles that sets of a and b must share to link: the least o with
    DENOMINATOR * o >= NUMERATOR * (a + b - o)."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def prefix_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Prefix shingles that sets of a and b must share to link."""
    return pair_overlap(a, b) - np.maximum(least_overlap(a), least_overlap(b)) + 1


def _levels(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How common each counter's shingles are (twice the log2 of the count above
    the counters' mean), over all documents, and log2 of the counters.

    The counters are of fixed size, so they order shingles only roughly; every
    order gives the same links.
    """
    spark, rows = docs.sparkSession, docs.count()
    bits = int(min(COUNTER_BITS[1], max(COUNTER_BITS[0], math.ceil(math.log2(max(1, rows) * 400 / 16)))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, held, n, seen = np.zeros(1 << bits, np.uint32), [], 0, set()

        def flush() -> None:
            nonlocal totals
            at = np.concatenate(held)
            if len(at) < totals.size // 8:
                np.add.at(totals, at, 1)
            else:
                totals += np.bincount(at, minlength=totals.size).astype(np.uint32)
            held.clear()

        for b in batches:
            for _, words, _, _, _ in rows_of_words(b.column(1)):
                own = shingle_set(words, WORDS)
                sig = xxhash.xxh3_64_intdigest(own)
                if len(own) and sig not in seen:
                    seen.add(sig)
                    held.append((own >> np.uint64(64 - bits)).astype(np.int32))
                    n += len(own)
                    if n >= 1 << 21:
                        flush()
                        n = 0
        if held:
            flush()
        if seen:
            parts = np.split(totals, _BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(_BLOCKS), pa.int32()), pa.array([zstandard.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(zstandard.decompress(counts), np.uint32).astype(np.uint64)
                sums[block] = sums[block] + part if block in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zstandard.compress(s.tobytes(), 1) for s in sums.values()], pa.binary())], ["block", "counts"])

    kind = "block int, counts binary"
    parts = docs.select("k", "text").mapInArrow(count, kind).repartition(_BLOCKS, "block").mapInArrow(add, kind).collect()  # fixed size
    counts = np.zeros(1 << bits, np.float64)
    span = (1 << bits) // _BLOCKS
    for p in parts:
        counts[p.block * span : (p.block + 1) * span] = np.frombuffer(zstandard.decompress(p.counts), np.uint64)
    net = np.maximum(counts - counts.mean(), 0) + 1
    return np.minimum(63, 2 * np.log2(net)).astype(np.uint8), bits


def _entries(docs: DataFrame, levels: np.ndarray, bits: int) -> DataFrame:
    """Prefix entries and, under salt -1, one row per document: key (shingle, or
    signature of the set), salt, gid, np (size and place), k, doc_id."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of, seen = sent.value, set()
        salts = np.maximum(1, np.ceil(2.0 ** ((np.arange(64) + 1) / 2) / POSTING)).astype(np.uint64)
        for b in batches:
            # per document: sig, gid, n; per entry: shingle, salt, gid, np
            sigs, gids, sizes = [np.zeros(b.num_rows, t) for t in (np.uint64, np.uint64, np.int64)]
            keys, salted, owners, places = [], [], [], []
            for row, words, _, _, _ in rows_of_words(b.column(1)):
                own = shingle_set(words, WORDS)
                n = len(own)
                if not n:
                    continue
                level = level_of[own >> np.uint64(64 - bits)]
                first = n - int(least_overlap(n)) + 1
                rank = (level.astype(np.uint64) << np.uint64(58)) | (own >> np.uint64(6))
                order = np.argsort(rank, kind="stable")[:first]
                prefix = own[order]
                gid = xxhash.xxh3_64_intdigest(prefix, seed=n)
                sigs[row], gids[row], sizes[row] = xxhash.xxh3_64_intdigest(own), gid, n
                if gid not in seen:
                    seen.add(gid)
                    deal = salts[level[order]]
                    keys.append(prefix)
                    salted.append(((np.uint64(gid) % deal) << np.uint64(32)) | deal)
                    owners.append(np.full(first, gid, np.uint64))
                    places.append((np.int64(n) << 32) | np.arange(first))
            yield _batch(_signed(sigs), np.full(b.num_rows, -1), _signed(gids), sizes << 32, b.column(0), b.column(2))
            if keys:
                flat = [np.concatenate(x) for x in (keys, salted, owners, places)]
                for at in range(0, len(flat[0]), 100_000):
                    cut = [x[at : at + 100_000] for x in flat]
                    none = pa.nulls(len(cut[0]), pa.int64())
                    yield _batch(_signed(cut[0]), _signed(cut[1]), _signed(cut[2]), cut[3], none, none)

    return docs.select("k", "text", "doc_id").mapInArrow(run, "key long, salt long, gid long, np long, k long, doc_id long")


def _batch(key, salt, gid, size, k, doc_id) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(salt, pa.int64()), pa.array(gid, pa.int64()), pa.array(size, pa.int64()), k, doc_id], ["key", "salt", "gid", "np", "k", "doc_id"])


def _groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Of batches sorted by their first two columns: the columns of whole runs of
    equal (first, second) and the runs' edges; a run never spans two results."""
    tail: list[list[np.ndarray]] = []
    last = None
    for b in batches:
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in range(columns)]
        if not len(cols[0]):
            continue
        change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
        starts_new = last is not None and last != (cols[0][0], cols[1][0])
        last = (cols[0][-1], cols[1][-1])
        if starts_new:
            yield _whole(tail)
            tail = []
        if not len(change):
            tail.append(cols)
            continue
        cut = change[-1]
        yield _whole([*tail, [c[:cut] for c in cols]])
        tail = [[c[cut:] for c in cols]]
    if tail:
        yield _whole(tail)


def _whole(parts: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    cols = [np.concatenate(x) for x in zip(*parts)]
    change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
    return cols, np.concatenate(([0], change, [len(cols[0])]))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings with two groups or more (or dealt to several) as arrays, and the document rows."""

    def postings() -> Iterator[pa.RecordBatch]:
        for (key, salt, gid, size), edges in _groups(iter(entries), 4):
            keep = np.ones(len(key), bool)
            keep[1:] = (gid[1:] != gid[:-1]) | (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
            run = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[keep]
            many = np.bincount(run, minlength=len(edges) - 1)
            wanted = (many > 1) | ((salt[edges[:-1]] & 0xFFFFFFFF) > 1)
            chosen = wanted[run]
            if chosen.any():
                ends = np.concatenate(([0], np.cumsum(many[wanted]))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[keep][chosen])) for x in (gid, size)]
                at = edges[:-1][wanted]
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), np.int32)), pa.array(key[at]), pa.array(salt[at]), *lists, none, none], names)

    names = ["kind", "key", "salt", "gids", "nps", "k", "doc_id"]
    entries: list[pa.RecordBatch] = []

    def split() -> Iterator[tuple[bool, pa.RecordBatch]]:
        for b in batches:
            doc = pa.compute.equal(b.column("salt"), -1)
            docs = b.filter(doc)
            if docs.num_rows:
                yield True, docs
            rest = b.filter(pa.compute.invert(doc))
            if rest.num_rows:
                yield False, rest

    import pyarrow.compute  # noqa: F401

    source = split()
    pending: list[pa.RecordBatch] = []

    def only_entries() -> Iterator[pa.RecordBatch]:
        for is_doc, b in source:
            if is_doc:
                pending.append(b)
            else:
                yield b

    def documents() -> Iterator[pa.RecordBatch]:
        while pending:
            b = pending.pop()
            n = b.num_rows
            one = pa.array(np.arange(n + 1, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), b.column("key"), b.column("salt"), pa.ListArray.from_arrays(one, b.column("gid")), pa.ListArray.from_arrays(one, b.column("np")), b.column("k"), b.column("doc_id")], names)

    entries = only_entries()  # type: ignore[assignment]
    for made in postings():
        yield from documents()
        yield made
    yield from documents()


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each posting, (group, the posting's pivot, size of the group, shared
    shingles).  Rows sorted by key and salt: key, salt, gid, np, weight.  The pivot
    is the group of greatest weight: the one whose prefix is most shared, so the
    original among edited copies."""
    for (_, _, gid, size, weight), edges in _groups(batches, 5):
        many = np.diff(edges)
        run = np.repeat(np.arange(len(many)), many)
        head = np.lexsort((gid, -weight, run))[edges[:-1]]
        n = size >> 32
        pivot, other = np.repeat(gid[head], many), np.repeat(n[head], many)
        fits = (gid != pivot) & (NUMERATOR * np.maximum(n, other) <= DENOMINATOR * np.minimum(n, other))
        if fits.any():
            pairs, count = np.unique(np.stack([gid[fits], pivot[fits], n[fits]], axis=1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(pairs[:, c])) for c in range(3)), pa.array(count)], ["x", "p", "n", "c"])


def _may_share(need: np.ndarray, sides: tuple[np.ndarray, np.ndarray], words: tuple[list[np.ndarray], list[np.ndarray]]) -> np.ndarray:
    """Whether two prefixes can share `need` shingles, from how many shared
    shingles each has and the parities of their sketches: what only one of them
    has leaves at least as many shingles as odd bits."""
    odd = np.zeros(len(need), np.int64)
    for x, y in zip(*words):
        odd += np.bitwise_count((x ^ y).view(np.uint64))
    return sides[0] + sides[1] - odd >= 2 * need


def _cross(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...] | None) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of groups (gid, size, place, shared shingles before that place, least
    and greatest component, shared shingles, sketch) of one posting, or of two of
    one shingle, that are not yet known to be linked and that size, place and
    sketch allow: ids and sizes, some at a time.  A pair is left out where the
    shingle cannot be the first that both have, so most pairs are made once."""
    gid, n, pos, before, low, high, shared, *sketch = a
    whole = low == high
    names, count = np.unique(low[whole], return_counts=True) if whole.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    most = names[count.argmax()] if len(names) else None
    minor = np.flatnonzero(~whole | (low != most)) if most is not None else np.arange(len(gid))
    second = np.zeros(len(gid), bool)
    second[minor] = True
    left, other = (minor, a) if b is None else (np.arange(len(gid)), b)
    g2, n2, p2, b2, l2, h2, s2, *k2 = other
    for at in range(0, len(left), 256):
        i = left[at : at + 256]
        x, y = np.maximum(n[i, None], n2), np.minimum(n[i, None], n2)
        ok = (NUMERATOR * x <= DENOMINATOR * y) & (gid[i, None] != g2)
        same = whole[i, None] & (l2 == h2) & (low[i, None] == l2)
        reach = np.minimum(before[i, None], b2) + np.minimum(n[i, None] - pos[i, None], n2 - p2)
        ok &= ~same & (reach >= pair_overlap(n[i, None], n2))
        if b is None:  # a pair of two minor groups once
            ok &= ~second[None] | (np.arange(len(gid))[None] > i[:, None])
        u, v = np.nonzero(ok)
        for cut in range(0, len(u), 1 << 16):
            p, r = i[u[cut : cut + (1 << 16)]], v[cut : cut + (1 << 16)]
            need = prefix_overlap(n[p], n2[r])
            # from the first shingle that both have, as many are left in either prefix
            keep = np.minimum(shared[p] - before[p], s2[r] - b2[r]) >= need
            p, r, need = p[keep], r[keep], need[keep]
            keep = _may_share(need, (shared[p], s2[r]), ([w[p] for w in sketch], [w[r] for w in k2]))
            if keep.any():
                p, r = p[keep], r[keep]
                yield gid[p], g2[r], n[p], n2[r]


def _counted(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch | None:
    cols = [np.concatenate(x) for x in zip(*found)] if found else []
    if not cols or not len(cols[0]):
        return None
    flip = cols[0] > cols[1]
    a, b, na, nb = np.where(flip, cols[1], cols[0]), np.where(flip, cols[0], cols[1]), np.where(flip, cols[3], cols[2]), np.where(flip, cols[2], cols[3])
    rows, count = np.unique(np.stack([a, b, na, nb], axis=1), axis=0, return_counts=True)
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(rows[:, c])) for c in range(4)), pa.array(count)], ["a", "b", "na", "nb", "c"])


_WORDS = tuple(f"w{i}" for i in range(SKETCH // 64))
_LISTS = ("gids", "nps", "befores", "lows", "highs", "shareds", *(w + "s" for w in _WORDS))
_PAIR = "a long, b long, na long, nb long, c long"


def _side(gid: np.ndarray, size: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    return gid, size >> 32, size & 0xFFFFFFFF, *more


def _pairs(runs: Iterator[Iterator[tuple[np.ndarray, ...]]]) -> Iterator[pa.RecordBatch]:
    """The pairs that `_cross` gives for each of `runs`, counted some at a time."""
    found, held = [], 0
    for run in runs:
        for part in run:
            found.append(part)
            held += len(part[0])
            if held > 200_000:
                yield _counted(found)
                found, held = [], 0
    if found:
        yield _counted(found)


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of groups in the same posting that may link across components; rows
    sorted by key and salt: key, salt, gid, np, then as `_cross` has them."""

    def runs() -> Iterator[Iterator[tuple[np.ndarray, ...]]]:
        for (_, _, *cols), edges in _groups(batches, 2 + len(_LISTS)):
            least, most = np.minimum.reduceat(cols[3], edges[:-1]), np.maximum.reduceat(cols[4], edges[:-1])
            for r in np.flatnonzero((least != most) & (np.diff(edges) > 1)):
                yield _cross(_side(*(c[edges[r] : edges[r + 1]] for c in cols)), None)

    return _pairs(runs())


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As `_within`, for rows of two postings of one dealt-out shingle."""

    def runs() -> Iterator[Iterator[tuple[np.ndarray, ...]]]:
        for b in batches:
            for r in range(b.num_rows):
                one, two = (_side(*(b.column(c + side)[r].values.to_numpy(zero_copy_only=False) for c in _LISTS)) for side in ("1", "2"))
                yield _cross(one, two)

    return _pairs(runs())


class _Join:
    """One run of the join; its tables live in a scratch folder."""

    def __init__(self, docs: DataFrame):
        self.scratch = Scratch(docs.sparkSession, "ngrams")
        self.spark = docs.sparkSession
        text = F.col("text").cast("string")
        # k finds a member's row again
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("k", F.xxhash64("doc_id", "text"))
        self.turn = 0

    def release(self) -> None:
        """Lets Spark delete shuffle files of plans that have run."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def run(self) -> DataFrame:
        levels, bits = _levels(self.docs)
        entries = _entries(self.docs, levels, bits)
        dealt = entries.withColumn("deal", F.when(F.col("salt") == -1, F.col("k")).otherwise(F.col("key"))).repartition("deal", "salt").drop("deal")
        sorted_rows = dealt.sortWithinPartitions("key", "salt", "gid")
        rows = self.scratch.save(sorted_rows.mapInArrow(_collapse, "kind int, key long, salt long, gids array<long>, nps array<long>, k long, doc_id long"), "rows", "kind")
        self.release()
        self.postings = rows.where("kind = 0").select("key", "salt", "gids", "nps")
        self.entries = self.scratch.save(self.shared_entries(), "entries")
        members = rows.where("kind = 1").select("doc_id", "k", F.col("key").alias("sig"), F.col("gids")[0].alias("gid"), F.shiftright(F.col("nps")[0], 32).alias("n"))
        # one row per distinct set
        self.sets = self.scratch.save(members.where("n > 0").groupBy("sig", "gid", "n").agg(F.min("doc_id").alias("doc_id"), F.min("k").alias("k")), "sets")
        leads = self.scratch.save(self.sets.groupBy("gid").agg(F.min("sig").alias("lead"), F.count("*").alias("members")), "leads")
        edges = self.verify(self.first_pairs(leads))
        comps = components(edges, self.scratch, "cc0")
        self.release()
        pairs = self.group_pairs(comps)
        self.release()
        comps = self.finish(pairs, leads, edges, comps)
        named = self.sets.join(comps.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "doc_id", F.coalesce("comp", "sig").alias("comp"))
        least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        labels = self.scratch.save(named.join(least, "comp").select("sig", "comp", "component_id"), "labels")
        out = members.join(labels, "sig", "left")
        out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "k", "comp")
        linked = self.scratch.save(out, "linked")
        self.scratch.keep("linked")
        return linked

    def shared_entries(self) -> DataFrame:
        """Entries of postings with two groups or more: key, salt, gid, np, `before`
        (the group's entries of lesser place; its other prefix shingles are in no
        other prefix) and `weight` (mean size of the postings of its prefix)."""
        flat = self.postings.select("key", "salt", F.size("gids").alias("m"), F.explode(F.arrays_zip("gids", "nps")).alias("e")).select("key", "salt", "m", F.col("e.gids").alias("gid"), F.col("e.nps").alias("np"))
        own, n = Window.partitionBy("gid"), F.shiftright("np", 32)
        prefix = n - F.ceil(NUMERATOR * n / DENOMINATOR) + 1
        placed = flat.withColumn("before", F.row_number().over(own.orderBy("np", "key")).cast("long") - 1).withColumn("weight", F.sum("m").over(own) / prefix)
        return placed.drop("m")

    def first_pairs(self, leads: DataFrame) -> DataFrame:
        """Member pairs to try first: each group's members against the leads of the
        two pivots it shares most shingles with, and members against their lead."""
        by_posting = self.entries.select("key", "salt", "gid", "np", "weight").repartition("key", "salt").sortWithinPartitions("key", "salt")
        own = by_posting.mapInArrow(_pivots, "x long, p long, n long, c long")
        # postings that a common shingle was dealt to meet in the best of their pivots
        hot = self.entries.where("(salt & 4294967295) > 1").groupBy("key", "salt").agg(F.max(F.struct("weight", F.bitwise_not("gid").alias("g"))).alias("top"))
        best = hot.groupBy("key").agg(F.max("top").alias("best"))
        across = hot.join(best, "key").where("top.g <> best.g").select(F.bitwise_not("top.g").alias("x"), F.bitwise_not("best.g").alias("p"), F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("c"))
        counted = own.unionAll(across).groupBy("x", "p").agg(F.sum("c").alias("c"), F.max("n").alias("n")).where("c >= 0.06 * n")
        best = counted.groupBy("x").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "p")), False), 1, 2).alias("best"))
        group_pairs = best.select("x", F.explode("best").alias("b")).select("x", F.col("b.p").alias("p"))
        lead = leads.select(F.col("gid").alias("p"), F.col("lead").alias("b"))
        tried = group_pairs.join(self.sets.select(F.col("gid").alias("x"), F.col("sig").alias("a")), "x").join(lead, "p").select("a", "b")
        inside = self.sets.join(leads.where("members > 1"), "gid").select(F.col("sig").alias("a"), F.col("lead").alias("b"))
        return tried.unionAll(inside).where("a <> b")

    def group_pairs(self, comps: DataFrame) -> DataFrame:
        """Pairs of groups that may link and are in different components (or hold
        members of several): a, b."""
        named = self.sets.join(comps.withColumnRenamed("node", "sig"), "sig", "left").select("gid", F.coalesce("comp", "sig").alias("comp"))
        group = self.scratch.save(named.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high")), "groups")
        placed = self.entries.join(group, "gid").select("key", "salt", "gid", "np", "before", "low", "high")
        # postings whose groups are all in one component make no pairs
        own = Window.partitionBy("key", "salt")
        apart = F.min("low").over(own) != F.max("high").over(own)
        mixed = placed.repartition("key", "salt").withColumn("apart", apart).where("apart or (salt & 4294967295) > 1")
        mixed = self.scratch.save(mixed, "mixed")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("key").bitwiseAND(63).cast("int"))
        word = F.shiftright("key", 6).bitwiseAND(len(_WORDS) - 1)
        sketch = self.entries.groupBy("gid").agg(F.count("*").alias("shared"), *[F.bit_xor(F.when(word == i, bit).otherwise(0)).alias(w) for i, w in enumerate(_WORDS)])
        sketch = sketch.join(mixed.select("gid").distinct(), "gid", "left_semi")
        entries = mixed.join(sketch, "gid").select("key", "salt", "gid", "np", "before", "low", "high", "shared", *_WORDS, "apart")
        by_posting = entries.where("apart").drop("apart").repartition("key", "salt").sortWithinPartitions("key", "salt")
        found = by_posting.mapInArrow(_within, _PAIR)
        dealt = entries.where("(salt & 4294967295) > 1")
        if not self.postings.where("(salt & 4294967295) > 1").isEmpty():
            several = dealt.groupBy("key").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("key")
            lists = [F.col("e." + c[:-1]).alias(c) for c in _LISTS]
            chunks = dealt.join(several, "key").groupBy("key", "salt").agg(F.collect_list(F.struct(*[c[:-1] for c in _LISTS])).alias("e")).select("key", "salt", *lists)
            chunks = self.scratch.save(chunks, "chunks")
            one, two = (chunks.select("key", *[F.col(c).alias(c + s) for c in ("salt", *_LISTS)]) for s in ("1", "2"))
            found = found.unionAll(one.join(two, "key").where("salt1 < salt2").drop("key", "salt1", "salt2").mapInArrow(_between, _PAIR))
        counted = found.groupBy("a", "b").agg(F.sum("c").alias("c"))
        return self.scratch.save(counted.select("a", "b", "c"), "pairs")

    def inside_pairs(self, members: DataFrame, comps: DataFrame) -> DataFrame:
        """Member pairs of one group (gid, sig) from different components.  Only
        members outside the group's largest component look for partners, so a group
        that its lead has joined makes none."""
        named = members.join(comps.select(F.col("node").alias("sig"), "comp"), "sig", "left").select("gid", "sig", F.coalesce("comp", "sig").alias("comp"))
        sizes = named.groupBy("gid", "comp").agg(F.count("*").alias("m"))
        most = sizes.groupBy("gid").agg(F.max_by("comp", F.struct("m", "comp")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
        told = self.scratch.save(named.join(most, "gid").select("gid", "sig", "comp", (F.col("comp") != F.col("most")).alias("minor")), "inside")
        left = told.where("minor").select("gid", F.col("sig").alias("a"), F.col("comp").alias("ca"))
        right = told.select("gid", F.col("sig").alias("b"), F.col("comp").alias("cb"), "minor")
        return left.join(right, "gid").where("ca <> cb and (not minor or a < b)").select("a", "b", F.lit(1 << 30).cast("long").alias("c"))

    def finish(self, pairs: DataFrame, leads: DataFrame, edges: DataFrame, comps: DataFrame) -> DataFrame:
        """Expands the pairs of groups to members and verifies until every pair is
        verified or joined otherwise; the components."""
        member = self.sets.select("gid", "sig")
        left, right = member.select(F.col("gid").alias("a"), F.col("sig").alias("x")), member.select(F.col("gid").alias("b"), F.col("sig").alias("y"))
        two = pairs.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"), "c")
        same = self.inside_pairs(member.join(leads.where("members > 2").select("gid"), "gid"), comps)
        rest = self.scratch.save(two.unionAll(same), "rest0")
        size = self.sets.count()
        while True:
            self.turn += 1
            name = {s: comps.select(F.col("node").alias(s), F.col("comp").alias("c" + s)) for s in "ab"}
            open_pairs = rest.join(name["a"], "a", "left").join(name["b"], "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "c")
            rest = self.scratch.save(open_pairs, f"rest{self.turn}")
            n = rest.count()
            if not n:
                return comps
            if n <= max(10_000, size):  # no more than a pair for each set
                batch, last = rest.select("a", "b"), True
            else:  # for each member the pair with most shared shingles; the others wait
                best = rest.groupBy("a").agg(F.max(F.struct("c", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
                batch, last = self.scratch.save(best, f"batch{self.turn}"), False
            edges = self.scratch.save(edges.unionAll(self.verify(batch)), f"edges{self.turn}")
            comps = components(edges, self.scratch, f"cc{self.turn}")
            if last:
                return comps
            rest = self.scratch.save(rest.join(batch, ["a", "b"], "left_anti"), f"open{self.turn}")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b signatures) whose whole texts link.

        A pair's hub is its side with more pairs.  The hub's text is sent once for
        every HUB_PAIRS of its pairs or so, that of the other side with each pair, so
        the text of a cluster's centre is not copied for each of its members.
        """
        self.turn += 1
        pairs = self.scratch.save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"try{self.turn}")
        degree = pairs.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.count("*").alias("degree"))
        nodes = degree.join(self.sets.select("sig", "k"), "sig").withColumn("h", F.xxhash64("k"))
        nodes = self.scratch.save(nodes, f"nodes{self.turn}")
        n = nodes.count()
        if not n:
            return pairs
        log2 = bloom.size_for(n)
        sent = self.spark.sparkContext.broadcast(bloom.build(nodes, "h", log2))

        def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = sent.value
            for b in batches:
                yield b.select(["k", "text"]).filter(pa.array(bloom.might_have(words, b.column("h").to_numpy(zero_copy_only=False), log2)))

        some = self.docs.select("k", "text", F.xxhash64("k").alias("h")).mapInArrow(wanted, "k long, text string")
        once = some.withColumn("same", F.xxhash64("text")).dropDuplicates(["k", "same"])  # of repeated rows one
        texts = self.scratch.save(once.join(nodes.select("k", "sig"), "k").select("sig", "text"), f"texts{self.turn}")
        for s in "ab":
            pairs = pairs.join(nodes.select(F.col("sig").alias(s), F.col("degree").alias("d" + s)), s)
        first = F.col("da") >= F.col("db")
        sides = pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("leaf"), F.greatest("da", "db").alias("d"))
        sides = sides.select("hub", F.pmod(F.xxhash64("leaf"), F.ceil(F.col("d") / HUB_PAIRS)).alias("salt"), "leaf")
        hubs = sides.select("hub", "salt").distinct().join(texts.withColumnRenamed("sig", "hub"), "hub").select("hub", "salt", F.lit(None).cast("long").alias("leaf"), "text")
        leaves = sides.join(texts.withColumnRenamed("sig", "leaf"), "leaf").select("hub", "salt", "leaf", "text")
        met = hubs.unionAll(leaves).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.asc_nulls_first("leaf"))

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, x = None, np.zeros(0, np.uint64)
            for b in batches:
                yes = np.zeros(b.num_rows, bool)
                hub, leaf = b.column("hub").to_pylist(), b.column("leaf").to_pylist()
                for r, words, _, _, _ in rows_of_words(b.column("text")):
                    y = shingle_set(words, WORDS)
                    # k can stand for several texts; only that of the signature counts
                    sig = int(np.uint64(xxhash.xxh3_64_intdigest(y)).astype(np.int64))
                    if leaf[r] is None and sig == hub[r]:
                        last, x = sig, y
                    elif leaf[r] == sig and last == hub[r]:
                        short, long = (x, y) if len(x) <= len(y) else (y, x)
                        at = np.searchsorted(long, short)
                        at[at == len(long)] = 0
                        both = int((long[at] == short).sum())
                        yes[r] = DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)
                linked = b.filter(pa.array(yes))
                yield pa.RecordBatch.from_arrays([linked.column("hub"), linked.column("leaf")], ["a", "b"])

        edges = met.select("hub", "leaf", "text").mapInArrow(check, "a long, b long")
        made = self.scratch.save(edges.distinct(), f"links{self.turn}")
        self.scratch.drop(f"texts{self.turn}")
        return made


def link(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text; other columns are ignored): doc_id,
    n_shingles, component_id (the smallest doc_id reachable by links), k (a hash
    of doc_id and text) and comp (a number of its component; null without shingles).

    Null, empty and blank texts have no shingles and stand alone, under their own
    doc_id.  Null doc_ids take part and name no component.  Repeated rows and
    copies are linked.  An empty table gives no rows.  Sets and shingles are told
    apart by 64-bit hashes.
    """
    return _Join(docs).run()


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without all but one document of each component: that of
    the smallest doc_id (null last, then by a hash of the row), all columns as
    they are.  Rows without shingles stay; of rows repeated under one doc_id and
    text any one does."""
    (key,) = fresh(docs, "__k")
    keyed = docs.withColumn(key, F.xxhash64(q("doc_id").cast("long"), q("text").cast("string")))
    linked = link(docs).where("n_shingles > 0")
    first = linked.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("m")).select("comp", F.col("m.k").alias("first"))
    gone = linked.join(first, "comp").where("k <> first").select("k").distinct()
    kept = keyed.join(gone, q(key) == gone.k, "left_anti")
    twice = linked.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    names = [q(c) for c in docs.columns]
    if twice.isEmpty():
        return kept.select(names)
    again = kept.join(twice, q(key) == twice.k, "left_semi").dropDuplicates([key]).select(names)
    return kept.join(twice, q(key) == twice.k, "left_anti").select(names).unionAll(again)
