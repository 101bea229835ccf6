"""Benchmark decontamination: rare n-gram seeds, whole and gapped, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, q
from .shingles import MARKS, mix, ngrams, rows_of_words

#: Words of a seed; the share of all documents up to which a seed is rare.
SEED_WORDS, RARE_SHARE = 3, 0.001
#: An item of fewer words is found where its words stand in a row, without a seed; one of a single word only where it is all of a text.
MIN_WORDS = 5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least score of a hit, as a share of the score of the item's own text.
MIN_SCORE = 0.35
#: Pairs of words that are compared at once for the bounds of a score.
PAIRS = 1 << 20
#: Items, and bytes of their texts, that are looked for in one pass over the documents.
PASS_ITEMS, PASS_BYTES = 20_000, 16 << 20


def smith_waterman(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local score of two sequences of word hashes, and the stretch of `words`
    (first, end) that it covers; of equal scores the earliest end."""
    n = len(words)
    places = np.arange(n + 1, dtype=np.int32)
    row, origin = np.zeros(n + 1, np.int32), places.copy()
    best = (0, 0, 0)
    for w in item:
        diagonal = row[:-1] + np.where(words == w, MATCH, MISMATCH).astype(np.int32)
        up = row[1:] + GAP
        body = np.maximum(np.maximum(diagonal, up), 0)
        source = np.where(body == 0, places[1:], np.where(body == diagonal, origin[:-1], origin[1:]))
        new = np.concatenate(([0], body)).astype(np.int32)
        # gaps along the row: the greatest earlier cell less the steps from it
        lifted = new - GAP * places
        top = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == top, places, 0))
        new = np.maximum(top + GAP * places, 0).astype(np.int32)
        source = np.concatenate(([0], source)).astype(np.int32)[at]
        row, origin = new, np.where(new == 0, places, source)
        end = int(row.argmax())
        if row[end] > best[0]:
            best = (int(row[end]), int(origin[end]), end)
    return best


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's seeds and the word each begins with: runs of SEED_WORDS words,
    and those of one word more with the last but one left open, so that a copy in
    which every third word is another one still has seeds."""
    runs = ngrams(words, SEED_WORDS)
    if len(words) <= SEED_WORDS:
        return runs, np.arange(len(runs))
    gapped = mix(ngrams(words, SEED_WORDS - 1)[: len(runs) - 1] + mix(words[SEED_WORDS:] ^ np.uint64(SEED_WORDS)))
    return np.concatenate((runs, gapped)), np.concatenate((np.arange(len(runs)), np.arange(len(gapped))))


@dataclass(frozen=True)
class Items:
    """Test items of one pass: their words, seeds sorted by hash with the item and
    the place of each, and whether it is rare; and the items of few words by these."""

    ids: tuple
    words: tuple[np.ndarray, ...]
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    rare: np.ndarray
    short: dict[bytes, list[int]]


def prepare(rows: list[tuple]) -> Items:
    """Items of (id, text) rows that have words."""
    short: dict[bytes, list[int]] = {}
    ids, words, hashes, item, place = [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row, own, _, _, _ in rows_of_words(pc.utf8_lower(pa.array([t for _, t in rows], pa.string())), MARKS):
        if len(own) < MIN_WORDS:
            if len(own):
                short.setdefault(own.tobytes(), []).append(len(ids))
                ids.append(rows[row][0])
                words.append(own)
            continue
        grams, places = seeds(own)
        hashes.append(grams)
        item.append(np.full(len(grams), len(ids)))
        place.append(places)
        ids.append(rows[row][0])
        words.append(own)
    s, i, p = np.concatenate(hashes), np.concatenate(item), np.concatenate(place)
    order = np.argsort(s, kind="stable")
    return Items(tuple(ids), tuple(words), s[order], i[order], p[order], np.ones(len(s), bool), short)


class _Lookup:
    """Finds the seeds in arrays of n-gram hashes."""

    def __init__(self, items: Items):
        self.items = items
        self.unique = np.unique(items.seeds)
        self.bits = max(12, int(len(self.unique)).bit_length() + 5)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.unique >> np.uint64(64 - self.bits)] = True
        self.phrases: dict[int, dict[int, list[int]]] = {}
        for k, own in items.short.items():
            run = np.frombuffer(k, np.uint64)
            if len(run) > 1:
                self.phrases.setdefault(len(run), {}).setdefault(int(ngrams(run, len(run))[0]), []).extend(own)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `grams` that are seeds, and which unique seed each is."""
        at = np.flatnonzero(self.table[grams >> np.uint64(64 - self.bits)])
        if not len(at) or not len(self.unique):
            return at[:0], at[:0]
        which = np.minimum(np.searchsorted(self.unique, grams[at]), len(self.unique) - 1)
        hit = self.unique[which] == grams[at]
        return at[hit], which[hit]


def _short(words: np.ndarray, lookup: _Lookup) -> dict[int, tuple[int, float, int, int]]:
    """Items of few words whose words stand in a row in a text, where they first do."""
    items, found = lookup.items, {}
    if len(words) == 1:
        found = {k: (k, 1.0, 0, 1) for k in items.short.get(words.tobytes(), ())}
    for n, known in lookup.phrases.items():
        grams = ngrams(words, n)
        for at in np.flatnonzero(np.isin(grams, np.fromiter(known, np.uint64, len(known)))).tolist():
            for k in known[int(grams[at])]:
                if k not in found and np.array_equal(items.words[k], words[at : at + n]):
                    found[k] = (k, 1.0, at, at + n)
    return found


def _in_common(item: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words of either sequence stand in the other."""
    if len(item) * len(words) > PAIRS:
        return np.isin(item, words), np.isin(words, item)
    equal = item[:, None] == words
    return equal.any(axis=1), equal.any(axis=0)


def _bound(common: np.ndarray) -> int:
    """No local score is greater: the best stretch, with MATCH for each word in
    common and, as any other in it costs as much at least, MISMATCH for the rest."""
    sums = np.concatenate(([0], np.cumsum(np.where(common, MATCH, max(MISMATCH, GAP)))))
    return int((sums - np.minimum.accumulate(sums)).max())


def align(words: np.ndarray, lookup: _Lookup) -> list[tuple[int, float, int, int]]:
    """(item, share of its score, first word, end) of each item seeded in a text
    and found with MIN_SCORE, at its best place (of equal ones the first).

    Stretches with a rare seed are aligned where they have words enough in
    common; those of common seeds only where no bound rules the score out.
    """
    items = lookup.items
    found = _short(words, lookup)
    grams, places = seeds(words)
    at, which = lookup.find(grams)
    at = places[at]
    if not len(at):
        return [found[k] for k in sorted(found)]
    low, high = np.searchsorted(items.seeds, lookup.unique[which]), np.searchsorted(items.seeds, lookup.unique[which], "right")
    many = high - low
    rows = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
    item, offset = items.item[rows], np.repeat(at, many) - items.place[rows]
    order = np.lexsort((offset, item))
    item, offset, is_rare = item[order], offset[order], items.rare[rows][order]
    size = np.array([len(w) for w in items.words])[item]
    edges = np.flatnonzero((np.diff(item) != 0) | (np.diff(offset) > size[1:])) + 1
    for own in np.split(np.arange(len(item)), edges):
        k = int(item[own[0]])
        m = len(items.words[k])
        first = max(0, int(offset[own[0]]) - m // 2)
        end = min(len(words), int(offset[own[-1]]) + m + m // 2)
        # words in common bound the score
        ours, theirs = _in_common(items.words[k], words[first:end])
        if ours.sum() < MIN_SCORE * m:
            continue
        if not is_rare[own].any() and min(_bound(ours), _bound(theirs)) < MIN_SCORE * MATCH * m:
            continue
        score, a, b = smith_waterman(items.words[k], words[first:end])
        share = score / (MATCH * m)
        if share >= MIN_SCORE and share > found.get(k, (0, 0.0))[1]:
            found[k] = (k, share, first + a, first + b)
    return [found[k] for k in sorted(found)]


def _passes(items: DataFrame) -> list[list[tuple]]:
    """(id, text) rows in lists of bounded size, by a hash of the row."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = own.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = max(1, -(-total.n // PASS_ITEMS), -(-(total.bytes or 0) // PASS_BYTES))
    return [[tuple(r) for r in own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()] for k in range(n)]


def rare(docs: DataFrame, items: Items, share: float = RARE_SHARE) -> Items:
    """The items with the seeds marked that few documents hold, counted over all
    documents: at most `share` of them, or among the rarer half of the item's own
    that occur.  The common ones stay, as a copy may have no others left."""
    sent = docs.sparkSession.sparkContext.broadcast(_Lookup(items))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, rows = sent.value, 0
        totals = np.zeros(len(lookup.unique), np.int64)
        for b in batches:
            rows += b.num_rows
            for _, words, _, _, _ in rows_of_words(pc.utf8_lower(b.column(0)), MARKS):
                _, which = lookup.find(seeds(words)[0])
                if len(which):
                    totals[np.unique(which)] += 1
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(totals[used], rows))], ["seed", "n"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    found = {r.seed: r.n for r in counts.collect()}  # at most the seeds of a pass
    df = np.array([found.get(int(k), 0) for k in np.searchsorted(np.unique(items.seeds), items.seeds)], np.int64)
    keep = df <= share * found.get(-1, 0)
    for k in range(len(items.ids)):
        own = np.flatnonzero((items.item == k) & (df > 0))  # seeds in no document find nothing
        if len(own):
            keep[own] |= df[own] <= np.median(df[own])
    return replace(items, rare=keep)


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """`docs` with an array of (item_id, score, first, end), and its name: the items
    that a text holds a copy of, also an edited one, with the words it covers.

    Null and empty texts hold none; items without words are not looked for, those
    of fewer than MIN_WORDS are found word for word only, and one of a single word
    only as all of a text; item_id may be null;
    equal items under one id count once.  Rows and all their columns stay,
    repeated ones too; an empty table of either kind gives no hits.
    """
    (name,) = fresh(docs, "leaks")
    kind = "array<struct<item_id:long,score:double,first:long,end:long>>"
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first", pa.int64()), ("end", pa.int64())]))

    def finder(sent):
        @F.arrow_udf(kind)
        def find(texts: pa.Array) -> pa.Array:
            lookup = sent.value
            out: list[list[dict]] = [[] for _ in range(len(texts))]
            for row, words, _, _, _ in rows_of_words(pc.utf8_lower(texts), MARKS):
                out[row] = [{"item_id": lookup.items.ids[k], "score": s, "first": a, "end": b} for k, s, a, b in align(words, lookup)]
            return pa.array(out, arrow)

        return find

    columns = []
    for rows in _passes(benchmark):
        items = rare(docs.select(q(text).alias("text")), prepare(rows))
        columns.append(finder(docs.sparkSession.sparkContext.broadcast(_Lookup(items)))(q(text).cast("string")))
    return docs.withColumn(name, F.concat(*columns)), name


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word for each document and item it
    holds; clean documents have no row."""
    found, name = annotate(docs.select("doc_id", "text"), benchmark)
    one = found.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(q(name)).alias("leak"))
    return one.select("doc_id", "leak.item_id", F.round("leak.score", 6).alias("score"), F.col("leak.first").alias("first_word"), F.col("leak.end").alias("end_word"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no item, as they are."""
    found, name = annotate(docs, benchmark)
    return found.where(F.size(q(name)) == 0).select([q(c) for c in docs.columns])
