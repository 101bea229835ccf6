"""Approximate nearest neighbours by additive quantisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Codebooks, codewords of each, beams while encoding, rows of the training sample.
BOOKS, WORDS, BEAMS, SAMPLE = 8, 256, 4, 8192
#: Index rows in a block, queries in a group, candidates of a block that are reranked first.
BLOCK_ROWS, GROUP_QUERIES, RERANK = 8192, 2048, 160
#: Deviations of its likely error that a row may lie below the k-th best and still be scored exactly.
LIKELY = 2.5


@dataclass(frozen=True)
class Codebooks:
    """books[m, k] is codeword k of codebook m, of the full dimension."""

    books: np.ndarray

    def encode(self, x: np.ndarray, beams: int = BEAMS) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, books) and squared norms of the sums of codewords, by a
        beam search that keeps the `beams` nearest partial sums at each book."""
        n, dim = x.shape
        residual, codes = x[:, None, :].astype(np.float32), np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            width = residual.shape[1]
            flat = residual.reshape(-1, dim)
            cost = (flat * flat).sum(1)[:, None] - 2 * flat @ book.T + (book * book).sum(1)[None]
            cost = cost.reshape(n, width * len(book))
            keep = min(beams, cost.shape[1])
            best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
            parent, word = best // len(book), best % len(book)
            rows = np.arange(n)[:, None]
            residual = residual[rows, parent] - book[word]
            codes = np.concatenate([codes[rows, parent], word[..., None].astype(np.uint8)], axis=2)
        left = (residual * residual).sum(2).argmin(1)
        chosen = codes[np.arange(n), left]
        total = self.decode(chosen)
        return chosen, (total * total).sum(1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(len(self.books)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of queries with codewords: (books, queries, words)."""
        return np.einsum("qd,mkd->mqk", queries.astype(np.float32), self.books, optimize=True)


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 7) -> Codebooks:
    """Codebooks by k-means of what the earlier ones leave of the sample."""
    rng, left, out = np.random.default_rng(seed), sample.astype(np.float32), []
    k = min(words, len(sample))
    for _ in range(books):
        book = left[rng.choice(len(left), k, replace=False)].copy()
        for _ in range(rounds):
            near = ((book * book).sum(1)[None] - 2 * left @ book.T).argmin(1)
            n = np.bincount(near, minlength=k)
            order = np.argsort(near, kind="stable")
            used = np.flatnonzero(n)
            sums = np.add.reduceat(left[order], (np.cumsum(n) - n)[used], axis=0)
            book[used] = sums / n[used][:, None]
            empty = np.flatnonzero(n == 0)
            book[empty] = left[rng.integers(0, len(left), len(empty))]
        near = ((book * book).sum(1)[None] - 2 * left @ book.T).argmin(1)
        left = left - book[near]
        out.append(book)
    return Codebooks(np.stack(out))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of rows that take part: vec_id not null,
    the vector of the most usual length (the longer, if equally usual), finite,
    without null components and not all zero."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    own = own.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    own = own.where(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0))
    sizes = own.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    return own.where(F.size("embedding") == (sizes[0].n if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def search(vectors: DataFrame, every: int = 20, k: int = 20, sample: int = SAMPLE, rerank: int = RERANK) -> DataFrame:
    """The k rows of largest inner product for each row whose vec_id is divisible
    by `every`: query_id, rank, vec_id, score.

    Codebooks are fitted on the `sample` rows of least hash; every row is
    encoded and scored.  Groups of queries meet blocks of rows: within a block
    the `rerank` best by lookup tables are scored exactly in double precision,
    then every other row that may reach the k-th best of them by LIKELY deviations
    of its error: what the codes leave of a row points anywhere, so its product
    with a query deviates by the stored norm of that rest over the root of the
    dimensions, a part of what the norms alone would allow.  The best k of all
    blocks stay, ties to the smaller vec_id.  Other columns are not read.  A row is no
    candidate of a query of its own vec_id.  Queries repeated under one vec_id
    count once, by the least vector; repeated candidates count each.  Rows that
    take no part are named at `usable`; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = usable(vectors)
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow().column(0).combine_chunks()
    if not len(first):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = spark.sparkContext.broadcast(fit(_matrix(first)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs, n = [], [], 0

        def block() -> pa.RecordBatch:
            i, v = np.concatenate(ids), np.concatenate(vecs)
            order = np.argsort(i, kind="stable")
            i, v = i[order], v[order]
            parts = [books.value.encode(v[a : a + 1024]) for a in range(0, len(v), 1024)]
            codes = np.concatenate([c for c, _ in parts])
            # the norm of what the codes leave, from those of the row and of the sum of its codewords
            norms, sums = (v * v).sum(1), np.concatenate([n for _, n in parts])
            inner = np.concatenate([(v[a : a + 1024] * books.value.decode(codes[a : a + 1024])).sum(1) for a in range(0, len(v), 1024)])
            errors = np.sqrt(np.maximum(norms - 2 * inner + sums, 0.0))
            cells = i.tobytes(), codes.tobytes(), np.sqrt(norms).astype("<f8").tobytes(), errors.astype("<f8").tobytes(), v.tobytes()
            ids.clear(), vecs.clear()
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["ids", "codes", "norms", "errors", "vectors"])

        for b in batches:
            if b.num_rows:
                ids.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                vecs.append(_matrix(b.column(1)).astype(np.float64))
                n += b.num_rows
            if n >= BLOCK_ROWS:  # a block has less than twice so many, as batches are no larger
                yield block()
                n = 0
        if n:
            yield block()

    blocks = scratch.save(rows.mapInArrow(index, "ids binary, codes binary, norms binary, errors binary, vectors binary"), "index")
    queries = scratch.save(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    groups = max(1, -(-queries.count() // GROUP_QUERIES))
    dealt = queries.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    asked = dealt.groupBy("g").agg(F.collect_list("vec_id").alias("query_ids"), F.flatten(F.collect_list("embedding")).alias("asked"))
    met = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(asked, "g").drop("g")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, codes, norms, errors, vecs = (np.frombuffer(b.column(c)[r].as_buffer(), t) for c, t in (("ids", "<i8"), ("codes", "u1"), ("norms", "<f8"), ("errors", "<f8"), ("vectors", "<f8")))
                codes, vecs = np.ascontiguousarray(codes.reshape(len(ids), -1).T), vecs.reshape(len(ids), -1)
                query_ids = b.column("query_ids")[r].values.to_numpy(zero_copy_only=False)
                asked_all = b.column("asked")[r].values.to_numpy(zero_copy_only=False).reshape(len(query_ids), -1)
                out: list[list[np.ndarray]] = [[], [], []]
                for at in range(0, len(query_ids), 256):
                    near = _near(books.value, query_ids[at : at + 256], asked_all[at : at + 256], ids, codes, norms, errors, vecs, k, rerank)
                    for x, y in zip(out, near):
                        x += y
                cells = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["query_id", "vec_id", "score"])

    scored = met.mapInArrow(score, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _near(books: Codebooks, query_ids: np.ndarray, asked: np.ndarray, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, errors: np.ndarray, vecs: np.ndarray, k: int, rerank: int) -> list[list[np.ndarray]]:
    """Query ids, row ids and exact scores of each query's best k rows of a block (rows by id)."""
    tables = books.tables(asked)
    rough = np.zeros((len(asked), len(ids)), np.float32)
    for m in range(len(codes)):
        rough += tables[m][:, codes[m]]
    keep = min(max(rerank, k) + 1, len(ids))  # one more for the query itself
    first = np.argpartition(rough, len(ids) - keep, axis=1)[:, len(ids) - keep :]
    # what single precision adds to an error, and double precision to a score, for a query of length 1
    terms = vecs.shape[1] + 2 * len(codes)
    single = terms * 2.0**-22 * np.linalg.norm(books.books, axis=2).max(axis=1).sum()
    double = terms * 2.0**-50 * norms.max()
    likely = errors * min(1.0, LIKELY / np.sqrt(vecs.shape[1]))
    out: list[list[np.ndarray]] = [[], [], []]
    for row, query_id, vec, own in zip(rough, query_ids, asked, first):
        length = np.linalg.norm(vec)
        least = _least(vecs[own[ids[own] != query_id]] @ vec, k) - double * length
        # the k-th best of the first is no better than that of all; a row that is not likely to reach it stays out
        may = ~(row + (likely + single) * length < least)
        may[own] = True
        own = np.flatnonzero(may & (ids != query_id))
        near = vecs[own] @ vec
        own = own[~(near < _least(near, k) - double * length)]
        exact = (vecs[own] * vec).sum(1)
        best = np.lexsort((ids[own], -exact))[:k]
        out[0].append(np.full(len(best), query_id, np.int64))
        out[1].append(ids[own][best])
        out[2].append(exact[best])
    return out


def _least(scores: np.ndarray, k: int) -> float:
    """The k-th best score; of fewer, less than any."""
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf
