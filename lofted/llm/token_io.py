"""Token-ID files: documents in doc_id order as Simple-8b blocks."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import Scratch
from .tokens import default_path, encoder

MAGIC = b"S8BTOK01"
#: Ids after which a task closes a file and begins the next.
FILE_IDS = 4_000_000
_MANIFEST = "part int, seq int, file string, n_docs long, n_ids long"


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A file's bytes: magic; counts of documents, ids and blocks; doc_ids with
    their null marks; lengths; block and escape offsets; words.  Little-endian."""
    words, first, escapes = simple8b.encode(ids)
    known = np.array([d is not None for d in doc_ids], "<u1")
    return b"".join((
        MAGIC, np.array([len(doc_ids), len(ids), len(first) - 1], "<i8").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(),
        np.array(lengths, "<i8").tobytes(), first.astype("<i8").tobytes(), escapes.astype("<i8").tobytes(), words.astype("<u8").tobytes(),
    ))


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token-ID file")
    at = 8

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    docs, n_ids, blocks = map(int, take("<i8", 3))
    raw, known, lengths = take("<i8", docs), take("<u1", docs), take("<i8", docs)
    first, escapes = take("<i8", blocks + 1), take("<i8", blocks + 1)
    ids = simple8b.decode(take("<u8", int(first[-1])), first, escapes)
    if len(ids) != n_ids:
        raise ValueError("a token-ID file is damaged")
    return [int(d) if k else None for d, k in zip(raw, known)], lengths, ids


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    """Lazily writes `docs` (doc_id, text; others are ignored) in ascending
    doc_id order to files in `folder`, a URI that all executors share.

    Returns the manifest, one row per file; its (part, seq) order is the order
    of the ids.  Save it before reading the files: each attempt of a task writes
    files of new names, so only those of the saved manifest count.  Null texts
    are empty (the end id only); null doc_ids come first; equal doc_ids are
    ordered by a hash of the text, repeated rows stay.
    """
    path = tokenizer_path or default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        where, root = fs.FileSystem.from_uri(folder)
        part, made = TaskContext.get().partitionId(), []
        held: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            doc_ids, lengths, parts = held
            if not doc_ids:
                return
            name, ids = f"{part:06d}-{len(made):06d}-{uuid.uuid4().hex}.s8b", np.frombuffer(b"".join(parts), "<u4")
            with where.open_output_stream(f"{root}/{name}") as f:
                f.write(pack_file(doc_ids, lengths, ids))
            made.append((part, len(made), f"{folder}/{name}", len(doc_ids), len(ids)))
            for x in held:
                x.clear()

        n = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc.encode(text.as_py()) + end
                held[0].append(doc_id)
                held[1].append(len(ids) // 4)
                held[2].append(ids)
                n += len(ids) // 4
                if n >= FILE_IDS:
                    close()
                    n = 0
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "seq", "file", "n_docs", "n_ids"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    # rows that are alike in both are told apart by their place, so that a range can end among them
    keyed = keyed.withColumn("nth", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange("doc_id", "tie", "nth").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return dealt.mapInArrow(write, _MANIFEST)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files of a saved manifest: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32 (of its ids as little-endian
    unsigned 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                where, name = fs.FileSystem.from_uri(file)
                with where.open_input_stream(name) as f:
                    doc_ids, lengths, ids = unpack_file(f.read())
                raw, cut = ids.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(lengths)))
                crc = [zlib.crc32(raw[4 * cut[i] : 4 * cut[i + 1]]) for i in range(len(doc_ids))]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(cut[:-1] + before, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # ids before a task's files, of one row per task, and before a file among its task's
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    tasks = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", earlier(Window.orderBy("part")).alias("base"))
    placed = manifest.withColumn("own", earlier(Window.partitionBy("part").orderBy("seq"))).join(tasks, "part")
    files = placed.select("file", (F.col("base") + F.col("own")).alias("before")).repartition(max(1, min(manifest.count(), 10_000)), "file")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes token-ID files to the shared folder and returns what they hold."""
    scratch = Scratch(docs.sparkSession, "tokens")
    manifest = scratch.save(write_token_files(docs, scratch.folder("files"), tokenizer_path, end_id), "manifest")
    return read_token_files(manifest)
