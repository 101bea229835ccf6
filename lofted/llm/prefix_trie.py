"""The trie of what conversations have in common from their first turn on.

A node is a sequence of turns with which some conversation starts; its members
are the conversations that start with it, and the least of them owns it.  Who
owns a prefix owns all longer ones of its own, so each conversation owns one
chain of nodes, from its first owned depth to its end, and the chains form the
tree: a chain hangs on the node, of another's chain, one turn above its top.

* Prefix digests are running sums of hashes of (place, turn), 128 bits, so a
  conversation of any length is summed in blocks by many tasks.
* The least member of every prefix digest is one grouped minimum.  The first
  owned depth comes by binary search, all conversations at once: a round joins
  each one's middle depth to the minima; after log2 of the longest it is done.
* Sums go bottom-up: along each chain from its end, then from the chain's top to
  all prefixes above it in one grouped sum, so that chains on chains on chains
  need no round each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, q, table

#: Turns of a conversation that one task sums.
BLOCK = 1024
#: Bytes of ids joined before they go to the digest of a node.
PIECE_BYTES = 1 << 16
#: Characters of role and text by which turns of one number are ordered first.
TIE_CHARS = 64

_KEY = ["depth", "k1", "k2"]


def number(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (conv_id, pos, content, bytes): each turn's place, from 1, a digest of
    role and text, and the text's bytes.  Places go over sorted ranges of all
    turns, so that a conversation of any size is numbered by many tasks."""
    role, text = (F.coalesce(q(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.select(q("conv_id").cast("long").alias("conv_id"), q("turn").alias("turn"), F.substring(role, 1, TIE_CHARS).alias("r"), F.substring(text, 1, TIE_CHARS).alias("t"), content.alias("content"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "r", "t", "content", "row"]
    sorted_ = turns.where("conv_id is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    at = scratch.save(sorted_.select("conv_id", "content", "bytes", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)), "sorted")
    parts = at.groupBy("conv_id", "part").agg(F.min("at").alias("least"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    numbered = at.join(parts.withColumn("before", before).drop("n"), ["conv_id", "part"])
    return scratch.save(numbered.select("conv_id", (F.col("at") - F.col("least") + F.col("before") + 1).alias("pos"), "content", "bytes"), "numbered")


def rebuild(numbered: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Every conversation c anew: the first h turns of c - c % 5, then its own after
    its first h, h being crc32(c) % 9.  Returns turns and (conv_id, total)."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    lens = scratch.save(numbered.groupBy("conv_id").agg(F.count("*").alias("n")), "lens")
    convs = lens.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    based = convs.join(lens.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    shared = F.least("h", F.coalesce("base_n", F.lit(0).cast("long")))
    convs = scratch.save(based.withColumn("shared", shared).withColumn("total", F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "shared", "total"), "convs")
    own = numbered.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "content", "bytes", "total")
    first = numbered.where("pos <= 8").withColumnRenamed("conv_id", "base").join(convs, "base").where("pos <= h").select("conv_id", "pos", "content", "bytes", "total")
    return own.unionByName(first), convs.select("conv_id", "total")


def _running(df: DataFrame, key: str, pos: str, sums: list[str], scratch: Scratch, label: str) -> DataFrame:
    """`df` with each of `sums` added up over the key's rows to this one, by blocks of BLOCK places."""
    df = df.withColumn("block", F.floor((F.col(pos) - 1) / BLOCK))
    inside = Window.partitionBy(key, "block").orderBy(pos)
    added = df.withColumns({f"{s}_run": F.sum(s).over(inside) for s in sums})
    totals = df.where(F.col("longest") > BLOCK).groupBy(key, "block").agg(*(F.sum(s).alias(s) for s in sums))
    along = Window.partitionBy(key).orderBy("block")
    before = scratch.save(totals.select(key, "block", *((F.sum(s).over(along) - F.col(s)).alias(f"{s}_before") for s in sums)).where("block > 0"), label)
    joined = added.join(before, [key, "block"], "left")
    return joined.withColumns({f"{s}_run": F.col(f"{s}_run") + F.coalesce(F.col(f"{s}_before"), F.lit(0).cast("long")) for s in sums}).drop("block", *(f"{s}_before" for s in sums))


def _prefixes(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (conv_id, depth, k1, k2, bytes, total), one for each prefix, the empty one too."""
    low, hashes = F.lit((1 << 32) - 1), [F.xxhash64(F.lit(k), F.col("pos"), F.col("content")) for k in (1, 2)]
    pieces = {f"s{k}{half}": (F.shiftrightunsigned(x, 32) if half else x.bitwiseAND(low)) for k, x in enumerate(hashes) for half in (0, 1)}
    summed = _running(turns.withColumns(pieces).withColumn("longest", F.col("total")), "conv_id", "pos", list(pieces), scratch, "blocks")

    def joined(k: int) -> Column:
        one, two = (F.col(f"s{k}{half}_run").bitwiseAND(low) for half in (0, 1))
        return F.shiftleft(one, 32).bitwiseOR(two)

    zero = F.lit(0).cast("long")
    rows = summed.select("conv_id", F.col("pos").cast("long").alias("depth"), joined(0).alias("k1"), joined(1).alias("k2"), "bytes", "total")
    return scratch.save(rows.unionByName(convs.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("bytes"), "total")), "prefixes")


def _first_owned(convs: DataFrame, minima: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (conv_id, total, first): the least depth whose prefix the conversation
    owns, total + 1 if none.  It owns nothing at `low` and all from `high` on."""
    owned = minima.select(F.col("owner").alias("conv_id"), F.col("depth").alias("mid"), F.lit(True).alias("own"))
    state, done, turn = convs.select("conv_id", "total", F.lit(-1).cast("long").alias("low"), (F.col("total") + 1).alias("high")), None, 0
    longest = convs.agg(F.max("total")).first()[0]
    for turn in range(0 if longest is None else (longest + 1).bit_length()):
        asked = state.withColumn("mid", F.floor((F.col("low") + F.col("high")) / 2)).join(owned, ["conv_id", "mid"], "left")
        own = F.coalesce("own", F.lit(False))
        state = scratch.save(asked.select("conv_id", "total", F.when(own, F.col("low")).otherwise(F.col("mid")).alias("low"), F.when(own, F.col("mid")).otherwise(F.col("high")).alias("high")), f"search{turn}")
        ended = state.where("high - low = 1")
        done, state = ended if done is None else done.unionByName(ended), state.where("high - low > 1")
    return scratch.save((state if done is None else done).select("conv_id", "total", F.col("high").alias("first")), "first")


_PIECES = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("least", pa.int64()), ("ids", pa.string())])
_ENDS = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, k1, k2, conv_id) to the ids of each node, comma-joined, in pieces."""
    key, ids, size, out = None, [], 0, []

    def close() -> None:
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
            ids.clear()

    for batch in batches:
        for *node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node != key or size > PIECE_BYTES:
                close()
                key, size = node, 0
            ids.append(conv)
            size += 20
        if len(out) > 5_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _PIECES, strict=True)], schema=_PIECES)
            out.clear()
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _PIECES, strict=True)], schema=_PIECES)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to the digest of each node's ids; holds one piece at a time."""
    key, running, out = None, None, []
    for batch in batches:
        for *node, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node == key:
                running.update(b",")
            else:
                if key is not None:
                    out.append((*key, running.hexdigest()))
                key, running = node, hashlib.sha256()
            running.update(ids.encode())
        if len(out) > 5_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _ENDS, strict=True)], schema=_ENDS)
            out.clear()
    if key is not None:
        out.append((*key, running.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _ENDS, strict=True)], schema=_ENDS)


def trie(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row a node: conv_id (its owner), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256, as the query's contract words them.

    `turns` has conv_id, pos (1 up to total, each once), content (a digest of the
    turn), bytes and total; `convs` has every conv_id with its total, turnless
    ones too.  Without conversations there is no node, not even the root.
    """
    prefixes = _prefixes(turns, convs, scratch)
    minima = scratch.save(prefixes.groupBy(*_KEY).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes")), "minima")
    first = _first_owned(convs, minima, scratch)

    # a chain hangs on the owner of the prefix above its top
    tops = first.where("first between 1 and total").select("conv_id", (F.col("first") - 1).alias("depth"))
    above = prefixes.select("conv_id", *_KEY).join(tops, ["conv_id", "depth"])
    hung = scratch.save(above.join(minima.select(*_KEY, F.col("owner").alias("parent")), _KEY).select("conv_id", "parent", "depth"), "hung")
    hung_on = hung.groupBy(F.col("parent").alias("owner"), "depth").agg(F.count("*").alias("n_hung"))

    chains = first.where("first <= total").select(F.col("conv_id").alias("owner"), "total", "first").join(hung.select(F.col("conv_id").alias("owner"), "parent"), "owner", "left")
    ends_at = chains.join(hung_on.withColumnRenamed("depth", "total"), ["owner", "total"], "left").withColumn("leaf", F.col("n_hung").isNull().cast("long")).drop("n_hung")
    weighed = minima.withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")).join(ends_at, "owner")
    nodes = _running(weighed.withColumn("longest", F.col("total")), "owner", "depth", ["own"], scratch, "chain_blocks").drop("longest")
    nodes = scratch.save(nodes, "nodes")
    chain = scratch.save(nodes.where("depth = total").select(F.col("owner").alias("conv_id"), "first", "leaf", F.col("own_run").alias("whole")), "chains")

    up = prefixes.select("conv_id", *_KEY).join(chain.where("leaf > 0 or whole > 0"), "conv_id").where("depth < first")
    up = up.groupBy(*_KEY).agg(F.sum("leaf").alias("up_leaves"), F.sum("whole").alias("up_saved"))

    order = [*_KEY, "conv_id"]
    ids = prefixes.where("depth = total").select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined_ids, "depth long, k1 long, k2 long, least long, ids string")
    digests = ids.repartition(*_KEY).sortWithinPartitions(*_KEY, "least").mapInArrow(_digested, "depth long, k1 long, k2 long, ends_sha256 string")

    whole = chain.select(F.col("conv_id").alias("owner"), "whole")
    out = nodes.join(whole, "owner").join(hung_on, ["owner", "depth"], "left").join(up, _KEY, "left").join(digests, _KEY, "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs",
        ((F.col("depth") < F.col("total")).cast("long") + F.coalesce("n_hung", zero)).alias("n_children"),
        (F.col("leaf") + F.coalesce("up_leaves", zero)).alias("n_leaves"),
        (F.col("whole") - F.col("own_run") + F.col("own") + F.coalesce("up_saved", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def of_table(conversations: DataFrame) -> DataFrame:
    """The trie of a table's conversations as they are.

    Columns conv_id, turn, role and text are read, others not.  Turns go by their
    number, null first, then by the first TIE_CHARS characters of role and of
    text, then by digest, so repeated rows are turns of their own; null role or
    text is empty; rows without conv_id take no part; texts count whole.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    numbered = number(conversations, scratch)
    convs = scratch.save(numbered.groupBy("conv_id").agg(F.count("*").alias("total")), "convs")
    return trie(numbered.join(convs, "conv_id"), convs, scratch)


def of_rebuilt(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations that `rebuild` makes, with the handling of `of_table`."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, convs = rebuild(number(conversations, scratch), scratch)
    return trie(turns, convs, scratch)


def query(spark, sf_dir: str) -> DataFrame:
    return of_rebuilt(table(spark, sf_dir, "conversations"))
