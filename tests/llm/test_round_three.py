"""The suffix, trie and divergence operators against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lofted.llm import divergence, prefix_trie, suffix_dedup

# ---- removal of repeated byte strings


def removed(rows, length=suffix_dedup.LENGTH):
    first, out = set(), []
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k)):
        data = (rows[k][1] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            piece = data[i : i + length]
            if piece in first:
                gone[i : i + length] = b"\1" * length
            first.add(piece)
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out.append((rows[k][0], len(data), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digests(spark, rows, kind="doc_id long, text string"):
    return sorted(map(tuple, suffix_dedup.digests(spark.createDataFrame(rows, kind).coalesce(1)).collect()), key=str)


@pytest.mark.parametrize(("hot", "parts"), [(2048, 1), (2, 1), (2, 9), (40, 4)])
def test_removal_equals_brute_force(spark, monkeypatch, hot, parts):
    """Units are as many as partitions here; earlier rows of one id are of earlier partitions."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    own = random.Random(5)
    words = ["alpha", "beta", "gamma", "délta", "e", "f\U0001f600"]
    passage = " ".join(own.choices(words, k=60))
    texts = [None, "", "a" * 500, "a" * 99, "a" * 100, "ab" * 300, passage, "x" + passage[3:] + "y", passage + passage, passage[:150]]
    texts += [" ".join(own.choices(words, k=own.randint(0, 80))) + passage[own.randint(0, 50) : own.randint(100, 300)] + " ".join(own.choices(words, k=own.randint(0, 80))) for _ in range(50)]
    rows = [(i if i % 7 else (None if i % 14 else i // 3), t) for i, t in enumerate(texts + texts[:20])]
    df = spark.sparkContext.parallelize(rows, parts).toDF("doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.digests(df).collect()), key=str) == removed(rows)


def test_runs_and_units_in_pieces(monkeypatch):
    own = random.Random(7)
    texts = [bytes(own.choices(b"abc", k=n)) for n in (0, 99, 100, 101, 2_000, 7, 350, 20_000)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]

    def windows():
        return {(w, a, g) for low, high, a, g in zip(*map(np.ndarray.tolist, suffix_dedup._runs(data, ends))) for w in range(low, high + 1)}

    whole = windows()
    assert {w for w, _, _ in whole} == {w for a, b in zip(ends, ends[1:]) for w in range(a, b - 99)}
    assert all(w <= a <= w + 68 for w, a, _ in whole)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    assert windows() == whole
    by_text = {}
    for w, a, g in whole:
        assert by_text.setdefault(bytes(data[w : w + 100]), (a - w, g)) == (a - w, g)  # equal windows name the same gram

    class Context:
        partitionId = staticmethod(lambda: 3)

    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: Context))
    monkeypatch.setattr(suffix_dedup, "UNIT_BYTES", 1_000)
    batches = [pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])] * 2
    made = [r for b in suffix_dedup._units(iter(batches)) for r in b.to_pylist()]
    assert [r["bytes"] for r in made] == texts * 2 and len({(r["unit"], r["idx"]) for r in made}) == len(made)
    sizes = Counter()
    for r in made:
        sizes[r["unit"]] += len(r["bytes"])
    assert all(n <= 1_000 or sum(r["unit"] == u and len(r["bytes"]) > 0 for r in made) == 1 for u, n in sizes.items()) and min(sizes) == 3 << 32


def test_removal_over_long_texts(spark):
    rng = np.random.default_rng(2)
    long = bytes(rng.integers(97, 123, 30_000).astype(np.uint8)).decode()
    rows = [(2, long), (1, long[5_000:9_000] + "-" + long[20_000:20_099]), (3, "z" + long[1:]), (4, long[7:]), (5, "q" * 5_000)]
    assert digests(spark, rows) == removed(rows)


def test_removal_with_other_columns_and_without_rows(spark):
    rows = [(1, "t" * 120, "x", 1), (1, "t" * 120, "y", 2)]
    got = digests(spark, rows, "doc_id long, text string, kept string, `Unit` int")
    assert got == removed([r[:2] for r in rows]) and digests(spark, []) == []
    (spans,) = [r.spans for r in suffix_dedup.dedupe(spark.createDataFrame([(7, "ab" * 80)], "doc_id long, text string")).collect()]
    assert [(s.start, s.end) for s in spans] == [(2, 160)]


def test_longest_previous_factors():
    own = random.Random(1)
    for length in (3, 9, 20):
        for _ in range(30):
            data = bytes(own.choices(b"ab", k=own.randint(length, 150)))
            starts = np.arange(len(data) - length + 1)
            got = suffix_dedup.previous_factors(np.frombuffer(data, np.uint8), starts, length)
            for i in starts.tolist():
                seen = any(data[j : j + length] == data[i : i + length] for j in range(i))
                assert (got[i] >= length) == seen and got[i] <= length


# ---- the trie of conversations


def nodes(convs):
    members = {}
    for k in sorted(convs):
        for d in range(len(convs[k]) + 1):
            members.setdefault(tuple(convs[k][:d]), []).append(k)
    kids = {}
    for s in members:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    out, below = [], {}
    for s in sorted(members, key=len, reverse=True):
        saved = (len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0
        leaves = 0 if s in kids else 1
        for x in kids.get(s, []):
            saved, leaves = saved + below[x][0], leaves + below[x][1]
        below[s] = saved, leaves
        ends = ",".join(str(k) for k in members[s] if len(convs[k]) == len(s))
        out.append((members[s][0], len(s), members[s[:-1]][0] if s else None, len(members[s]), len(kids.get(s, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def grouped(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {k: [x[2:] for x in sorted(v)] for k, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    return out


_TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [1024, 3])
def test_trie_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    own = random.Random(block)
    rows = []
    for c in [*range(-6, 40), 1000, 2**40]:
        for t in range(own.randint(0, 14) if c != 10 else 60):
            rows.append((c, None if own.random() < 0.05 else t, own.choice(["user", "assistant", None]), own.choice(["hi", "ho", None, "été"])))
    rows += rows[:25] + [(None, 1, "user", "x"), (77, 1, "u", "m" * 50_000)]
    df = spark.createDataFrame(rows, _TURNS)
    order = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, prefix_trie.of_rebuilt(df).select(order).collect()), key=str) == nodes(rebuilt(grouped(rows)))
    plain = prefix_trie.of_table(df.withColumnsRenamed({}))
    assert sorted(map(tuple, plain.select(order).collect()), key=str) == nodes(grouped(rows))


def test_trie_of_chains_on_chains_and_of_nothing(spark):
    # each conversation goes one turn further than the one before: chains nest as deep as there are
    rows = [(c, t, "user", f"t{t}") for c in range(30) for t in range(c + 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], _TURNS + ", depth string, `Owner` int")
    got = prefix_trie.of_table(df)
    assert sorted(map(tuple, got.collect()), key=str) == nodes(grouped(rows))
    assert prefix_trie.of_table(df.limit(0)).count() == 0 and prefix_trie.of_rebuilt(df.limit(0)).count() == 0


def test_ends_in_pieces(monkeypatch):
    rows = [(1, 5, 5, c) for c in range(-3, 200)] + [(1, 5, 6, 2**40)] + [(2, 0, 0, c) for c in (7, 8)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[k : k + 50])], names=["depth", "k1", "k2", "conv_id"]) for k in range(0, len(rows), 50)]
    want = {}
    for *node, conv in rows:
        want.setdefault(tuple(node), []).append(str(conv))
    want = {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}
    for size in (10, 300, 1 << 16):
        monkeypatch.setattr(prefix_trie, "PIECE_BYTES", size)
        made = prefix_trie._digested(prefix_trie._joined_ids(iter(batches)))
        assert {(r["depth"], r["k1"], r["k2"]): r["ends_sha256"] for b in made for r in b.to_pylist()} == want


# ---- divergence of sources


def audited(rows):
    terms = {}
    for i, (lang, source, text) in enumerate(rows):
        lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        terms[i] = ((lang or "", source or ""), Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)))
    out = []
    for lang in {k[0] for k, _ in terms.values()}:
        docs = Counter(t for (g, _), c in terms.values() if g == lang for t in c)
        kept = sorted(t for t, n in docs.items() if n >= 3)
        count = {}
        for (g, source), c in terms.values():
            if g == lang:
                count.setdefault(source, Counter()).update({t: n for t, n in c.items() if docs[t] >= 3})
        whole = sum(count.values(), Counter())

        def p(c):
            total = sum(c.values()) + len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // total for t in kept}

        ps, q = {s: p(c) for s, c in count.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s, own in ps.items():
            pairs = [(-sum(f(own[t], ps[o][t]) for t in kept), o.encode()) for o in ps if o != s]
            words = [(-f(own[t], q[t]), t.encode()) for t in kept if count[s][t] and own[t] > q[t]]
            for part, found in (("pair", pairs), ("term", words)):
                out += [(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(sorted(found), 1) if part == "pair" or r <= divergence.TOP_TERMS]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("SHARD_ROWS", 10), ("SENT_GROUPS", 0), ("SALTS", 3)):
            monkeypatch.setattr(divergence, name, value)
    own = random.Random(4)
    words = ["The", "the", "Été", "naïve", "x1y", "ÀB", "中文", "don't", "a_b", "\U0001f600", "q", *[f"w{chr(97 + k)}" for k in range(20)]]
    rows = [(own.choice(["en", "fr", None, ""]), own.choice(["s1", "s2", "é", None, "s3"]), " ".join(own.choices(words, k=own.randint(0, 25)))) for _ in range(90)]
    rows += [("de", "only", "x y z"), ("it", "a", None), ("it", "b", "never thrice"), ("en", "s1", "The " * 5_000)] + rows[:15]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, source string, text string, term int, `Item` string")
    assert sorted(map(tuple, divergence.audit(df).collect())) == audited(rows)


def test_counts_in_slices(monkeypatch):
    texts = ["One one two", None, "été, ÉTÉ!", "two"] * 9
    batch = pa.record_batch([pa.array(["en", "fr"] * 18), pa.array(["a"] * 36), pa.array(texts)], names=["lang", "source", "text"])

    def counted():
        out = Counter()
        for b in divergence._counted(iter([batch, batch])):
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["term"], "n"] += r["n"]
                out[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        return out

    whole = counted()
    assert whole["en", "a", "one", "n"] == 36 and whole["en", "a", "one", "docs"] == 18 and whole["en", "a", "été", "n"] == 18 and ("fr", "a", "", "n") in whole
    monkeypatch.setattr(divergence, "SLICE_BYTES", 30)
    monkeypatch.setattr(divergence, "HELD_ROWS", 4)
    assert counted() == whole


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_exact_where_counts_are_large(spark):
    n, total, terms = 9_300_000_000, 40_000_000_000_000, 17
    row = spark.createDataFrame([(n, total, terms)], "n long, t long, v long").select(divergence._p(*map(divergence.F.col, ("n", "t", "v"))).alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (n + 1) // (total + terms)
