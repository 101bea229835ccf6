import hashlib
import io
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lofted.llm import ann, decontaminate, langid, license_scan, packing, secret_scan, simple8b, token_io, tokens, url_filter, warc

DOCS = "doc_id long, text string, secrets string, Score double"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], DOCS)


def test_simple8b_round_trip():
    rng = np.random.default_rng(3)
    for k in range(40):
        n = int(rng.integers(0, 9000))
        v = rng.integers(0, 2**63, n, dtype=np.uint64) >> rng.integers(0, 63, n).astype(np.uint64) if k % 2 else rng.integers(0, 50_000, n).astype(np.uint64)
        if n:
            v[rng.integers(0, n, 3)] = np.uint64(2**64 - 1)
        assert (simple8b.decode(*simple8b.encode(v)) == v).all()


def test_generations_of_the_cache(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "CACHE_BYTES", 2000)
    own, lib, rng = tokens.WordEncoder(tokens.default_path()), Tokenizer.from_file(tokens.default_path()), random.Random(4)
    words = [f"{w}{m}" for w in ("the", "Été", "naïve", "ßa", "x1", "l'été", "中文", "ÀB") for m in ("", ",", "...", "!?)", "(x")]
    for _ in range(300):
        text = " ".join(rng.choices(words, k=40))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(tokens, "STRETCH", 10)
    assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_word_encoder_equals_library():
    from tokenizers import Tokenizer

    own, lib = tokens.encoder(tokens.default_path()), Tokenizer.from_file(tokens.default_path())
    pool, rng = ["a", "É", "é", "Σ", "'s", "<|endoftext|>", "İ", "ß", "1", " ", "\n", "\x1c", "...", "word.", "WORD", "ﬁ", "中文", "👍", "\t", "Ǆ"], random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices(pool, k=rng.randint(0, 10)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_words_that_normalise_to_combining_marks():
    from tokenizers import Tokenizer

    own, lib = tokens.encoder(tokens.default_path()), Tokenizer.from_file(tokens.default_path())
    for body in ("ALİ", "\u0915\u0958", "\ufb2a", "été", "İstanbul", "Σίσυφος"):
        for mark in ".,;:!?":
            assert np.frombuffer(own.encode(body + mark), "<u4").tolist() == lib.encode(body + mark, add_special_tokens=False).ids


def test_token_files(spark):
    texts = ["hello world", None, "", "word " * 20_000, "hello world"]
    rows = token_io.round_trip(docs(spark, texts).repartition(3)).orderBy("doc_id").collect()
    own, start = tokens.encoder(tokens.default_path()), 0
    for r, t in zip(rows, texts, strict=True):
        ids = own.encode(t) + np.array([2], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += r.n_tokens
    assert token_io.round_trip(docs(spark, [])).count() == 0


def test_packing(spark):
    texts = [None, "", *[f"w{i} " * (i * 37 % 900) for i in range(120)], "long " * 5000]
    rows = packing.pack(docs(spark, texts).repartition(4)).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    assert len(bins) <= -(-total // 2048) + 1
    own = tokens.encoder(tokens.default_path())
    for i, t in enumerate(texts):
        mine = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == i)
        assert sum(n for *_, n in mine) == len(own.encode(t)) // 4 + 1 and all(s == p * 2048 for p, s, _ in mine)
    assert packing.pack(docs(spark, [])).count() == 0


def test_fullest_is_optimal():
    rng = random.Random(5)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}
        slack = rng.randint(1, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        got = packing.fullest(counts, slack)
        assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= slack)
        assert all(n <= counts[x] for x, n in got.items())


def brute_secrets(t):
    found = [("assign", m.start(), m.end()) for m in secret_scan.ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def github(body="Zz" * 15):
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        digits = secret_scan.BASE62[n % 62] + digits
        n //= 62
    return "ghp_" + body + digits


def test_secrets(spark):
    pool, rng = ["token", "Secret", "=", ":", " ", '"', "api", "_", "key", "passwd", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "x", "K", "İ", "/", "ſecret"], random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choices(pool, k=rng.randint(0, 14)))
        assert secret_scan.spans(t) == brute_secrets(t)
    made = spark.createDataFrame([(k, "".join(rng.choices(pool, k=30)), "x") for k in range(300)], "doc_id long, text string, Spans string")
    for r, m in zip(secret_scan.digests(made).orderBy("doc_id").collect(), made.orderBy("doc_id").collect(), strict=True):
        own = brute_secrets(m.text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) == (*(sum(s[0] == k for s in own) for k in ("assign", "access", "hex")), hashlib.sha256(listed.encode()).hexdigest(), listed)
    good, bad = github(), github()[:-1] + "!"
    df = docs(spark, [None, "", f"x {good} y", f"x {bad}", "token=abcdefabcdef12 and 0123456789abcdef", "clean"])
    out = secret_scan.scan(df)
    assert out.columns == [*df.columns, "_secrets"]
    clean = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert clean == {0: None, 1: "", 2: "x [github] y", 3: f"x {bad}", 4: "[assign] and [hex]", 5: "clean"}
    assert {r.doc_id: r.spans for r in secret_scan.digests(df).collect()}[2] == f"github:2:{2 + len(good)}"


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a b/", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (5, "u", "é" * 5000), (2, None, "same")], "page_id long, url string, html string")
    rows = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=repr)
    assert rows == sorted([(1, 4, "revisit", 2), (2, 4, "response", None), (2, 4, "response", None), (None, 4, "revisit", 2), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 10000, "response", None)], key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_revisits_refer_to_records(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "same" if i % 3 else f"own {i}", "x") for i in range(90)] + [(89, "http://h/89", "same", "x")], "page_id long, url string, html string, `File` string")
    rows = warc.round_trip(pages.repartition(5)).collect()
    by_id = {r.record_id: r for r in rows}
    assert len(by_id) == len(rows) == 91
    revisits = [r for r in rows if r.record_type == "revisit"]
    assert len(revisits) == 59
    for r in revisits:
        other = by_id[r.refers_to_id]
        assert (other.record_type, other.page_id, other.payload_digest) == ("response", r.refers_to, r.payload_digest) and r.refers_to == 89


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    data = warc.arc_version_block(version, "f.arc", "19970102030405")
    made = []
    for i in range(4):
        made.append(warc.ArcRecord(version, f"http://h/{i} x", "1.2.3.4", "19970102030405", "text/html", b"a\nb" * i, "f.arc", len(data)))
        data += warc.arc_record(made[-1])
    assert list(warc.parse_arc(io.BytesIO(data))) == made
    starts = [r.offset for r in warc.parse_arc(io.BytesIO(data))]
    assert all(data[a:].startswith(f"http://h/{i} x".encode()) for i, a in enumerate(starts))
    with pytest.raises(ValueError):
        list(warc.parse_arc(io.BytesIO(data[:-3])))


def test_stored_arc_files(spark, tmp_path):
    page = b"HTTP/1.0 200 OK\r\nContent-Length: 4\r\n\r\nbody"
    for version in (1, 2):
        blocks = [page, b"plain", b""]
        text = warc.arc_version_block(version, f"{version}.arc", "1997010203") + b"".join(warc.arc_record(warc.ArcRecord(version, f"http://h/{k}", "1.2.3.4", "1997010203", "text/plain", x)) for k, x in enumerate(blocks))
        (tmp_path / f"{version}.arc").write_bytes(text)
    files = spark.createDataFrame([(f"file://{tmp_path}/{v}.arc",) for v in (1, 2)] + [(None,)], "file string")
    (tmp_path / "warc").mkdir()
    index = warc.convert_arc(spark, files, f"file://{tmp_path}/warc").persist()
    assert index.count() == 6 and {r.date for r in index.collect()} == {"1997-01-02T03:00:00Z"}
    rows = warc.read_warc(index).collect()
    assert sorted((r.record_type, r.payload_bytes) for r in rows) == sorted([("response", 4), ("resource", 5), ("resource", 0)] * 2)
    assert len({r.record_id for r in rows}) == 6


def test_members_are_read_in_linear_time():
    one = warc._packed(b"x" * 300)
    began = time.perf_counter()
    assert sum(1 for _ in warc.members(io.BytesIO(one * 60_000))) == 60_000
    assert time.perf_counter() - began < 20
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(one[:-2])))


def test_url_filter(spark):
    urls = ["http://A.Org/x", "https://x.example.org/es/1", "http://example.org/en/12?q", "http://example.org", "http://notorg/", "http://s.com/fr/", "http://s.com/de/1", "ftp", None, "http://bad.test/p/?utm_source=1#x", "http://S.com/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for size in (0, 20):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rule_table(spark), url_filter.listed_table(spark, ["http://www.bad.test:80/p"]), size).collect()}
        assert got == {0: ("a.org", "/x", "org/", "allow"), 1: ("x.example.org", "/es/1", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("example.org", "", None, "allow"), 4: ("notorg", "/", None, "allow"), 5: ("s.com", "/fr/", "com/fr/", "allow"), 6: ("s.com", "/de/1", "com/de/", "block"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("bad.test", "/p/", None, "block"), 10: ("s.com", "/fr/", "com/fr/", "allow")}


def test_ann_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    odd = spark.createDataFrame([(1000, None), (1020, [0.0] * 64), (1040, [float("nan")] * 64), (1060, [1.0])], "vec_id long, embedding array<float>")
    rows = df.select("vec_id", "embedding").collect()
    m, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = {}
    for r in ann.search(df.select("vec_id", "embedding").unionByName(odd)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = m @ m[i]
        best = [int(ids[j]) for j in np.lexsort((ids, -s)) if j != i][:20]
        mine = [v for _, v, _ in sorted(got[int(ids[i])])]
        assert len(mine) == 20
        hit, total = hit + len(set(best) & set(mine)), total + 20
    assert set(got) == {int(i) for i in ids if i % 20 == 0} and hit / total >= 0.98
    assert ann.search(df.limit(0)).count() == 0


def test_ann_recall_of_hot_group(spark):
    rng = np.random.default_rng(12)
    n, hot = 24_000, 8_000
    m = rng.standard_normal((n, 32))
    m[:hot] = m[0] + 0.1 * rng.standard_normal((hot, 32))
    m = m[rng.permutation(n)]
    m /= np.linalg.norm(m, axis=1)[:, None]
    table = pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(list(m), pa.list_(pa.float64()))})
    got = {}
    for r in ann.search(spark.createDataFrame(table).coalesce(1), every=200).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert len(got) == n // 200
    hit = 0
    for i, mine in got.items():
        s = m @ m[i]
        s[i] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & {v for _, v in mine})
    assert hit >= 0.9 * 20 * len(got)  # rows unlikely to be among the nearest are not scored


def test_decontamination(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(3000)]
    items = [" ".join(rng.choices(vocab, k=30)) for _ in range(6)]
    edited = items[1].split()
    for at in (3, 9, 15, 21, 27):
        edited[at] = "zz"
    noise = lambda: " ".join(rng.choices(vocab, k=200))
    texts = [noise(), None, "", noise() + ", " + items[0].upper() + "! " + noise(), noise() + " " + " ".join(edited) + " " + noise(), items[5], "Too, short!", "too short of"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None), (10, "too short")], "item_id long, text string")
    df = docs(spark, texts)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.hits(df, bench).collect()) == [(3, 0), (4, 1), (5, 5), (6, 10), (7, 10)]
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]
    assert decontaminate.hits(df, bench.limit(0)).count() == 0
    assert decontaminate.hits(df.limit(0), bench).count() == 0
    twice = decontaminate.hits(df.unionAll(df), bench.unionAll(bench)).collect()
    assert sorted((r.doc_id, r.item_id) for r in twice) == [(3, 0)] * 2 + [(4, 1)] * 2 + [(5, 5)] * 2 + [(6, 10)] * 2 + [(7, 10)] * 2


def aligned(texts, items):
    """(text, item) pairs by seeds and by full alignment, in this process."""
    hashes = lambda t: next(decontaminate.rows_of_words(pa.array([t.lower()]), decontaminate.MARKS))[1]
    lookup = decontaminate._Lookup(decontaminate.prepare(list(enumerate(items))))
    seeded, full = set(), set()
    for n, text in enumerate(texts):
        own = hashes(text)
        seeded |= {(n, lookup.items.ids[k]) for k, *_ in decontaminate.align(own, lookup)}
        full |= {(n, k) for k, item in enumerate(items) if decontaminate.smith_waterman(hashes(item), own)[0] >= decontaminate.MIN_SCORE * 2 * len(hashes(item))}
    return seeded, full


def test_short_items_are_found_in_texts():
    items = ["what is the capital", "yes", "two words"]
    seeded, _ = aligned(["so what is the capital of france", "what is a capital", "yes", "oh yes", "words two words", "what is the", ""], items)
    assert seeded == {(0, 0), (2, 1), (4, 2)}


@pytest.mark.parametrize("rate", ["every third", 20, 30, 40])
def test_recall_against_full_alignment(rate):
    rng = random.Random(1)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(3000)]
    items = [" ".join(rng.choices(vocab, k=rng.randint(8, 40))) for _ in range(40)]

    def edited(words):
        if rate == "every third":
            return [w if i % 3 != 2 else f"zz{i}" for i, w in enumerate(words)]
        out = []
        for w in words:
            kind = rng.random() * 100
            # of the edits a third each are words left out, put in and changed
            out += [] if kind < rate / 3 else [w, "in"] if kind < rate * 2 / 3 else [f"sub{rng.randint(0, 9999)}"] if kind < rate else [w]
        return out

    texts = [" ".join(rng.choices(vocab, k=20) + edited(item.split()) + rng.choices(vocab, k=20)) for item in items for _ in range(2)]
    seeded, full = aligned(texts, items)
    assert seeded <= full and len(full) >= 70 and len(seeded) >= 0.95 * len(full)


def test_common_seeds_find_edited_copies(spark):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(3000)]
    noise = lambda n: " ".join(rng.choices(vocab, k=n))
    item = noise(30)
    edited = item.split()
    edited[2::5] = ["zz"] * len(edited[2::5])
    # more copies than a rare seed may have, and a whole one that lowers the median of the item's seeds
    texts = [f"{noise(60)} {' '.join(edited)} {noise(60)}" for _ in range(40)] + [item] + [noise(120) for _ in range(200)]
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    df = docs(spark, texts)
    assert sorted(r.doc_id for r in decontaminate.hits(df, bench).collect()) == list(range(41))
    marked = decontaminate.rare(df.select("text"), decontaminate.prepare([(0, item)]))
    assert 0 < marked.rare.sum() < len(marked.rare) == 28 + 27  # whole and gapped


def test_score_bounds_hold():
    rng = np.random.default_rng(9)
    for _ in range(500):
        a, b = rng.integers(0, 9, rng.integers(1, 20)).astype(np.uint64), rng.integers(0, 12, rng.integers(1, 30)).astype(np.uint64)
        ours, theirs = decontaminate._in_common(a, b)
        assert ours.tolist() == np.isin(a, b).tolist() and theirs.tolist() == np.isin(b, a).tolist()
        assert decontaminate.smith_waterman(a, b)[0] <= min(decontaminate._bound(ours), decontaminate._bound(theirs))


def test_smith_waterman_equals_plain():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 9)).astype(np.uint64), rng.integers(0, 6, rng.integers(1, 15)).astype(np.uint64)
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.smith_waterman(a, b)[0] == h.max()


def test_langid(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(df)
    extra = spark.createDataFrame([(-1, None, "a"), (-2, "123 !!", "b")], "doc_id long, text string, lang_pred string")
    odd = {r.doc_id: (r._lang_pred, r.score, r.rejected) for r in langid.predict(extra, model).collect()}
    assert odd == {-1: ("und", 0.0, True), -2: ("und", 0.0, True)}
    rows = langid.predict(df, model).where(langid.held_out(df.doc_id)).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.97 and np.mean([r.rejected for r in rows]) <= 0.03
    assert langid.predict(extra, langid.train(df.limit(0))).where("lang_pred = 'x'").count() == 0


def test_license_inheritance(spark):
    files = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "import os"), (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0.\n" + "code " * 20), (4, "z/w.py", None), (5, None, "x"), (6, "a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3.")]
    got = {r.id: (r.license, r.basis, r.license_dir) for r in license_scan.scan(spark.createDataFrame(files, "id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("GPL-3.0", "inherited", "a/b"), 3: ("Apache-2.0", "own", None), 4: (None, None, None), 5: (None, None, None), 6: ("GPL-3.0", "own", None)}


def test_license_of_whole_texts(spark):
    """Each public text has its own name, whatever its lines say, and hands it down."""
    texts = {name: t for name, t in license_scan.WHOLES[len(license_scan.TEXTS) :]}
    assert {"GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Apache-2.0", "CC0-1.0"} <= set(texts)
    bsd = "Copyright (c) The Authors. All rights reserved.\n\n" + dict(license_scan.TEXTS)["BSD-3-Clause"].replace(". ", ".\n").replace("copyright holder", "University")
    rows = [(n, f"p{n}/LICENSE", "Copyright 2024 Someone\n\n" + t) for n, t in texts.items()] + [(n + " child", f"p{n}/a/b/x.py", "import os") for n in texts]
    rows += [("BSD-3-Clause", "b/LICENSE", bsd), ("BSD-3-Clause child", "b/x", "x")]
    odd = "This licence is made up. " + " ".join(f"word{k} shall bind the parties" for k in range(80)) + "\nLicensed under CC BY 4.0.\n"
    rows += [("none", "n/LICENSE", "Copyright 2020 Foo. All rights reserved.\n" * 3), ("none child", "n/x", "x"), ("odd", "o/COPYING", odd), ("odd child", "o/x", "x")]
    got = {r.id: (r.license, r.basis) for r in license_scan.scan(spark.createDataFrame(rows, "id string, path string, text string")).collect()}
    for name in [*texts, "BSD-3-Clause"]:
        assert got[name] == (name, "own") and got[name + " child"] == (name, "inherited")
    assert all(got[k] == (None, None) for k in ("none", "none child", "odd", "odd child"))


def test_license_texts_and_odd_files(spark):
    wrapped = dict(license_scan.TEXTS)["MIT"].split()
    wrapped = "\n".join(" ".join(wrapped[i : i + 8]) for i in range(0, len(wrapped), 8))
    gpl = "# " + dict(license_scan.TEXTS)["GPL-3.0"].replace(". ", ".\n# ")
    files = [
        (1, "a/COPYRIGHT", "Copyright (c) 2020 Foo\n" + wrapped),
        (2, "a/x.py", "SPDX-License-Identifier: Apache-2.0\n" + "code " * 20),
        (3, "b/y.c", gpl),
        (4, "a/z", "no notice"),
        (4, "a/z", "no notice"),
        (None, "b/w", "Released under the MIT License."),
        (None, "b/w", "Released under the MIT License."),
        (5, "c/v", "licence " * 100_000),
        (6, "d", ""),
        (7, "c/u", "Released under the MIT License.\nReleased under the ISC License."),
    ]
    df = spark.createDataFrame([(*f, "x", 1) for f in files], "id long, path string, text string, `own.license` string, K int")
    rows = license_scan.scan(df).collect()
    assert len(rows) == len(files)
    got = {r.id: (r.license, r.basis, r.license_dir) for r in rows}
    assert got[1][:2] == ("MIT", "own") and got[2][:2] == ("Apache-2.0", "own") and got[3][:2] == ("GPL-3.0", "own")
    assert got[4] == ("MIT", "inherited", "a") and got[None][:2] == ("MIT", "own")
    assert got[5] == ("MIT", "inherited", "c") and got[6] == (None, None, None) and got[7][:2] == ("MIT", "own")
    assert license_scan.scan(df.limit(0)).count() == 0
