"""Empty tables, repeated rows, ties, long texts, nulls and clashing columns."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lofted.llm import ann, decontaminate, langid, packing, secret_scan, token_io, tokens, url_filter


def same_twice(f, df, *columns):
    """Repeated rows give repeated results."""
    once, twice = (Counter(tuple(r[c] for c in columns) for r in f(x).collect()) for x in (df, df.unionAll(df)))
    assert twice == Counter({k: 2 * n for k, n in once.items()})
    return once


def test_urls(spark):
    judge = lambda df: url_filter.judge(df, url_filter.rule_table(spark), url_filter.listed_table(spark, ["http://bad.test/p"]))
    kind = "page_id long, url string, rule string, `Host` string, k int"
    pages = spark.createDataFrame([(1, "http://a.org/x", "z", "h", 1), (2, None, "z", None, 2), (3, "http://bad.test/p", None, "h", 3), (4, "http://" + "a" * 100_000 + ".org/", "", "", 4)], kind)
    got = same_twice(judge, pages.select("page_id", "url"), "page_id", "verdict")
    assert got == {(1, "allow"): 1, (2, "allow"): 1, (3, "block"): 1, (4, "allow"): 1}
    assert judge(pages.select("page_id", "url").limit(0)).count() == 0
    assert Counter((r.page_id, r.verdict) for r in judge(pages.select("page_id", "url", "k")).collect()) == got


def test_secrets(spark):
    key = "AKIA" + "Q" * 16
    texts = [None, "", "x " * 400_000 + key, "password = 'abcdefghijklmnop'", "deadbeef" * 3]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, Spans string")
    got = same_twice(secret_scan.digests, df, "doc_id", "n_assign", "n_access", "n_hex")
    assert got == {(0, 0, 0, 0): 1, (1, 0, 0, 0): 1, (2, 0, 1, 0): 1, (3, 1, 0, 0): 1, (4, 0, 0, 1): 1}
    assert secret_scan.digests(df.limit(0)).count() == 0


def test_neighbours(spark):
    own = np.eye(4).repeat(6, axis=0)
    rows = [(i, v.tolist(), 5, "x") for i, v in enumerate(own)] + [(0, own[0].tolist(), 5, "x"), (5, own[5].tolist(), 5, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, Score int, rank string")
    got = {}
    for r in ann.search(df, every=20, k=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    # equal scores in order of vec_id, a repeated candidate counts twice, a repeated query once
    assert sorted(got) == [0, 20] and sorted(got[0]) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (4, 4, 1.0)]
    assert [v for _, v, _ in sorted(got[20])] == [18, 19, 21, 22]


def test_packing_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "other words"), (None, None)], "doc_id long, text string")
    rows = packing.pack(df).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4
    assert Counter(r.ids_crc32 for r in rows).most_common(1)[0][1] == 2


def test_decontamination_of_long_texts_and_null_items(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(4000)]
    item = " ".join(rng.choices(vocab, k=25))
    long = " ".join(rng.choices(vocab, k=150_000))
    df = spark.createDataFrame([(1, long + " " + item + " " + long), (2, long), (3, None), (3, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (7, item), (8, "")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.hits(df, bench).collect())
    assert got == {(1, None): 1, (1, 7): 1, (3, None): 1, (3, 7): 1}
    assert decontaminate.hits(df, bench.where("item_id = 8")).count() == 0


def test_languages(spark):
    rng = random.Random(5)
    words = {"aa": ["katu", "melo", "rina", "soba"], "bb": ["zwerg", "strumpf", "knall", "pferd"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=120)), lang, "s", 1) for i, lang in enumerate(["aa", "bb"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, Score int")
    model = langid.train(docs)
    odd = [(1, None), (2, "123 !!"), (3, " ".join(rng.choices(words["bb"], k=100_000))), (4, ""), (5, " ".join(words["aa"] * 20))]
    asked = spark.createDataFrame(odd, "doc_id long, text string")
    got = same_twice(lambda df: langid.predict(df, model), asked, "doc_id", "lang_pred")
    assert got == {(1, "und"): 1, (2, "und"): 1, (3, "bb"): 1, (4, "und"): 1, (5, "aa"): 1}
    assert langid.predict(asked.limit(0), model).count() == 0
    assert langid.predict(docs.select("doc_id", "text", "lang_pred"), model).count() == 120


def test_token_files(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.default_path())
    rows = [(1, "one text"), (1, "another one"), (1, "one text"), (0, None), (5, "word " * 60_000)]
    got = token_io.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = []
    for i, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(want)
    starts = sorted((r.start, r.n_tokens, r.doc_id) for r in got)
    assert [s for s, _, _ in starts] == np.cumsum([0, *(n for _, n, _ in starts[:-1])]).tolist() and [d for _, _, d in starts] == [0, 1, 1, 1, 5]
    assert token_io.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
