import random
import re

import pytest

from lofted.llm import ngram_join

SCHEMA = "doc_id long, text string, Component_ID string"


def brute(rows):
    """Components by comparing every pair."""
    sets = []
    for _, text, *_ in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                comp[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(60)]
    texts = []
    while len(texts) < n:
        kind = rng.random()
        if texts and kind < 0.25:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.7:
            w = rng.choice(texts[:3] if kind < 0.5 else texts).split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
        elif kind < 0.8:
            texts.append(" ".join(passage + [rng.choice(vocab) for _ in range(rng.randint(0, 25))]))
        else:
            texts.append(" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 5, 8, 40, 120]))))
    rng.shuffle(texts)
    return [(i, t, "x") for i, t in enumerate(texts)]


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,posting", [(1, 1024), (2, 8)])
def test_components_equal_brute_force(spark, monkeypatch, seed, posting):
    # with few groups to a posting, common shingles are dealt to several
    monkeypatch.setattr(ngram_join, "POSTING", posting)
    rows = corpus(seed)
    assert got(ngram_join.link(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_nulls_ties_and_long_texts(spark):
    long = " ".join(f"a{i % 997}b{i % 31}" for i in range(40_000))
    rows = [(1, None, None), (2, "", "x"), (3, " \t\n", "x"), (4, "Same Words", "x"), (5, "same words", "x"), (None, "same words", "x"), (7, long, "x"), (8, long + " end", "x"), (9, "É a b c d e", "x"), (9, "É a b c d e", "x"), (10, "é a b c d e", "x"), (None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(ngram_join.link(df)) == brute(rows)
    kept = ngram_join.keep_one(df)
    assert kept.columns == ["doc_id", "text", "Component_ID"]
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(map(repr, [1, 2, 3, 4, 7, 9, 10, None]))


def test_one_row_of_each_component_stays(spark):
    text = "one two three four five six"
    rows = [(1, "other words here", 0), (1, text, 1), (2, text, 2), (None, text, 3), (5, text.upper(), 4), (None, "alone in this table", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int")
    assert sorted(r["a.b"] for r in ngram_join.keep_one(df).collect()) == [0, 1, 5]
    nulls = spark.createDataFrame([(None, text, 1), (None, text + " seven", 2), (None, text, 1)], "doc_id long, text string, K int")
    assert ngram_join.keep_one(nulls).count() == 2


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_join.link(empty).count() == 0
    assert ngram_join.keep_one(empty).count() == 0


def test_overlap_bounds():
    for a in range(1, 60):
        for b in range(1, 60):
            need = int(ngram_join.pair_overlap(a, b))
            assert 100 * need >= 80 * (a + b - need) and not 100 * (need - 1) >= 80 * (a + b - need + 1)


def test_a_centre_dealt_to_several_tasks_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HUB_PAIRS", 2)
    rows = corpus(5, 120)
    rows += [rows[0]] * 6 + [rows[7]] * 3 + [(None, rows[1][1], "x"), (500, "", "x")]
    assert got(ngram_join.link(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
