"""The n-gram join and components against brute force."""

import random

import numpy as np
import pytest

from vellumine.llm import ngram_join as N
from vellumine.llm.components import components
from vellumine.llm.skew import join_hot

DOCS = "doc_id long, text string, lang string, n_grams string"


def sets(text, k):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in "".join(" " if c in "\t\n\v\f\r " else c for c in low).split(" ") if x]
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    s = [sets(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                root[find(i)] = find(j)
    return {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))}


def corpus(seed, n=160):
    random.seed(seed)
    words = [f"w{k}" for k in range(300)]
    passage = [random.choice(words) for _ in range(40)]
    rows, base = [], []
    for k in range(n):
        if base and random.random() < 0.7:
            w = list(random.choice(base[-3:]))
            for _ in range(random.randint(0, 5)):
                w[random.randrange(len(w))] = random.choice(words)
        else:
            w = [random.choice(words) for _ in range(random.randint(1, 120))]
            w = passage + w if random.random() < 0.3 else w
        base.append(w)
        rows.append((k, random.choice([" ", "\n", "\t "]).join(w)))
    return rows


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_components_against_brute_force(spark, seed, k, percent):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component"] for r in N.join(df, k=k, percent=percent).collect()}
    assert got == brute(rows, k, percent)


def brute_links(rows, k, percent):
    s = [sets(t, k) for _, t in rows]
    return {rows[i][0]: sum(1 for j in range(len(rows)) if i != j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])) for i in range(len(rows))}


@pytest.mark.parametrize(("seed", "k", "percent", "block"), [(1, 4, 85, None), (2, 5, 80, None), (3, 2, 60, 300), (4, 4, 85, 100)])
def test_numbers_of_links_against_brute_force(spark, monkeypatch, seed, k, percent, block):
    if block:
        monkeypatch.setattr(N.links_of, "__defaults__", (block,))
        monkeypatch.setattr(N, "PAIRS", 50)
    rows = corpus(seed)
    rows += [(1000 + i, None if i % 3 == 0 else t) for i, (_, t) in enumerate(rows[:40])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = N.join(df, k=k, percent=percent).collect()
    want = brute_links(rows, k, percent)
    assert max(want.values()) > 1 and {r["doc_id"]: r["n_links"] for r in got} == want
    assert {r["doc_id"]: r["component"] for r in got if r["n_grams"]} == {d: c for d, c in brute(rows, k, percent).items() if dict(rows)[d]}


@pytest.mark.parametrize("fragments", [1, 2, 5])
def test_partial_overlaps_against_brute_force(fragments):
    rng = np.random.default_rng(fragments)
    core = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = []
    for n in range(60):
        own = core[rng.random(len(core)) < (0.95 if n % 3 else 0.4)]
        sets.append(np.unique(np.concatenate([own, rng.integers(0, 1 << 63, rng.integers(0, 30), dtype=np.uint64)])) << np.uint64(1))
    sizes = np.array([len(s) for s in sets])
    edges = np.array([(j << 64) // fragments for j in range(1, fragments)], np.uint64)
    cuts = [np.split(s, np.searchsorted(s, edges)) for s in sets]
    for percent in (60, 85):
        links = N.Links(sizes, np.ones(60, np.int64), percent)
        firsts = list(range(60))
        blobs = []
        for f in range(fragments):
            part = N.Fragment([c[f] for c in cuts], sizes, percent)
            blobs.append(N.packed([part.after(i) for i in firsts], firsts, 60))
        for i, *parts in zip(firsts, *[N.unpacked(b, firsts, 60) for b in blobs], strict=True):
            overlap = np.zeros(60, np.int64)
            for where, n in parts:
                overlap[where] += n
            links.add(i, np.flatnonzero(overlap), overlap[overlap > 0])
        want = [sum(1 for j in range(60) if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))) for i in firsts]
        assert links.links.tolist() == want and max(want) > 5


def test_hot_keys_are_joined_apart(spark):
    left = spark.createDataFrame([(k % 3, k) for k in range(30)] + [(7, 100), (None, 101)], "k int, v int")
    right = spark.createDataFrame([(0, 10, "a"), (1, 10, "b"), (7, 1, "c")], "k int, n int, w string")
    for hot in (0, 5, 100):
        inner = sorted((r["k"], r["v"], r["w"]) for r in join_hot(left, right, "k", "n", hot=hot).collect())
        outer = {r["v"]: r["w"] for r in join_hot(left, right, "k", "n", "left", hot=hot).collect()}
        assert len(inner) == 21 and (7, 100, "c") in inner
        assert len(outer) == 32 and outer[2] is None and outer[101] is None and outer[100] == "c" and outer[0] == "a"


def test_odd_rows_have_links(spark):
    rows = [(1, None), (2, ""), (4, "one two"), (5, "one two"), (5, "one two"), (None, "ONE two"), (7, "alone here")]
    got = N.join(spark.createDataFrame(rows, "doc_id long, text string"), k=4, percent=85).collect()
    assert sorted((r["doc_id"] or 0, r["n_links"]) for r in got) == [(0, 3), (1, 0), (2, 0), (4, 3), (5, 3), (5, 3), (7, 0)]


def test_odd_rows(spark):
    long = " ".join(f"x{k % 977}" for k in range(60_000))
    rows = [(1, None, "en", "c"), (2, "", "en", "c"), (3, " \n\t", "en", "c"), (4, "One two", None, None), (5, "one TWO", None, None), (5, "one TWO", None, None), (6, long, None, None), (7, long, None, None), (None, "one two", None, None), (None, None, None, None), (9, "É a b c d", None, None), (10, "é a b c d", None, None)]
    got = N.join(spark.createDataFrame(rows, DOCS), k=4, percent=85).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["n_grams"], r["component"]) for r in got if r["doc_id"] is not None}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (1, 4) and by[5] == (1, 4) and by[7] == (by[6][0], 6) and by[9][1] == 9 and by[10][1] == 10
    assert {(r["n_grams"], r["component"]) for r in got if r["doc_id"] is None} == {(1, 4), (0, None)}
    assert N.join(spark.createDataFrame([], DOCS)).count() == 0


def test_grams_are_words_of_bytes():
    a, b, c = N.gram_sets(["A b\x0bc\x1fd e", "a B c\x1fd\re", "a b c d e"], 3)
    assert np.array_equal(a, b) and not np.array_equal(a, c) and len(a) == 2


def test_long_paths(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(201)}, 1000: 1000, 1001: 1000}
    assert components(edges.limit(0)).count() == 0


def test_rounds_that_do_not_settle_raise(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(edges, most=2)


def test_hub_is_the_greatest_node(spark, monkeypatch):
    monkeypatch.setattr("vellumine.llm.skew.HOT", 20)
    edges = spark.createDataFrame([(k, 999) for k in range(100)], "a long, b long")
    assert {r["root"] for r in components(edges).collect()} == {0}


def test_same_rows_as_sql(same):
    same(N.op3, N.sql())
