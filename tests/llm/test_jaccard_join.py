import random
import re
from itertools import combinations

import numpy as np
import pytest

from quirework.llm import jaccard_join as j


def brute(rows, k=4, percent=85):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return sorted((d, len(s), top(d)) for d, s in sets.items())


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6)))
    base = [[word() for _ in range(rnd.choice([3, 5, 9, 30, 80]))] for _ in range(25)]
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(260):
        w = list(rnd.choice(base)) if rnd.random() < 0.8 else [word() for _ in range(30)]
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            w[rnd.randrange(len(w))] = word()
        if rnd.random() < 0.2:
            w += passage
        rows.append((i * 7, rnd.choice([" ", "\n", "\t "]).join(w)))
    return rows + [(5, None), (6, ""), (8, " \n "), (9, "One"), (10, "one"), (11, "a b c d"), (12, "A b C d"), (13, "a b"), (15, "É x y z"), (16, "é x y z")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, shingles string, n bigint").repartition(5)
    assert sorted(tuple(r) for r in j.jaccard_components(df).collect()) == brute(rows)


def test_one_large_group_of_near_copies(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(9999)}" for _ in range(60)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(60)] = f"z{rnd.randrange(9999)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert sorted(tuple(r) for r in j.jaccard_components(df).collect()) == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    got = sorted(tuple(r) for r in j.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(1, 3, 1), (1, 3, 1), (2, 3, 1)]
    assert j.jaccard_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_long_chain_is_one_component(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 400), (400, 450)]
    got = {r["node"]: r["component"] for r in j.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(101)}, 500: 400, 450: 400, 400: 400}


def test_blocks_lose_no_pair(spark):
    """Whoever shares a list, is in another group, and may reach the threshold by position and size, meets."""
    rng = np.random.default_rng(4)
    n, percent = 1500, 85
    size = rng.integers(10, 30, 400)
    of, bucket = rng.integers(0, 120, 400), rng.integers(0, 9, 400)
    rows = {(int(v), int(d)): int(p) for v, d, p in zip(rng.integers(0, 40, n), rng.integers(0, 400, n), rng.integers(0, 5, n))}
    table = [(v, d, 7, int(size[d]), p, int(of[d]), int(bucket[d])) for (v, d), p in rows.items()]
    index = spark.createDataFrame(table, "value bigint, doc_id bigint, h1 bigint, n bigint, position bigint, component bigint, bucket bigint")
    met = {}
    for r in j.meetings(index, percent).collect():
        met.setdefault((r["low"], r["high"]), set()).add(r["doc_id"])
        assert r["side"] == (2 if r["low"] == r["high"] else int(r["high"] == bucket[r["doc_id"]]))
    checked = 0
    for (v, d), p in rows.items():
        for (w, e), q in rows.items():
            if v == w and of[d] != of[e] and min(size[d] - p, size[e] - q) >= j.least_overlap(size[d], size[e], percent):
                assert {d, e} <= met[min(bucket[d], bucket[e]), max(bucket[d], bucket[e])]
                checked += 1
    assert checked > 100


def test_derived_overlaps_are_the_true_ones():
    rng = np.random.default_rng(5)
    core = np.sort(rng.choice(500, 60, replace=False))
    rows = [np.unique(np.concatenate([rng.choice(core, 55, replace=False), rng.integers(0, 500, 4)])) for _ in range(80)] + [np.arange(3), np.arange(490, 500)]
    overlaps = j.Overlaps(rows[:50], 500)
    for r in rows:
        assert overlaps.of(r).tolist() == [len(np.intersect1d(r, t)) for t in rows[:50]]


def test_five_thousand_near_copies_and_one_shingle_in_every_document(spark, monkeypatch):
    """One group over many buckets, each of its sets with another text, beside documents that share only a passage with it."""
    monkeypatch.setattr(j, "WEIGHT", 1 << 14)
    rnd = random.Random(3)
    passage = "the very same words everywhere".split()
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base + passage))]
    for i in range(1, 5000):
        w = list(base)
        w[rnd.randrange(60)] = f"z{i}"  # 4 of 62 shingles at most: always linked with the base, seldom with each other
        rows.append((i, " ".join(w + passage)))
    rows += [(10_000 + i, " ".join([f"q{i}x{n}" for n in range(rnd.randrange(5, 40))] + passage)) for i in range(500)]
    rows += [(20_000 + i, " ".join(passage)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in j.jaccard_components(df).collect()}
    assert got == {d: 0 if d < 5000 else d if d < 20_000 else 20_000 for d, _ in rows}


def test_texts_that_differ_under_one_id_unite_their_links(spark):
    a, b = "a b c d e f g h i j k l m n o p q r s t u v w x y z", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26"
    rows = [(1, a), (2, a), (2, b), (3, b), (4, b + " 27"), (9, "else")]
    got = sorted(tuple(r) for r in j.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(1, 23, 1), (2, 23, 1), (2, 23, 1), (3, 23, 1), (4, 24, 1), (9, 1, 9)]


def test_very_long_texts_and_clashing_columns(spark):
    rnd = random.Random(8)
    words = [f"w{rnd.randrange(50_000)}" for _ in range(120_000)]
    near = list(words)
    for _ in range(1500):
        near[rnd.randrange(len(near))] = "changed"
    rows = [(3, " ".join(words)), (2, " ".join(near)), (1, "x" * 1_000_000), (5, "x" * 1_000_000)]
    df = spark.createDataFrame([(d, t, 1, 2, 3, 4) for d, t in rows], "doc_id bigint, text string, h1 int, component int, n_shingles int, component_id int")
    got = {r["doc_id"]: r["component_id"] for r in j.jaccard_components(df).collect()}
    assert got == {3: 2, 2: 2, 1: 1, 5: 1}


def test_repeated_rows_in_equal_batches(spark, monkeypatch):
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(99999)}" for _ in range(120)]
    near = list(base)
    for at in (10, 100):
        near[at] = "z"
    rows = [(1, " ".join(base))] * 64 + [(2, " ".join(near))]
    monkeypatch.setattr(j, "slices", lambda batch, text: (batch.slice(i, 2) for i in range(0, batch.num_rows, 2)))
    got = [tuple(r) for r in j.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)).collect()]
    assert sorted(got) == [(1, 117, 1)] * 64 + [(2, 117, 1)]
