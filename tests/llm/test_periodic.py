import hashlib
import random
import zlib

import numpy as np
import pytest

from quirework.llm import periodic


def brute_runs(x, least=12):
    """(start, length, period) of maximal repetitions, smallest period each, straight from the definition."""
    found = {}
    n = len(x)
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if x[i] != x[i - q]:
                i += 1
                continue
            j = i
            while j < n and x[j] == x[j - q]:
                j += 1
            b, e = i - q, j
            if e - b >= max(least, 2 * q):
                found.setdefault((b, e), q)
            i = j
    return sorted((b, e - b, q) for (b, e), q in found.items())


def brute_row(doc_id, text):
    words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for b, k, q in runs for i in range(b + q, b + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{b},{k},{q}\n" for b, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("least", [2, 5, 8, 12])
def test_runs_against_the_definition(least):
    rnd = random.Random(least)
    for trial in range(400):
        kinds, n = rnd.choice([1, 2, 2, 3, 4]), rnd.randint(1, 120)
        x = [rnd.randint(1, kinds) for _ in range(n)]
        if trial % 3 == 0:  # copies of longer pieces, nested repetitions
            while len(x) < 150:
                a = rnd.randrange(len(x))
                x += x[a : a + rnd.randint(1, 40)] * rnd.randint(1, 4)
        got = periodic.runs(np.array([*x, 0], np.int64), least)
        assert [tuple(r) for r in got.tolist()] == sorted(brute_runs(x, least), key=lambda r: (r[0], r[2]))
        many = periodic.runs_of_documents([np.array(x, np.int64), np.zeros(0, np.int64), np.array(x[::-1], np.int64)], least)
        assert [tuple(r) for r in many[0].tolist()] == [tuple(r) for r in got.tolist()] and not len(many[1])
        assert len(many[2]) == len(many[0])


def test_previous_factors_and_blocks():
    x = [1, 2, 1, 2, 1, 3, 1, 2, 1, 3, 3]
    s = periodic.Suffixes(np.array([*x, 0], np.int64))
    length, source = s.previous_factors()
    for i in range(len(x)):
        best = max((next((k for k in range(len(x) - i) if x[i + k] != x[j + k]), len(x) - i) for j in range(i)), default=0)
        assert length[i] == best
        assert not best or (source[i] < i and x[source[i] : source[i] + best] == x[i : i + best])
    assert periodic.blocks(length)[:4] == [0, 1, 2, 5]


def rows():
    rnd = random.Random(11)
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    text = lambda n, k: " ".join(f"w{rnd.randint(1, k)}" for _ in range(n))
    out = [(i, text(rnd.randint(0, 90), rnd.choice([2, 5, 300]))) for i in [*ids, *range(40)]]
    out += [(50, None), (51, ""), (52, " \t\n"), (53, "a b c " * 9), (53, "a b c " * 9), (54, "x y   z " * 7), (None, "no no " * 9), (None, None)]
    out += [(ids[0], None), (ids[1], "one"), (60, "la " * 5000), (61, "\v".join(["é", "ß", "é", "ß"] * 8)), (62, "A a " * 12)]
    return [(i, t, "x", [1]) for i, t in out]


def test_query_against_the_definition(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id bigint, text string, runs string, collapsed array<int>").repartition(3)
    got = periodic.digests(df)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((brute_row(i, t) for i, t, *_ in data), key=key)


def test_a_long_text_and_an_empty_table(spark):
    rnd = random.Random(2)
    words = [f"w{rnd.randint(1, 5000)}" for _ in range(60_000)]
    text = " ".join(words + words[100:900] * 5 + words)
    row = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert [(r.start, r.length, r.period) for r in row.runs if r.period == 800] == [(60_000, 4000, 800)]
    assert len(row.collapsed.split(" ")) == 120_800
    assert periodic.digests(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
