import math
import random

import numpy as np
import pytest

from quirework.llm import maxscore


@pytest.mark.parametrize("seed,n,dims,density,levels", [(1, 300, 16, 1.0, 200), (2, 400, 40, 0.1, 5), (3, 50, 3, 0.5, 1), (4, 7, 8, 1.0, 2), (5, 500, 12, 0.02, 3)])
def test_index_finds_the_best(seed, n, dims, density, levels):
    rng = np.random.default_rng(seed)
    v = rng.integers(-levels, levels + 1, (n, dims)) * (rng.random((n, dims)) < density)
    index = maxscore.Index(v)
    for q in v[:20]:
        rows, scores = index.search(q, 5)
        assert (v[rows] @ q == scores).all()
        want = np.sort(v @ q)[::-1][:5]
        assert (np.sort(scores)[::-1][: len(want)] == want).all()
        assert set(np.flatnonzero(v @ q >= want[-1])) <= set(rows)
        # from a threshold of another shard on: all that reach it, and the best if there are more
        for theta in (int(want[0]), int(want[-1]) - 3, int(want[0]) + 1):
            rows, scores = index.search(q, 5, theta)
            assert set(np.flatnonzero(v @ q >= max(theta, want[-1]))) <= set(rows) and (v[rows] @ q == scores).all()


def test_only_competitive_blocks_are_traversed(monkeypatch):
    """Sparse vectors: lists of small bounds are not traversed, nor are blocks under their level."""
    rng = np.random.default_rng(7)
    v = np.zeros((5000, 30), np.int64)
    v[np.arange(5000), rng.integers(0, 30, 5000)] = rng.integers(1, 100, 5000)
    q = np.zeros(30, np.int64)
    q[:10] = [50, 2, 1, 1, 1, 1, 1, 1, 1, 1]
    index, heads = maxscore.Index(v), []
    head = index._head
    monkeypatch.setattr(index, "_head", lambda d, x, length: heads.append((int(d), length)) or head(d, x, length))
    rows, scores = index.search(q, 5, 4500)
    assert sorted(scores)[-5:] == sorted(v @ q)[-5:] and {d for d, _ in heads} == {0}
    assert all(n <= 2 * maxscore.BLOCK for _, n in heads) and np.count_nonzero(v[:, 0]) > 100


def brute_rows(rows, picked, k):
    """Every row a candidate of its own: (id, vector) pairs."""
    out = []
    for i, (q, x) in enumerate(rows):
        if picked(q):
            scores = sorted((-sum(a * b for a, b in zip(x, y)), c) for j, (c, y) in enumerate(rows) if j != i)
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def test_query_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1.0, -0.5, 0.0, 0.25, 0.7]) for _ in range(6)], "x", 1) for i in range(230)]
    rows += [(230, None, "x", 1), (231, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x", 1), (250, [float("nan")] * 6, "x", 1), (300, [math.inf] * 6, "x", 1), (None, [1.0] * 6, "x", 1)]
    rows += [(350, [], "x", 1), (400, [3.0], "x", 1), (7, list(rows[7][1]), "x", 1), (7, [1.0, 1.0, 1.0, -1.0, -1.0, -1.0], "x", 1), (50, list(rows[50][1]), "x", 1), (50, [0.7] * 6, "x", 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string, row int")
    got = sorted(tuple(r) for r in maxscore.every_fiftieth(df).collect())
    finite = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    assert got == brute_rows(finite, lambda i: i % 50 == 0, 5)


def test_many_shards_and_blocks(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.randint(-9, 9) for _ in range(5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>").repartition(3)
    got = sorted(tuple(r) for r in maxscore.top_k(df, "vec_id % 10 = 0", k=4, shard=40, block=7).collect())
    assert got == brute_rows(rows, lambda i: i % 10 == 0, 4)


def test_long_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-3, 4, 20_000) * (rng.random(20_000) < 0.01)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>").repartition(2)
    assert sorted(tuple(r) for r in maxscore.top_k(df, "vec_id % 20 = 0", k=3).collect()) == brute_rows(rows, lambda i: i % 20 == 0, 3)


def test_sql_says_the_same_of_repeated_rows(spark):
    import duckdb
    import pyarrow as pa

    rows = [(i % 40 * 5, [((i * 7 + d * 3) % 11) / 11 - 0.4 for d in range(4)]) for i in range(90)]
    db = duckdb.connect()
    db.register("embeddings", pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))}))
    want = db.sql("SELECT query_id, rank, vec_id, score FROM (" + maxscore.SQL + ")").fetchall()
    got = maxscore.every_fiftieth(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_and_few(spark):
    assert maxscore.every_fiftieth(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert maxscore.every_fiftieth(spark.createDataFrame([(50, [1.0])], "vec_id bigint, embedding array<float>")).count() == 0
    same = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(100)], "vec_id bigint, embedding array<float>")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in maxscore.every_fiftieth(same).collect()) == [(0, i, i) for i in range(1, 6)] + [(50, i + 1, i) for i in range(5)]
