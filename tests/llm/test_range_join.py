import math

import numpy as np
import pytest

from quirework.llm import range_join as R


def brute(rows, threshold=0.98):
    """(vec_id, n_links, component_id, kept) of each row with an id, by comparing all."""
    rows = [r for r in rows if r[0] is not None]
    width = max((len(v) for _, v, _ in rows if v is not None), default=0)
    good = [i for i, (_, v, label) in enumerate(rows) if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i in range(len(rows))}
    if good:
        x = np.array([list(rows[i][1]) + [0.0] * (width - len(rows[i][1])) for i in good])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        label = np.array([rows[i][2] for i in good])
        for p, q in zip(*np.nonzero((x @ x.T >= threshold) & (label[:, None] == label[None, :]))):
            if p != q:
                near[good[p]].add(good[q])
    seen, out = {}, []
    for i in range(len(rows)):
        if i not in seen:
            todo, members = [i], {i}
            while todo:
                for j in near[todo.pop()] - members:
                    members.add(j)
                    todo.append(j)
            least = min(rows[j][0] for j in members)
            seen.update(dict.fromkeys(members, least))
        out.append((rows[i][0], len(near[i]), seen[i], rows[i][0] == seen[i]))
    return sorted(out)


def clusters(seed, n, dims, spreads, labels=2):
    """Background, groups of near copies of different spread, exact copies."""
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=dims) for _ in range(n)]
    for size, spread in spreads:
        centre = rng.normal(size=dims)
        centre /= np.linalg.norm(centre)
        x += [centre + spread * rng.normal(size=dims) / math.sqrt(dims) for _ in range(size)]
    x += x[:: max(1, len(x) // 40)]
    order = rng.permutation(len(x))
    return [(int(i), [float(e) for e in x[k]], int(rng.integers(labels)) if spreads == [] else int(k % 7 == 0)) for i, k in enumerate(order)]


def answer(spark, rows, **how):
    df = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], "vec_id bigint, embedding array<double>, label int, node int, cell string").repartition(3)
    return sorted(tuple(r) for r in R.range_components(df, **how).collect())


@pytest.mark.parametrize("seed,dims,spreads,cell", [
    (1, 12, [(160, 0.08), (60, 0.12), (40, 0.2)], 30),
    (3, 6, [(120, 0.14), (120, 0.18)], 40),
])
def test_small_cells(spark, monkeypatch, seed, dims, spreads, cell):
    rows = clusters(seed, 220, dims, spreads)
    kinds, chosen = set(), R._plans
    monkeypatch.setattr(R, "_plans", lambda *a: (p := chosen(*a).cache(), kinds.update(r.k < 0 for r in p.collect()))[0])
    assert answer(spark, rows, cell=cell, visitors=50) == brute(rows)
    assert kinds == {False, True}  # pivots, and balls


def test_no_round_and_one_cell(spark):
    rows = clusters(4, 60, 5, [(40, 0.1)])
    want = brute(rows)
    assert answer(spark, rows) == want
    assert answer(spark, rows, cell=16, visitors=20, rounds=0) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), math.inf
    rows = [(1, [1.0, 0.0], 3), (2, [2.0, 0.0], 3), (3, [1.0, 0.0], 4), (4, [1.0, 0.0], None), (5, None, 3), (6, [0.0, 0.0], 3), (7, [1.0, nan], 3)]
    rows += [(8, [1.0, None], 3), (9, [inf, 0.0], 3), (10, [], 3), (None, [1.0, 0.0], 3), (2, [2.0, 0.0], 3), (2, [0.0, 1.0], 3), (11, [1e-200, 1e-201], 3), (12, [1e200, 1e199], 3)]
    rows += [(13, [5.0], 3), (14, [1.0, -0.0], 3), (15, [-1.0, 0.0], 3), (0, [0.0, 1.0, 0.1], 3)]
    assert answer(spark, rows) == brute(rows)
    assert R.range_components(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_sql_says_the_same(spark):
    import duckdb
    import pyarrow as pa

    rows = clusters(6, 40, 4, [(30, 0.1)]) + [(500, [0.0] * 4, 0), (501, None, 0), (502, [1.0, 0.5, 0.2, 0.1], None)]
    db = duckdb.connect()
    db.register("embeddings", pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64())), "label": pa.array([r[2] for r in rows], pa.int32())}))
    assert sorted(db.sql(R.SQL).fetchall()) == answer(spark, rows)


def test_pivots_lose_no_pair():
    """Whatever is within r meets: at home together, or the one with the smaller home visits the other."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = 0.2
    pivots = R.far_pivots(x, 12, 2 * r)
    assert len(pivots) > 3 and (R.distances(pivots, pivots) + 9 * np.eye(len(pivots))).min() >= 2 * r
    home, near, far = R.Pivots(pivots, r).assign(x)
    d = R.distances(x, x)
    radius = [max(R.distances(x[home == k], pivots[k : k + 1]).max(initial=0), 0) for k in range(len(pivots))]
    sent = 0
    for i, j in zip(*np.nonzero(d <= r)):
        reach = {k for k, at in zip(near[i], far[i]) if at <= radius[k] + r + R.SLACK}
        assert home[j] in reach
    for i in range(len(x)):
        sent += sum(at <= radius[k] + r for k, at in zip(near[i], far[i])) - 1
    assert sent < 0.6 * len(x) * (len(pivots) - 1)


def test_a_ball_is_found_and_holds_only_links():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 16))
    x[:80] = x[0] + 0.02 * rng.normal(size=(80, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = R.ball(x, 0.2)
    inside = R.distances(x, centre[None, :])[:, 0] <= 0.1
    assert inside.sum() >= 70 and (x[inside] @ x[inside].T).min() >= 0.98
    assert R.ball(x[80:], 0.2) is None
