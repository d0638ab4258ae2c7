import math
from fractions import Fraction

import numpy as np
import pytest

from quirework.llm import whitening as W


def exact_covariance(vectors):
    """n, S and V of the distinct vectors, in fractions."""
    n, d = len(vectors), len(vectors[0])
    sums = [sum(v[i] for v in vectors) for i in range(d)]
    c = [[v[i] - Fraction(sums[i], n) for i in range(d)] for v in vectors]
    return n, sums, [[sum(r[i] * r[j] for r in c) / n for j in range(d)] for i in range(d)]


def test_error_free_parts():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=200) * 10.0 ** rng.integers(-9, 9, 200), rng.normal(size=200)
    for f, op in ((W.two_sum, Fraction.__add__), (W.two_product, Fraction.__mul__)):
        s, e = f(a, b)
        assert all(Fraction(x) + Fraction(y) == op(Fraction(p), Fraction(q)) for x, y, p, q in zip(s, e, a, b))
    high, low = W.two_sum(a.reshape(50, 4), b.reshape(50, 4) * 1e-17)
    parts = W.cut(high, low)
    for col in range(4):
        top = max(abs(high[:, col]))
        for i in range(50):
            left = Fraction(high[i, col]) + Fraction(low[i, col]) - sum(Fraction(p[i, col]) for p in parts)
            assert abs(left) <= Fraction(top) * Fraction(1, 2**80)


@pytest.mark.parametrize("offset", [0, 10**9])
def test_moments_are_double_double(offset):
    rng = np.random.default_rng(3)
    x = rng.integers(-500, 500, (1300, 5)) + offset
    n, sums, v = exact_covariance([r.tolist() for r in x])
    g = W.Gram(5, 5).add(W.Centre(n, sums).subtract(x))
    for i in range(5):
        for j in range(5):
            got = (Fraction(g.high[i, j]) + Fraction(g.low[i, j])) / n
            assert abs(got - v[i][j]) <= Fraction(1, 2**75) * v[i][i]


def test_eigenpairs_of_close_values():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(8, 8)))
    m = q @ np.diag([9.0, 9.0 - 1e-9, 5, 5, 2, 1, 1e-8, 0]) @ q.T
    m = (m + m.T) / 2
    values, x = W.eigenpairs(m, np.zeros_like(m))
    assert np.all(np.diff(values) <= 1e-15) and np.abs(x.T @ x - np.eye(8)).max() < 1e-15 * 8
    for k in range(8):
        residual = [sum(Fraction(m[i, j]) * Fraction(x[j, k]) for j in range(8)) - Fraction(values[k]) * Fraction(x[i, k]) for i in range(8)]
        assert max(map(abs, residual)) < 2e-15 * 9


def check(spark, rows, parts=3, **how):
    """Compares whiten() with fractions and a plain eigen-solve."""
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, n string, component int").repartition(parts)
    got = W.whiten(df, **how).collect()
    good = [(i, [math.floor(256 * e) for e in v]) for i, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    width = max(len(v) for _, v in good)
    good = [(i, v + [0] * (width - len(v))) for i, v in good]
    n, sums, v = exact_covariance(sorted(set(map(tuple, (x for _, x in good)))))
    values, u = np.linalg.eigh(np.array([[float(a) for a in r] for r in v]))
    values, u = values[::-1], u[:, ::-1]
    trace, k = sum(v[i][i] for i in range(width)), min(4, width)
    assert len(got) == k * len(good)
    order = lambda r: ((r[0] is None, r[0] or 0), *(str(x) for x in r[1:]))
    want = sorted(((i, c + 1, n, sum((n * e - s) ** 2 for e, s in zip(x, sums))) for i, x in good for c in range(k)), key=order)
    assert sorted(((r.vec_id, r.component, r.n, r.deviation) for r in got), key=order) == want
    signs, of = {}, {}
    for r in got:
        of.setdefault((r.vec_id, r.component), []).append(r)
    for i, x in good:
        for c in range(k):
            if values[c] > 1e-9:
                w = sum(float(e - Fraction(s, n)) * u[d, c] for d, (e, s) in enumerate(zip(x, sums))) / math.sqrt(values[c])
                near = min(of[i, c + 1], key=lambda r: min(abs(r.whitened - w), abs(r.whitened + w)))
                assert abs(abs(near.whitened) - abs(w)) < 1e-9 * max(1, abs(w))
                if abs(w) > 1e-6:
                    signs.setdefault(c, set()).add(np.sign(near.whitened) == np.sign(w))
    assert all(len(s) == 1 for s in signs.values())
    for r in got:
        assert abs(r.explained - values[r.component - 1] / float(trace)) < 1e-10 and r.identity_error < 1e-9
    return got


def test_against_fractions(spark, monkeypatch):
    rng = np.random.default_rng(7)
    scale = np.array([3, 2, 1, 0.5, 0.2, 0.1])
    rows = [(i, (rng.normal(size=6) * scale).tolist()) for i in range(150)]
    rows += [(200 + i, list(rows[0][1])) for i in range(300)]  # a group of copies
    rows += [(5, list(rows[5][1])), (5, [9.0] * 6), (None, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (600, [1.0, -2.0]), (601, []), (602, None), (603, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (604, [float("nan")] * 6), (605, [math.inf] + [0.0] * 5)]
    check(spark, rows)
    monkeypatch.setattr(W, "BAND", 7)  # many bands
    check(spark, rows[:40], parts=2)


def test_large_offsets(spark):
    """Without compensation the spread of these would be lost."""
    rng = np.random.default_rng(9)
    rows = [(i, (1e8 + rng.integers(-40, 40, 3) / 4).tolist()) for i in range(60)]
    check(spark, rows)


def test_deviations_beyond_a_long(spark):
    df = spark.createDataFrame([(1, [3e9, 0.0]), (2, [-3e9, 1.0]), (3, [0.0, 2.0])], "vec_id bigint, embedding array<double>")
    rows = {r.vec_id: r.deviation for r in W.whiten(df).filter("component = 1").collect()}
    assert rows[1] is None and rows[2] is None and rows[3] == (3 * 512 - 768) ** 2


def test_no_spread_and_no_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert W.whiten(spark.createDataFrame([], schema)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    rows = W.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert sorted(tuple(r) for r in rows) == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    line = W.whiten(spark.createDataFrame([(i, [float(i), float(i)]) for i in range(5)], schema)).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)}
    assert all(r.identity_error < 1e-12 for r in line) and {round(r.explained, 12) for r in line} == {0.0, 1.0}
    with pytest.raises(ValueError):
        W.whiten(spark.createDataFrame([(1, [0.0] * 5000)], schema))
