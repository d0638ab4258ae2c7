"""Whitening of integer vectors by a compensated covariance.

1. *Fit list.* Each distinct vector once, written as a table; its size n and the sums S of its dimensions are exact whole numbers.
2. *Covariance.* A task centres its vectors by S / n, held as two doubles, and adds up outer products in double-double: the
   centred numbers are cut into slices of so few bits that every product of slices over a block of rows is exact (an
   error-free transformation), and each is added to a high and a low part by two-sum. Tasks give the parts of row bands of the matrix;
   they are merged band by band, high and low, in tasks again. Only the merged matrix comes to the driver: at most WIDTH dimensions
   squared, whatever the number of rows.
3. *Eigenvectors.* ``numpy.linalg.eigh`` (LAPACK's syevd: reduction to a tridiagonal matrix, then divide and conquer) of the high part,
   then a few refinements of all eigenpairs against the double-double matrix, so that they are right to double precision.
4. *Projection.* Each row by itself; the model is a few vectors.

Vectors that are null or hold a null or non-finite entry are dropped. Components missing at the end count as 0. Repeated rows and ids give
their rows each, null ids too; the fit list has each vector once. Entries of which ``scale`` times the value leaves a long
saturate; a deviation beyond a long is null. Components of no spread (eigenvalue under 1e-13 of the
trace) have a null ``whitened``; without any spread ``explained`` and ``identity_error`` are null too. Fewer dimensions than components
give fewer components. Equal eigenvalues: any orthonormal vectors of their space, the same for all rows. Extra columns are not read,
whatever their names. An empty table gives no rows. More than WIDTH dimensions are refused: a covariance of that size would not fit the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop, materialise

#: Dimensions at most. Rows of a block and bits of a slice: products of slices over a block stay below 2**53.
WIDTH, ROWS, BITS, SLICES = 4096, 512, 22, 4
#: Numbers of a band of the matrix, about.
BAND = 1 << 18
NO_SPREAD = 1e-13


def two_sum(a, b):
    """a + b rounded, and what the rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a, b):
    """a * b rounded, and what the rounding lost."""
    p = a * b
    split = lambda x: (h := 134217729.0 * x - (134217729.0 * x - x), x - h)
    (ah, al), (bh, bl) = split(a), split(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def cut(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Numbers high + low as SLICES matrices of BITS bits each, relative to the largest of the column; only what is below all of them is lost."""
    out, rest = [], high
    for k in range(SLICES):
        if k == SLICES // 2:
            rest = rest + low
        most = np.max(np.abs(rest), axis=0, initial=0.0)
        sigma = np.where(most > 0, np.ldexp(1.0, np.frexp(most)[1] + 53 - BITS), 0.0)
        q = (rest + sigma) - sigma
        out.append(q)
        rest = rest - q
    return out


class Gram:
    """X'Y of matrices of doubles in two parts, added up block after block in double-double."""

    def __init__(self, rows: int, columns: int):
        self.high, self.low = np.zeros((rows, columns)), np.zeros((rows, columns))

    def put(self, part: np.ndarray, low: np.ndarray | float = 0.0) -> None:
        s, lost = two_sum(self.high, part)
        self.high, self.low = two_sum(s, self.low + (lost + low))

    def add(self, x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray] | None = None) -> Gram:
        """Adds X'Y (X'X without y); each product of slices is exact."""
        for at in range(0, len(x[0]), ROWS):
            a = cut(x[0][at : at + ROWS], x[1][at : at + ROWS])
            if y is None:
                for i in range(SLICES):
                    for j in range(i, SLICES - i):
                        m = a[i].T @ a[j]
                        self.put(m)
                        if i < j:
                            self.put(m.T)
            else:
                b = cut(y[0][at : at + ROWS], y[1][at : at + ROWS])
                for i in range(SLICES):
                    for j in range(SLICES - i):
                        self.put(a[i].T @ b[j])
        return self


def eigenpairs(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest down and unit eigenvectors (columns) of the symmetric matrix high + low, to double precision."""
    d = len(high)
    values, x = np.linalg.eigh(high)
    zero = np.zeros_like(x)
    for _ in range(4):  # each step squares what is wrong
        product = Gram(d, d).add((high, low), (x, zero))
        s = Gram(d, d).add((x, zero), (product.high, product.low))
        g = Gram(d, d).add((x, zero))
        r = (np.eye(d) - g.high) - g.low
        values = (np.diag(s.high) + np.diag(s.low)) / (1 - np.diag(r))
        # how far the pairs are from exact; closer eigenvalues share a space and are only made orthonormal
        off = (s.high - np.diag(np.diag(s.high))) + (s.low - np.diag(np.diag(s.low)))
        close = 2 * (np.linalg.norm(off) + np.max(np.abs(values), initial=0.0) * np.linalg.norm(r))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > close
        e = np.where(apart, (off + values[None, :] * r) / np.where(apart, gap, 1.0), r / 2)
        np.fill_diagonal(e, np.diag(r) / 2)
        x = x + x @ e
        if np.abs(e).max(initial=0.0) < 1e-15:
            break
    order = np.argsort(-values, kind="stable")
    values, x = values[order], x[:, order]
    sign = np.sign(x[np.argmax(np.abs(x), axis=0), np.arange(d)])
    return values, x * np.where(sign == 0, 1.0, sign)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut to a few million numbers, and their vectors."""
    step = max(ROWS, (1 << 22) // max(1, width) // ROWS * ROWS)
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            b = whole.slice(at, step)
            yield b, _matrix(b.column("x"), width)


class Centre(NamedTuple):
    """Exact mean S / n of the fit list."""

    n: int
    sums: list[int]

    def subtract(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - S / n in two doubles."""
        exact = [Fraction(s, self.n) for s in self.sums]
        mean = np.array([float(m) for m in exact])
        rest = np.array([float(m - Fraction(h)) for m, h in zip(exact, mean.tolist())])
        a, b = (x >> 20 << 20).astype(np.float64), (x & ((1 << 20) - 1)).astype(np.float64)
        s, e = two_sum(a, -mean)
        t, f = two_sum(b, -rest)
        high, g = two_sum(s, t)
        return two_sum(high, e + f + g)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over dimensions of (n * x - S) ** 2, null beyond a long."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most * most * max(1, len(self.sums)) < 1 << 62:
            y = self.n * x - np.array(self.sums, np.int64)
            return (y * y).sum(axis=1).tolist()
        # beyond 64 bits: Python's whole numbers
        y = x.astype(object) * self.n - np.array(self.sums, object)
        return [v if v < 1 << 63 else None for v in (y * y).sum(axis=1).tolist()]


def integer_rows(vectors: DataFrame, vector: str, vec_id: str, scale: int) -> DataFrame:
    """vec_id, x (array<bigint>): floor(scale * entry) of each vector that is whole and finite."""
    v = F.col(vector)
    good = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    x = F.transform(v, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("bigint"))
    return vectors.filter(v.isNotNull() & good).select(F.col(vec_id).alias("vec_id"), x.alias("x"))


def _padded(x: Column, width: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size(x)))


def _exact_sums(fit: DataFrame, width: int) -> Centre:
    """n and the sum of each dimension: halves of 32 bits in the tasks, decimals between them."""

    def sums(batches):
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for b, x in _blocks(batches, width):
            n += b.num_rows
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(high), pa.array(low)], names=["dim", "n", "high", "low"])

    parts = fit.mapInArrow(sums, "dim bigint, n bigint, high bigint, low bigint")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = parts.groupBy("dim").agg(total("n"), total("high"), total("low")).orderBy("dim").collect()  # width rows
    return Centre(int(rows[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in rows])


def _merged(parts: DataFrame, rows: int, columns: int) -> Gram:
    """The sum of the tasks' matrices: bands are added up in tasks, high and low, and the matrix is put together here."""
    schema = "band bigint, high binary, low binary"

    def merge(batches):
        held: dict[int, Gram] = {}
        for b in batches:
            for band, high, low in zip(*(b.column(c).to_pylist() for c in ("band", "high", "low"))):
                high, low = (np.frombuffer(v).reshape(-1, columns) for v in (high, low))
                held.setdefault(band, Gram(*high.shape)).put(high, low)
        yield _bands(held)

    bands = -(-rows // _band_rows(columns))
    out = Gram(rows, columns)
    # first some tasks for each band, then one: what a task reads does not grow with the rows
    several = parts.withColumn("part", F.spark_partition_id() % 16).repartition(16 * bands, "band", "part").mapInArrow(merge, schema)
    for r in several.repartition(bands, "band").mapInArrow(merge, schema).collect():  # the matrix: at most WIDTH squared
        at = r["band"] * _band_rows(columns)
        high, low = (np.frombuffer(r[c]).reshape(-1, columns) for c in ("high", "low"))
        out.high[at : at + len(high)], out.low[at : at + len(low)] = high, low
    return out


def _band_rows(columns: int) -> int:
    return max(1, BAND // max(1, columns))


def _bands(held: dict[int, Gram]) -> pa.RecordBatch:
    order = sorted(held)
    data = [pa.array(order, pa.int64()), *(pa.array([getattr(held[k], c).tobytes() for k in order], pa.binary()) for c in ("high", "low"))]
    return pa.RecordBatch.from_arrays(data, names=["band", "high", "low"])


def _second_moments(fit: DataFrame, width: int, columns: int, centred) -> Gram:
    """Sum over the fit list of the outer products of centred(vectors), two matrices of ``columns``."""

    def products(batches):
        gram, any_rows = Gram(columns, columns), False
        for _, x in _blocks(batches, width):
            gram.add(centred(x))
            any_rows = True
        if any_rows:
            step = _band_rows(columns)
            held = {}
            for k, at in enumerate(range(0, columns, step)):
                held[k] = Gram(0, 0)
                held[k].high, held[k].low = gram.high[at : at + step], gram.low[at : at + step]
            yield _bands(held)

    return _merged(fit.mapInArrow(products, "band bigint, high binary, low binary"), columns, columns)


class Model(NamedTuple):
    """What a row needs: the exact mean, unit components (columns), their eigenvalues and what of them is reported."""

    width: int
    centre: Centre
    components: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    identity_error: float | None

    def whiten(self, x: np.ndarray) -> np.ndarray:
        high, low = self.centre.subtract(x)
        spread = self.values > 0
        out = (high @ self.components + low @ self.components)[:, spread] / np.sqrt(self.values[spread])
        whole = np.full((len(x), len(self.values)), np.nan)
        whole[:, spread] = out
        return whole


def fit(rows: DataFrame, components: int = 4) -> Model | None:
    """The model of the distinct vectors of ``rows`` (x); None without any entry."""
    width = int(rows.agg(F.max(F.size("x"))).first()[0] or 0)
    if not width:
        return None
    if width > WIDTH:
        raise ValueError(f"{width} dimensions; at most {WIDTH}")
    listed = materialise(rows.select(_padded(F.col("x"), width).alias("x")).distinct(), "fit-list")
    centre = _exact_sums(listed, width)
    gram = _second_moments(listed, width, width, centre.subtract)
    # divided by n in double-double
    high = gram.high / centre.n
    p, lost = two_product(high, float(centre.n))
    high, low = two_sum(high, ((gram.high - p) - lost + gram.low) / centre.n)
    values, vectors = eigenpairs(high, low)
    trace = math.fsum([*np.diag(high), *np.diag(low)])
    k = min(components, width)
    kept = np.where(values[:k] > NO_SPREAD * trace, values[:k], 0.0)
    model = Model(width, centre, np.ascontiguousarray(vectors[:, :k]), kept, [float(max(v, 0.0)) / trace if trace > 0 else None for v in values[:k]], None)
    spread = int((kept > 0).sum())  # the first ones
    if spread:
        whitened = lambda x: (w := np.ascontiguousarray(model.whiten(x)[:, :spread]), np.zeros_like(w))
        check = _second_moments(listed, width, spread, whitened)
        model = model._replace(identity_error=float(np.abs(check.high / centre.n + check.low / centre.n - np.eye(spread)).max()))
    drop(listed)
    return model


def whiten(vectors: DataFrame, components: int = 4, vector: str = "embedding", vec_id: str = "vec_id", scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row and component."""
    schema = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    kind = vectors.schema[vec_id].dataType.simpleString()
    rows = integer_rows(vectors, vector, vec_id, scale)
    model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, {schema}")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for b, x in _blocks(batches, model.width):
            m = b.num_rows
            whitened = model.whiten(x).ravel()
            columns = [
                b.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.centre.n)),
                pa.array(model.centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(whitened, mask=np.isnan(whitened)),
                pa.array(model.explained * m, pa.float64()),
                pa.array([model.identity_error] * (m * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, f"vec_id {kind}, {schema}")
