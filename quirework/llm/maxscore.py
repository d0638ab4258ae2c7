"""Exact top-k search by MaxScore over integer vectors.

A dimension is a term, a vector's component there its posting. Queries are taken in blocks of bounded size, each
broadcast to one pass over the vectors; a task cuts its vectors into shards and searches one after the other, so no vector is
shuffled, and the k-th best score that a shard leaves is where the next one starts. In a shard, each list is
sorted by impact and cut into blocks. Terms with the smallest bounds are non-essential as long as their bounds together stay below the k-th best score: a vector
that is met in no other list cannot reach it. Nor can one whose postings in all essential lists stay under the levels that share out what is left of
that score; blocks under its level are not traversed. Other terms are probed for vectors that are
still competitive. The lists of all tasks are merged by a window that keeps k rows of each query.

The embeddings are dense, so every vector is in every list, and with many dimensions of like bounds few blocks fall under
their level; what is saved there comes from the probing.

Vectors that are null or hold a null or non-finite component take no part, nor do null ids. Every row is a candidate
and, if asked for, a query of its own: repeated rows of an id find each other, and a repeated query gives its rows as often. Components missing at the end count as 0; very long vectors make smaller
query blocks and shards. Ties go to the smaller id. Extra columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

#: Vectors of a shard and queries of a block, at most; both hold at most BYTES of numbers. Postings of a block.
SHARD, QUERIES, BYTES, BLOCK = 8192, 16_384, 32 << 20, 64
#: Terms that are probed together.
TOGETHER = 8
LEAST = np.iinfo(np.int64).min // 4


def integer_vectors(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", scale: int = 256) -> DataFrame:
    """vec_id, v (array<bigint>): floor(scale * x) of each finite vector."""
    x = F.col(vector)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    rows = df.filter(F.col(vec_id).isNotNull() & x.isNotNull() & finite)
    ints = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("bigint"))
    return rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), ints.alias("v"))


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Vectors, short ones filled with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = lists.flatten().to_numpy()
    return out


class Index:
    """Postings of one shard, term by term in order of impact."""

    def __init__(self, vectors: np.ndarray):
        self.n, self.width = vectors.shape
        self.vectors, self.columns = vectors, np.ascontiguousarray(vectors.T)
        self.order = np.argsort(self.columns, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.columns, self.order, axis=1)
        self.low, self.high = self.sorted[:, 0], self.sorted[:, -1]

    def _length(self, d: int, q: int, level: int) -> int:
        """How many vectors lie in the blocks of a list that hold a posting worth more than ``level``."""
        # q * x > level, and whole blocks of it
        n = self.n - int(np.searchsorted(self.sorted[d], level // q, side="right")) if q > 0 else int(np.searchsorted(self.sorted[d], -(level // -q), side="left"))
        return min(self.n, -(-n // BLOCK) * BLOCK)

    def _head(self, d: int, q: int, length: int) -> np.ndarray:
        """The first vectors of a list in order of impact."""
        return self.order[d, self.n - length :] if q > 0 else self.order[d, :length]

    def search(self, q: np.ndarray, k: int, theta: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
        """Rows of exact scores; none of the best k is missing that reaches ``theta``."""
        q = q[: self.width]
        terms = np.flatnonzero(q)
        if not len(terms):
            return np.arange(self.n), np.zeros(self.n, np.int64)
        q = q[terms]
        most, least = np.maximum(q * self.high[terms], q * self.low[terms]), np.minimum(q * self.high[terms], q * self.low[terms])
        if theta == LEAST:  # the first shard: the vectors of most impact in one list give a first threshold
            first = int(np.argmax(most - least))
            seeds = self._head(terms[first], int(q[first]), min(self.n, 4 * k))
            theta = self._kth(self.vectors[seeds][:, terms] @ q, k)
        # non-essential: the terms with the smallest bounds, while their bounds together stay below theta
        by_bound = np.argsort(most, kind="stable")
        sums = np.cumsum(most[by_bound])
        split = int(np.searchsorted(np.maximum.accumulate(sums), theta, side="left"))
        if split == len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)  # all terms together stay below it
        essential, left = by_bound[split:], theta - 1 - int(sums[split - 1] if split else 0)
        whole = int(most[essential].sum())
        level = lambda t: int(most[t]) * left // whole if whole > 0 and left >= 0 else LEAST
        heads = [(terms[t], int(q[t]), self._length(terms[t], int(q[t]), level(t))) for t in essential.tolist()]
        if sum(h[2] for h in heads) < self.n:
            met = np.zeros(self.n, bool)
            for h in heads:
                met[self._head(*h)] = True
            rows = np.flatnonzero(met)
        else:  # together they are no fewer than all vectors
            rows = np.arange(self.n)
        # probing, widest bounds first; what can no longer reach theta goes
        order = np.argsort(-(most - least), kind="stable")
        rest = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0]])
        floor = np.concatenate([np.cumsum(least[order][::-1])[::-1], [0]])
        scores = np.zeros(len(rows), np.int64)
        for i in range(0, len(order), TOGETHER):
            some = order[i : i + TOGETHER]
            columns = self.columns[terms[some]]
            scores = scores + q[some] @ (columns if len(rows) == self.n else columns[:, rows])
            end = min(i + TOGETHER, len(order))
            theta = max(theta, self._kth(scores, k) + int(floor[end]))
            keep = scores + rest[end] >= theta
            if 4 * np.count_nonzero(keep) < 3 * len(rows):
                rows, scores = rows[keep], scores[keep]
        keep = scores >= theta
        return rows[keep], scores[keep]

    @staticmethod
    def _kth(scores: np.ndarray, k: int) -> int:
        return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else LEAST


class Best:
    """The k best candidates of each query so far: score, id and row of each, best first."""

    def __init__(self, n: int, k: int):
        self.k, self.lists = k, [np.zeros((0, 3), np.int64) for _ in range(n)]

    def theta(self, i: int) -> int:
        return int(self.lists[i][-1, 0]) if len(self.lists[i]) == self.k else LEAST

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        both = np.concatenate([self.lists[i], np.stack([scores, ids, rows], axis=1)])
        self.lists[i] = both[np.lexsort((both[:, 2], both[:, 1], -both[:, 0]))[: self.k]]


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a task in pieces of ``size``."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        while b.num_rows:
            piece = b.slice(0, size - n)
            held.append(piece)
            n, b = n + piece.num_rows, b.slice(piece.num_rows)
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def top_k(vectors: DataFrame, queries: str, k: int = 5, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` (vec_id, v) for each of its rows that ``queries`` (a condition) picks, but its own."""
    # a row's number is fixed by writing it
    rows = materialise(vectors.select("vec_id", "v").withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = rows.filter(queries)
    m, width = asked.count(), int(rows.agg(F.max(F.size("v"))).first()[0] or 0)
    fit = max(1, BYTES // (8 * max(1, width)))
    blocks, shard = max(1, -(-m // min(block, fit))), min(shard, fit)
    out = None
    for i in range(blocks):
        found = _pass(rows, asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == i), width, k, shard)
        best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found = materialise(found, "top-k")
        out = found if out is None else out.unionAll(found)
    return out


def _pass(rows: DataFrame, asked: DataFrame, width: int, k: int, shard: int) -> DataFrame:
    """The k best of each task's rows for a block of queries."""
    q = asked.select("vec_id", "row", "v").toArrow()  # a block: at most about BYTES
    column = q.column("v").combine_chunks()
    column = column if isinstance(column, pa.ListArray) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    shared = rows.sparkSession.sparkContext.broadcast((q.column("vec_id").to_numpy(), q.column("row").to_numpy(), _matrix(column, width)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, vectors = shared.value
        best = Best(len(ids), k)
        for table in _shards(batches, shard):
            lists = pa.concat_arrays([c for c in table.column("v").chunks])
            index = Index(_matrix(lists, width))
            vec_ids, numbers = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
            for i in range(len(ids)):
                # one more than k, as the query itself may be among them
                at, scores = index.search(vectors[i], k + 1, best.theta(i))
                keep = numbers[at] != own[i]
                best.add(i, scores[keep], vec_ids[at[keep]], numbers[at[keep]])
        for i in range(0, len(ids), 1024):
            some = best.lists[i : i + 1024]
            each = np.repeat(np.arange(i, i + len(some)), [len(s) for s in some])
            every = np.concatenate(some)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own[each], ids[each], every[:, 1], every[:, 2], every[:, 0])], names=["query_row", "query_id", "vec_id", "row", "score"])

    return rows.mapInArrow(search, "query_row bigint, query_id bigint, vec_id bigint, row bigint, score bigint")


def every_fiftieth(embeddings: DataFrame, k: int = 5) -> DataFrame:
    return top_k(integer_vectors(embeddings), "vec_id % 50 = 0", k)


SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.r AS r, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, r) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
