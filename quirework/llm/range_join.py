"""Exact metric range join of vectors: pivots, boundary replication, independent cells.

Vectors of one label link when their cosine reaches ``threshold``. On unit vectors that is a range of the Euclidean metric:
a distance of at most r = sqrt(2 - 2 * threshold).

1. *Copies.* Equal vectors of a label become one that counts as often.
2. *Rounds.* A cell (at first a label) of more than CELL vectors is looked at by a sample. If a good part of it lies in a ball of radius r / 2,
   all vectors in the ball link with each other by the triangle inequality, so they are counted and
   joined at once, and only vectors within 3/2 r of its centre are compared with them; the rest of the cell goes on.
   Otherwise the sample gives pivots, far from each other, and each vector gets a home: the cell of its nearest pivot.
3. *Replication.* A vector also visits the cell of another pivot if a vector within r of it may be at home there: the triangle inequality bounds
   its distance to the pivot by the cell's radius plus r, and the half space between the two pivots by r. Of two cells only one sends
   visitors to the other, so that every pair meets once.
4. *Cells.* Each cell is joined by itself: homes with homes and with visitors, block by block. A cell that no pivot splits is dealt to
   blocks of homes, each with all visitors. A cell gives how many links each vector has and a spanning forest of the links, never pairs.
5. *Groups.* Forests are joined to components by large-star and small-star rounds.

Only pivots are broadcast, in passes of PASS bytes. Distances concentrate in many dimensions: of vectors without any structure most have to
visit many cells, and the work is then not far from comparing all.

Vectors that are null, zero or hold null or non-finite components link with nothing and give a row; so do those of a null label. Rows
with a null id take no part and give no rows. Components missing at the end count as 0. Repeated rows of an id each give a row and
are vectors of their own: they link with their copies. Ties: the smallest id names a component. Extra columns are not read, whatever their names. An empty
table gives no rows. Very long vectors make smaller cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop, materialise
from .jaccard_join import components

#: Homes of a cell and visitors of a task, at most; bytes of either. Pivots of a split, sampled vectors of a cell. Bytes of pivots that are broadcast together.
CELL, VISITORS, BYTES, PIVOTS, SAMPLE, PASS = 2048, 8192, 16 << 20, 64, 512, 32 << 20
#: Share of a sample that makes a ball worth while; rounds; what rounding may do to a distance.
BALL, ROUNDS, SLACK = 0.125, 8, 1e-6
#: Rows of a block of a cell.
BLOCK = 1024
KEY = ["label", "cell"]


def unit_vectors(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of length 1 as doubles, short ones filled with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(axis=1, keepdims=True, initial=0.0)  # squares neither overflow nor vanish
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0.0))


def ball(sample: np.ndarray, r: float) -> np.ndarray | None:
    """The centre of a ball of radius r / 2 that holds a good part of the sample, if there is one."""
    near = (distances(sample, sample) <= r).sum(axis=1)
    centre = sample[np.argmax(near)]
    for _ in range(3):
        inside = distances(sample, centre[None, :])[:, 0] <= r
        centre = sample[inside].mean(axis=0)
        centre = centre / math.sqrt(float(centre @ centre))
    held = (distances(sample, centre[None, :])[:, 0] <= r / 2 - SLACK).sum()
    return centre if held >= max(2, BALL * len(sample)) else None


def far_pivots(sample: np.ndarray, most: int, apart: float) -> np.ndarray:
    """Pivots that are ``apart`` at least, each the farthest from those before it."""
    chosen = [0]
    least = distances(sample, sample[:1])[:, 0]
    while len(chosen) < most:
        k = int(np.argmax(least))
        if least[k] < apart:
            break
        chosen.append(k)
        least = np.minimum(least, distances(sample, sample[k : k + 1])[:, 0])
    return sample[chosen]


class Pivots:
    """The pivots of a cell: homes of vectors and which other cells they may have to visit."""

    def __init__(self, pivots: np.ndarray, r: float):
        self.pivots, self.r = pivots, r
        self.between = distances(pivots, pivots)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Of each vector the nearest pivot, all those whose half space is within r, and the distances to them."""
        d = distances(x, self.pivots)
        home = d.argmin(axis=1)
        nearest = d[np.arange(len(x)), home][:, None]
        beyond = d * d - nearest * nearest <= 2 * self.between[home] * (self.r + SLACK) + SLACK
        near = [np.flatnonzero(row) for row in beyond]
        return home, near, [d[i, k] for i, k in enumerate(near)]


class Forest:
    """Smallest number of each group so far."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            least = np.minimum(x, y)
            np.minimum.at(self.of, x, least)
            np.minimum.at(self.of, y, least)
            while (new := self.of[self.of]).tobytes() != self.of.tobytes():
                self.of = new


def join_cell(home: np.ndarray, visitors: np.ndarray, home_counts: np.ndarray, visitor_counts: np.ndarray, inner: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each home and visitor (each partner as often as it counts) and the least member of its group; homes come first.

    Homes meet visitors, and each other if ``inner``.
    """
    n = len(home)
    x, counts = np.concatenate([home, visitors]), np.concatenate([home_counts, visitor_counts]).astype(np.float64)
    links, forest = np.zeros(len(x)), Forest(len(x))
    for i in range(0, n, BLOCK):
        a = slice(i, min(i + BLOCK, n))
        for j in [*(range(i, n, BLOCK) if inner else ()), *range(n, len(x), BLOCK)]:
            b = slice(j, min(j + BLOCK, n if j < n else len(x)))
            linked = x[a] @ x[b].T >= threshold
            if i == j:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            weight = linked.astype(np.float64)
            links[a] += weight @ counts[b]
            if i != j:
                links[b] += counts[a] @ weight
            p, q = np.nonzero(linked)
            forest.join(p + a.start, q + b.start)
    return links.astype(np.int64), forest.of


def _of_cells(size: int, base: str) -> Column:
    return F.greatest(F.ceil(F.col(base) / size), F.lit(1)).cast("bigint")


def _leaves(rows: DataFrame, cell: int, visitors: int) -> DataFrame:
    """Rows of leaf cells (inner, home) dealt to (block, chunk): each home stands in one block with every chunk, each visitor in every block."""
    key = [*KEY, "inner"]
    sizes = rows.groupBy(*key).agg(F.count(F.when(F.col("home"), 1)).alias("homes"), F.count(F.when(~F.col("home"), 1)).alias("others"))
    sizes = sizes.filter("homes > 0 and (inner or others > 0)").withColumn("blocks", _of_cells(cell, "homes"))
    asking = F.col("others") + F.when(F.col("inner") & (F.col("blocks") > 1), F.col("homes")).otherwise(0)
    sizes = materialise(sizes.withColumn("asking", asking).withColumn("chunks", _of_cells(visitors, "asking")), "leaf-sizes")
    rows = rows.join(sizes.select(*key, "blocks", "chunks"), key)
    block, chunk = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks"))
    place = lambda b, c, home: F.struct(b.alias("block"), c.alias("chunk"), F.lit(home).alias("home"))
    zero = F.lit(0).cast("bigint")
    as_home = F.transform(F.sequence(zero, F.col("chunks") - 1), lambda c: place(block, c, True))
    before = F.when(F.col("inner") & (block > 0), F.transform(F.sequence(zero, block - 1), lambda b: place(b, chunk, False))).otherwise(F.array().cast("array<struct<block:bigint,chunk:bigint,home:boolean>>"))
    as_visitor = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda b: place(b, chunk, False))
    places = F.when(F.col("home"), F.concat(as_home, before)).otherwise(as_visitor)
    return rows.select(*key, "node", "copies", "v", F.explode(places).alias("p")).select(*key, "node", "copies", "v", "p.*")


FOUND = "a bigint, b bigint, links bigint"


def _join_leaves(rows: DataFrame, width: int, threshold: float, cell: int, visitors: int) -> DataFrame:
    """a, links of vectors (b null) and links a - b of a forest (links null)."""

    def join(group: pa.Table) -> pa.Table:
        is_home = group.column("home").to_numpy()
        order = np.argsort(~is_home, kind="stable")
        n = int(is_home.sum())
        node, copies = group.column("node").to_numpy()[order], group.column("copies").to_numpy()[order]
        x = unit_vectors(group.column("v"), width)[order]
        inner = group.column("inner")[0].as_py() and group.column("chunk")[0].as_py() == 0
        links, least = join_cell(x[:n], x[n:], copies[:n], copies[n:], inner, threshold)
        some, tied = np.flatnonzero(links), np.flatnonzero(least != np.arange(len(least)))
        a = np.concatenate([node[some], node[tied]])
        b = pa.array(np.concatenate([np.zeros(len(some), np.int64), node[least[tied]]]), mask=np.arange(len(a)) < len(some))
        n_links = pa.array(np.concatenate([links[some], np.zeros(len(tied), np.int64)]), mask=np.arange(len(a)) >= len(some))
        return pa.table([pa.array(a), b, n_links], names=["a", "b", "links"])

    return _leaves(rows, cell, visitors).groupBy(*KEY, "inner", "block", "chunk").applyInArrow(join, FOUND)


def _plans(rows: DataFrame, big: DataFrame, width: int, r: float, cell: int) -> DataFrame:
    """For each big cell: the centre of a ball (k = -1), or pivots (k = 0, 1, ...); no row if there is neither."""

    def choose(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("h").to_numpy(), kind="stable")[:SAMPLE]
        sample = unit_vectors(group.column("v").take(pa.array(order)), width)
        centre = ball(sample, r)
        most = min(PIVOTS, max(2, -(-2 * group.column("homes")[0].as_py() // cell)))
        points = far_pivots(sample, most, 2 * r) if centre is None else centre[None, :]
        n = len(points) if centre is not None or len(points) > 1 else 0
        first = pa.array(np.zeros(n, np.int64))
        return pa.table([group.column("label").take(first), group.column("cell").take(first), pa.array(np.arange(n) if centre is None else np.full(n, -1)), pa.array(list(points[:n]), pa.list_(pa.float64()))], names=["label", "cell", "k", "pivot"])

    h = F.xxhash64("node", F.lit(2)).bitwiseAND(0x7FFFFFFFFFFFFFFF)
    # one and a half times the sample on average
    sampled = rows.filter("home").join(big.select(*KEY, "homes"), KEY).withColumn("h", h).filter(F.col("h") <= F.lit(1.5 * SAMPLE * 2.0**63) / F.col("homes"))
    label = rows.schema["label"].dataType.simpleString()
    return sampled.select(*KEY, "homes", "h", "v").groupBy(*KEY).applyInArrow(choose, f"label {label}, cell bigint, k bigint, pivot array<double>")


def _assigned(rows: DataFrame, plans: DataFrame, width: int, r: float) -> DataFrame:
    """Rows of planned cells with their home pivot (-1: the centre of a ball) and ``near``: pivots and distances. Pivots are broadcast in passes."""
    n = plans.count()
    passes = -(-n * width * 8 // PASS)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = None
    for i in range(passes):
        of = F.pmod(F.xxhash64(*KEY), F.lit(passes)) == i
        cells: dict[tuple, list] = {}
        for t in plans.filter(of).orderBy(*KEY, "k").toArrow().to_pylist():  # about PASS bytes
            cells.setdefault((t["label"], t["cell"]), []).append((t["k"], t["pivot"]))
        held = {key: (v[0][0] < 0, Pivots(np.array([p for _, p in v]), r)) for key, v in cells.items()}
        shared = rows.sparkSession.sparkContext.broadcast(held)

        def assign(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                by_cell: dict[tuple, list[int]] = {}
                for j, key in enumerate(zip(b.column("label").to_pylist(), b.column("cell").to_pylist())):
                    by_cell.setdefault(key, []).append(j)
                for key, at in by_cell.items():
                    if key not in shared.value:
                        continue
                    is_ball, pivots = shared.value[key]
                    some = b.take(pa.array(at))
                    x = unit_vectors(some.column("v"), width)
                    if is_ball:
                        d = distances(x, pivots.pivots)
                        home, near, far = np.full(len(x), -1), [np.zeros(1, np.int64)] * len(x), list(d)
                    else:
                        home, near, far = pivots.assign(x)
                    offsets = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in near]))), pa.int32())
                    entries = pa.StructArray.from_arrays([pa.array(np.concatenate(near).astype(np.int64)), pa.array(np.concatenate(far))], names=["k", "d"])
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(home.astype(np.int64)), pa.ListArray.from_arrays(offsets, entries)], names=[*some.schema.names, "at", "near"])

        found = materialise(rows.filter(of).mapInArrow(assign, f"{fields}, at bigint, near array<struct<k:bigint,d:double>>"), "assigned")
        shared.destroy()
        out = found if out is None else out.unionAll(found)
    return out


def _without_balls(rows: DataFrame, r: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of cells with a ball: what it says at once (FOUND), the leaf that compares it with what is near, and the rest of the cell."""
    d = F.col("near")[0]["d"]
    inside = F.col("home") & (d <= r / 2 - SLACK)
    rows = rows.withColumn("inside", inside)
    # what lies as near as the ball itself links with all of it
    rows = rows.withColumn("sure", ~F.col("inside") & (d <= r / 2 - SLACK)).withColumn("close", d <= 1.5 * r + SLACK)
    total = lambda c: F.sum(F.when(F.col(c), F.col("copies")).otherwise(0))
    sums = rows.groupBy(*KEY).agg(total("inside").alias("in_ball"), total("sure").alias("in_reach"), F.min(F.when(F.col("inside"), F.col("node"))).alias("head")).filter("head is not null")
    known = rows.filter("inside or sure").join(materialise(sums, "ball-sums"), KEY)
    counts = known.select("node", F.lit(None).cast("bigint").alias("b"), F.when(F.col("inside"), F.col("in_ball") - F.col("copies") + F.col("in_reach")).otherwise(F.col("in_ball")).alias("links"))
    forest = known.filter("node <> head").select("node", "head", F.lit(None).cast("bigint"))
    leaf = rows.filter("inside or (close and not sure)").select("label", "cell", "node", "copies", F.col("inside").alias("home"), F.lit(False).alias("inner"), "v")
    rest = rows.filter("not inside").withColumn("parent", F.lit(None).cast("bigint"))
    return counts.unionAll(forest).toDF("a", "b", "links"), leaf, rest


def _split(rows: DataFrame, homes: DataFrame, r: float) -> DataFrame:
    """Rows of the cells of pivots: each where it is at home, and where it visits."""
    entry = rows.select("*", F.explode("near").alias("e")).select("*", "e.*").drop("near", "e")
    radius = materialise(entry.filter("home and k = at").groupBy(*KEY, "k").agg(F.max("d").alias("radius")), "radius")
    entry = entry.join(radius, [*KEY, "k"]).filter(F.col("d") <= F.col("radius") + r + SLACK)
    entry = entry.filter("not home or k >= at").drop("parent").join(homes.select(*KEY, F.col("homes").alias("parent")), KEY)
    return entry.select("label", (F.col("cell") * 2 * PIVOTS + F.col("k") + 1).alias("cell"), "parent", "node", "copies", (F.col("home") & (F.col("k") == F.col("at"))).alias("home"), "v")


def links(vectors: DataFrame, threshold: float, cell: int = CELL, visitors: int = VISITORS, rounds: int = ROUNDS) -> DataFrame:
    """Of vectors (node, label, v, copies): a, links (b null) how many others each links with, in parts; a, b (links null) a forest of the links."""
    width = int(vectors.agg(F.max(F.size("v"))).first()[0] or 0)
    r = math.sqrt(2 - 2 * threshold)
    fit = max(64, BYTES // (8 * max(1, width)))
    cell, visitors = min(cell, fit), min(visitors, fit)
    rows = vectors.select("label", F.lit(0).cast("bigint").alias("cell"), F.lit(None).cast("bigint").alias("parent"), "node", "copies", F.lit(True).alias("home"), "v")
    columns = ["label", "cell", "node", "copies", "home", F.lit(True).alias("inner"), "v"]
    found, leaves = [], []
    for turn in range(rounds + 1):
        homes = materialise(rows.groupBy(*KEY).agg(F.count(F.when(F.col("home"), 1)).alias("homes"), F.max("parent").alias("parent")), "cell-sizes")
        # a cell that a split left nearly whole is dealt to blocks
        big = homes.filter((F.col("homes") > cell) & (F.col("parent").isNull() | (F.col("homes") < 0.9 * F.col("parent"))))
        plans = materialise(_plans(rows, big, width, r, cell), "pivots") if turn < rounds and not big.isEmpty() else None
        if plans is None or plans.isEmpty():
            leaves.append(rows.select(columns))
            break
        planned = plans.select(*KEY).distinct()
        leaves.append(rows.join(planned, KEY, "left_anti").select(columns))
        assigned = _assigned(rows, plans, width, r)
        said, leaf, rest = _without_balls(assigned.filter("at < 0"), r)
        found.append(said)
        leaves.append(leaf)
        split = _split(assigned.filter("at >= 0"), homes, r)
        rows = materialise(split.unionAll(rest.select(split.columns)), "cells")
    for i, leaf in enumerate(leaves):
        # a cell is peeled more than once at most under another round
        found.append(_join_leaves(leaf, width, threshold, cell, visitors))
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return materialise(out, "found")


def range_components(embeddings: DataFrame, threshold: float = 0.98, cell: int = CELL, visitors: int = VISITORS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row (vec_id, embedding, label) with an id."""
    v = F.col("embedding")
    whole = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = embeddings.filter("vec_id is not null").select("vec_id", "label", F.transform(v, lambda e: e.cast("double")).alias("v"), (F.coalesce(whole, F.lit(False)) & F.col("label").isNotNull()).alias("whole"))
    used = rows.filter("whole").select("vec_id", "label", "v")
    distinct = used.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    distinct = materialise(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    found = links(distinct, threshold, cell, visitors, rounds)
    groups = components(found.filter("b is not null").select("a", "b"))
    named = materialise(distinct.select("node", "first", "copies").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "groups")
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    n_links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    of = named.join(names, "component").join(n_links, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    of = materialise(distinct.select("node", "label", "v").join(of, "node").drop("node"), "answers")
    answers = used.join(of, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not whole").select("vec_id", F.lit(0).cast("bigint"), "vec_id")
    return answers.unionAll(alone).toDF("vec_id", "n_links", "component_id").withColumn("kept", F.col("vec_id") == F.col("component_id"))


SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
         label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS used
  FROM embeddings WHERE vec_id IS NOT NULL),
w AS MATERIALIZED (
  SELECT r, vec_id, label, list_concat(v, list_transform(range(coalesce((SELECT max(len(v)) FROM v), 0) - len(v)), lambda i: CAST(0 AS DOUBLE))) AS v FROM v WHERE used),
e AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM w a JOIN w b ON a.label = b.label AND a.r <> b.r AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
  SELECT r AS node, r AS seen FROM v
  UNION
  SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.seen),
c AS (SELECT node, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.seen GROUP BY node),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.node = v.r LEFT JOIN n ON n.a = v.r
"""
