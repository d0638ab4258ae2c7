"""Matching blocks of two sequences and the steps that turn one into the other, as rounds over rows.

The longest common block comes first (of equally long ones the one that starts first in a, then in b), then the same left and
right of it, until nothing is shared. What is shared is held as runs on diagonals, so that a round is one window per
range and clips each run to what lies left and right of the block; rows of a pair stay in their partition, and several rounds make one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .written import written

#: Rounds between two tables.
TOGETHER = 4


def shared_runs(pairs: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """key, i, j, size: maximal runs a[i:i+size] = b[j:j+size] on each diagonal (from 0)."""
    left = pairs.select(*key, F.posexplode(a).alias("i", "token")).filter("token is not null")
    right = pairs.select(*key, F.posexplode(b).alias("j", "token")).filter("token is not null")
    met = left.join(right, [*key, "token"]).select(*key, "i", "j", (F.col("i") - F.col("j")).alias("diagonal"))
    along = Window.partitionBy(*key, "diagonal").orderBy("i")
    met = met.withColumn("run", F.col("i") - F.row_number().over(along))
    return met.groupBy(*key, "diagonal", "run").agg(F.min("i").alias("i"), F.min("j").alias("j"), F.count("*").cast("int").alias("size")).select(*key, "i", "j", "size")


def matching_blocks(pairs: DataFrame, key: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """key, i, j, size of the blocks that the sequences share, in the order of both; adjacent blocks are one."""
    # a range of both sequences is named by where it starts in a; done rows are blocks
    rows = shared_runs(pairs, key, a, b).withColumns({"at": F.lit(0), "done": F.lit(False)})
    rows = written(rows.repartition(*key), "shared-runs")
    range_ = Window.partitionBy(*key, "at", "done")
    while not rows.filter("not done").isEmpty():
        # after the table is read, one exchange serves all rounds of the job
        rows = rows.repartition(*key)
        for _ in range(TOGETHER):
            best = F.max(F.struct("size", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).over(range_)
            rows = rows.withColumn("best", best).select(*key, "at", "done", "i", "j", "size", F.col("best.size").alias("best_size"), (-F.col("best.i")).alias("best_i"), (-F.col("best.j")).alias("best_j"))
            i, j, size, k, bi, bj = map(F.col, ("i", "j", "size", "best_size", "best_i", "best_j"))
            part = lambda at, i, j, size, done: F.struct(at.alias("at"), i.alias("i"), j.alias("j"), size.alias("size"), F.lit(done).alias("done"))
            left = F.least(size, bi - i, bj - j)
            skip = F.greatest(F.lit(0), bi + k - i, bj + k - j)
            split = F.array(part(F.col("at"), i, j, left, False), part(bi + k, i + skip, j + skip, size - skip, False))
            parts = F.when(F.col("done") | ((i == bi) & (j == bj) & (size == k)), F.array(part(F.col("at"), i, j, size, True))).otherwise(F.filter(split, lambda p: p["size"] > 0))
            rows = rows.select(*key, F.explode(parts).alias("p")).select(*key, "p.*")
        rows = written(rows, "matching-blocks")
    order = Window.partitionBy(*key).orderBy("i")
    starts = (F.col("i") != F.lag(F.col("i") + F.col("size")).over(order)) | (F.col("j") != F.lag(F.col("j") + F.col("size")).over(order))
    rows = rows.withColumn("block", F.sum(F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).over(order))
    return rows.groupBy(*key, "block").agg(F.min("i").alias("i"), F.min("j").alias("j"), F.sum("size").cast("int").alias("size")).select(*key, "i", "j", "size")


def opcodes(pairs: DataFrame, key: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """key, step (from 0), tag (equal, replace, delete, insert), begin and end in a and in b: how a becomes b, in order."""
    ends = pairs.select(*key, F.size(a).alias("i"), F.size(b).alias("j"), F.lit(0).alias("size"))
    order = Window.partitionBy(*key).orderBy("i", "j", F.desc("size"))
    rows = matching_blocks(pairs, key, a, b).unionByName(ends)
    before = lambda c: F.coalesce(F.lag(F.col(c) + F.col("size")).over(order), F.lit(0))
    rows = rows.withColumns({"pi": before("i"), "pj": before("j")})
    gap_a, gap_b = F.col("pi") < F.col("i"), F.col("pj") < F.col("j")
    tag = F.when(gap_a & gap_b, "replace").when(gap_a, "delete").when(gap_b, "insert")
    step = lambda t, ab, ae, bb, be: F.struct(t.alias("tag"), ab.alias("a_begin"), ae.alias("a_end"), bb.alias("b_begin"), be.alias("b_end"))
    i, j, size = F.col("i"), F.col("j"), F.col("size")
    steps = F.array(step(tag, F.col("pi"), i, F.col("pj"), j), step(F.when(size > 0, "equal"), i, i + size, j, j + size))
    rows = rows.select(*key, F.explode(F.filter(steps, lambda s: s["tag"].isNotNull())).alias("s")).select(*key, "s.*")
    numbered = Window.partitionBy(*key).orderBy("a_begin", "b_begin", "a_end", "b_end")
    return rows.withColumn("step", F.row_number().over(numbered) - 1)
