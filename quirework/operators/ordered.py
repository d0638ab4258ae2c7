"""Operators in which order is data: carry-forward, islands, tiling, neighbours, k-th occurrences.

Every one takes explicit partition and order columns, so its window is partitioned and deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = list[str]


def _w(by: Cols, order: Cols):
    return Window.partitionBy(*by).orderBy(*order)


def before(by: Cols, order: Cols):
    return _w(by, order).rowsBetween(Window.unboundedPreceding, -1)


def so_far(by: Cols, order: Cols):
    return _w(by, order).rowsBetween(Window.unboundedPreceding, 0)


def numbered(df: DataFrame, by: Cols, order: Cols, name: str = "n") -> DataFrame:
    """1, 2, … in order within each group."""
    return df.withColumn(name, F.row_number().over(_w(by, order)).cast("bigint"))


def neighbours(df: DataFrame, by: Cols, order: Cols, text: str, limit: int = 500) -> DataFrame:
    """previous, following: the neighbouring texts, cut to ``limit`` characters at a word's edge."""
    end = lambda t: F.when(F.length(t) <= limit, t).otherwise(F.regexp_replace(F.substr(t, F.lit(-limit)), r"^[^ \n]*[ \n]+", ""))
    start = lambda t: F.when(F.length(t) <= limit, t).otherwise(F.regexp_replace(F.left(t, F.lit(limit)), r"[ \n]+[^ \n]*\z", ""))
    w = _w(by, order)
    return df.withColumns({"previous": end(F.trim(F.lag(text).over(w))), "following": start(F.trim(F.lead(text).over(w)))})


def carried(df: DataFrame, by: Cols, order: Cols, value: Column, name: str) -> DataFrame:
    """The last non-null value so far."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(so_far(by, order)))


def runs(df: DataFrame, by: Cols, order: Cols, value: str, name: str = "run") -> DataFrame:
    """Number of the run of equal values (null equals null) that each row is in."""
    changed = F.when(F.lag(value).over(_w(by, order)).eqNullSafe(F.col(value)) & (F.row_number().over(_w(by, order)) > 1), 0).otherwise(1)
    return df.withColumn("__changed", changed).withColumn(name, F.sum("__changed").over(so_far(by, order)).cast("bigint")).drop("__changed")


#: Numbers of a range within which runs are found; runs that touch its ends are joined afterwards.
RANGE = 1 << 20


def islands(df: DataFrame, by: Cols, number: str, width: int = RANGE) -> DataFrame:
    """by, first, last, n of each run of consecutive numbers.

    Runs are found within ranges of numbers, so that a group may have any size; only those that touch an end of their
    range, two a range at most, are looked at again to be joined.
    """
    at = df.withColumn("__range", F.floor(F.col(number) / width))
    at = at.withColumn("__island", F.col(number) - F.row_number().over(_w([*by, "__range"], [number])))
    parts = at.groupBy(*by, "__range", "__island").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n"))
    touches = (F.pmod("first", F.lit(width)) == 0) | (F.pmod("last", F.lit(width)) == width - 1)
    edge = parts.filter(touches).withColumn("__new", F.coalesce(F.col("first") != F.lag("last").over(_w(by, ["first"])) + 1, F.lit(True)).cast("int"))
    edge = edge.withColumn("__run", F.sum("__new").over(so_far(by, ["first"])))
    joined = edge.groupBy(*by, "__run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    columns = [*by, "first", "last", "n"]
    return parts.filter(~touches).select(columns).unionAll(joined.select(columns))


def changes(df: DataFrame, by: Cols, order: Cols, value: str) -> DataFrame:
    """Rows whose value is not null and differs from the last one seen (a value that comes back counts again)."""
    seen = df.filter(F.col(value).isNotNull())
    last = F.lag(value).over(_w(by, order))
    return seen.withColumn("__last", last).filter(~F.col("__last").eqNullSafe(F.col(value))).drop("__last")


def tiled_clips(df: DataFrame, by: Cols, order: Cols, start_ms: str, total_ms: str) -> DataFrame:
    """begin_ms, end_ms: clips without gaps; each ends where the next begins, the first begins at 0, the last ends at the total.

    Starts are made strictly increasing with room of a millisecond for each clip to come, in closed
    form: least(max(start - i) so far, total - count) + i.
    """
    i = F.row_number().over(_w(by, order)) - 1
    n = F.count("*").over(Window.partitionBy(*by))
    at = df.withColumns({"__i": i, "__n": n})
    begin = F.when(F.col("__i") == 0, 0).otherwise(F.least(F.max(F.when(F.col("__i") == 0, 0).otherwise(F.greatest(F.col(start_ms) - F.col("__i"), F.lit(0)))).over(so_far(by, order)), F.col(total_ms) - F.col("__n")) + F.col("__i"))
    at = at.withColumn("begin_ms", begin.cast("bigint"))
    return at.withColumn("end_ms", F.coalesce(F.lead("begin_ms").over(_w(by, order)), F.col(total_ms)).cast("bigint")).drop("__i", "__n")


def running(df: DataFrame, by: Cols, order: Cols, value: Column, name: str, inclusive: bool = True) -> DataFrame:
    w = so_far(by, order) if inclusive else before(by, order)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def within_budget(df: DataFrame, by: Cols, order: Cols, length: Column, budget: int, extra: int = 2) -> DataFrame:
    """The first rows of each group whose lengths (plus ``extra`` for each row before) fit; at least one row."""
    held = df.withColumns({"__before": F.coalesce(F.sum(length + extra).over(before(by, order)), F.lit(0)), "__len": length})
    fits = (F.row_number().over(_w(by, order)) == 1) | (F.col("__before") + F.col("__len") <= budget)
    return held.withColumn("__fits", F.min(fits.cast("int")).over(so_far(by, order))).filter("__fits = 1").drop("__before", "__len", "__fits")


def checkpoints(df: DataFrame, by: Cols, order: Cols, urgent: Column, every: int = 20) -> DataFrame:
    """Every 20th row, the urgent ones and the last."""
    at = df.withColumns({"__i": F.row_number().over(_w(by, order)) - 1, "__n": F.count("*").over(Window.partitionBy(*by))})
    return at.filter((F.pmod("__i", F.lit(every)) == every - 1) | urgent | (F.col("__i") == F.col("__n") - 1)).drop("__i", "__n")


def parents(df: DataFrame, by: Cols, position: str, level: str, levels: list[int]) -> DataFrame:
    """parent: position of the nearest earlier row with a smaller level (null at the top); ``levels``: all there are."""
    w = before(by, [position])
    nearest = [F.when(F.col(level) > k, F.last(F.when(F.col(level) == k, F.col(position)), ignorenulls=True).over(w)) for k in levels]
    return df.withColumn("parent", F.greatest(*nearest, F.lit(None)))


def spread_numbered(df: DataFrame, by: Cols, order: str, name: str, width: int = RANGE) -> DataFrame:
    """1, 2, … in order of a whole number within each group, of any size: counted by ranges of the number first."""
    at = df.withColumn("__range", F.floor(F.col(order) / width))
    counts = at.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before(by, ["__range"])), F.lit(0))).drop("__n")
    ranked = at.join(counts, [*by, "__range"]).withColumn(name, F.row_number().over(_w([*by, "__range"], [order])) + F.col("__before"))
    return ranked.drop("__range", "__before")


def kth_occurrence(df: DataFrame, key: str, order: str, records: DataFrame, record_order: str) -> DataFrame:
    """Joins the k-th row of a key with the k-th record of that key; the last record serves all further rows."""
    right = spread_numbered(records, [key], record_order, "__k")
    counts = records.groupBy(key).agg(F.count("*").alias("__n"))
    left = spread_numbered(df, [key], order, "__row").join(counts, key, "left")
    left = left.withColumn("__k", F.least("__row", "__n")).drop("__row", "__n")
    return left.join(right, [key, "__k"], "left").drop("__k")
