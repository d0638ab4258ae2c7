"""Joins, aggregations, top-k and set operators that are more than one built-in call."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = list[str]


def latest(df: DataFrame, by: Cols, newest: Cols, n: int = 1) -> DataFrame:
    """The n newest rows of each group (``newest``: columns, all descending)."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in newest])
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def expired(df: DataFrame, by: Cols, newest: Cols, keep: int, older: Column) -> DataFrame:
    """Rows beyond the ``keep`` newest of their group, or older than the cut-off."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in newest])
    return df.withColumn("__r", F.row_number().over(w)).filter((F.col("__r") > keep) | older).drop("__r")


def priority_fold(df: DataFrame, by: Cols, state: str, order: list[str], name: str = "state") -> DataFrame:
    """The first of ``order`` that any row of the group has."""
    rank = reduce(lambda c, i: F.when(F.col(state) == order[i], i).otherwise(c), reversed(range(len(order))), F.lit(None).cast("int"))
    return df.groupBy(*by).agg(F.get(F.array(*map(F.lit, order)), F.min(rank)).alias(name))


def overlap_join(left: DataFrame, right: DataFrame, by: Cols, start: str = "start", end: str = "end", width: int = 3_600_000_000) -> DataFrame:
    """Pairs of half-open intervals that overlap, within equal ``by``.

    Both sides are cut into cells of ``width``, so the join is an equi join on (by, cell) that Spark
    can shuffle and split; a pair is kept only in the cell where the later of its two starts lies.
    ``right``'s columns come with the prefix ``r_``.
    """
    cells = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    a = left.filter(F.col(start) < F.col(end)).withColumn("__cell", cells(start, end))
    b = right.filter(F.col(start) < F.col(end)).select(*by, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in by])
    b = b.withColumn("__cell", cells(f"r_{start}", f"r_{end}"))
    met = (F.col(f"r_{start}") < F.col(end)) & (F.col(f"r_{end}") > F.col(start))
    own = F.floor(F.greatest(F.col(start), F.col(f"r_{start}")) / width) == F.col("__cell")
    return a.join(b, [*by, "__cell"]).filter(met & own).drop("__cell")


def as_of(left: DataFrame, right: DataFrame, by: Cols, at: str, value: str, name: str, forward: bool = False) -> DataFrame:
    """``name``: the value of the last right row at or before (forward: first at or after) each left row.

    One union and one window instead of a range join: linear in rows.
    """
    rows = left.withColumns({"__side": F.lit(1), "__value": F.lit(None).cast(right.schema[value].dataType)})
    marks = right.select(*by, at, F.col(value).alias("__value")).withColumn("__side", F.lit(2 if forward else 0))
    marks = marks.select(*[F.col(c) if c in marks.columns else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    if forward:
        w = Window.partitionBy(*by).orderBy(F.desc(at), F.desc("__side")).rowsBetween(Window.unboundedPreceding, 0)
    else:
        w = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.unionByName(marks).withColumn(name, F.last("__value", ignorenulls=True).over(w))
    return out.filter("__side = 1").drop("__side", "__value")


def positional_diff(expected: DataFrame, actual: DataFrame, by: Cols, order: Cols, value: str) -> DataFrame:
    """by, position, expected, actual where the i-th values differ (null-safe; a missing one is null)."""
    w = Window.partitionBy(*by).orderBy(*order)
    a = expected.select(*by, F.row_number().over(w).cast("bigint").alias("position"), F.col(value).alias("expected"))
    b = actual.select(*by, F.row_number().over(w).cast("bigint").alias("position"), F.col(value).alias("actual"))
    return a.join(b, [*by, "position"], "full_outer").filter(~F.col("expected").eqNullSafe(F.col("actual")))


def bag(df: DataFrame, by: Cols, items: Column, name: str) -> DataFrame:
    """by, item, count of exploded arrays."""
    return df.select(*by, F.explode(items).alias("item")).groupBy(*by, "item").agg(F.count("*").alias(name))


def bag_difference(source: DataFrame, produced: DataFrame, dropped: DataFrame | None, by: Cols, items: str = "items") -> DataFrame:
    """by, item, missing (source - produced - dropped), added (produced - source); multisets, floored at 0; rows with either."""
    out = bag(source, by, F.col(items), "s").join(bag(produced, by, F.col(items), "p"), [*by, "item"], "full_outer")
    if dropped is not None:
        out = out.join(bag(dropped, by, F.col(items), "d"), [*by, "item"], "left")
    s, p, d = (F.coalesce(F.col(c), F.lit(0)) if c in out.columns else F.lit(0) for c in "spd")
    out = out.select(*by, "item", F.greatest(F.lit(0), s - p - d).cast("bigint").alias("missing"), F.greatest(F.lit(0), p - s).cast("bigint").alias("added"))
    return out.filter("missing > 0 or added > 0")


def first_of_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """owner, hit: the smallest row of a content key makes it, the others reuse it; the owner is aggregated, then joined, so a hot key is split."""
    owners = df.groupBy(key).agg(F.min(order).alias("owner"))
    return df.join(owners, key).withColumn("hit", F.col(order) > F.col("owner"))


def overlay(base: DataFrame, edits: DataFrame, slot: str, text: str) -> DataFrame:
    """Per slot: replaced where an edit has a text, deleted where it has an empty one, else as it was."""
    e = edits.select(slot, F.col(text).alias("__new"), F.lit(True).alias("__edited"))
    out = base.join(e, slot, "left").withColumn(text, F.when(F.col("__edited"), F.col("__new")).otherwise(F.col(text)))
    return out.filter(~(F.coalesce("__edited", F.lit(False)) & (F.coalesce(F.col("__new"), F.lit("")) == ""))).drop("__new", "__edited")


def require_known(edits: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Edits of keys that the base lacks: must be empty for the edits to be accepted."""
    return edits.join(base.select(key).distinct(), key, "left_anti")
