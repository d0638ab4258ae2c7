"""Rules that claim spans of a text: matches as rows, a choice among those that overlap, and folds of token runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.arrays import CLOSE, OPEN, let, marked, occurrences, unmarked


def located(rows: DataFrame, key: list[str], text: Column, patterns: dict[int, str]) -> DataFrame:
    """key, rule, begin, end, match: every match of every rule, left to right. Offsets count characters."""
    of = lambda rule, p: F.transform(occurrences(marked(unmarked(text), p)), lambda m: F.struct(F.lit(rule).alias("rule"), m["begin"].alias("begin"), m["end"].alias("end"), m["match"].alias("match")))
    found = [of(rule, p) for rule, p in patterns.items()]
    return rows.select(*key, F.explode(F.concat(*found)).alias("m")).select(*key, "m.*")


def chosen(spans: Column, kind: str, always: list[int] = ()) -> Column:
    """Of an array of spans (rule, begin, end, ...), by rule and then from left to right, those that met no span taken before; spans of a rule in ``always`` are taken anyway."""

    def take(kept: Column, s: Column) -> Column:
        met = F.exists(kept, lambda k: (k["begin"] < s["end"]) & (s["begin"] < k["end"]))
        return F.when(met & ~s["rule"].isin(*always) if always else met, kept).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(spans, F.array().cast(kind), take)


def claimed(spans: DataFrame, key: list[str], always: list[int] = ()) -> DataFrame:
    """Of spans (key, rule, begin, end, ...) those that no span of an earlier rule, or of the same rule further left, has claimed.

    A span that lost claims nothing. Rules in ``always`` claim whatever was claimed before. Only spans that hang together by overlaps are
    looked at together, so what is held in one row is a knot of such spans.
    """
    rest = [c for c in spans.columns if c not in key]
    order = Window.partitionBy(*key).orderBy("begin", "end", "rule")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    knots = spans.withColumn("reach", reach).withColumn("knot", F.sum(F.when(F.col("reach") > F.col("begin"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct("rule", "begin", "end", *[c for c in rest if c not in ("rule", "begin", "end")]).alias("span")
    held = knots.groupBy(*key, "knot").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    kind = held.schema["spans"].dataType.simpleString()
    return held.select(*key, F.explode(chosen(F.col("spans"), kind, always)).alias("s")).select(*key, "s.*").select(*key, *rest)


def overlapping(spans: Column) -> Column:
    """Whether spans (begin, end, ...) in the order of their begins overlap anywhere."""
    return F.size(F.filter(spans, lambda s, i: F.coalesce(F.get(spans, i - 1)["end"] > s["begin"], F.lit(False)))) > 0


def covered(words: Column, spans: Column) -> Column:
    """begin, end, value, covered of words (begin, end, value), in order: whether a span (begin, end, ...) begins at or before a word's begin and ends after it."""
    places = F.flatten(F.transform(spans, lambda s: F.sequence(s["begin"], s["end"] - 1)))
    under = F.array_intersect(F.transform(words, lambda w: w["begin"]), places)
    row = lambda begin, is_word, end, value: F.struct(begin.alias("begin"), F.lit(is_word).alias("is_word"), end.alias("end"), value.alias("value"))
    # a covered begin sorts right before its word
    both = F.sort_array(F.concat(F.transform(under, lambda p: row(p, 0, F.lit(None).cast("int"), F.lit(None).cast("string"))), F.transform(words, lambda w: row(w["begin"], 1, w["end"], w["value"]))))

    def read(both: Column) -> Column:
        before = lambda i: F.coalesce(F.get(both, i - 1)["is_word"] == 0, F.lit(False))
        each = F.transform(both, lambda w, i: F.struct(w["begin"].alias("begin"), w["end"].alias("end"), w["value"].alias("value"), before(i).alias("covered"), w["is_word"].alias("is_word")))
        return F.filter(each, lambda w: w["is_word"] == 1)

    return let(both, read)


def folded(tokens: Column, kind: Callable[[Column], Column], pattern: str, value: Callable[[Column], Column]) -> Column:
    """Runs of tokens (value, begin, end, surface, gap) of one text become one token each.

    ``kind`` gives one letter for each token (or a point); the runs are the matches of ``pattern`` in the letters of a text; ``value`` gives the new
    value of an array of values. A run keeps its first surface and last gap.
    """

    def fold(tokens: Column) -> Column:
        # a run's first letter becomes +, its others -
        lead = lambda p: let(F.substring_index(p, CLOSE, 1), lambda m: F.concat(F.lit("+"), F.repeat(F.lit("-"), F.length(m) - 1), F.substring(p, F.length(m) + 2, F.length(p))))
        marks = lambda m: F.array_join(F.transform(F.split(m, OPEN), lambda p, i: F.when(i == 0, p).otherwise(lead(p))), "")

        def runs(marks: Column) -> Column:
            starts = F.array_compact(F.transform(F.split(marks, ""), lambda c, i: F.when(~c.isin("-", ""), i)))
            return F.zip_with(starts, F.regexp_extract_all(marks, F.lit("([^-]-*)"), F.lit(1)), lambda at, run: let(F.slice(tokens, at + 1, F.length(run)), lambda parts: one(parts, run)))

        def one(parts: Column, run: Column) -> Column:
            first, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
            new = F.when(F.startswith(run, F.lit("+")), value(F.transform(parts, lambda p: p["value"]))).otherwise(first["value"])
            return F.struct(new.alias("value"), first["begin"].alias("begin"), last["end"].alias("end"), first["surface"].alias("surface"), last["gap"].alias("gap"))

        letters = F.array_join(F.transform(tokens, kind), "")
        return let(marked(letters, pattern), lambda m: F.when(F.contains(m, F.lit(OPEN)), let(marks(m), runs)).otherwise(tokens))

    return let(tokens, fold)
