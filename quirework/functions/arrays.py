"""Values named inside an expression, and the matches of a pattern as an array: what a row's own text or tokens give, without leaving the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stand at both ends of a match; a text's own ones have to be taken out before.
OPEN, CLOSE = "\u0001", "\u0002"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it (a plan would copy the expression to each place)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unmarked(text: Column) -> Column:
    return F.translate(text, OPEN + CLOSE, "\u0003\u0003")


def marked(text: Column, pattern: str) -> Column:
    """An unmarked text with each match of a pattern between marks."""
    return F.regexp_replace(text, f"(?:{pattern})", f"{OPEN}$0{CLOSE}")


def occurrences(text: Column) -> Column:
    """begin, end, match of each match of a marked text, left to right; offsets count the characters of the text without marks."""
    none = F.array().cast("array<struct<begin:int,end:int,match:string>>")

    def read(m: Column) -> Column:
        places = F.array_compact(F.transform(F.split(m, ""), lambda c, i: F.when(c == OPEN, i)))

        def spans(at: Column) -> Column:
            def span(piece: Column, i: Column) -> Column:
                begin, match = F.get(at, i) - 2 * i, F.substring_index(piece, CLOSE, 1)
                return let(F.struct(begin.alias("b"), match.alias("m")), lambda s: F.struct(s["b"].alias("begin"), (s["b"] + F.length(s["m"])).alias("end"), s["m"].alias("match")))

            pieces = F.split(m, OPEN)
            return F.transform(F.slice(pieces, F.lit(2), F.size(at)), span)

        return F.when(F.contains(m, F.lit(OPEN)), let(places, spans)).otherwise(none)

    return let(text, read)
