"""Minimal alignments of two arrays, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Rows of bits between two states that are kept: an alignment holds this many rows, or the root of their number where that is more.
_TOGETHER = 1024
#: Elements of the longer side that a distance goes through at once: 4 KB of bits for each row and each distinct element.
_STRIP = 32768


def _rows(places: Callable, steps: list, vp: int, vn: int, mask: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Per step and for all elements of the other side at once (a bit each): whether the diagonal is minimal, whether the step alone is, whether the other's element alone is; then the state.

    Neighbouring cells of the table of costs differ by one at most, so a row of it is two numbers of bits (Myers; Hyyrö's form for whole sequences).
    """
    for x in steps:
        same = places(x)
        level = ((((same & vp) + vp) ^ vp) | same | vn) & mask  # the cost is that of the cell before on the diagonal
        up, down = vn | (mask ^ (level | vp)), level & vp
        shifted = ((up << 1) | 1) & mask
        vp, vn = ((down << 1) & mask) | (mask ^ (level | shifted)), shifted & level
        yield same | (mask ^ level), up, vp, vp, vn


def _without_ends(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence]:
    """Both without the end and then the start that they share."""
    n, m = len(a), len(b)
    end = 0
    while end < min(n, m) and a[n - 1 - end] == b[m - 1 - end]:
        end += 1
    start = 0
    while start < min(n, m) - end and a[start] == b[start]:
        start += 1
    return a[start : n - end], b[start : m - end]


def _places(short: Sequence, long: Sequence) -> Callable:
    """Where in ``long`` an element of ``short`` stands, a bit for each place. Only the places themselves are held for every element: their bits would grow with the square of the length."""
    places = {x: [] for x in short}
    for at, y in enumerate(long):
        if y in places:
            places[y].append(at)

    @lru_cache(_TOGETHER)
    def bits(x) -> int:
        row = 0
        for at in places[x]:
            row |= 1 << at
        return row

    return bits


def _character_places(short: str, long: str) -> dict[str, int]:
    """``_places`` of two texts for the characters that both have, up to 64 of them at once."""
    codes = lambda text: np.frombuffer(text.encode("utf-32-le"), "<u4")
    characters, places = "".join(set(short) & set(long)), {}
    for first in range(0, len(characters), 64):
        some = characters[first : first + 64]
        rows = np.packbits(np.equal.outer(codes(some), codes(long)), axis=1, bitorder="little")
        places.update((x, int.from_bytes(row.tobytes(), "little")) for x, row in zip(some, rows))
    return places


def plain_edit_distance(a: str, b: str) -> int:
    """The least number of substitutions, deletions and insertions of characters, for texts of any length.

    The table of costs is gone through by strips of the longer side, which bounds the rows and the places that are held. A strip
    gets from the one before it, for each element of the shorter side, whether the cost at its edge rises or falls there.
    """
    short, long = sorted(_without_ends(a, b), key=len)
    rises, falls = bytearray(b"\1") * len(short), bytearray(len(short))  # at the edge of the first one, costs rise by one each
    for first in range(0, len(long), _STRIP):
        strip = long[first : first + _STRIP]
        places, last, mask = _character_places(short, strip), len(strip) - 1, (1 << len(strip)) - 1
        vp, vn = mask, 0
        for i, (x, rise, fall) in enumerate(zip(short, rises, falls)):  # as in _rows; only the last row is wanted
            same = places.get(x, 0) | fall
            level = (((same & vp) + vp) ^ vp) | same | vn  # may have a bit too many, which the masks below take away
            up, down = vn | (mask ^ (level | vp)), level & vp
            rises[i], falls[i] = up >> last & 1, down >> last
            shifted = ((up << 1) | rise) & mask
            vp, vn = ((down << 1) | (mask ^ (level | shifted))) & mask, shifted & level
            if fall:
                vp |= 1
    return len(long) + sum(rises) - sum(falls)


def plain_edit_counts(a: list, b: list) -> tuple[int, int, int, int]:
    """``edit_counts`` of two lists."""
    n = len(a)
    # equal ends lie on the diagonal, which is taken first; any minimal path along an equal start has the same counts
    a, b = _without_ends(a, b)
    swapped = len(a) > len(b)
    short, long = (b, a) if swapped else (a, b)
    i, j = len(short), len(long)
    mask = (1 << j) - 1
    places = _places(short, long)
    every = max(_TOGETHER, math.isqrt(i) + 1)
    states = [(mask, 0)]
    while len(states) * every < i:
        for *_, vp, vn in _rows(places, short[(len(states) - 1) * every : len(states) * every], *states[-1], mask):
            pass
        states.append((vp, vn))
    substituted = alone_short = alone_long = 0
    while states and i and j:
        first = (len(states) - 1) * every
        rows = [r[:3] for r in _rows(places, short[first:i], *states.pop(), mask)]
        while i > first and j:
            diagonal, by_short, by_long = rows[i - first - 1]
            if diagonal >> (j - 1) & 1:
                substituted += short[i - 1] != long[j - 1]
                i, j = i - 1, j - 1
            # a deletion, an element of a alone, goes before an insertion
            elif not by_long >> (j - 1) & 1 if swapped else by_short >> (j - 1) & 1:
                i, alone_short = i - 1, alone_short + 1
            else:
                j, alone_long = j - 1, alone_long + 1
    alone_short, alone_long = alone_short + i, alone_long + j
    deleted, inserted = (alone_long, alone_short) if swapped else (alone_short, alone_long)
    return substituted, deleted, inserted, n - substituted - deleted


_COUNTS = ("substitutions", "deletions", "insertions", "matches")


@F.arrow_udf(StructType([StructField(c, IntegerType()) for c in _COUNTS]))
def _edit_counts(a: pa.Array, b: pa.Array) -> pa.Array:
    found = [None if x is None or y is None else dict(zip(_COUNTS, plain_edit_counts(x, y))) for x, y in zip(a.to_pylist(), b.to_pylist())]
    return pa.array(found, pa.struct([(c, pa.int32()) for c in _COUNTS]))


def edit_counts(a: Column, b: Column) -> Column:
    """Substitutions, deletions, insertions and matches of the minimal alignment that takes the diagonal before a deletion before an insertion on a tie.

    A row of the table of costs is computed at once, a bit for each element of the longer array, by a small helper on Arrow batches: as
    lambdas over arrays each cell alone took microseconds. Of ``k`` rows some ``2 * sqrt(k)`` are held (up to 1024 all), and one for each of up to 1024 elements.
    """
    return _edit_counts(a, b)


@F.arrow_udf(IntegerType())
def _edit_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else plain_edit_distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance of two strings by their characters, a row of a strip of the table of costs at once; the built-in one goes cell by cell. No text is too long: only its time grows, with the product of both lengths."""
    return _edit_distance(a, b)


def error_rate(errors: Column, count: Column, other: Column) -> Column:
    """Errors per expected element to four places; without any, 0 if nothing was heard and 1 otherwise."""
    return F.when(count > 0, F.round(errors / count, 4)).when(other > 0, 1.0).otherwise(0.0)
