"""Maximal periodic runs of words, by longest previous factors.

Each document is one sequence of words. A batch of documents is worked on at once, each with symbols and an end mark of its own:

1. *Suffix array.* Prefixes of 1, 2, 4, ... words are ranked, and only what is still tied is sorted again. The
   ranks of every length are kept: they answer how far two places agree to the right or to the left.
2. *LPF.* Longest common prefixes of neighbours in suffix order and one stack give, for each word, the length and place of the longest
   factor from there that also begins earlier. They cut the text into the blocks of Lempel and Ziv.
3. *Boundaries.* A run that is not strictly inside a block touches the start of the block it ends in, and its period is shorter than
   that block and the one before. For each such boundary and period, how far the text agrees with itself to both sides gives the run (Main).
4. *Copies.* Runs strictly inside a block are those of its earlier occurrence: they are copied from buckets of runs by start, block after block.

A run of at least ``least`` words repeats at least ``ceil(least / 2)`` words at its period, so a document without a repeated sequence
of that length (told by 64-bit hashes, which may only give false alarms) has none and is not sorted.

A word is a stretch of ``[^\\x20\\x09-\\x0D]``. Null and empty texts have no words and no runs. Very long texts are one sequence
each, read whole; ranks take four bytes for each word and doubling of its longest repetition. Of runs over the same words the smallest
period counts. Repeated rows give a row each, rows with a null id too. Extra columns are not read unless named in ``keep``. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import slices

#: Words of a run at least.
LEAST = 12
#: Pairs of boundary and period that are looked at together; known words of a task.
PAIRS, WORDS = 1 << 20, 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


class _Numbers(dict):
    """A number for each word, from 1."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class Suffixes:
    """Suffix order of a sequence whose last symbol stands there once, and ranks of its windows of 1, 2, 4, ... symbols."""

    def __init__(self, x: np.ndarray):
        n = self.n = len(x)
        order = np.argsort(x, kind="stable")
        first = np.concatenate(([True], x[order][1:] != x[order][:-1]))
        rank = np.zeros(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        #: ranks[k][i] is the same for equal windows of 2**k symbols.
        self.ranks, tied, width = [rank.astype(np.int32)], np.arange(n), 1
        while True:
            tied = tied[np.bincount(rank[tied], minlength=n)[rank[tied]] > 1] if len(tied) else tied
            if not len(tied):
                break
            # a tied window ends before the last symbol, so there is one to its right
            tied = tied[np.argsort(rank[tied] * n + rank[tied + width], kind="stable")]
            old, key = rank[tied], rank[tied + width]
            new_group = np.concatenate(([True], old[1:] != old[:-1]))
            new_key = new_group | np.concatenate(([True], key[1:] != key[:-1]))
            at = np.arange(len(tied))
            within = at - np.maximum.accumulate(np.where(new_group, at, 0))
            rank = rank.copy()
            rank[tied] = np.maximum.accumulate(np.where(new_key, old + within, 0))
            self.ranks.append(rank.astype(np.int32))
            width *= 2
        self.order = np.zeros(n, np.int64)
        self.order[rank] = np.arange(n)

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on are the same (i <> j)."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            out += (self.ranks[k][i + out] == self.ranks[k][j + out]).astype(np.int64) << k
        return out

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before i and before j are the same (i < j)."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i - out - (1 << k), j - out - (1 << k)
            out += ((a >= 0) & (self.ranks[k][np.maximum(a, 0)] == self.ranks[k][np.maximum(b, 0)])).astype(np.int64) << k
        return out

    def previous_factors(self) -> tuple[list[int], list[int]]:
        """For each place the length of the longest factor from there that begins earlier too, and where (0 and -1 if there is none)."""
        common = np.zeros(self.n, np.int64)
        common[1:] = self.right(self.order[:-1], self.order[1:])
        length, source = [0] * self.n, [-1] * self.n
        places: list[int] = []
        shared: list[int] = []  # with the place below it on the stack
        for p, n in zip([*self.order.tolist(), -1], [*common.tolist(), 0]):
            while places and places[-1] > p:
                q, m = places.pop(), shared.pop()
                if m >= n:
                    length[q], source[q] = m, (places[-1] if m else -1)
                    # what lies between p and the place below shares n
                else:
                    length[q], source[q] = n, p
                n = min(n, m)
            places.append(p)
            shared.append(n)
        return length, source


def blocks(length: list[int]) -> list[int]:
    """Starts of the blocks: each one is the longest factor that begins earlier too, or one new symbol."""
    out, i = [], 0
    while i < len(length):
        out.append(i)
        i += length[i] or 1
    return out


def _at_boundaries(s: Suffixes, starts: np.ndarray, least: int) -> np.ndarray:
    """start, end (exclusive), period of all runs that touch a boundary of blocks (and of others that were met)."""
    sizes = np.diff(np.append(starts, s.n))
    c, before, after = starts[1:], sizes[:-1], sizes[1:]
    near = 2 * (before + after) > least
    c, before, after = c[near], before[near], after[near]
    # one side agrees for a quarter of the least length: a cheap test of what is worth a look
    k = min(len(s.ranks) - 1, max(0, (-(-least // 4)).bit_length() - 1))
    window, found = s.ranks[k], [np.zeros((0, 3), np.int64)]
    for right_hand, most in ((True, after), (False, before + after)):
        most = np.minimum(most, s.n - 1 - c) if right_hand else np.minimum(most, c)
        cuts = np.concatenate(([0], np.cumsum(most)))
        for low in range(0, int(cuts[-1]), PAIRS):
            flat = np.arange(low, min(low + PAIRS, int(cuts[-1])))
            which = np.searchsorted(cuts, flat, side="right") - 1
            q, at = flat - cuts[which] + 1, c[which]
            i, j = (at, at + q) if right_hand else (at - q, at)
            a, b = i - (1 << k), j - (1 << k)
            likely = (window[i] == window[j]) | ((a >= 0) & (window[np.maximum(a, 0)] == window[np.maximum(b, 0)]))
            i, j, q = i[likely], j[likely], q[likely]
            to_left, to_right = s.left(i, j), s.right(i, j)
            good = to_left + to_right >= np.maximum(q, least - q)
            found.append(np.stack([i - to_left, j + to_right, q], axis=1)[good])
    return np.concatenate(found)


def runs(x: np.ndarray, least: int = LEAST) -> np.ndarray:
    """start, length, period of each maximal run of at least max(least, 2 * period) symbols, by start and period; the last symbol stands in x once."""
    s = Suffixes(x)
    length, source = s.previous_factors()
    starts = blocks(length)
    found = _at_boundaries(s, np.array(starts, np.int64), least)
    known: dict[tuple[int, int], int] = {}
    for b, e, q in found.tolist():
        known[b, e] = min(q, known.get((b, e), q))
    buckets: dict[int, list[tuple[int, int]]] = {}
    for (b, e), q in known.items():
        buckets.setdefault(b, []).append((e, q))
    keys = sorted(buckets)
    for at in starts:
        if length[at] < least + 2:
            continue
        start, shift, end = source[at], at - source[at], source[at] + length[at]
        k = bisect_right(keys, start)
        while k < len(keys) and keys[k] < end - least:
            for e, q in list(buckets[keys[k]]):
                if e < end and (keys[k] + shift, e + shift) not in known:
                    b = keys[k] + shift
                    known[b, e + shift] = q
                    if b not in buckets:
                        buckets[b] = []
                        insort(keys, b)
                    buckets[b].append((e + shift, q))
            k += 1
    out = np.array([(b, e - b, q) for (b, e), q in known.items()], np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _repeating(x: np.ndarray, owner: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of the n documents hold a sequence of ``size`` words twice (or seem to)."""
    out = np.zeros(n, bool)
    if len(x) <= size:
        return out
    z = x[: len(x) - size + 1].astype(np.uint64)
    whole = owner[: len(z)] == owner[size - 1 :]
    for j in range(1, size):
        z = (z ^ (z >> np.uint64(29))) * MIX + x[j : j + len(z)].astype(np.uint64)
    z = ((z ^ (z >> np.uint64(32))) + owner[: len(z)].astype(np.uint64)) * MIX
    z, of = z[whole], owner[: len(z)][whole]
    order = np.argsort(z)
    again = z[order][1:] == z[order][:-1]
    out[of[order][1:][again]] = True
    return out


def runs_of_documents(documents: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """The runs of each sequence of positive numbers; all are sorted at once."""
    n = len(documents)
    sizes = np.array([len(d) for d in documents], np.int64)
    out = [np.zeros((0, 3), np.int64)] * n
    x = np.concatenate(documents) if n else np.zeros(0, np.int64)
    some = np.flatnonzero(_repeating(x, np.repeat(np.arange(n), sizes), -(-least // 2), n))
    if not len(some):
        return out
    most = int(x.max()) + 1
    # symbols of a document are its own; its end mark stands once
    marked = np.concatenate([part for i, d in enumerate(some.tolist()) for part in (documents[d] + i * most, np.array([i * most], np.int64))])
    at = np.concatenate(([0], np.cumsum(sizes[some] + 1)))
    found = runs(marked, least)
    cuts = np.searchsorted(found[:, 0], at)
    for i, d in enumerate(some.tolist()):
        own = found[cuts[i] : cuts[i + 1]].copy()
        own[:, 0] -= at[i]
        out[d] = own
    return out


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Of n words, those that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document (by crc32 of its id) repeat from some word on."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * (-(-(n - a) // p)))[: n - a]


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = (), least: int = LEAST, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, the columns ``keep``, runs (array of start, length, period), collapsed (words that no run repeats, joined by a space) of each row.

    ``change`` may replace the words of a document, given its id, before they are looked at.
    """
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("__text"), *keep)
    schema = T.StructType([*src.select("doc_id", *keep).schema.fields, T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        struct = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for whole in batches:
            for b in slices(whole, "__text"):
                if len(numbers) > WORDS:
                    numbers.clear()
                # bytes.split() splits at exactly [\x20\x09-\x0D]
                words = [(t or "").encode().split() for t in b.column("__text").to_pylist()]
                if change:
                    words = [change(i, w) for i, w in zip(b.column("doc_id").to_pylist(), words)]
                found = runs_of_documents([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in words], least)
                kept = [b" ".join(w if not len(r) else [w[i] for i in np.flatnonzero(kept_words(len(w), r)).tolist()]).decode() for w, r in zip(words, found)]
                every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in found]))), pa.int32())
                values = pa.StructArray.from_arrays([pa.array(every[:, i]) for i in range(3)], names=["start", "length", "period"])
                columns = [b.column("doc_id"), *(b.column(k) for k in keep), pa.ListArray.from_arrays(offsets, values).cast(struct), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *keep, "runs", "collapsed"])

    return src.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """Per row doc_id, n_runs, the greatest run, and digests of all runs and of the collapsed words."""
    found = periodic_runs(docs, change=planted)
    # the greatest length, then the smallest start and period
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period")))
    found = found.withColumn("best", F.array_min(order))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start"),
        (-F.col("best.minus")).alias("length"),
        F.col("best.period"),
        F.expr("1000 * -best.minus div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
