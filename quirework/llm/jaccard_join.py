"""N-gram Jaccard join by prefix index, block skipping and derived answers.

Exact self join of word-shingle sets at a Jaccard threshold, down to connected groups of links:

1. *Private shingles.* Shingles of a fixed part of the hash space are counted over all documents. A
   document with more private ones than the threshold lets it miss has no partner and is done.
2. *Seeds.* The rest, one per distinct set, are dealt twice to buckets of bounded weight by a min-hash; the
   links inside each bucket are answered. They join nearly all of a group of near copies at once, so
   that later steps look only for links between what is still apart.
3. *Index.* Sets order their shingles by document frequency and index the prefix that any partner must
   share. The entries of a list fall into blocks of one bucket, size class and depth of position. A block
   keeps its sizes, its least position and whether it is of one group; two blocks whose positions and
   sizes leave too small an overlap, or that are of one group, skip each other whole, and so do
   single entries against a block. No pairs of sets are made: a list names meetings of two buckets
   and who takes part there.
4. *Answers.* In a meeting (or seed bucket) a set's overlaps with all others are derived from those of the
   set answered before it, a similar one where there is any: only the shingles in which the two
   differ are looked up. A shingle that most sets hold lists those that lack it. Sets that are in one group
   already are not looked at.
5. *Groups.* A meeting gives a spanning forest of its links; all are joined to components by large-star
   and small-star rounds.

Shingles are 64-bit hashes. They travel packed in binary; a batch counts its own repeats before the
shuffle, so a shingle of all documents weighs one entry a batch. No task holds more than a hash range of
such counts, a batch of documents, or two buckets of about WEIGHT shingles (or one longer set).

Null and empty texts have no shingles and link with nothing; rows with a null id are in
no set and give no rows. Repeated rows of an id each give a row. Texts of one id that differ are all sets of that id:
their links unite, and each row shows its own n_shingles. Very long texts are one set
each, read whole. Ties: the smallest id names a component. Extra columns, whatever their names, are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop, materialise, map_texts, slices

UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Share of the hash space in which private shingles are counted, and in which frequencies order a prefix.
COUNTED, ORDERED = 0.3, 0.5
#: Shingles of a bucket (about); two buckets meet in one task.
WEIGHT = 1 << 19
#: Depths of position that a list's blocks tell apart, for each 1 of position / size.
DEPTHS = 64
WORDS = 1_000_000


class Shingler:
    """Sorted distinct 64-bit hashes of a text's k-word shingles."""

    def __init__(self, k: int):
        self.k = k
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        # bytes.split() splits at exactly [\x20\x09-\x0D]
        words = text.encode("utf-8", "surrogatepass").translate(UPPER).split()
        if not words:
            return np.zeros(0, np.uint64)
        known, out = self.known, []
        if len(known) > WORDS:
            known.clear()
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        a = np.array(out, np.uint64)
        n = max(1, len(a) - self.k + 1)
        z = a[:n].copy()
        for j in range(1, min(self.k, len(a))):
            z = (z ^ (z >> np.uint64(29))) * MIX + a[j : n + j]
        z = (z ^ (z >> np.uint64(32))) * MIX
        return np.unique(z ^ (z >> np.uint64(29)))


def allowed_misses(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of its n shingles a set may miss in a partner: n - ceil(percent / 100 * n)."""
    return n - -(-n * percent // 100)


def least_overlap(a, b, percent: int):
    """Smallest shared count with 100 * shared >= percent * (a + b - shared)."""
    return -(-(a + b) * percent // (100 + percent))


def _parts(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _binary(arrays) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _array(value: bytes, dtype) -> np.ndarray:
    return np.frombuffer(value, dtype)


BLOB = "part bigint, chunk bigint, shingles binary, counts binary, home binary"
COUNTS = "chunk bigint, part bigint, shingles binary, counts binary, found binary, home binary"


class Batch:
    """The sets of one batch: which distinct shingles of the counted part they hold, in the order (range, shingle), and whose they are."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, sets: list[np.ndarray], share: float, parts: int):
        self.ids, self.marks, self.parts = ids.astype(np.int64), marks, parts
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owners = np.repeat(np.arange(len(sets), dtype=np.uint32), self.sizes)
        inside = values < np.uint64(int(share * 2.0**64))
        values, owners = values[inside], owners[inside]
        # the range: by bits that the counted part does not fix
        part = ((values & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((values, part))
        values, self.owners = values[order], owners[order]
        new = np.concatenate(([True], values[1:] != values[:-1])) if len(values) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        self.values, self.part = values[at], part[order][at]
        self.counts = np.diff(np.append(at, len(values))).astype(np.uint32)
        #: The same for equal batches only, and when a task runs again.
        self.chunk = xxhash.xxh3_64_intdigest(self.ids.tobytes() + b"".join(xxhash.xxh3_64_digest(s.tobytes()) for s in sets)) >> 1

    def blobs(self, *more: np.ndarray) -> pa.RecordBatch:
        """Per hash range the shingles with their counts here; one more row, dealt to any range, says whose they are."""
        cuts = np.searchsorted(self.part, np.arange(self.parts + 1))
        full = np.flatnonzero(cuts[:-1] < cuts[1:])
        pieces = [(cuts[i], cuts[i + 1]) for i in full]
        home = _pack(self.ids, self.marks, self.sizes, self.owners, *more)
        cols = [
            pa.array([*full.tolist(), self.chunk % self.parts], pa.int64()),
            pa.array([self.chunk] * (len(full) + 1), pa.int64()),
            pa.array([*(self.values[a:b].tobytes() for a, b in pieces), b""], pa.binary()),
            pa.array([*(self.counts[a:b].tobytes() for a, b in pieces), b""], pa.binary()),
            pa.array([*(None for _ in pieces), home], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["part", "chunk", "shingles", "counts", "home"])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays end to end, their lengths in bytes before them."""
    raw = [a.tobytes() for a in arrays]
    return np.array([len(raw), *map(len, raw)], np.int64).tobytes() + b"".join(raw)


def _unpack(data: bytes, *dtypes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    at, out = 8 * (n + 1), []
    for size, dtype in zip(np.frombuffer(data, np.int64, n, 8).tolist(), dtypes):
        out.append(np.frombuffer(data[at : at + size], dtype))
        at += size
    return out


def _frequencies(group: pa.Table) -> pa.Table:
    """In one hash range, how often each shingle of a batch stands in all batches together."""
    rows = group.to_pydict()
    values = [_array(x, np.uint64) for x in rows["shingles"]]
    _, inverse = np.unique(np.concatenate(values), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([_array(x, np.uint32) for x in rows["counts"]]))[inverse] if len(inverse) else np.zeros(0)
    cuts = np.cumsum([0, *map(len, values)])
    found = [np.minimum(total[a:b], 2.0**32 - 1).astype(np.uint32) for a, b in zip(cuts, cuts[1:])]
    return pa.table([group.column("chunk"), group.column("part"), group.column("shingles"), group.column("counts"), _binary(found), group.column("home")], names=["chunk", "part", "shingles", "counts", "found", "home"])


def _of_batch(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bytes, int]:
    """Of one batch: its shingles and how often each is found, for every owner; its home row; how many equal batches there are."""
    rows = group.to_pydict()
    homes = [h for h in rows["home"] if h is not None]
    # equal batches share a chunk and say the same: one row of each range is read
    by_part = {p: i for i, p in enumerate(rows["part"]) if rows["home"][i] is None}
    take = [by_part[p] for p in sorted(by_part)]
    join = lambda name, dtype: _array(b"".join(rows[name][i] for i in take), dtype)
    counts = join("counts", np.uint32)
    return np.repeat(join("shingles", np.uint64), counts), np.repeat(join("found", np.uint32), counts), homes[0], len(homes)


def sizes_and_candidates(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (hash of the set), alive of each row with an id: alive ones may have a partner."""
    parts = _parts(docs)

    def shingle(batches):
        cut = Shingler(k)
        for whole in batches:
            for b in slices(whole, "text"):
                sets = [cut(t or "") for t in b.column("text").to_pylist()]
                hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").astype(np.int64).reshape(-1, 2)
                yield Batch(b.column("doc_id").to_numpy(), hashes[:, 0], sets, COUNTED, parts).blobs(hashes[:, 1])

    def decide(group: pa.Table) -> pa.Table:
        _, found, home, repeats = _of_batch(group)
        ids, h1, sizes, owners, h2 = _unpack(home, np.int64, np.int64, np.int64, np.uint32, np.int64)
        private = np.bincount(owners[found == 1], minlength=len(ids))
        alive = (sizes > 0) & (private <= allowed_misses(sizes, percent))
        return pa.table([np.tile(x, repeats) for x in (ids, sizes, h1, h2, alive)], names=["doc_id", "n_shingles", "h1", "h2", "alive"])

    blobs = docs.select("doc_id", "text").mapInArrow(shingle, BLOB)
    counted = blobs.groupBy("part").applyInArrow(_frequencies, COUNTS)
    return counted.groupBy("chunk").applyInArrow(decide, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, alive boolean")


def _smallest(sets: list[np.ndarray], salt: int) -> list[int]:
    """Min-hash of each set: the smallest of its shingles, mixed with a salt."""
    out = []
    for s in sets:
        z = (s ^ np.uint64(salt * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)) * MIX
        out.append(int((z ^ (z >> np.uint64(32))).min() >> np.uint64(1)))
    return out


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, wanted1, wanted2, h1, h2, n, key1, key2, shingles: each row's sorted distinct hashes (packed), a 128-bit hash of them, two min-hashes."""

    def make():
        cut = Shingler(k)

        def run(texts):
            sets = [cut(t) for t in texts]
            packed = [s.tobytes() for s in sets]
            wide = [xxhash.xxh3_128_digest(p) for p in packed]
            some = [s if len(s) else np.zeros(1, np.uint64) for s in sets]
            halves = [[int.from_bytes(w[i : i + 8], "big", signed=True) for w in wide] for i in (0, 8)]
            return [*halves, [len(s) for s in sets], _smallest(some, 1), _smallest(some, 2), packed]

        return run

    return map_texts(docs, make, "h1 bigint, h2 bigint, n bigint, key1 bigint, key2 bigint, shingles binary", "text", ["doc_id", "wanted1", "wanted2"])


def buckets(keyed: DataFrame, key: str, salt: int, total: int, least_mates: int = 1) -> DataFrame:
    """``keyed`` (doc_id, h1, n, a key, ...) with ``bucket``; of keys with ``least_mates`` sets or more.

    Sets of a key share a bucket; a key of more than WEIGHT shingles is dealt to several by id. A bucket holds about WEIGHT.
    """
    weights = keyed.groupBy(key).agg(F.sum("n").alias("weight"), F.count("*").alias("mates")).filter(F.col("mates") > least_mates - 1)
    deal = F.pmod(F.xxhash64("doc_id", "h1", F.lit(salt)), F.ceil(F.col("weight") / WEIGHT))
    return keyed.join(weights, key).withColumn("bucket", F.pmod(F.xxhash64(key, deal, F.lit(salt)), F.lit(-(-total // WEIGHT)))).drop("weight", "mates")


class Overlaps:
    """How many shingles a set shares with each of the targets, derived from the set asked before."""

    def __init__(self, rows: list[np.ndarray], distinct: int):
        n = len(rows)
        dense = np.concatenate(rows)
        owner = np.repeat(np.arange(n), [len(r) for r in rows])
        held = np.bincount(dense, minlength=distinct)
        #: Shingles that most targets hold list those that lack them.
        self.common = 2 * held > n
        where = np.flatnonzero(self.common)
        place = np.cumsum(self.common) - 1
        lacks = np.ones((len(where), n), bool)
        mine = self.common[dense]
        lacks[place[dense[mine]], owner[mine]] = False
        row, col = np.nonzero(lacks)
        value = np.concatenate([dense[~mine], where[row]])
        order = np.argsort(value, kind="stable")
        self.holders = np.concatenate([owner[~mine], col])[order]
        self.begin = np.searchsorted(value[order], np.arange(distinct + 1))
        self.length = np.diff(self.begin)
        self.shared, self.last = np.zeros(n), None

    def _add(self, shingles: np.ndarray, sign: int) -> None:
        common = self.common[shingles]
        self.shared += sign * int(np.count_nonzero(common))
        for some, weight in ((shingles[~common], sign), (shingles[common], -sign)):
            total = self.length[some]
            n = int(total.sum())
            if n:
                places = np.repeat(self.begin[some] - (np.cumsum(total) - total), total) + np.arange(n)
                self.shared += weight * np.bincount(self.holders[places], minlength=len(self.shared))

    def of(self, row: np.ndarray) -> np.ndarray:
        if self.last is not None:
            gone, new = np.setdiff1d(self.last, row, assume_unique=True), np.setdiff1d(row, self.last, assume_unique=True)
        if self.last is not None and len(gone) + len(new) < len(row):
            self._add(gone, -1)
            self._add(new, 1)
        else:
            self.shared[:] = 0
            self._add(row, 1)
        self.last = row
        return self.shared


def linked(ids: np.ndarray, groups: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect just what all links between the two sides (or within the only one) connect.

    ``groups``: sets with one number are connected already. ``sides``: 0 and 1, or only 2 where all meet each other.
    """
    if len(set(sides.tolist()) - {2}) == 1:  # the other side has nobody
        return []
    values, dense = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.cumsum([0, *map(len, sets)])
    sizes = np.diff(cuts)
    rows = [dense[a:b] for a, b in zip(cuts, cuts[1:])]
    kinds, many = np.unique(sides, return_counts=True)
    heads = np.flatnonzero(sides == kinds[many.argmin()])
    targets = np.flatnonzero(sides != kinds[many.argmin()]) if len(kinds) > 1 else heads
    _, labels = np.unique(groups, return_inverse=True)
    overlaps = Overlaps([rows[t] for t in targets], len(values))
    out: list[tuple[int, int]] = []
    # sets with like shingles follow each other, so that one's answer serves the next
    for h in sorted(heads.tolist(), key=lambda i: rows[i][:3].tolist()):
        apart = labels[targets] != labels[h]
        if not apart.any():
            continue
        shared = overlaps.of(rows[h])
        for t in targets[apart & (100 * shared >= percent * (sizes[h] + sizes[targets] - shared))].tolist():
            if labels[t] != labels[h]:
                out.append((int(ids[h]), int(ids[t])))
                labels[labels == labels[t]] = labels[h]
    return out


def _answer(percent: int):
    def run(group: pa.Table) -> pa.Table:
        found = []
        if group.num_rows > 1:
            ids, groups, sides = (group.column(c).to_numpy() for c in ("doc_id", "component", "side"))
            found = linked(ids, groups, sides, [_array(x, np.uint64) for x in group.column("shingles").to_pylist()], percent)
        return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return run


def seed_links(sets: DataFrame, percent: int, total: int) -> DataFrame:
    """a, b: links inside the buckets of two min-hashes."""
    out = None
    for salt in (1, 2):
        dealt = buckets(sets.select("doc_id", "h1", "n", f"key{salt}", "shingles"), f"key{salt}", salt, total, 2)
        rows = dealt.select("bucket", "doc_id", F.col("doc_id").alias("component"), F.lit(2).alias("side"), "shingles")
        found = rows.groupBy("bucket").applyInArrow(_answer(percent), "a bigint, b bigint").filter("a <> b")
        out = found if out is None else out.unionAll(found)
    return out


def prefix_entries(sets: DataFrame, percent: int) -> DataFrame:
    """value, doc_id, h1, n, position: the entries of the prefix index, one row each."""
    parts = _parts(sets)
    bound = np.uint64(int(ORDERED * 2.0**64))

    def emit(batches):
        for whole in batches:
            for b in slices(whole, "shingles"):
                values = [_array(x, np.uint64) for x in b.column("shingles").to_pylist()]
                # sets whose ordered part is shorter than their prefix go on in the rest of the hash space
                rest = []
                for s in values:
                    have = int(np.searchsorted(s, bound))
                    rest.append(s[have : max(have, int(allowed_misses(np.int64(len(s)), percent)) + 1)])
                more = np.repeat(np.arange(len(rest), dtype=np.uint32), [len(r) for r in rest])
                yield Batch(b.column("doc_id").to_numpy(), b.column("h1").to_numpy(), values, ORDERED, parts).blobs(np.concatenate(rest), more)

    def prefixes(group: pa.Table) -> pa.Table:
        values, found, home, _ = _of_batch(group)
        ids, marks, sizes, owners, rest, whose = _unpack(home, np.int64, np.int64, np.int64, np.uint32, np.uint64, np.uint32)
        order = np.lexsort((values, found, owners))
        values, owners, found = values[order], owners[order].astype(np.int64), found[order]
        start = np.searchsorted(owners, np.arange(len(ids) + 1))
        position = np.arange(len(owners)) - start[owners]
        # single ones are in no other set, so they index nothing, but keep their position
        used = (position <= allowed_misses(sizes[owners], percent)) & (found > 1)
        after = np.arange(len(whose)) - np.searchsorted(whose, whose) + np.diff(start)[whose] if len(whose) else np.zeros(0, np.int64)
        values, owners, position = np.concatenate([values[used], rest]), np.concatenate([owners[used], whose.astype(np.int64)]), np.concatenate([position[used], after])
        return pa.table([values.view(np.int64), ids[owners], marks[owners], sizes[owners], position], names=["value", "doc_id", "h1", "n", "position"])

    blobs = sets.select("doc_id", "h1", "shingles").mapInArrow(emit, BLOB)
    counted = blobs.groupBy("part").applyInArrow(_frequencies, COUNTS)
    return counted.groupBy("chunk").applyInArrow(prefixes, "value bigint, doc_id bigint, h1 bigint, n bigint, position bigint")


def _enough(n: Column, position: Column, m: Column, other: Column, least_n: Column, least_m: Column, percent: int) -> Column:
    """Whether what the positions leave of two sizes can reach the overlap that the least sizes ask for."""
    asked = F.ceil((least_n + least_m) * percent / (100 + percent) - 1e-6)
    return (F.least(n - position, m - other) >= asked) & (100 * n >= percent * least_m) & (100 * m >= percent * least_n)


def meetings(index: DataFrame, percent: int) -> DataFrame:
    """low, high (two buckets), doc_id, h1, component, side: who has to meet there, as blocks of index lists say.

    ``index``: value, doc_id, h1, n, position, component, bucket.
    """
    block = ["value", "bucket", "size_class", "depth"]
    entries = index.withColumns({
        "size_class": F.floor(F.log("n") / (1.01 * math.log(100 / percent) + 1e-6)).cast("int"),  # partners differ by one at most
        "depth": F.floor(DEPTHS * F.col("position") / F.col("n")).cast("int"),
    })
    summary = [F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.min("position").alias("min_position"), F.min("component").alias("first"), F.max("component").alias("last")]
    # lists of one group have nothing left to say
    alive = index.groupBy("value").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("value")
    entries = entries.join(alive, "value", "left_semi")
    blocks = materialise(entries.groupBy(*block).agg(*summary), "list-blocks")
    a = blocks.select("value", *[F.col(c).alias(f"a_{c}") for c in blocks.columns[1:]])
    b = blocks.select("value", *[F.col(c).alias(f"b_{c}") for c in blocks.columns[1:]])
    one_group = (F.col("a_first") == F.col("a_last")) & (F.col("b_first") == F.col("b_last")) & (F.col("a_first") == F.col("b_first"))
    fits = _enough(*(F.col(c) for c in ("a_max_n", "a_min_position", "b_max_n", "b_min_position", "a_min_n", "b_min_n")), percent)
    named = a.join(b, "value").filter((F.abs(F.col("a_size_class") - F.col("b_size_class")) <= 1) & ~one_group & fits)
    named = named.select("value", *[F.col(f"a_{c}").alias(c) for c in block[1:]], "b_bucket", "b_min_n", "b_max_n", "b_min_position", "b_first", "b_last")
    one_group = (F.col("b_first") == F.col("b_last")) & (F.col("b_first") == F.col("component"))
    fits = _enough(*(F.col(c) for c in ("n", "position", "b_max_n", "b_min_position", "n", "b_min_n")), percent)
    who = entries.join(named, block).filter(~one_group & fits)
    side = F.when(F.col("bucket") == F.col("b_bucket"), 2).when(F.col("bucket") < F.col("b_bucket"), 0).otherwise(1)
    return who.select(F.least("bucket", "b_bucket").alias("low"), F.greatest("bucket", "b_bucket").alias("high"), "doc_id", "h1", "component", side.alias("side")).distinct()


def links(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between sets (doc_id, h1, n, key1, key2, shingles) that connect just what all links connect."""
    total = int(sets.agg(F.sum("n")).first()[0] or 1)
    seeds = components(seed_links(sets, percent, total))
    near = sets.select("doc_id", "h1", "n", "key1").join(seeds, sets["doc_id"] == seeds["node"], "left")
    grouped = near.select("doc_id", "h1", "n", F.coalesce("component", "doc_id").alias("component"), F.coalesce("component", "key1").alias("key"))
    dealt = buckets(grouped, "key", 3, total).select("doc_id", "h1", "component", "bucket")
    index = materialise(prefix_entries(sets, percent).join(dealt, ["doc_id", "h1"]), "prefix-index")
    who = materialise(meetings(index, percent), "meetings")
    # both sides are shuffled at every size: neither has a bound
    rows = who.join(sets.select("doc_id", "h1", "shingles").hint("merge"), ["doc_id", "h1"]).select("low", "high", "doc_id", "component", "side", "shingles")
    found = rows.groupBy("low", "high").applyInArrow(_answer(percent), "a bigint, b bigint")
    return found.unionAll(seeds.select(F.col("node").alias("a"), F.col("component").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of the nodes that have a link; large-star and small-star rounds."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    digest = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = digest(edges)
    while True:
        # large star: each node links its larger neighbours to the smallest of all; written, so that the join has
        # an exchange on both sides and a node with very many neighbours is split
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = materialise(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        # small star: each node links itself and its smaller neighbours to the smallest
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        star = F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")
        new = materialise(large.join(small, "u").select(star).select("e.u", F.col("e.m").alias("v")).filter("u <> v").distinct(), "small-star")
        after = digest(new)
        drop(edges, least, large)
        edges = new
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select("v", "v").distinct().toDF("node", "component"))
        before = after


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of each row with an id."""
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null")
    state = materialise(sizes_and_candidates(src, k, percent), "set-sizes")
    own = state.filter("alive").select("doc_id", "h1", "h2", "n_shingles").distinct()
    classes = materialise(own.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("first")), "classes")
    # one row of each distinct set has its text read again
    chosen = classes.select(F.col("first").alias("doc_id"), F.col("h1").alias("wanted1"), F.col("h2").alias("wanted2"))
    again = shingle_sets(src.join(chosen.hint("merge"), "doc_id"), k).filter("h1 = wanted1 and h2 = wanted2")
    sets = materialise(again.drop("wanted1", "wanted2", "h2").dropDuplicates(["doc_id", "h1"]), "distinct-sets")
    copies = own.join(classes, ["h1", "h2", "n_shingles"]).filter("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    groups = components(links(sets, percent).unionAll(copies))
    return state.join(groups, state["doc_id"] == groups["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
