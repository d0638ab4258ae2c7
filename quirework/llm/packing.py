"""Lexical retrieval packing: windows filled by a sharded BM25 index.

Every document becomes token ids and an end id. Whole windows of a long document are sequences of
their own; what is left of it, its rest, is dealt to a shard of bounded size by what it shares (see Deal): rests are ordered by a key of
telling terms, counted over all rests, and cut into shards. All rests order terms alike, so those that share much mostly
have the same key; rests that share no term are dealt by row. A seed asks its own shard. Each
shard holds a BM25 inverted index over its rests: the longest unused rest opens a window, the index returns unused
neighbours in order of score over all terms of the seed, those that fit are added, and the best one that does not fit is cut to
fill the window; what remains of it stays in the index. Only the last window of a shard is padded.

Texts are encoded once; packed ids are written, counted (what comes to the driver is as large as the vocabulary) and moved
once. Words between ASCII white space, across which the tokenizer never joins, are cut and told apart by Arrow, lower-cased and split into parts; a part is
encoded once per worker. Texts with any other space go to the tokenizer whole.

Null and empty texts are one end id. Very long texts are cut into windows, read whole. Repeated rows are packed each by itself, rows with a null id
too, and are dealt apart like any others. Ties in score go to the smaller place (by id). Extra columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import gc
import json
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_texts, materialise

WINDOW = 2048
#: Rests of a shard (about).
SHARD = 2000
#: Parts of words that a worker remembers; when it has more, the memory is emptied before the next texts.
WORDS = 1_000_000
#: White space that only some libraries split at (a pattern of Arrow's, as those below are).
ODD_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


#: The tokenizer's own splitting pattern, the same for words without white space, and what keeps a word from being split and lower-cased here.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PARTS_OF_WORD = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+)"
NOT_PLAIN = r"[^\x00-\x{12f}\x{131}-\x{24f}]|<\|"


def listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def ragged(values: np.ndarray, begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``which`` of those that begin at ``begin``, one after the other, and where each begins."""
    size = begin[which + 1] - begin[which]
    new = np.concatenate(([0], np.cumsum(size)))
    return values[np.arange(new[-1]) + np.repeat(begin[which] - new[:-1], size)], new


class WordEncoder:
    """Packed ids of a text; equal to the tokenizer's.

    Arrow cuts many texts into words, each distinct word is lower-cased and split as the tokenizer would, and only parts
    that are new are encoded by its model. What is remembered are parts, not the forms that case and marks give them.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the same model for parts, which need no more than to be kept apart
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.splits = self._splits_as_expected(tokenizer_file)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        #: Where the ids of a part are: at begin[known[part]]; an empty one has none.
        self.known: dict[str, int] = {"": 0}
        self.ids, self.begin = np.zeros(0, self.dtype), np.zeros(2, np.int64)

    @staticmethod
    def _splits_as_expected(tokenizer_file: str) -> bool:
        """Whether this tokenizer normalises and splits just as is done here."""
        with open(tokenizer_file, encoding="utf-8") as f:
            t = json.load(f)
        try:
            kinds = [n["type"] for n in t["normalizer"]["normalizers"]]
            split, *rest = t["pre_tokenizer"]["pretokenizers"]
            pattern = split["pattern"]["Regex"], split["behavior"], split["invert"]
            after = [(r["type"], r["add_prefix_space"], r["use_regex"]) for r in rest]
        except (KeyError, TypeError):
            return False
        return kinds == ["NFC", "Replace", "Lowercase"] and pattern == (PARTS, "Removed", True) and after == [("ByteLevel", False, False)]

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids, one text's after the other's, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(ids)), self.dtype), [len(x) for x in ids]

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, list[int]]:
        """Many parts as one text: white space keeps them apart, and each one's last id, and no other, ends a word."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(parts) or cuts[-1] != len(ids):
            return self._encode(parts)
        return ids, np.diff(cuts, prepend=0).tolist()

    def _places(self, words: pa.Array, encode) -> np.ndarray:
        """Where each word is remembered; new ones are encoded."""
        distinct, known = words.dictionary_encode(), self.known
        texts = listed(distinct.dictionary)
        at = np.fromiter(map(known.get, texts, repeat(-1)), np.int64, len(texts))
        missing = np.flatnonzero(at < 0)
        new = [texts[i] for i in missing.tolist()]
        at[missing] = np.arange(len(known), len(known) + len(new))
        known.update(zip(new, at[missing].tolist()))
        ids, sizes = [self.ids], []
        for i in range(0, len(new), 512):
            some, counts = encode(new[i : i + 512])
            ids.append(some)
            sizes += counts
        self.ids = np.concatenate(ids)
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(sizes, dtype=np.int64)))
        return at[distinct.indices.to_numpy()]

    def _split(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of lower-cased plain words: places of parts, where each row's begin, and each word's row."""
        letters = pc.utf8_is_alpha(words)
        core = pc.if_else(letters, words, pc.utf8_slice_codeunits(words, 0, -1))
        last = pc.if_else(letters, "", pc.utf8_slice_codeunits(words, -1))
        easy = pc.utf8_is_alpha(core)  # letters, and one other character at the end, which is a part of its own
        others = pc.ascii_split_whitespace(pc.replace_substring_regex(words.filter(pc.invert(easy)), PARTS_OF_WORD, r"\1 "))
        core, last, parts = core.filter(easy), last.filter(easy), others.flatten()
        n = len(core)
        places = self._places(pa.concat_arrays([core, last, parts]), self._encode_parts)
        row, easy = np.empty(len(words), np.int64), easy.to_numpy(zero_copy_only=False)
        row[easy], row[~easy] = np.arange(n), n + np.arange(len(words) - n)
        return np.concatenate((places[: 2 * n].reshape(2, n).T.ravel(), places[2 * n :])), np.concatenate((2 * np.arange(n), 2 * n + others.offsets.to_numpy())), row

    def many(self, texts: list[str]) -> list[bytes]:
        # nothing here makes cycles, and looking for them would go through all that is remembered again and again
        was_on = gc.isenabled()
        gc.disable()
        try:
            return self._many(texts)
        finally:
            if was_on:
                gc.enable()

    def _many(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(column, ODD_SPACE)
        words = pc.ascii_split_whitespace(pc.if_else(odd, "", column))
        every = words.flatten().dictionary_encode()
        distinct = every.dictionary
        whole = pc.match_substring_regex(distinct, NOT_PLAIN) if self.splits else pa.array([True] * len(distinct), pa.bool_())
        lower = pc.utf8_lower(distinct.filter(pc.invert(whole))).dictionary_encode()
        if len(self.known) > WORDS:
            self._forget()
        places, begin, row = self._split(lower.dictionary)
        rows = len(begin) - 1
        whole_places = self._places(distinct.filter(whole), self._encode)
        of_part, part_begin = ragged(self.ids, self.begin, np.concatenate((places, whole_places)))
        word_begin = part_begin[np.concatenate((begin, begin[-1] + 1 + np.arange(len(whole_places))))]
        whole, of_word = whole.to_numpy(zero_copy_only=False), np.empty(len(distinct), np.int64)
        of_word[~whole], of_word[whole] = row[lower.indices.to_numpy()], rows + np.arange(len(whole_places))
        ids, at = ragged(of_part, word_begin, of_word[every.indices.to_numpy()])
        packed, width = ids.tobytes(), ids.itemsize
        at = (at[words.offsets.to_numpy()] * width).tolist()
        out = [packed[i:j] for i, j in zip(at, at[1:])]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._encode([texts[i]])[0].tobytes()
        return out

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


@functools.cache
def encoder(tokenizer_file: str) -> WordEncoder:
    """One per worker process: what it has learned serves all tasks that run there."""
    return WordEncoder(tokenizer_file)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Bm25:
    """Inverted index over the token ids of a shard's rests."""

    def __init__(self, rests: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        n = len(rests)
        doc = np.repeat(np.arange(n), [len(r) for r in rests])
        term = np.concatenate(rests).astype(np.int64) if rests else np.zeros(0, np.int64)
        key, tf = np.unique(term * n + doc, return_counts=True)
        term, docs = key // max(n, 1), key % max(n, 1)
        _, term, df = np.unique(term, return_inverse=True, return_counts=True)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        lengths = np.array([len(r) for r in rests])
        norm = k1 * (1 - b + b * lengths / max(lengths.mean() if n else 1, 1))
        weights = idf[term] * tf * (k1 + 1) / (tf + norm[docs])
        # a document's terms that another one has, too
        shared = np.flatnonzero(df[term] > 1)
        by_doc = shared[np.argsort(docs[shared], kind="stable")]
        self.terms, self.at = term[by_doc], np.searchsorted(docs[by_doc], np.arange(n + 1))
        self.n, self.distinct, self.frequent = n, len(df), np.zeros(len(df), bool)
        # a term of many documents is a row of weights, any other a list of postings
        self.frequent[df > max(1, n // 16)] = True
        self.place = np.cumsum(self.frequent) - 1
        often = shared[self.frequent[term[shared]]]
        self.rows = np.zeros((int(self.frequent.sum()), n))
        self.rows[self.place[term[often]], docs[often]] = weights[often]
        rare = shared[~self.frequent[term[shared]]]
        self.docs, self.weights = docs[rare], weights[rare]
        self.begin = np.searchsorted(term[rare], np.arange(self.distinct + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first; ties by place."""
        lists = self.terms[self.at[seed] : self.at[seed + 1]]
        often = self.frequent[lists]
        scores = self.rows[self.place[lists[often]]].sum(axis=0)
        lists = lists[~often]
        total = self.begin[lists + 1] - self.begin[lists]
        at = np.repeat(self.begin[lists] - (np.cumsum(total) - total), total) + np.arange(int(total.sum()))
        scores += np.bincount(self.docs[at], self.weights[at], self.n)
        found = np.flatnonzero((scores > 0) & unused)
        return found[np.argsort(-scores[found], kind="stable")]


def fill(rests: list[np.ndarray], window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (rest, begin, end); every rest is covered once, and all windows but the last are full."""
    index = Bm25(rests)
    begin = np.zeros(len(rests), np.int64)
    end = np.array([len(r) for r in rests], np.int64)
    unused = end > 0
    seeds = np.argsort(-end, kind="stable").tolist()
    spare = seeds[:]  # its end: the shortest, for windows whose seed has no neighbour left
    out: list[list[tuple[int, int, int]]] = []
    for seed in seeds:
        while unused[seed]:
            room, pieces, cut = window, [], None

            def take(d: int, most: int) -> int:
                a, b = int(begin[d]), int(min(end[d], begin[d] + most))
                pieces.append((d, a, b))
                begin[d] = b
                unused[d] = b < end[d]
                return b - a

            room -= take(seed, room)
            if room:
                found = index.neighbours(seed, unused)
                sizes, at = end[found] - begin[found], 0
                while room:
                    fits = sizes[at:] <= room
                    step = int(fits.argmax()) if len(fits) else 0
                    if not len(fits) or not fits[step]:  # no further one fits
                        cut = at if cut is None and len(fits) else cut
                        break
                    cut = at if cut is None and step else cut  # the best one that did not fit
                    room -= take(int(found[at + step]), room)
                    at += step + 1
                if room and cut is not None:
                    room -= take(int(found[cut]), room)
            while room and spare:
                if unused[spare[-1]]:
                    room -= take(spare[-1], room)
                else:
                    spare.pop()
            out.append(pieces)
    return out


def _distinct_terms(rests: list[bytes], dtype, vocabulary: int) -> list[bytes]:
    """Distinct terms of each rest, ascending, packed."""
    sizes = [len(r) // np.dtype(dtype).itemsize for r in rests]
    small = np.uint32 if len(rests) * vocabulary < 1 << 32 else np.int64  # narrow keys sort faster
    key = np.sort(np.repeat(np.arange(len(rests), dtype=small) * small(vocabulary), sizes) + np.frombuffer(b"".join(rests), dtype))
    key = key[np.diff(key, prepend=key[:1] + small(1)) != 0]
    terms = (key % small(vocabulary)).astype(dtype).tobytes()
    width = np.dtype(dtype).itemsize
    cuts = (np.searchsorted(key, np.arange(len(rests) + 1) * vocabulary) * width).tolist()
    return [terms[a:b] for a, b in zip(cuts, cuts[1:])]


class Deal:
    """A key of each rest; rests in the order of their keys are cut into shards.

    It is the commonest of the rest's terms that a shard can hold all rests of. Where even its rarest term has more rests than that, as every term has when
    there are enough rests, it is the rarest terms one after the other: rests of one term stand together in the order of the next, at any size.
    """

    #: Rarest terms in a key.
    CHAIN = 8

    def __init__(self, frequency: np.ndarray, shard: int):
        #: Rests of a term that a shard can hold; 0 for all others.
        self.rests = np.where((frequency > 1) & (frequency <= shard), frequency, 0)
        by_count = np.argsort(np.where(frequency > 1, frequency, np.iinfo(np.int64).max), kind="stable")
        self.shared, self.term = frequency > 1, by_count
        self.rank = np.empty(len(frequency), np.int64)
        self.rank[by_count] = np.arange(len(frequency))

    def keys(self, packed: list[bytes], dtype) -> list[bytes]:
        """Of each rest, given its distinct terms."""
        size = len(self.rests)
        sizes = np.array([len(p) for p in packed], np.int64) // np.dtype(dtype).itemsize
        term = np.frombuffer(b"".join(packed), dtype).astype(np.int64)
        # the larger count wins, of equal ones the smaller term
        worth = self.rests[term] * size + (size - 1 - term)
        best = np.zeros(len(packed), np.int64)
        start = np.cumsum(sizes) - sizes
        some = np.flatnonzero(sizes)
        if len(some):
            best[some] = np.maximum.reduceat(worth, start[some])
        lead = np.where(best >= size, size - 1 - best % size, -1).astype(">u4")
        out = [b"\0" + lead[i : i + 1].tobytes() if best[i] >= size else b"" for i in range(len(packed))]
        for i in np.flatnonzero(best < size).tolist():
            own = term[start[i] : start[i] + sizes[i]]
            ranks = np.sort(self.rank[own[self.shared[own]]])[: self.CHAIN]
            out[i] = b"\1" + self.term[ranks].astype(">u4").tobytes() if len(ranks) else b"\2"
        return out


def next_shard(keys: list[bytes], shard: int) -> int:
    """Where the next shard begins: where the first term of the keys changes, if that is in the second half of a shard."""
    for i in range(min(shard, len(keys) - 1), shard // 2, -1):
        if keys[i][:5] != keys[i - 1][:5]:
            return i
    return shard


def pack(df: DataFrame, tokenizer_file: str, end_id: int = 1, window: int = WINDOW, shard: int = SHARD, text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece (see PIECE); ``with_ids`` adds the piece's ids (array<int>)."""
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(tokenizer_file).get_vocab_size(), end_id + 1)
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(tokenizer_file)
        width = np.dtype(encode.dtype).itemsize
        end = np.array([end_id], encode.dtype).tobytes()

        def run(texts):
            counts, whole, rest = [], [], []
            for ids in encode.many(texts):
                packed = ids + end
                n = len(packed) // width
                cut = n // window * window
                counts.append(n)
                whole.append(packed[: cut * width] if with_ids else b"".join(zlib.crc32(np.frombuffer(packed, encode.dtype, window, i * width).astype("<u4")).to_bytes(4, "little") for i in range(0, cut, window)))
                rest.append(np.frombuffer(packed, encode.dtype, n - cut, cut * width).astype("<u4" if width == 4 else "<u2").tobytes())
            return [counts, whole, rest, _distinct_terms(rest, "<u4" if width == 4 else "<u2", vocabulary), [width] * len(texts)]

        return run

    src = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), text)
    encoded = map_texts(src, make, "doc_tokens bigint, whole binary, rest binary, terms binary, width int", text, ["doc_id"])
    # a row's number is fixed by writing it; by it repeated rows are told apart
    ids = materialise(encoded.withColumn("row", F.monotonically_increasing_id()), "packed-ids")
    frequency = np.zeros(vocabulary, np.int64)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(vocabulary, np.int64)
        for b in batches:
            seen += np.bincount(np.frombuffer(b"".join(b.column("terms").to_pylist()), dtype), minlength=vocabulary)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["term", "n"])

    # as many rows as the vocabulary has, at most; so are the counts of keys
    for r in ids.select("terms").mapInArrow(frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        frequency[r["term"]] = r["n"]
    deal = Deal(frequency, shard)

    @F.pandas_udf("binary")
    def key_of(terms: pd.Series) -> pd.Series:
        return pd.Series(deal.keys(terms.tolist(), dtype))
    # ranges of keys; the row's number splits the rests of one key, however many they are
    parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, -(-ids.count() // (2 * shard))))
    dealt = ids.withColumn("key", key_of("terms")).drop("terms").repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, n, number = TaskContext.get().partitionId(), [], 0, 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            while 2 * n >= 3 * shard:  # what is left is half a shard at least
                whole = pa.Table.from_batches(held)
                cut = next_shard(whole.column("key").slice(0, shard + 1).to_pylist(), shard)
                yield from _pack_shard(whole.slice(0, cut), window, with_ids, number << 20 | part).to_batches()
                held, n, number = whole.slice(cut).to_batches(), n - cut, number + 1
        if n:
            yield from _pack_shard(pa.Table.from_batches(held), window, with_ids, number << 20 | part).to_batches()

    return dealt.mapInArrow(place, PIECE + ", ids array<int>" * with_ids)


def _pack_shard(group: pa.Table, window: int, with_ids: bool, shard: int) -> pa.Table:
    rows = group.to_pydict()
    # one order, whatever order the rows came in
    order = sorted(range(group.num_rows), key=lambda i: (rows["doc_id"][i] is None, rows["doc_id"][i] or 0, rows["doc_tokens"][i], rows["rest"][i], rows["row"][i]))
    width = rows["width"][0]
    dtype = np.dtype("<u4" if width == 4 else "<u2")
    first = shard << 32
    out: list[tuple] = []
    sequence = 0
    for i in order:
        n, whole = rows["doc_tokens"][i], rows["whole"][i]
        for w in range(n // window):
            ids = np.frombuffer(whole, dtype, window, w * window * width) if with_ids else None
            value = crc(ids) if with_ids else int.from_bytes(whole[4 * w : 4 * w + 4], "little")
            out.append((rows["doc_id"][i], w * window, window, value, n, first + sequence, 0, ids))
            sequence += 1
    rests = [np.frombuffer(rows["rest"][i], dtype) for i in order]
    for pieces in fill(rests, window):
        offset = 0
        for d, a, b in pieces:
            n, ids = rows["doc_tokens"][order[d]], rests[d][a:b]
            out.append((rows["doc_id"][order[d]], n // window * window + a, b - a, crc(ids), n, first + sequence, offset, ids))
            offset += b - a
        sequence += 1
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    cols = [pa.array([r[k] for r in out], pa.int64()) for k in range(7)]
    if with_ids:
        cols.append(pa.array([r[7].astype(np.int32) for r in out], pa.list_(pa.int32())))
    return pa.table(cols, names=names + ["ids"] * with_ids)
