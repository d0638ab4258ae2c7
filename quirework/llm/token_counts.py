"""Token counts of huge documents by overlap resynchronisation.

A text is encoded by the library in overlapping chunks, with offsets. Two neighbours are spliced at the last
boundary that both have in their overlap and that is proven stable: a space before a non-space. The splitting
pattern of byte-level vocabularies never lets a match run across such a place, whatever stands around
it, so ids left of it come whole from the left chunk and ids right of it from the right one. Where the two agree on
no such boundary the overlap is doubled; where that reaches back to the last splice the left chunk itself is encoded
again, twice as long. A text that fits a chunk is one chunk. Tokenizers for which the proof does not hold
(another splitter, a normaliser, added tokens with white space) encode every text as one chunk.

Nulls and empty texts have no tokens. Very long texts need memory for themselves and about two chunks, a stretch without
any stable place for that stretch. Equal texts give equal rows, repeated rows each give one. Extra columns are not read,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_texts

CHUNK, OVERLAP = 16_384, 256
#: A stable place: no match of the splitting pattern goes over it.
STABLE = re.compile(r"(?= \S)")


class Counter:
    def __init__(self, tokenizer_file: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk, max(2, overlap)
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        splitter = spec["pre_tokenizer"] or {}
        plain = not any(a["lstrip"] or a["rstrip"] or re.search(r"\s", a["content"]) for a in spec["added_tokens"])
        #: Whether STABLE is proven for this tokenizer.
        self.proven = plain and spec["normalizer"] is None and splitter.get("type") == "ByteLevel" and splitter["use_regex"] and not splitter["add_prefix_space"]

    def _starts(self, text: str, begin: int, end: int) -> list[int]:
        return [begin + a for a, _ in self.tokenizer.encode(text[begin:end], add_special_tokens=False).offsets]

    def spliced(self, text: str) -> tuple[list[int], int, int]:
        """Start (in code points) of each token, and how often chunks were spliced and overlaps widened."""
        if not self.proven:
            return self._starts(text, 0, len(text)), 0, 0
        done: list[int] = []  # tokens before ``cut``, the last splice
        begin, cut, end, overlap = 0, 0, min(self.chunk, len(text)), self.overlap
        left, splices, widenings = self._starts(text, begin, end), 0, 0
        while end < len(text):
            if end - overlap <= cut:  # no boundary since the last splice
                end, overlap = min(len(text), end + max(end - begin, self.chunk)), self.overlap
                left = self._starts(text, begin, end)
                widenings += 1
                continue
            start, after = end - overlap, min(len(text), end + self.chunk)
            right = self._starts(text, start, after)
            both = set(left) & set(right)
            place = max((m.start() for m in STABLE.finditer(text, start + 1, end) if m.start() in both), default=None)
            if place is None:
                overlap *= 2
                widenings += 1
                continue
            done += [s for s in left if cut <= s < place]
            begin, cut, end, overlap, left = start, place, after, self.overlap, right
            splices += 1
        return done + [s for s in left if s >= cut], splices, widenings

    def many(self, texts: list[str]) -> list[list[int]]:
        """Counts, splices and widenings of texts; those of one chunk go to the library together."""
        whole = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        out = [(0, 0, 0)] * len(texts)
        for i, e in zip(whole, self.tokenizer.encode_batch([texts[i] for i in whole], add_special_tokens=False)):
            out[i] = len(e), 0, 0
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                starts, splices, widenings = self.spliced(t)
                out[i] = len(starts), splices, widenings
        return [list(c) for c in zip(*out)] if out else [[], [], []]


def token_counts(df: DataFrame, tokenizer_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keep`` + n_bytes, n_tokens, n_splices, n_widenings, over_limit for each row."""

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(tokenizer_file, chunk, overlap)
        return lambda texts: [[len(t.encode("utf-8", "surrogatepass")) for t in texts], *counter.many(texts)]

    fields = "n_bytes bigint, n_tokens bigint, n_splices bigint, n_widenings bigint"
    return map_texts(df, make, fields, text, list(keep)).withColumn("over_limit", F.col("n_tokens") > limit)
