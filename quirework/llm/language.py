"""Language identification by words first, then shorter and shorter character n-grams.

Counts of words and of character n-grams per language come from a bounded sample of distinct labelled texts
(``docs_per_language``). A known word scores by its per-language log frequency. An unseen word backs
off: it is covered by its longest known n-grams, from ``max_n`` down to single characters.

Null texts and texts without a letter are ``und`` with score 0. Ties go to the smaller language name. Texts and words are
read whole, however long. Equal texts give equal rows, repeated rows each give one; without any labelled row every text is ``und``.
Extra columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_texts, materialise

WORD = re.compile(r"[^\W\d_]+")
#: Rows that one task remembers.
WORDS = 1_000_000


@dataclass
class Model:
    """Log frequencies: ``words`` and ``grams`` map a string to a row of one value per language."""

    languages: list[str]
    words: dict[str, list[float]] = field(default_factory=dict)
    grams: dict[str, list[float]] = field(default_factory=dict)
    max_n: int = 5


def sample(labelled: DataFrame, docs_per_language: int) -> DataFrame:
    """At most so many distinct texts of each language, those with the smallest hash; deterministic. Copies count once."""
    h = F.xxhash64("text").bitwiseAND(0x7FFFFFFFFFFFFFFF)
    ranked = labelled.filter("lang is not null and text is not null").select("lang", "text", h.alias("h"))
    # thinned first by the number of distinct texts, so that the ranking sees little more than it keeps; the 64 leave
    # enough for small samples, too. Written, so that Spark knows the size: few languages are broadcast, many are not
    sizes = ranked.groupBy("lang").agg(F.count_distinct("h").alias("n"))
    part = F.least(F.lit(1.0), (2.0 * docs_per_language + 64) / F.col("n")) * 2.0**63
    limits = materialise(sizes.select("lang", part.alias("most")), "language-sizes")
    thin = ranked.join(limits, "lang").filter("h <= most").groupBy("lang", "text", "h").count()
    order = Window.partitionBy("lang").orderBy("h", "text")
    return thin.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= docs_per_language).select("lang", "text")


def fit(labelled: DataFrame, docs_per_language: int = 1000, words_per_language: int | None = 20_000, grams_per_language: int | None = 20_000, max_n: int = 5, least_count: int = 2) -> Model:
    """A model from columns text and lang.

    Words and n-grams are counted on Spark; of each language the most frequent ones come to the driver, as many as the
    two parameters say, or all for None. Words that stand less than ``least_count`` times in a language's sample are left to their n-grams, as
    unseen words are. The model holds a value for each string and language: it grows with the square of the languages, not with the documents.
    """
    letters = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    words = sample(labelled, docs_per_language).select("lang", F.explode(letters).alias("s")).groupBy("lang", "s").agg(F.count("*").alias("n"))
    marked = F.concat(F.lit("<"), F.col("s"), F.lit(">"))
    cuts = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(max_n)),
            lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1))), lambda i: F.substring(marked, i, n)),
        )
    )
    grams = words.select("lang", "n", F.explode(cuts).alias("s")).groupBy("lang", "s").agg(F.sum("n").alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "s")
    kept = {}
    for name, counts, most in (("words", words.filter(F.col("n") >= least_count), words_per_language), ("grams", grams, grams_per_language)):
        if most is not None:
            counts = counts.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= most)
        kept[name] = counts.select("lang", "s", "n").collect()
    languages = sorted({r["lang"] for r in kept["words"] + kept["grams"]})
    return Model(languages, _log_rates(kept["words"], languages, 0), _log_rates(kept["grams"], languages, max_n), max_n)


def _log_rates(rows, languages: list[str], max_n: int) -> dict[str, list[float]]:
    """Smoothed log frequency of each string among those of its length (words: all)."""
    at = {x: i for i, x in enumerate(languages)}
    counts: dict[str, list[int]] = {}
    for r in rows:
        counts.setdefault(r["s"], [0] * len(languages))[at[r["lang"]]] += r["n"]
    of = (lambda s: len(s)) if max_n else (lambda s: 0)
    totals: dict[int, np.ndarray] = {}
    for s, c in counts.items():
        totals[of(s)] = totals.get(of(s), np.full(len(languages), 1.0)) + c
    return {s: [math.log((x + 0.1) / t) for x, t in zip(c, totals[of(s)])] for s, c in counts.items()}


class Scorer(dict):
    """word -> row of ``rows``; unseen words get their row at first sight."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.width = model, len(model.languages)
        self.rows = np.zeros((1024, self.width + 1))  # last column: 1 if the word has a letter

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        if len(self) == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        row, has_letter = self.rows[len(self)], any(c.isalpha() for c in word)
        row[:-1] = self.evidence(word) if has_letter else 0
        row[-1] = has_letter
        self[word] = i = len(self)
        return i

    def evidence(self, word: str) -> np.ndarray:
        known = self.model.words.get(word)
        if known is not None:
            return np.array(known)
        marked, total, used, at = f"<{word}>", np.zeros(self.width), 0, 0
        while at < len(marked):
            for n in range(min(self.model.max_n, len(marked) - at), 0, -1):
                gram = self.model.grams.get(marked[at : at + n])
                if gram is not None:
                    total, used, at = total + gram, used + 1, at + n
                    break
            else:
                at += 1  # not even the single character is known
        return total / used if used else total

    def predict(self, text: str) -> tuple[str, float]:
        found = WORD.findall(text.lower())
        if not found or not self.width:
            return "und", 0.0
        if len(self) + len(found) > WORDS:
            self.clear()
        ids = [self[w] for w in found]
        total = self.rows[ids].sum(axis=0)
        if not total[-1]:
            return "und", 0.0
        scores = total[:-1]
        p = np.exp(scores - scores.max())
        best = int(p.argmax())
        return self.model.languages[best], float(p[best] / p.sum())


def predict(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` + lang_pred, score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def run(texts):
            found = [scorer.predict(t) for t in texts]
            return [[a for a, _ in found], [b for _, b in found]]

        return run

    return map_texts(df, make, "lang_pred string, score double", text, list(keep))


def held_out_predictions(docs: DataFrame, docs_per_language: int = 1000) -> DataFrame:
    """Learns from documents whose crc32(doc_id) mod 4 is not 2 and predicts all."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs.filter(~held).select("text", "lang"), docs_per_language)
    src = docs.select("doc_id", held.alias("held_out"), "text")
    return predict(src, model, keep=("doc_id", "held_out"))
