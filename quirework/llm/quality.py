"""Quality by random indexing: word vectors pooled per document, a two-layer network, calibrated.

Every token gives words: its form (lower case, outer punctuation off), its shape (case, digits and
punctuation, runs shortened), and whether it repeats the token before it. Each word has a sparse
random index vector from its hash; its vector is the sum of the index vectors of its neighbours over
the sample, scaled to length 1. A document is pooled by mean and by spread of its shapes' and forms'
vectors; a two-layer numpy network reads that, and a temperature fitted on rows kept from its
training makes its probabilities honest.

The sample is read in Spark tasks: they count words, sum neighbours' index vectors (whole numbers, so
in any order) and pool each text; the driver gets counts of words, their vectors and one row of numbers a text,
whatever the length of the texts.

Texts without tokens (null, empty) are pooled to zeros. Every token is read whole, however long, and so is every text.
Equal texts give equal scores; repeated rows each give one. Extra columns are not read, whatever their names. An empty table
gives no rows; without labels of both classes every score is 0.5 or the only class.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held_out, labelled_sample, labels_of_class, map_texts, read_texts

#: Tokens that one task remembers, of at most LONG characters; longer ones are worked out each time.
TOKENS, LONG = 1_000_000, 64
DIMS = 48
_RUNS = re.compile(r"(.)\1+")
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")


@dataclass
class Model:
    words: dict[str, int]  # form or shape -> row of vectors; row 0 is for words not in the sample
    vectors: np.ndarray
    layers: list[np.ndarray]
    temperature: float


def shape_of(token: str) -> str:
    kinds = "".join(["X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in token])
    return "shape " + _RUNS.sub(r"\1\1", kinds)


def _form(token: str) -> str:
    return _OUTER.sub("", token).lower()


def index_vector(word: str, dims: int, ones: int = 6) -> np.ndarray:
    """A few places of +1 and -1, drawn from the word's hash."""
    out = np.zeros(dims, np.float32)
    h = xxhash.xxh3_128_intdigest(word.encode("utf-8", "surrogatepass"))
    for i in range(ones):
        h, place = divmod(h, dims)
        out[place] += 1 if i % 2 else -1
    return out


class Reader(dict):
    """token -> (row of its form, row of its shape), packed in one number."""

    def __init__(self, words: dict[str, int]):
        super().__init__()
        self.words = words

    def __missing__(self, token: str) -> int:
        code = self.words.get(_form(token), 0) << 32 | self.words.get(shape_of(token), 0)
        if len(token) <= LONG:
            if len(self) >= TOKENS:
                self.clear()
            self[token] = code
        return code

    def rows(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows of the forms, rows of the shapes, and how many tokens repeat the one before."""
        tokens = text.split()
        codes = np.array([self[t] for t in tokens], np.int64)
        again = sum(map(str.__eq__, tokens, tokens[1:])) if len(tokens) > 1 else 0
        return codes >> 32, codes & 0xFFFFFFFF, again


def pool(reader: Reader, vectors: np.ndarray, repeat: np.ndarray, text: str) -> np.ndarray:
    """Mean vector of forms, of shapes (with the repeat word's share of it), and the spread of shapes."""
    forms, shapes, again = reader.rows(text)
    if not len(forms):
        return np.zeros(3 * vectors.shape[1] + 1, np.float32)
    n = len(forms)
    rows, counts = np.unique(forms, return_counts=True)
    mean_form = counts @ vectors[rows] / n
    rows, counts = np.unique(shapes, return_counts=True)
    seen = vectors[rows]
    mean_shape = (counts @ seen + again * repeat) / n
    spread = np.sqrt(np.maximum(counts @ (seen - counts @ seen / n) ** 2 / n, 0))
    return np.concatenate([mean_form, mean_shape, spread, [again / n]]).astype(np.float32)


def count_words(texts: list[str]) -> Counter[str]:
    """How often each form and each shape stands in the texts."""
    tokens: Counter[str] = Counter()
    for t in texts:
        tokens.update(t.split())
    counts: Counter[str] = Counter()
    for token, c in tokens.items():
        counts[_form(token)] += c
        counts[shape_of(token)] += c
    return counts


def index_vectors(kept: list[str], dims: int) -> np.ndarray:
    """Index vectors of the kept words in small whole numbers; row 0 is for all others."""
    out = np.zeros((len(kept) + 1, dims), np.int8)
    for i, w in enumerate(kept):
        out[i + 1] = index_vector(w, dims)
    return out


def add_neighbours(vectors: np.ndarray, index: np.ndarray, reader: Reader, texts: list[str], window: int = 2) -> None:
    """Adds to each word's vector the index vectors of its neighbours in the texts."""
    for t in texts:
        forms, shapes, _ = reader.rows(t)
        own = index[forms].astype(np.int32) + index[shapes]
        for d in range(1, window + 1):
            if len(forms) > d:
                for at in (forms, shapes):
                    np.add.at(vectors, at[d:], own[:-d])
                    np.add.at(vectors, at[:-d], own[d:])


def unit_vectors(sums: np.ndarray) -> np.ndarray:
    """Rows of length 1, a few thousand at a time."""
    out = np.zeros(sums.shape, np.float32)
    for i in range(0, len(sums), 8192):
        some = sums[i : i + 8192].astype(np.float64)
        out[i : i + 8192] = some / np.maximum(np.linalg.norm(some, axis=1, keepdims=True), 1e-6)
    out[0] = 0
    return out


def forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    mean, scale, w1, b1, w2, b2 = layers
    hidden = np.tanh((x - mean) / scale @ w1 + b1)
    return hidden, hidden @ w2 + b2


def train(
    words: dict[str, int], vectors: np.ndarray, x: np.ndarray, labels: list[int], prior: float | None = None, hidden: int = 24, epochs: int = 60, seed: int = 11,
) -> Model:
    """The two layers and the temperature from pooled texts ``x``. ``prior``: the share of label 1 that probabilities are calibrated to (default: as in the sample)."""
    if len(set(labels)) < 2:
        z = 0.0 if not labels else (4.0 if labels[0] else -4.0)
        k = 3 * vectors.shape[1] + 1
        return Model(words, vectors, [np.zeros(k), np.ones(k), np.zeros((k, 1)), np.zeros(1), np.zeros(1), np.array(z)], 1.0)
    x = x.astype(np.float64)
    y = np.array(labels, float)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    aside, used = order[: len(y) // 5], order[len(y) // 5 :]
    share = y.mean()
    prior = share if prior is None else prior
    weigh = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-2
    layers = [mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    first, second = [np.zeros_like(p) for p in layers[2:]], [np.zeros_like(p) for p in layers[2:]]
    step = 0
    for _ in range(epochs):
        rng.shuffle(used)
        for s in range(0, len(used), 64):
            b = used[s : s + 64]
            h, z = forward(x[b], layers)
            d = weigh[b] * (1 / (1 + np.exp(-z)) - y[b]) / len(b)
            dh = np.outer(d, layers[4]) * (1 - h**2)
            grads = [((x[b] - mean) / scale).T @ dh + 1e-4 * layers[2], dh.sum(axis=0), h.T @ d + 1e-4 * layers[4], d.sum()]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g**2
                layers[i + 2] = layers[i + 2] - 0.005 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * first[i] / (np.sqrt(second[i]) + 1e-8)
    z = forward(x[aside], layers)[1]
    loss = lambda t: float((weigh[aside] * np.logaddexp(0, np.where(y[aside] == 1, -z, z) / t)).sum())
    return Model(words, vectors, layers, float(min(np.geomspace(0.25, 8, 61), key=loss)))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.reader = model, Reader(model.words)
        self.repeat = index_vector("repeats", model.vectors.shape[1])

    def score(self, text: str) -> float:
        x = pool(self.reader, self.model.vectors, self.repeat, text)
        z = float(forward(x[None].astype(np.float64), self.model.layers)[1].item() / self.model.temperature)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows_per_class: int = 1500, most_words: int | None = None, least_count: int = 2, dims: int = DIMS) -> Model:
    """Learns from a bounded sample of labelled documents, read whole; the classes' true shares set the prior.

    Forms and shapes that stand ``least_count`` times in the sample have vectors; rarer ones are unknown words, so that the layers meet unknown
    words as other texts have them (with vectors for words that stand once, what is learned does not carry over to texts full of rare words).
    ``most_words`` keeps the most frequent ones only; None: all of them.
    """
    ones, n = labels_of_class(labels, label)
    sample = labelled_sample(docs, labels, label, rows_per_class)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in read_texts(batches):
            found = count_words(texts)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    counts = sample.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count).orderBy(F.desc("n"), "word")
    kept = (counts if most_words is None else counts.limit(most_words)).select("word").toArrow().column("word").to_pylist()
    words = {w: i + 1 for i, w in enumerate(kept)}
    known = docs.sparkSession.sparkContext.broadcast(words)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors(list(known.value), dims)
        sums, reader = np.zeros(index.shape, np.int32), Reader(known.value)
        for _, texts in read_texts(batches):
            add_neighbours(sums, index, reader, texts)
        every = np.flatnonzero(sums.any(axis=1))
        for at in np.split(every, range(4096, len(every), 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.FixedSizeListArray.from_arrays(pa.array(sums[at].ravel()), dims).cast(pa.list_(pa.int64()))], names=["word", "v"])

    added = [F.sum(F.get("v", i)).alias(f"v{i}") for i in range(dims)]
    vectors = index_vectors(kept, dims).astype(np.int32)
    sums = sample.mapInArrow(neighbours, "word bigint, v array<bigint>").groupBy("word").agg(*added).toArrow()
    at = sums.column("word").to_numpy()
    for i in range(dims):
        vectors[at, i] += sums.column(f"v{i}").to_numpy().astype(np.int32)
    del sums
    vectors = unit_vectors(vectors)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, repeat = Reader(known.value), index_vector("repeats", dims)
        for ys, texts in read_texts(batches):
            rows = [pool(reader, shared.value, repeat, t).astype("<f4").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(rows, pa.binary())], names=["label", "x"])

    rows = sample.mapInArrow(pooled, "label int, x binary").orderBy("x", "label").collect()
    x = np.stack([np.frombuffer(r["x"], "<f4") for r in rows]) if rows else np.zeros((0, 3 * dims + 1), np.float32)
    return train(words, vectors, x, [r["label"] for r in rows], ones / n if n else None)


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """``keep`` + score, predicted."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        return lambda texts: [[scorer.score(t) for t in texts]]

    return map_texts(df, make, "score double", text, list(keep)).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def fit_outside_fold(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labels of documents whose crc32(doc_id) mod 5 is not 0."""
    return fit(docs, labels.filter(~held_out("doc_id", 5, 0)))


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score by a model that saw no label of the held-out fold."""
    model = fit_outside_fold(docs, labels)
    return score(docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text"), model, keep=("doc_id", "held_out"))
