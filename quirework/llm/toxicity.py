"""Toxicity by subword bags: n-gram embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of the character n-grams of ``<word>`` (and the word itself), hashed to buckets; its
vector is their mean, a text's the mean of its distinct words' (how often a word stands does not count),
and a linear softmax reads that. Embeddings
and softmax are trained together, so an unseen misspelling shares the vectors of its n-grams. As all
of it is linear, a trained word comes down to one number, its part of the log odds.

One Spark task learns from the bounded sample, every bucket of it, and gives the model; neither texts nor bags come to the driver. Bags beyond HELD
bytes are cut again from their texts in each epoch, so that long texts do not need more memory than they take themselves.

Texts without words (null, empty) score by the bias alone. Every word is read whole, however long, and so is every
text. Equal texts give equal scores; repeated rows each give one. Extra columns are not read,
whatever their names. An empty table gives no rows; without labels of both classes every score is the prior 0.5 or the only class.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held_out, labelled_sample, labels_of_class, map_texts, read_texts

WORD = re.compile(r"[^\W_]+")
#: Words that one task remembers, of at most LONG characters; longer ones are worked out each time.
WORDS, LONG = 1_000_000, 64
BASE, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
BUCKETS, SHORTEST, LONGEST = 1 << 18, 3, 6
#: Bytes of bags that the learning task keeps.
HELD = 256 << 20


@dataclass
class Model:
    """Log odds = bias + mean over distinct words of the mean of ``odds`` over their n-gram buckets."""

    odds: np.ndarray
    bias: float
    shortest: int
    longest: int


def _mixed(h: np.ndarray, salt: int, n: int) -> np.ndarray:
    z = (h + np.uint64(salt)) * MIX
    z = (z ^ (z >> np.uint64(29))) * MIX
    return ((z >> np.uint64(32)) % np.uint64(n)).astype(np.int32)


def gram_buckets(words: list[str], n: int, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words (with every repeat), and the word that each belongs to; rolling hashes over code points."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    sizes = np.array([len(w) for w in marked])
    start = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(start + sizes, sizes) - np.arange(len(codes))  # code points from here to the word's end
    rolling, found, whose = codes.copy(), [], []
    for k in range(2, longest + 1):
        rolling = rolling[:-1] * BASE + codes[k - 1 :]
        if k >= shortest:
            inside = left[: len(rolling)] >= k
            found.append(_mixed(rolling[inside], k, n))
            whose.append(owner[: len(rolling)][inside])
    # the whole word: its code points times the powers of the base, summed
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(sizes.max(initial=1)) - 1, BASE)]))
    found.append(_mixed(np.add.reduceat(codes * powers[np.arange(len(codes)) - start[owner]], start), 0, n))
    whose.append(np.arange(len(words)))
    return np.concatenate(found), np.concatenate(whose)


def bag(text: str, n: int = BUCKETS, shortest: int = SHORTEST, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights, which sum to 1."""
    words = list(dict.fromkeys(WORD.findall(text.lower())))
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    found, whose = gram_buckets(words, n, shortest, longest)
    share = 1 / np.bincount(whose, minlength=len(words)) / len(words)
    keys, inverse = np.unique(found, return_inverse=True)
    return keys, np.bincount(inverse, share[whose]).astype(np.float32)


class Bags:
    """The bags of texts; up to HELD bytes of them are kept, the others are cut again each time they are asked for."""

    def __init__(self, texts: Iterable[str] = ()):
        self.items: list[tuple[np.ndarray, np.ndarray] | str] = []
        self.held = 0
        for t in texts:
            self.add(t)

    def add(self, text: str) -> None:
        b = bag(text)
        self.held += b[0].nbytes + b[1].nbytes
        self.items.append(b if self.held <= HELD else text)

    def __len__(self) -> int:
        return len(self.items)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        x = self.items[i]
        return bag(x) if isinstance(x, str) else x


def train(
    bags: Bags | list[tuple[np.ndarray, np.ndarray]], labels: list[int], prior: float | None = None, n: int = BUCKETS, dims: int = 8, shortest: int = SHORTEST, longest: int = LONGEST,
    least_docs: int = 1, epochs: int = 8, least_steps: int = 400, decay: float = 1e-5, rate: float = 0.1, batch: int = 64, seed: int = 7,
) -> Model:
    """Minibatch Adam on embeddings and softmax together, over the bags (buckets, weights) of texts.

    Every bucket met is learned, or only those met in ``least_docs`` texts. ``prior``: the share of label 1 outside the sample (default: as in the sample).
    """
    if len(set(labels)) < 2:
        return Model(np.zeros(n, np.float32), 0.0 if not labels else (4.0 if labels[0] else -4.0), shortest, longest)
    spread = np.zeros(n, np.int64)
    for i in range(len(bags)):
        spread[bags[i][0]] += 1
    common = spread >= max(1, least_docs)
    closed_up = (np.cumsum(common) - 1).astype(np.int32)
    y = np.array(labels)
    share = y.mean()
    prior = share if prior is None else min(max(prior, 1e-3), 1 - 1e-3)
    prior = (prior + share) / 2  # half way to equal care for both classes
    weigh = np.where(y == 1, prior / share, (1 - prior) / (1 - share)).astype(np.float32)
    rng = np.random.default_rng(seed)
    # embeddings start at zero, so that what is never trained adds nothing
    params = [np.zeros((int(common.sum()), dims), np.float32), rng.normal(0, 0.5, (dims, 2)).astype(np.float32), np.zeros(2, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    grads = [np.zeros_like(p) for p in params]
    rounds = -(-len(bags) // batch)
    epochs = max(epochs, -(-least_steps // rounds))
    steps, total = 0, epochs * rounds
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for s in range(0, len(order), batch):
            take = order[s : s + batch]
            some = [bags[i] for i in take.tolist()]
            rows = np.repeat(np.arange(len(take)), [len(k) for k, _ in some])
            k, w = np.concatenate([k for k, _ in some]), np.concatenate([w for _, w in some])
            if least_docs > 1:
                keep = common[k]
                rows, k, w = rows[keep], k[keep], w[keep]
            k = closed_up[k]
            emb, soft, bias = params
            docs = np.stack([np.bincount(rows, w * emb[k, d], len(take)) for d in range(dims)], axis=1).astype(np.float32)
            z = docs @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(take)), y[take]] -= 1
            p *= weigh[take, None] / len(take)
            back = p @ soft.T
            np.multiply(emb, decay, out=grads[0])
            for d in range(dims):
                grads[0][:, d] += np.bincount(k, w * back[rows, d], len(emb))
            grads[1][:], grads[2][:] = docs.T @ p, p.sum(axis=0)
            steps += 1
            lr = np.float32(rate * (1 - steps / (total + 1)) * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps))
            for m, v, g, x in zip(first, second, grads, params):  # in place, a gradient's own array serves as room
                m *= np.float32(0.9)
                m += np.float32(0.1) * g
                g *= g
                v *= np.float32(0.999)
                v += np.float32(0.001) * g
                np.sqrt(v, out=g)
                g += np.float32(1e-8)
                np.divide(m, g, out=g)
                g *= lr
                x -= g
    emb, soft, bias = params
    odds = np.zeros(n, np.float32)  # untrained buckets say nothing
    odds[common] = emb @ (soft[:, 1] - soft[:, 0])
    return Model(odds, float(bias[1] - bias[0]), shortest, longest)


class Scorer:
    """Scores of texts; remembers each word's part of the log odds."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def values(self, words: list[str]) -> list[float]:
        """Each word's part of the log odds: the mean over its n-grams, summed in one order."""
        out: list[float] = []
        size, at = 0, 0
        for i, w in enumerate([*words, None]):  # about a million code points at a time
            size += len(w or "") + 2
            if w is None or size > 1 << 20:
                part = words[at : i if w is None else i + 1]
                at, size = i + 1, 0
                if part:
                    x = self.model
                    found, whose = gram_buckets(part, len(x.odds), x.shortest, x.longest)
                    out += (np.bincount(whose, x.odds[found], len(part)) / np.bincount(whose, minlength=len(part))).tolist()
        return out

    def many(self, texts: list[str]) -> list[float]:
        found = [list(dict.fromkeys(WORD.findall(t.lower()))) for t in texts]
        every = dict.fromkeys(w for words in found for w in words)
        if len(self.known) + len(every) > WORDS:
            self.known = {}
        new = [w for w in every if w not in self.known]
        fresh = dict(zip(new, self.values(new)))
        self.known.update(fresh)
        of = self.known.__getitem__
        bias = self.model.bias
        z = np.array([bias + (sum(map(of, words)) / len(words) if words else 0.0) for words in found])
        for w in new:
            if len(w) > LONG:
                del self.known[w]
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()

    def score(self, text: str) -> float:
        return self.many([text])[0]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows_per_class: int = 2000, least_docs: int = 1) -> Model:
    """Learns from a bounded sample of labelled documents, ``rows_per_class`` of each class, read whole."""
    ones, n = labels_of_class(labels, label)
    prior = ones / n if n else None

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, ys = Bags(), []
        for y, some in read_texts(batches):
            ys += y
            for t in some:
                bags.add(t)
        m = train(bags, ys, prior, least_docs=least_docs)
        yield pa.RecordBatch.from_arrays([pa.array([m.odds.tobytes()], pa.binary()), pa.array([m.bias])], names=["odds", "bias"])

    # the sample is bounded, so one task learns from it; the order of its texts does not hang on the tasks before
    sample = labelled_sample(docs, labels, label, rows_per_class).repartition(1).sortWithinPartitions(F.xxhash64("text"), "text", "label")
    rows = sample.mapInArrow(learn, "odds binary, bias double").collect()
    if not rows:
        return train([], [])
    return Model(np.frombuffer(rows[0]["odds"], np.float32), rows[0]["bias"], SHORTEST, LONGEST)


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` + score, predicted."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        return lambda texts: [scorer.many(texts)]

    return map_texts(df, make, "score double", text, list(keep)).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def fit_outside_fold(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labels of documents whose crc32(doc_id) mod 5 is not 0."""
    return fit(docs, labels.filter(~held_out("doc_id", 5, 0)))


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score by a model that saw no label of the held-out fold."""
    model = fit_outside_fold(docs, labels)
    return score(docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text"), model, keep=("doc_id", "held_out"))
