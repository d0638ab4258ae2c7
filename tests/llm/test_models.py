import random

import numpy as np
import pytest

from quirework.llm import language, quality, toxicity
from quirework.llm._common import held_out, labelled_sample


def words(rnd, n, letters="aeioulnrst"):
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 8))) for _ in range(n)]


BAD = ["idiot", "moron", "scumbag", "worthless", "pathetic"]


def toxic_corpus(n=600, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        w, toxic = words(rnd, rnd.randint(20, 120)), int(i % 4 == 0)
        if toxic:
            for _ in range(max(2, len(w) // 12)):
                w.insert(rnd.randrange(len(w)), rnd.choice(BAD))
        out.append((i, " ".join(w), toxic))
    return out


def train_toxicity(texts, labels):
    return toxicity.train([toxicity.bag(t) for t in texts], labels)


def train_quality(texts, labels, dims=48):
    """As fit() does, without Spark."""
    counts = quality.count_words(texts)
    kept = sorted((w for w, c in counts.items() if c > 1), key=lambda w: (-counts[w], w))
    words = {w: i + 1 for i, w in enumerate(kept)}
    index = quality.index_vectors(kept, dims)
    sums = index.astype(np.int32)
    quality.add_neighbours(sums, index, quality.Reader(words), texts)
    vectors = quality.unit_vectors(sums)
    reader, repeat = quality.Reader(words), quality.index_vector("repeats", dims)
    x = np.stack([quality.pool(reader, vectors, repeat, t) for t in texts]) if texts else np.zeros((0, 3 * dims + 1))
    return quality.train(words, vectors, x, labels)


def test_toxicity_learns_and_shares_grams():
    rows = toxic_corpus()
    model = train_toxicity([t for _, t, _ in rows[:450]], [y for *_, y in rows[:450]])
    s = toxicity.Scorer(model)
    right = [(s.score(t) >= 0.5) == y for _, t, y in rows[450:]]
    assert np.mean(right) > 0.95
    clean = " ".join(words(random.Random(9), 40))
    assert s.score(clean + " idiooot moronn worthles patheticc idiotts") > s.score(clean)
    assert 0 <= s.score("") <= 1 and s.score("b a") == s.score("a b")


def test_quality_learns_and_is_calibrated():
    rnd = random.Random(3)
    rows = []
    for i in range(500):
        w = words(rnd, rnd.randint(20, 80))
        kind = i % 8
        text = " ".join(w)
        if kind == 0:
            text = " ".join(x.upper() + "!!" for x in w)
        elif kind == 1:
            text = " ".join(x for x in w[:8] for _ in range(12))
        rows.append((text, int(kind > 1)))
    model = train_quality([t for t, _ in rows[:380]], [y for _, y in rows[:380]])
    s = quality.Scorer(model)
    p = np.array([s.score(t) for t, _ in rows[380:]])
    y = np.array([y for _, y in rows[380:]])
    assert ((p >= 0.3) == y).mean() > 0.97 and ((p >= 0) & (p <= 1)).all()
    assert 0 <= s.score("") <= 1 and model.temperature > 0


def test_one_class_only():
    assert toxicity.Scorer(train_toxicity(["a"], [0])).score("x") < 0.5 and toxicity.Scorer(train_toxicity([], [])).score("x") == 0.5
    assert quality.Scorer(train_quality(["a"], [1])).score("x") > 0.5 and quality.Scorer(train_quality([], [])).score("x") == 0.5


def plain_bucket(text, salt, n):
    """A rolling hash one code point at a time."""
    h, mask = 0, 2**64 - 1
    for c in text:
        h = (h * 0x100000001B3 + ord(c) + 1) & mask
    if salt == 0:  # whole words: the first code point is the lowest
        h = sum((ord(c) + 1) * pow(0x100000001B3, i, 2**64) for i, c in enumerate(text)) & mask
    z = (h + salt) * 0x9E3779B97F4A7C15 & mask
    z = (z ^ z >> 29) * 0x9E3779B97F4A7C15 & mask
    return (z >> 32) % n


def plain_toxicity(model, text):
    """The score by its definition: n-gram by n-gram, word by word."""
    import re

    parts = []
    for w in set(re.findall(r"[^\W_]+", text.lower())):
        marked = f"<{w}>"
        grams = [model.odds[plain_bucket(marked[i : i + k], k, len(model.odds))] for k in range(model.shortest, model.longest + 1) for i in range(len(marked) - k + 1)]
        grams.append(model.odds[plain_bucket(marked, 0, len(model.odds))])
        parts.append(sum(map(float, grams)) / len(grams))
    z = model.bias + (sum(parts) / len(parts) if parts else 0)
    return 1 / (1 + np.exp(-z))


def plain_quality(model, text):
    """The forward pass by its definition, token by token."""
    import re

    dims = model.vectors.shape[1]
    zero = np.zeros(dims)
    of = lambda w: model.vectors[model.words[w]].astype(float) if w in model.words else zero
    forms, shapes, tokens = [], [], text.split()
    for t in tokens:
        forms.append(of(re.sub(r"^[\W_]+|[\W_]+$", "", t).lower()))
        kinds = [("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c) for c in t]
        short = [c for i, c in enumerate(kinds) if i < 2 or not c == kinds[i - 1] == kinds[i - 2]]
        shapes.append(of("shape " + "".join(short)))
    n = len(tokens)
    if n:
        again = sum(a == b for a, b in zip(tokens, tokens[1:])) / n
        mean = sum(shapes) / n
        spread = np.sqrt(sum((s - mean) ** 2 for s in shapes) / n)
        x = np.concatenate([sum(forms) / n, mean + again * quality.index_vector("repeats", dims), spread, [again]])
    else:
        x = np.zeros(3 * dims + 1)
    m, s, w1, b1, w2, b2 = model.layers
    hidden = np.tanh(sum((x - m)[i] / s[i] * w1[i] for i in range(len(x))) + b1)
    return 1 / (1 + np.exp(-(sum(hidden * w2) + b2) / model.temperature))


LONG_ONES = ["", " ", "a", "Moron! moron, IDIOTS", "x" * 3000 + "idiot", "é" * 200 + " worthless", "word " * 3000, "1.2.3.4-5_6 __ A-b-C", "aaa aaa aaa bbb bbb"]


def test_scores_equal_the_plain_ones():
    rows = toxic_corpus(300)
    toxic = train_toxicity([t for _, t, _ in rows], [y for *_, y in rows])
    good = train_quality([t for _, t, _ in rows], [1 - y for *_, y in rows])
    for t in LONG_ONES + [t for _, t, _ in rows[:20]]:
        assert abs(toxicity.Scorer(toxic).score(t) - plain_toxicity(toxic, t)) < 1e-6
        assert abs(quality.Scorer(good).score(t) - plain_quality(good, t)) < 1e-5
    together = toxicity.Scorer(toxic).many(LONG_ONES)
    assert together == [toxicity.Scorer(toxic).score(t) for t in LONG_ONES]


def test_long_tokens_are_read_whole():
    rows = toxic_corpus(300)
    toxic = train_toxicity([t for _, t, _ in rows], [y for *_, y in rows])
    s = toxicity.Scorer(toxic)
    clean = "x" * 1_000_000
    assert s.score(clean + "idiot" * 200_000) > s.score(clean) and not s.known
    assert quality._form("x" * 1000 + "Y.") == "x" * 1000 + "y" and quality.shape_of("ab" * 9 + "1" * 9 + "." + "C" * 9) == "shape xx99.XX"
    reader = quality.Reader({"x" * 1_000_000 + "y": 3})
    assert reader["x" * 1_000_000 + "Y"] >> 32 == 3 and not reader


SCHEMA = "doc_id bigint, text string, score double, label int, h string"


@pytest.mark.parametrize("module,label,cut", [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_queries(spark, module, label, cut):
    rows = [(i, t, 0.0, 1, "x") for i, t, _ in toxic_corpus(160)] + [(900, None, 0.0, 1, "x"), (901, "", 0.0, 1, "x"), (902, "a b", 0.0, 1, "x"), (902, "a b", 0.0, 1, "x"), (None, "c", 0.0, 1, "x"), (903, "lang " * 300_000, 0.0, 1, "x"), (904, "q" * 1_000_000, 0.0, 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, y if label == "toxic" else 1 - y) for i, _, y in toxic_corpus(160)] + [(901, None), (None, 1), (5, 7)], f"doc_id bigint, {label} int")
    out = module.held_out_scores(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in out)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert len({r.score for r in out if r.doc_id in (900, 901)}) == 1
    empty = module.held_out_scores(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], f"doc_id bigint, {label} int"))
    assert empty.count() == 0


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs = spark.createDataFrame([(i, t, 0.0, 1, "x") for i, t, _ in toxic_corpus(120)], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic_corpus(120)], "doc_id bigint, toxic int")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(held_out("doc_id", 5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.held_out_scores(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def language_rows():
    rnd = random.Random(4)
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    return [(i, " ".join(words(rnd, 30, alphabets[lang])), lang) for i, lang in enumerate(list(alphabets) * 60)]


def test_language(spark):
    rows = language_rows() + [(900, None, "aa"), (901, "", "aa"), (902, "12 34 ²! _", "aa"), (903, "kolm nonm", None), (None, "abc abd", "aa"), (904, "abcd", "aa"), (904, "abcd", "aa")]
    docs = spark.createDataFrame([(d, t, lang, "x", 0.5) for d, t, lang in rows], "doc_id bigint, text string, lang string, lang_pred string, score double")
    out = language.held_out_predictions(docs, docs_per_language=40).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert all(got[d] == ("und", 0.0) for d in (900, 901, 902)) and got[903][0] == "cc" and got[904][0] == "aa"
    assert np.mean([got[d][0] == lang for d, _, lang in rows[:180]]) == 1 and all(0 <= s <= 1 for _, s in got.values())
    assert language.held_out_predictions(spark.createDataFrame([], docs.schema)).count() == 0


def test_language_backs_off_to_shorter_grams():
    m = language.Model(["x", "y"], {"known": [-1.0, -5.0]}, {"<ab": [-1.0, -9.0], "a": [-2.0, -8.0], "b": [-2.0, -8.0], "c": [-9.0, -1.0]}, 3)
    s = language.Scorer(m)
    assert s.predict("known")[0] == "x"
    assert list(s.evidence("abc")) == [(-1.0 - 9.0) / 2, (-9.0 - 1.0) / 2]
    assert list(s.evidence("zz")) == [0, 0] and s.predict("ccc")[0] == "y"


def test_language_sample_is_bounded(spark):
    rows = language_rows()
    df = spark.createDataFrame([(t, lang) for _, t, lang in rows], "text string, lang string")
    out = language.sample(df, 10).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in out} == {"aa": 10, "bb": 10, "cc": 10}


def test_language_sample_takes_distinct_texts(spark):
    few = [(f"texto {i % 3}", "few") for i in range(2000)]  # by the hash of the row's text alone, all copies pass or fail together
    hot = [("copia", "hot")] * 300 + [(f"otro {i}", "hot") for i in range(60)]
    out = language.sample(spark.createDataFrame(few + hot, "text string, lang string"), 20).collect()
    assert sorted(r.text for r in out if r.lang == "few") == ["texto 0", "texto 1", "texto 2"]
    of_hot = [r.text for r in out if r.lang == "hot"]
    assert len(of_hot) == len(set(of_hot)) == 20


def test_labelled_sample_fills_both_classes(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, quality int")
    taken = labelled_sample(spark.createDataFrame([(i, str(i)) for i in range(400)], "doc_id bigint, text string"), labels, "quality", 1).collect()
    first = min(int(r.text) for r in taken)  # an id with a small hash
    hot = spark.createDataFrame([(first, str(first))] * 500 + [(i, str(i)) for i in range(400)], "doc_id bigint, text string")
    rows = labelled_sample(hot, labels, "quality", 20).collect()
    assert sorted(r.label for r in rows) == [0] * 20 + [1] * 20 and len({r.text for r in rows}) == 40
    # documents that are gone take no place; null and very long ones do
    rest = spark.createDataFrame([(i, str(i)) for i in range(0, 400, 9)] + [(1, None), (3, "x" * 60)], "doc_id bigint, text string")
    rows = labelled_sample(rest, labels, "quality", 200).collect()
    assert sorted(r.text for r in rows) == sorted(["", "x" * 60] + [str(i) for i in range(0, 400, 9)])


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_models_learn_from_long_labelled_texts(spark, module, label):
    """Only texts of over 50,000 characters have labels, and they are learned from."""
    rnd = random.Random(6)
    rows = []
    for i in range(60):
        w = words(rnd, 9000)
        bad = i % 2
        if bad:
            w = [rnd.choice(BAD).upper() + "!!" if rnd.random() < 0.1 else x for x in w]
        rows.append((i, " ".join(w), bad))
    assert min(len(t) for _, t, _ in rows) > 50_000
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y if label == "toxic" else 1 - y) for i, _, y in rows], f"doc_id bigint, {label} int")
    right = [r.predicted == (rows[r.doc_id][2] if label == "toxic" else 1 - rows[r.doc_id][2]) for r in module.held_out_scores(docs, labels).collect()]
    assert np.mean(right) > 0.95


def test_all_words_can_be_kept(spark):
    rows = toxic_corpus(80)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    few, every = quality.fit(docs, labels, most_words=10), quality.fit(docs, labels, most_words=None)
    assert len(few.words) == 10 and len(every.words) == sum(c > 1 for c in quality.count_words([t for _, t, _ in rows]).values())
    assert len(quality.fit(docs, labels, least_count=1).words) == len(quality.count_words([t for _, t, _ in rows]))
    assert np.count_nonzero(toxicity.fit(docs, labels).odds) > np.count_nonzero(toxicity.fit(docs, labels, least_docs=3).odds)


def plain_language(model, text):
    """Word by word: known, else the longest known n-grams in turn."""
    import re

    total, letters = [0.0] * len(model.languages), False
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        if not any(c.isalpha() for c in w):
            continue
        letters = True
        rows, rest = [], f"<{w}>"
        if w in model.words:
            rows, rest = [model.words[w]], ""
        while rest:
            n = next((n for n in range(min(model.max_n, len(rest)), 0, -1) if rest[:n] in model.grams), None)
            if n:
                rows.append(model.grams[rest[:n]])
            rest = rest[n or 1 :]
        for i in range(len(total)):
            total[i] += sum(r[i] for r in rows) / len(rows) if rows else 0.0
    if not letters or not total:
        return "und", 0.0
    p = [np.exp(x - max(total)) for x in total]
    return model.languages[p.index(max(p))], max(p) / sum(p)


def test_language_equals_the_plain_scorer(spark):
    rows = language_rows()
    model = language.fit(spark.createDataFrame([(t, lang) for _, t, lang in rows], "text string, lang string"), words_per_language=30)
    scorer = language.Scorer(model)
    for t in ["", "abc abd kzz", "zzz", "ñandú", "42", "a" * 5000, "abcde fghij " * 50] + [t[:40] for _, t, _ in rows[:30]]:
        got, want = scorer.predict(t), plain_language(model, t)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9
    every = language.fit(spark.createDataFrame([(t, lang) for _, t, lang in rows], "text string, lang string"), words_per_language=None, grams_per_language=None)
    assert len(every.words) > len(model.words)


def test_bounds_of_the_samples():
    import inspect

    of = lambda f, name: inspect.signature(f).parameters[name].default
    assert of(quality.fit, "rows_per_class") == 1500 and of(toxicity.fit, "rows_per_class") == 2000 and of(toxicity.train, "least_steps") == 400
