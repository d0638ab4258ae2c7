"""The pipeline's stages on a small corpus, each held against what it should do to its own input."""

import random
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quirework.llm import quality, toxicity

from .test_jaccard_join import brute as components_of
from .test_models import BAD, words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rnd = random.Random(8)
    docs, labels = [], []
    for i in range(400):
        w = words(rnd, rnd.randint(25, 90))
        bad, junk = i % 5 == 0, i % 7 == 0
        if bad:
            for _ in range(len(w) // 8 + 2):
                w.insert(rnd.randrange(len(w)), rnd.choice(BAD))
        text = " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w[: len(w) // 2]) + "\n" + " ".join(w[len(w) // 2 :])
        if i % 3 == 0:
            text += "\nThis very line stands in many documents"
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not junk), int(bad)))
    for i in range(400, 440):  # exact and near copies
        text = docs[i - 399][1]
        docs.append((i, text if i % 2 else text + " tail", "en", "s", len(text)))
    docs += [(500, None, None, None, None), (501, "", "en", "s", 0)]
    return docs, labels


def test_stages(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "line_dedup", "jaccard_join", "packing"]
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out-{name}")
        seen[name] = now, spark.read.parquet(f"{tmp_path}/out-{name}")
        now = seen[name][1]
        assert name == "packing" or now.columns == spark.createDataFrame([], SCHEMA).columns
    rows = {name: ({r.doc_id: r for r in a.collect()}, b.collect()) for name, (a, b) in seen.items()}

    truth = {i: (q, t) for i, q, t in labels}
    for name, module, keep, at in (("quality", quality, 1, 0), ("toxicity", toxicity, 0, 1)):
        before, after = rows[name]
        kept = {r.doc_id for r in after}
        model = module.fit_outside_fold(seen[name][0], spark.read.parquet(f"{tmp_path}/labels.parquet"))
        scorer = module.Scorer(model)
        cut = 0.3 if module is quality else 0.5
        assert kept == {d for d, r in before.items() if int(scorer.score(r.text or "") >= cut) == keep}
        right = [(d in kept) == (truth[d][at] == keep) for d in before if d in truth]
        assert sum(right) > 0.93 * len(right)
        assert all(r == before[r.doc_id] for r in after)

    before, after = rows["line_dedup"]
    line = "this very line stands in many documents"
    holders = [r.doc_id for r in after if line in (r.text or "").lower().split("\n")]
    assert len(holders) == 1 and holders[0] == min(d for d, r in before.items() if line in (r.text or "").lower().split("\n"))
    assert {r.doc_id for r in after} == set(before) and all(r.n_chars == len(r.text) for r in after)

    before, after = rows["jaccard_join"]
    want = {d for d, _, c in components_of([(d, r.text) for d, r in before.items()]) if d == c}
    assert {r.doc_id for r in after} == want and all(r == before[r.doc_id] for r in after)

    before, after = rows["packing"]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d, r in before.items():
        n = len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1
        assert sum(p.length for p in after if p.doc_id == d) == n
    assert not any(re.search("!!", r.text or "") for r in before.values())
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, after))


def test_clashing_columns_nulls_repeats_and_long_texts(spark, tmp_path):
    """Columns called like those of the operators come out as they went in, and so do odd rows."""
    docs, labels = corpus()
    extra = "predicted int, score string, kept string, n_lines string, held_out string, h1 string, component_id string, label string, row string, shard string"
    long = " ".join(words(random.Random(2), 60_000))
    rows = [(*d, 7, "s", "k", "n", "h", "h1", "c", "l", "r", "sh") for d in [*docs[:120], (docs[3]), (None, "no id here at all", "en", "s", 17), (600, long, "en", "s", len(long)), (500, None, None, None, None)]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(rows, f"{SCHEMA}, {extra}").write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == columns
        got = now.collect()
        assert {tuple(r)[5:] for r in got} == {(7, "s", "k", "n", "h", "h1", "c", "l", "r", "sh")}
        assert any(r.doc_id is None for r in got) and any(r.doc_id == 600 for r in got)
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_without_n_chars_and_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
