"""Alignments against a plain table of cells, blocks and steps against difflib."""

import difflib
import random
import time
import tracemalloc

from pyspark.sql import functions as F

from quirework.functions import alignment as A
from quirework.operators import matching as M
from quirework.plans import comparison


def plain_counts(a, b):
    """Substitutions, deletions, insertions, matches: on a tie the diagonal, then a deletion, then an insertion."""
    table = {(0, 0): (0, 0, 0)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            options = []
            if i and j:
                s, d, n = table[i - 1, j - 1]
                options.append((s + (a[i - 1] != b[j - 1]), d, n))
            if i:
                s, d, n = table[i - 1, j]
                options.append((s, d + 1, n))
            if j:
                s, d, n = table[i, j - 1]
                options.append((s, d, n + 1))
            if options:
                table[i, j] = min(options, key=sum)  # the first of equal ones
    s, d, n = table[len(a), len(b)]
    return s, d, n, len(a) - s - d


def pairs(seed, count=60):
    rnd = random.Random(seed)
    out = [([], []), (["a"], []), ([], ["a", "b"]), (["a", "b"], ["a", "b"]), (["a", "b"], ["b", "a"]), (["x", "a", "b"], ["a", "b", "y"]), (["a"] * 5, ["a"] * 3)]
    for _ in range(count):
        kinds = rnd.choice([1, 2, 3, 8])
        a = [f"w{rnd.randrange(kinds)}" for _ in range(rnd.randint(0, 14))]
        b = [w for w in a if rnd.random() < 0.8] if rnd.random() < 0.5 else [f"w{rnd.randrange(kinds)}" for _ in range(rnd.randint(0, 14))]
        for _ in range(rnd.randint(0, 2)):
            b.insert(rnd.randint(0, len(b)), f"w{rnd.randrange(kinds)}")
        out.append((a, b))
    long = [f"w{rnd.randrange(40)}" for _ in range(150)]
    return [*out, (long, long[:70] + ["x"] + long[72:140] + long[:9])]


def frame(spark, data):
    rows = [(k, a, b) for k, (a, b) in enumerate(data)]
    return spark.createDataFrame(rows, "k int, a array<string>, b array<string>")


def test_counts_with_ties(spark):
    data = pairs(1, 120)
    got = {r.k: tuple(r.c) for r in frame(spark, data).select("k", A.edit_counts(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got == {k: plain_counts(a, b) for k, (a, b) in enumerate(data)}


def test_counts_from_kept_states_and_of_nulls(spark, monkeypatch):
    monkeypatch.setattr(A, "_TOGETHER", 3)
    for a, b in pairs(3, 120):
        assert A.plain_edit_counts(a, b) == plain_counts(a, b) and A.plain_edit_counts(b, a) == plain_counts(b, a)
    data = [(["a", None], [None, "a"]), ([None], [None]), (["a"], None)]
    got = [r.c for r in frame(spark, data).orderBy("k").select(A.edit_counts(F.col("a"), F.col("b")).alias("c")).collect()]
    assert tuple(got[0]) == plain_counts(*data[0]) and tuple(got[1]) == (0, 0, 0, 1) and (got[2] is None or set(got[2]) == {None})


def test_long_pairs_in_short_time(spark):
    """Twelve million cells: by lambdas over arrays they took minutes."""
    data = [([f"a{i}" for i in range(4000)], [f"b{i}" for i in range(3000)])]
    began = time.monotonic()
    got = frame(spark, data).select(A.edit_counts(F.col("a"), F.col("b")).alias("c")).collect()[0].c
    assert tuple(got) == (3000, 1000, 0, 0) and time.monotonic() - began < 30


def test_many_different_words_in_little_memory():
    """A bit for each place of each word would be 50 MB."""
    words = [f"w{i}" for i in range(20_000)]
    tracemalloc.start()
    try:
        got = A.plain_edit_counts(words, words[1000:] + words[:1000])
        assert got == (0, 1000, 1000, 19_000) and tracemalloc.get_traced_memory()[1] < 30e6
    finally:
        tracemalloc.stop()


def test_distances_are_the_built_in_ones(spark):
    rnd = random.Random(4)
    word = lambda letters, n: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, n)))
    data = [("", ""), ("", "año"), ("café 🎈", "cafe"), ("abc", None), *((word(s, n), word(s, n)) for s in ("ab", "añ🎈 ", "abcdefgh") for n in (3, 70, 300) for _ in range(15))]
    got = spark.createDataFrame(data, "x string, y string").select(A.edit_distance(F.col("x"), F.col("y")).alias("d"), F.levenshtein("x", "y").alias("built_in")).collect()
    assert len(got) == len(data) and all(r.d == r.built_in for r in got)


def test_distance_goes_by_rows_of_bits():
    """Nine hundred million cells."""
    rnd = random.Random(6)
    a = "".join(rnd.choice("abcd") for _ in range(30_000))
    began = time.monotonic()
    assert A.plain_edit_distance(a, a[1000:29_000] + "x") == 2000 and time.monotonic() - began < 30


def test_distances_by_strips(monkeypatch):
    """Strips of the longer side give what the whole table gives."""
    rnd = random.Random(7)
    a = "".join(rnd.choice("abcd") for _ in range(40_000))
    assert len(a) > A._STRIP and A.plain_edit_distance(a, a[1000:39_000] + "x") == 2000
    data = [("".join(w[-1] for w in x), "".join(w[-1] for w in y)) for x, y in pairs(8, 120)]
    many = ["".join(chr(0x4E00 + rnd.randrange(150)) for _ in range(n)) for n in (220, 300)]  # more characters than are looked for at once
    data.append(tuple(many))
    for strip in (1, 2, 3, 7, 64, 1000):
        monkeypatch.setattr(A, "_STRIP", strip)
        for a, b in data:
            assert A.plain_edit_distance(a, b) == A.plain_edit_distance(b, a) == sum(plain_counts(a, b)[:3])


def test_characters_of_very_long_pairs_have_their_rate(spark):
    """The reference leaves them out beyond four million cells; here pairs just at that, just beyond and far beyond it, and empty ones."""
    rnd = random.Random(9)
    text = lambda words, more="": " ".join("".join(rnd.choice("abcñ") for _ in range(3)) for _ in range(words)) + more
    long = text(2500)
    texts = [(text(500, "q"), text(500, "r")), (text(500, "q"), text(500, "rr")), (long, text(2200)), (long, long[:4000] + "de " + long[4600:]), (long, ""), ("", long), ("", ""), ("a", "b" * 4_000_001)]
    rows = [(k, turn, role, said) for k, pair in enumerate(texts) for turn, (role, said) in enumerate(zip(("user", "assistant"), pair))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.cer for r in comparison.wer_pairs({"conversations": turns}.__getitem__).collect()}
    rate = F.when(F.length("x") > 0, F.round(F.levenshtein("x", "y") / F.length("x"), 4)).otherwise(0.0)
    both = spark.createDataFrame([(k, *pair) for k, pair in enumerate(texts)], "k long, x string, y string")
    assert len(texts[0][0]) * len(texts[0][1]) == 4_000_000 and None not in got.values()
    assert got == {r.k: r.rate for r in both.select("k", rate.alias("rate")).collect()}


def test_blocks_and_steps_are_those_of_difflib(spark):
    data = pairs(2)
    df = frame(spark, data)
    blocks, steps = {}, {}
    for r in M.matching_blocks(df, ["k"]).collect():
        blocks.setdefault(r.k, []).append((r.i, r.j, r["size"]))
    for r in sorted(M.opcodes(df, ["k"]).collect(), key=lambda r: (r.k, r.step)):
        steps.setdefault(r.k, []).append((r.tag, r.a_begin, r.a_end, r.b_begin, r.b_end))
    for k, (a, b) in enumerate(data):
        m = difflib.SequenceMatcher(a=a, b=b, autojunk=False)
        assert sorted(blocks.get(k, [])) == [tuple(x) for x in m.get_matching_blocks()[:-1]]
        assert steps.get(k, []) == m.get_opcodes()
