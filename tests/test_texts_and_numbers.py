"""Column functions against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quirework.functions import numbers as N
from quirework.functions import text as T
from quirework.functions.alignment import edit_counts
from quirework.operators import ordered as O


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_alignment_costs_the_distance(spark):
    rnd = random.Random(1)
    rows = [([], []), (["a"], []), (["a", "b"], ["b", "a"]), (["ñ", "ñ", "x"], ["ñ", "x"])]
    rows += [([rnd.choice("abcdefgh") for _ in range(rnd.randrange(30))], [rnd.choice("abcdefgh") for _ in range(rnd.randrange(30))]) for _ in range(60)]
    rows += [([f"w{i}" for i in range(700)], [f"w{i}" for i in range(699, -1, -1)])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").withColumn("c", edit_counts(F.col("a"), F.col("b")))
    assert all(r.c.substitutions + r.c.deletions + r.c.insertions == plain_distance(r.a, r.b) for r in df.collect())


@pytest.mark.parametrize("n,words,feminine", [
    (0, "cero", "cero"), (1, "uno", "una"), (16, "dieciséis", "dieciséis"), (21, "veintiuno", "veintiuna"), (31, "treinta y uno", "treinta y una"), (100, "cien", "cien"), (101, "ciento uno", "ciento una"),
    (540, "quinientos cuarenta", "quinientas cuarenta"), (1000, "mil", "mil"), (2021, "dos mil veintiuno", "dos mil veintiuna"), (21_000, "veintiún mil", "veintiuna mil"), (1_000_000, "un millón", "un millón"),
    (31_200_700, "treinta y un millones doscientos mil setecientos", "treinta y un millones doscientas mil setecientas"), (-8, "menos ocho", "menos ocho"), (10**9, None, None),
])
def test_cardinals(spark, n, words, feminine):
    r = spark.range(1).select(N.cardinal(F.lit(n)).alias("a"), N.cardinal(F.lit(n), "f").alias("b")).first()
    assert (r.a, r.b) == (words, feminine)


def plain_roman(n):
    out = ""
    for value, letters in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "M CM D CD C XC L XL X IX V IV I".split()):
        while n >= value:
            out, n = out + letters, n - value
    return out


def test_roman_numerals(spark):
    rows = [(plain_roman(n), n) for n in range(1, 4000)] + [(x, None) for x in ("", "IIII", "VX", "IC", "MMMM", "abc", "IXI")]
    df = spark.createDataFrame(rows, "t string, n int").withColumn("v", N.roman_value(F.col("t")))
    assert all(r.v == r.n for r in df.collect())


def test_written_numbers_and_keys(spark):
    rows = [("1.234,50", "1234.5"), ("007", "7"), ("0,0", "0"), ("12 000", "12000"), ("1.23", None), ("x", None), ("5,25", "5.25")]
    df = spark.createDataFrame(rows, "t string, v string").withColumn("w", N.written_number(F.col("t")))
    assert all(r.v == r.w for r in df.collect())
    r = spark.range(1).select(N.match_key(F.lit("  ¿Ámbar, ñandú?—«Çà» 12 ")).alias("k"), N.ordinal(F.lit(23), "f").alias("o"), N.ordinal(F.lit(1), short=True).alias("p"), N.ordinal(F.lit(100)).alias("q")).first()
    assert (r.k, r.o, r.p, r.q) == ("ambar nandu ca 12", "vigésima tercera", "primer", None)


def test_clean_lines(spark):
    lines = [f"line {i // 3}" for i in range(30_000)]
    r = spark.createDataFrame([("\n".join(lines),), ("a\na\n\n\nb\u00ad  c",)], "t string").select(T.clean_lines(F.col("t")).alias("t")).collect()
    assert r[0].t == "\n".join(f"line {i}" for i in range(10_000)) and r[1].t == "a\n\nb c"


def test_islands_over_ranges(spark):
    rnd = random.Random(2)
    numbers = {k: sorted(rnd.sample(range(300), 230)) for k in "ab"}
    df = spark.createDataFrame([(k, i) for k, x in numbers.items() for i in x], "k string, i bigint")
    want = []
    for k, x in numbers.items():
        start = 0
        for at in range(1, len(x) + 1):
            if at == len(x) or x[at] != x[at - 1] + 1:
                want.append((k, x[start], x[at - 1], at - start))
                start = at
    for width in (7, 64, 1 << 20):
        assert sorted(map(tuple, O.islands(df, ["k"], "i", width).collect())) == sorted(want)


def test_spread_numbers(spark):
    df = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", i * 7) for i in range(20)], "k string, i bigint")
    got = {(r.k, r.i): r.n for r in O.spread_numbered(df, ["k"], "i", "n", 16).collect()}
    assert got == {**{("hot", i): i + 1 for i in range(500)}, **{("cold", i * 7): i + 1 for i in range(20)}}


def test_parents(spark):
    rnd = random.Random(3)
    rows = [(d, p, rnd.randrange(4)) for d in range(5) for p in range(40)]
    df = spark.createDataFrame(rows, "d int, p int, level int")
    for r in O.parents(df, ["d"], "p", "level", [0, 1, 2, 3]).collect():
        before = [p for d, p, x in rows if d == r.d and p < r.p and x < r.level]
        assert r.parent == (max(before) if before else None)


def test_pauses_and_paragraphs_are_told_from_the_row(spark):
    """Without a shuffle: a text's own letters and lines tell them."""
    from quirework.plans.queries import PLANS

    plain = lambda df: "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    talk = spark.createDataFrame([(1, 0, "¡Sí, 2 años… ya!"), (1, 1, "…"), (1, 2, None), (1, 3, "sin"), (2, 0, "")], "conv_id long, turn int, text string")
    got = PLANS["pause_marks"](lambda _: talk)
    assert plain(got) and sorted(map(tuple, got.collect())) == [(1, 0, 1, "clause", 0.25), (1, 0, 2, "sentence", 0.75), (1, 0, 3, "sentence", 1.0), (1, 1, 1, "sentence", None)]
    texts = spark.createDataFrame([(1, " the cut \n\n 12 \n goes on\nNew one\nthen"), (2, None), (3, "\n 4 \n"), (4, "A"), (5, "a\nB\nb \n  b")], "doc_id long, text string")
    got = PLANS["joined_paragraphs"](lambda _: texts)
    assert plain(got) and sorted(map(tuple, got.collect())) == [(1, 1, "the cut goes on"), (1, 2, "New one then"), (4, 1, "A"), (5, 1, "a"), (5, 2, "B"), (5, 3, "b b")]
