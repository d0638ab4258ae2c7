"""Canonical tokens: what written and spoken forms of one thing come to, with their spans."""

import pytest
from pyspark.sql import functions as F

from quirework.operators import canonical as C

#: text, whether a time and a date are expected, values
CASES = [
    ("147", "", ["num:147"]),
    ("ciento cuarenta y siete", "", ["num:147"]),
    ("3 500", "", ["num:3500"]),
    ("tres mil quinientos", "", ["num:3500"]),
    ("3.500", "", ["num:3500"]),
    ("novecientos sesenta", "", ["num:960"]),
    ("mil doscientas personas", "", ["num:1200", "personas"]),
    ("dos millones trescientos mil uno", "", ["num:2300001"]),
    ("3.er edición", "", ["ord:3", "edicion"]),
    ("tercero edición", "", ["ord:3", "edicion"]),
    ("2,5", "", ["num:2.5"]),
    ("dos coma cinco metros", "", ["measure:2.5:m"]),
    ("dos coma cincuenta", "", ["num:2.5"]),
    ("dos coma cero cinco", "", ["num:2.05"]),
    ("2 coma 5 metros", "", ["measure:2.5:m"]),
    ("18 km", "", ["measure:18:km"]),
    ("dieciocho kilómetros", "", ["measure:18:km"]),
    ("9 metros y medio", "", ["measure:9:m", "y", "medio"]),
    ("6:45", "t", ["time:06:45"]),
    ("seis cuarenta y cinco", "t", ["time:06:45"]),
    ("veintitrés diez", "t", ["time:23:10"]),
    ("6 45", "t", ["time:06:45"]),
    ("a las seis y media", "t", ["a", "las", "time:06:30"]),
    ("una menos cuarto", "t", ["time:00:45"]),
    ("18:30 horas", "t", ["time:18:30"]),
    ("18 30 horas", "t", ["time:18:30"]),
    ("3 20", "", ["num:3", "num:20"]),
    ("tres veinte", "", ["num:3", "num:20"]),
    ("trescientos veinte", "", ["num:320"]),
    ("12/03/2024", "", ["date:2024-03-12"]),
    ("31/02/2024", "", ["num:31", "num:2", "num:2024"]),
    ("12 de marzo de 2024", "", ["date:2024-03-12"]),
    ("doce de marzo de dos mil veinticuatro", "d", ["date:2024-03-12"]),
    ("doce de marzo", "d", ["num:12", "de", "marzo"]),
    ("12%", "", ["measure:12:%"]),
    ("doce por ciento", "", ["measure:12:%"]),
    ("12 por 100", "", ["measure:12:%"]),
    ("20 €", "", ["measure:20:EUR"]),
    ("veinte euros", "", ["measure:20:EUR"]),
    ("tres euros con cincuenta", "", ["measure:3.5:EUR"]),
    ("tres euros con cinco céntimos y ya", "", ["measure:3.05:EUR", "y", "ya"]),
    ("3,50 €", "", ["measure:3.5:EUR"]),
    ("Capítulo XIV", "", ["capitulo", "num:14"]),
    ("Felipe II y Alfonso XIII", "", ["felipe", "ord:2", "y", "alfonso", "num:13"]),
    ("once y ha sido", "", ["num:11", "y", "ha", "sido"]),
    ("Productions, S.L.", "", ["productions", "org:sl"]),
    ("una sociedad limitada", "", ["num:1", "org:sl"]),
    ("sociedad anónima unipersonal", "", ["org:sau"]),
    ("la SA y la sa", "", ["la", "org:sa", "y", "la", "sa"]),
    ("S.L.U.", "", ["org:slu"]),
    ("S-2, S2 y S 2", "", ["code:s2", "code:s2", "y", "code:s2"]),
    ("a 2 metros", "", ["a", "measure:2:m"]),
    ("ese hache a ka e", "", ["spell:shake"]),
    ("S H A K E", "", ["spell:shake"]),
    ("a e i o u", "", ["a", "e", "i", "o", "u"]),
    ("ele u con diéresis i griega", "", ["spell:luy"]),
    ("uve doble e be", "", ["spell:web"]),
    ("La canción está aquí.", "", ["la", "cancion", "esta", "aqui"]),
    ("", "", []),
    ("…", "", []),
]


@pytest.fixture(scope="module")
def tokens(spark):
    rows = [(i, text, "t" in how, "d" in how) for i, (text, how, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, text string, time boolean, date boolean")
    out = {}
    for r in C.canonical_tokens(df, ["id"]).collect():
        out.setdefault(r.id, []).append((r.k, r.value, r.begin, r.end))
    return {i: sorted(v) for i, v in out.items()}


def test_values(tokens):
    got = {CASES[i][0] + "|" + CASES[i][1]: [t[1] for t in tokens.get(i, [])] for i in range(len(CASES))}
    assert got == {text + "|" + how: want for text, how, want in CASES}


def test_spans_stand_on_the_text(tokens):
    at = {text: [text[b:e] for _, _, b, e in tokens[i]] for i, (text, _, want) in enumerate(CASES) if want}
    assert at["La canción está aquí."] == ["La", "canción", "está", "aquí"]
    assert at["tres euros con cinco céntimos y ya"] == ["tres euros con cinco céntimos", "y", "ya"]
    assert at["Capítulo XIV"] == ["Capítulo", "XIV"] and at["18 30 horas"] == ["18 30 horas"]
    assert at["Productions, S.L."] == ["Productions", "S.L"] and at["doce por ciento"] == ["doce por ciento"]
    assert all([t[0] for t in tokens[i]] == list(range(len(tokens[i]))) for i in tokens)


def test_tokens_of_a_text_need_no_shuffle(spark):
    """Control characters in a text and rules that overlap included."""
    rows = [(1, "\u0001dos\u0002 12/03/2024 y 3 de enero de 1999", False, False), (2, None, True, True)]
    df = C.canonical_tokens(spark.createDataFrame(rows, "id int, text string, time boolean, date boolean"), ["id"])
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r.k, r.value, r.begin, r.end) for r in sorted(df.collect(), key=lambda r: r.k)] == [(0, "num:2", 1, 4), (1, "date:2024-03-12", 6, 16), (2, "y", 17, 18), (3, "date:1999-01-03", 19, 37)]


def test_claims_follow_the_order_of_the_rules(spark):
    """A span that lost to an earlier rule claims nothing from a later one."""
    from quirework.operators.claims import claimed

    rows = [("a", 0, 0, 5), ("a", 1, 4, 9), ("a", 2, 8, 12), ("a", 2, 20, 25), ("a", 1, 24, 30), ("b", 1, 4, 9), ("b", 2, 8, 12), ("b", 3, 0, 40)]
    df = spark.createDataFrame(rows, "text string, rule int, begin int, end int")
    assert sorted(map(tuple, claimed(df, ["text"]).collect())) == [("a", 0, 0, 5), ("a", 1, 24, 30), ("a", 2, 8, 12), ("b", 1, 4, 9)]
    assert ("b", 3, 0, 40) in map(tuple, claimed(df, ["text"], [3]).collect())


def test_located_matches(spark):
    from quirework.operators.claims import located

    df = spark.createDataFrame([(1, "ab12cd3"), (2, "9"), (3, "x")], "id int, text string")
    got = sorted(tuple(r) for r in located(df, ["id"], F.col("text"), {4: "[0-9]+", 5: "[a-z]+"}).collect())
    assert got == [(1, 4, 2, 4, "12"), (1, 4, 6, 7, "3"), (1, 5, 0, 2, "ab"), (1, 5, 4, 6, "cd"), (2, 4, 0, 1, "9"), (3, 5, 0, 1, "x")]
