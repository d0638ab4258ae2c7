"""Differences between expected and heard texts: kinds, places and verdicts of hand-made pairs."""

import difflib
import random

import pytest

from quirework.functions import text as T
from quirework.operators import review as R

LONG = "el viejo camino subía despacio entre los pinos hasta la ermita blanca del cerro"
#: expected, heard, verdict, (kind, rule, missing, said) of each difference
CASES = [
    ("La canción está aquí.", "la cancion esta aqui", "verified", []),
    ("147", "uno cuatro siete", "verified", []),
    ("147", "1 4 7", "verified", []),
    ("3 20", "trescientos veinte", "likely_error", [("replace", "value", "3 20", "trescientos veinte")]),
    ("147", "ciento cuarenta y ocho", "likely_error", [("replace", "value", "147", "ciento cuarenta y ocho")]),
    ("6:45", "seis cuarenta y cinco", "verified", []),
    ("12/03/2024", "doce de marzo de dos mil veinticuatro", "verified", []),
    ("Había 12 cajas", "Había cajas", "likely_error", [("delete", "value", "12", "")]),
    (LONG, LONG.replace("el viejo", "el el viejo"), "likely_error", [("insert", "stutter", "", "el")]),
    (LONG, LONG.replace("camino", "ca camino"), "likely_error", [("insert", "stutter", "", "ca")]),
    (LONG, LONG + " una heno", "likely_error", [("insert", "trailing", "", "una heno")]),
    (LONG, LONG.replace("los pinos", "pinos"), "ambiguous", [("delete", "function_word", "los", "")]),
    (LONG, LONG.replace("la ermita", "una ermita"), "ambiguous", [("replace", "function_words", "la", "una")]),
    (LONG, LONG.replace("viejo", "biejo"), "ambiguous", [("replace", "same_sound", "viejo", "biejo")]),
    (LONG, LONG.replace("blanca", "blancas"), "ambiguous", [("replace", "near_homophone", "blanca", "blancas")]),
    (LONG, LONG.replace("camino", "perro"), "likely_error", [("replace", "wide", "camino", "perro")]),
    ("Buenas tardes", "Buenos días", "likely_error", None),
    ("Ximena llega tarde hoy", "Jimena llega tarde hoy", "ambiguous", [("replace", "same_sound", "Ximena", "Jimena")]),
    ("Sí, señor", "Sí, señora", "ambiguous", [("replace", "near_homophone", "señor", "señora")]),
    ("", "", "verified", []),
    ("hola", "", "likely_error", [("delete", "short_phrase", "hola", "")]),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, e, h) for i, (e, h, *_) in enumerate(CASES)], "id int, expected string, heard string")
    issues, verdicts = R.compare(df, ["id"])
    by_id = {}
    for r in sorted(issues.collect(), key=lambda r: (r.id, r.step)):
        by_id.setdefault(r.id, []).append(r)
    return by_id, {r.id: r for r in verdicts.collect()}


def test_kinds_and_verdicts(found):
    issues, verdicts = found
    for i, (expected, heard, verdict, want) in enumerate(CASES):
        assert verdicts[i].verdict == verdict, CASES[i]
        if want is not None:
            assert [(r.kind, r.rule, r.missing, r.said) for r in issues.get(i, [])] == want
        assert 0 <= verdicts[i].confidence <= 1 and verdicts[i].n_issues == len(issues.get(i, []))


def test_places(found):
    for i, rows in found[0].items():
        expected, heard = CASES[i][:2]
        for r in rows:
            assert expected[r.expected_begin : r.expected_end] == r.missing and heard[r.heard_begin : r.heard_end] == r.said


def test_similarity_is_that_of_difflib(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abce") for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    pairs = [(i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))]
    got = {r.id: r.ratio for r in R.similarity(spark.createDataFrame(pairs, "id int, x string, y string"), ["id"], "x", "y").collect()}
    assert all(abs(got[i] - difflib.SequenceMatcher(a=a, b=b, autojunk=False).ratio()) < 1e-12 for i, a, b in pairs)


def test_sounds(spark):
    pairs = [("Ximena", "Jimena"), ("Llanes", "Yanes"), ("vaca", "baca"), ("hola", "ola"), ("queso", "keso"), ("guerra", "gerra"), ("gente", "jente"), ("web", "ueb"), ("casa", "kasa"), ("cena", "zena")]
    apart = [("casa", "caza"), ("pero", "perro"), ("gato", "jato"), ("ocho", "oco")]
    df = spark.createDataFrame([(a, b, True) for a, b in pairs] + [(a, b, False) for a, b in apart], "a string, b string, alike boolean")
    assert all(r.alike == r.same for r in df.withColumn("same", T.sound_key(df.a) == T.sound_key(df.b)).collect())
