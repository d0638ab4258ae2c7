"""Spanish number words, Roman numerals and written numbers as column expressions: lookups in arrays, no Python per row."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words.
SMALL = (
    "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve "
    "veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve"
).split()
TENS = {3: "treinta", 4: "cuarenta", 5: "cincuenta", 6: "sesenta", 7: "setenta", 8: "ochenta", 9: "noventa"}
HUNDREDS = ["", "ciento", "doscientos", "trescientos", "cuatrocientos", "quinientos", "seiscientos", "setecientos", "ochocientos", "novecientos"]
ORDINAL_UNITS = ["", "primero", "segundo", "tercero", "cuarto", "quinto", "sexto", "séptimo", "octavo", "noveno"]
ORDINAL_TENS = ["", "décimo", "vigésimo", "trigésimo", "cuadragésimo", "quincuagésimo", "sexagésimo", "septuagésimo", "octogésimo", "nonagésimo"]
#: Roman digits of the units, tens and hundreds, by value.
ROMAN = [["", *(x.translate(str.maketrans("IVX", letters)) for x in ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))] for letters in ("IVX", "XLC", "CDM")]


def below_hundred(gender: str) -> list[str]:
    """Words of 0 to 99; gender n (uno), m (un, before a noun) or f (una)."""
    one = {"n": "uno", "m": "un", "f": "una"}[gender]
    words = [*SMALL, *(TENS[t] + (f" y {SMALL[u]}" if u else "") for t in TENS for u in range(10))]
    words = [w[: -len("uno")] + one if w.endswith("uno") else w for w in words]
    return ["veintiún" if w == "veintiun" else w for w in words]


def hundreds(gender: str) -> list[str]:
    return [h[:-2] + "as" if gender == "f" and h.endswith("os") else h for h in HUNDREDS]


def _lookup(words: list[str], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), index.cast("int"))


def _group(n: Column, gender: str) -> Column:
    """Words of 1 to 999."""
    h, r = F.floor(n / 100), n % 100
    small = _lookup(below_hundred(gender), r)
    return F.when(n == 100, "cien").when(h == 0, small).when(r == 0, _lookup(hundreds(gender), h)).otherwise(F.concat(_lookup(hundreds(gender), h), F.lit(" "), small))


def cardinal(n: Column, gender: str = "n") -> Column:
    """Words of an integer of at most nine digits (others: null)."""
    size = F.abs(n)
    millions, thousands, rest = F.floor(size / 1_000_000), F.floor(size / 1000) % 1000, size % 1000
    parts = F.array_compact(F.array(
        F.when(n < 0, "menos"),
        F.when(millions == 1, "un millón").when(millions > 1, F.concat(_group(millions, "m"), F.lit(" millones"))),
        F.when(thousands == 1, "mil").when(thousands > 1, F.concat(_group(thousands, "f" if gender == "f" else "m"), F.lit(" mil"))),
        F.when(rest > 0, _group(rest, gender)).when(size == 0, "cero"),
    ))
    return F.when(size < 1_000_000_000, F.array_join(parts, " "))


def ordinal(n: Column, gender: str = "m", short: bool = False) -> Column:
    """Words of 1 to 99 (others: null); ``short``: primer, tercer."""
    bend = lambda words: [w[:-1] + "a" if gender == "f" and w else w for w in words]
    units = bend([{"primero": "primer", "tercero": "tercer"}.get(w, w) if short and gender == "m" else w for w in ORDINAL_UNITS])
    tens, unit = _lookup(bend(ORDINAL_TENS), F.floor(n / 10)), _lookup(units, n % 10)
    return F.when(n.between(1, 99), F.trim(F.concat(tens, F.lit(" "), unit)))


def roman_value(text: Column) -> Column:
    """Value of a canonical Roman numeral from I to MMMCMXCIX (others: null)."""
    t = F.upper(text)
    pattern = "^(M{0,3})(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
    digit = lambda k: F.array_position(F.array(*map(F.lit, ROMAN[k])), F.regexp_extract(t, pattern, 4 - k)) - 1
    value = F.length(F.regexp_extract(t, pattern, 1)) * 1000 + digit(2) * 100 + digit(1) * 10 + digit(0)
    return F.when(t.rlike(pattern) & (t != ""), value.cast("int"))


def written_number(text: Column) -> Column:
    """1.234,50 as 1234.5: dots or spaces group, a comma is decimal; no zeros at the ends. Others: null."""
    plain = F.regexp_replace(text, "[. ]", "")
    whole, part = F.regexp_replace(F.split(plain, ",")[0], "^0+", ""), F.regexp_replace(F.get(F.split(plain, ","), F.lit(1)), "0+$", "")
    value = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(F.coalesce(part, F.lit("")) != "", F.concat(F.lit("."), part)).otherwise(""))
    return F.when(text.rlike(r"^([0-9]{1,3}([. ][0-9]{3})+|[0-9]+)(,[0-9]+)?$"), value)


def gender_of(noun: Column) -> Column:
    """f or m by the noun's ending: a rule of thumb."""
    w = F.lower(noun)
    one = F.regexp_replace(w, "s$", "")
    return F.when(one.rlike("(ma|pa|ta)$") & one.isin("problema", "sistema", "tema", "programa", "clima", "idioma", "mapa", "planeta", "poeta", "artista", "día"), "m").when(w.rlike("(a|as|ción|ciones|sión|siones|dad|dades|tud|tudes|umbre|umbres)$"), "f").otherwise("m")


#: Latin letters with marks and the ones they fold to: all of Latin-1 and Latin Extended-A that decompose to one letter.
_MARKED = [(c, unicodedata.normalize("NFKD", c)) for c in map(chr, range(0xC0, 0x180))]
MARKED = [(c, d[0]) for c, d in _MARKED if len(d) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])]


def folded(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(text), "".join(c for c, _ in MARKED), "".join(d for _, d in MARKED))


def match_key(text: Column) -> Column:
    """For telling headings apart: marks, case and punctuation do not count."""
    return F.trim(F.regexp_replace(folded(text), r"[^\p{L}\p{N}_]+", " "))
