"""Spanish spoken forms: the grammar of number phrases as a pattern over words, and the values of phrases and written numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numbers as N
from .arrays import let, marked


def _bare(words) -> list[str]:
    return [w.translate(str.maketrans("áéíóúü", "aeiouu")) for w in words]


_BELOW = {w: i for g in "nmf" for i, w in enumerate(_bare(N.below_hundred(g))) if i < 30}
_BELOW["veintiun"] = 21
_TENS = {w: 10 * t for t, w in N.TENS.items()}
_HUNDREDS = {w: 100 * i for g in "nf" for i, w in enumerate(_bare(N.hundreds(g))) if i} | {"cien": 100}
# What multiplies, ordinals, months, and units by the words that name them.
_SCALES = {"mil": 10**3, "millon": 10**6, "millones": 10**6, "billon": 10**12, "billones": 10**12}
ORDINALS = {
    "primero": 1, "primer": 1, "primera": 1, "segundo": 2, "segunda": 2, "tercero": 3, "tercer": 3, "tercera": 3, "cuarto": 4, "cuarta": 4, "quinto": 5, "quinta": 5,
    "sexto": 6, "sexta": 6, "septimo": 7, "septima": 7, "octavo": 8, "octava": 8, "noveno": 9, "novena": 9, "decimo": 10, "decima": 10,
}
MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
}
UNITS = {
    "m": "m metro metros", "km": "km kilometro kilometros", "cm": "cm centimetro centimetros", "mm": "mm milimetro milimetros", "mi": "milla millas",
    "kg": "kg kilo kilos kilogramo kilogramos", "g": "g gramo gramos", "l": "l litro litros", "%": "porciento", "EUR": "euro euros eur", "USD": "dolar dolares usd",
    "hPa": "hpa hectopascal hectopascales", "ha": "ha hectarea hectareas", "ml": "ml mililitro mililitros", "t": "t tonelada toneladas", "deg": "grado grados", "h": "hora horas", "GBP": "libra libras",
}
UNIT_OF = {word: unit for unit, words in UNITS.items() for word in words.split()}

#: What each word can be in a number phrase, as one letter; other words are a point.
LETTERS = {
    **{w: "Z" if v == 0 else "D" if v < 10 else "S" if v <= 23 else "s" for w, v in _BELOW.items()},
    **{w: "t" if v < 60 else "T" for w, v in _TENS.items()}, **dict.fromkeys(_HUNDREDS, "H"), "ciento": "C", **dict.fromkeys(_SCALES, "M"), **dict.fromkeys(ORDINALS, "O"), "cuarto": "Q",
    **dict.fromkeys(MONTHS, "m"), **dict.fromkeys(UNIT_OF, "u"), "y": "y", "coma": "c", "de": "d", "por": "p", "media": "h", "en": "e", "punto": "k", "menos": "n",
}
_GROUP = "(?:[HC](?:y*(?:[tT]y*D|[tT]|[DZSs]))?|[tT]y*D|[tT]|[DZSs])"
_SCALED = f"(?:(?:{_GROUP}y*)?M)"
#: A cardinal number; it may begin with "y", and never ends with it.
CARDINAL = f"y*(?:{_SCALED}(?:y*{_SCALED})*(?:y*{_GROUP})?|{_GROUP})"
CLOCK = "[DZS](?:yh|yQ|ek|nQ)"
HOUR_MINUTE = "[DZS](?:ty*D|t|[DZSs])(?!M)"
DATE = f"{CARDINAL}dmd{CARDINAL}"
MEASURED = "(?:u|pC)"
_NUMBER = f"[OQ]|{CARDINAL}(?:c(?:[DZ]+|[tT]yD|[tT]|[Ss]))?{MEASURED}?"


def phrases(letters: Column, time: Column, date: Column) -> Column:
    """Letters of words with each number phrase between marks; clock times and dates only where they are expected."""
    of = lambda *first: marked(letters, "|".join([*first, _NUMBER]))
    return F.when(time & date, of(DATE, CLOCK, HOUR_MINUTE)).when(time, of(CLOCK, HOUR_MINUTE)).when(date, of(DATE)).otherwise(of())


def letter(word: Column) -> Column:
    """What a word can be in a number phrase."""
    chosen, words = None, {}
    for w, x in LETTERS.items():
        words.setdefault(x, []).append(w)
    for x, ws in words.items():
        chosen = F.when(word.isin(*ws), x) if chosen is None else chosen.when(word.isin(*ws), x)
    return F.when(word.isin(*LETTERS), chosen).otherwise(".")


def lookup(table: dict, word: Column) -> Column:
    """The value of a word in a table of plain words; null for others."""
    quoted = lambda x: f"'{x}'" if isinstance(x, str) else f"{x}L"
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in table.items()) + ")")[word]


def cardinal_value(phrase: Column) -> Column:
    """Value of a cardinal phrase: groups below a thousand are added up, and what multiplies closes them (alone it is one of its kind)."""
    words = F.filter(F.split(phrase, " "), lambda w: (w != "y") & (w != ""))
    value = {w: v for t in (_BELOW, _TENS, _HUNDREDS) for w, v in t.items()}
    null = F.lit(None).cast("bigint")

    def add(acc: Column, w: Column) -> Column:
        closes = w.isin(*_SCALES)
        total = F.when(closes, acc["total"] + F.coalesce(acc["group"], F.lit(1)) * lookup(_SCALES, w)).otherwise(acc["total"])
        group = F.when(closes, null).otherwise(F.coalesce(acc["group"], F.lit(0)) + lookup(value, w))
        return F.struct(total.cast("bigint").alias("total"), group.cast("bigint").alias("group"))

    start = F.struct(F.lit(0).cast("bigint").alias("total"), null.alias("group"))
    n = F.aggregate(words, start, add, lambda acc: acc["total"] + F.coalesce(acc["group"], F.lit(0)))
    return F.when(n <= 999_999_999_999_999, n)


def number_text(written: Column) -> Column:
    """A written number by its value: a comma is decimal, dots before three digits group; no zeros at the ends."""
    c = F.regexp_replace(written, r"\s", "")
    c = F.when(F.contains(c, F.lit(",")), F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(c.rlike(r"^\d+(\.\d{3})+$"), F.replace(c, F.lit("."), F.lit(""))).otherwise(c)
    whole = F.regexp_replace(F.regexp_extract(c, r"^(\d+)", 1), r"^0+(?=\d)", "")
    part = F.regexp_replace(F.regexp_extract(c, r"\.(\d+)$", 1), "0+$", "")
    return F.when(c.rlike(r"^\d+(\.\d+)?$"), F.concat(whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))).otherwise(c)


def with_unit(number: Column, unit: Column) -> Column:
    return F.when(unit.isNull(), F.concat(F.lit("num:"), number)).otherwise(F.concat(F.lit("measure:"), number, F.lit(":"), unit))


def day(year: Column, month: Column, of: Column) -> Column:
    """date:yyyy-mm-dd of a day that there is, else null."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month.cast("int").cast("string"), of.cast("int").cast("string"))
    there = F.try_to_timestamp(text, F.lit("yyyy-M-d"))
    return F.when(there.isNotNull(), F.concat(F.lit("date:"), F.date_format(there, "yyyy-MM-dd")))


def clock(hour: Column, minute: Column) -> Column:
    return F.format_string("time:%02d:%02d", hour.cast("int"), minute.cast("int"))


def phrase_value(letters: Column, words: Column, time: Column, date: Column) -> Column:
    """The canonical value of a phrase that ``phrases`` has found; step by step, so that nothing is computed twice."""
    is_ = lambda p: letters.rlike(f"^(?:{p})$")
    kind = F.when(date & F.contains(letters, F.lit("dmd")), "date").when(time & is_(CLOCK), "clock").when(time & is_(HOUR_MINUTE), "pair").when(letters.rlike("^[OQ]$"), "ordinal").otherwise("number")
    n, last, head = F.size(words), F.element_at(words, -1), F.get(words, F.lit(0))
    tail = F.when(letters.rlike("u$"), 1).when(letters.rlike("pC$"), 2).otherwise(0)
    closing = F.array_join(F.slice(words, F.greatest(n - 1, F.lit(1)), F.lit(2)), " ")
    # digits one by one after the sign, or one number
    single = {w: v for w, v in _BELOW.items() if v < 10}

    def of_kind(kind: Column) -> Column:
        core = F.array_join(F.slice(words, F.lit(1), n - F.when(kind == "number", tail).otherwise(0)), " ")
        return let(core, lambda core: let(F.split(core, " de "), lambda of: of_said(kind, core, of)))

    def of_said(kind: Column, core: Column, of: Column) -> Column:
        # each cardinal of the phrase once: day and year, hour and minute, or what stands before and after the decimal sign
        rest = F.array_join(F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(1))), " ")
        said = F.when(kind == "date", F.array(of[0], F.get(of, F.lit(2)))).when(kind == "pair", F.array(head, rest)).when(kind == "clock", F.array(head)).otherwise(F.split(core, " coma "))
        return let(said, lambda said: let(F.transform(said, cardinal_value), lambda values: of_values(kind, of, said, F.get(values, F.lit(0)), F.get(values, F.lit(1)))))

    def of_values(kind: Column, of: Column, said: Column, first: Column, second: Column) -> Column:
        digits = F.split(F.get(said, F.lit(1)), " ")
        fraction = F.when(F.forall(digits, lambda w: w.isin(*single)), F.array_join(F.transform(digits, lambda w: lookup(single, w)), "")).otherwise(second.cast("string"))
        number = let(F.concat(first.cast("string"), F.when(F.size(said) > 1, F.concat(F.lit(","), fraction)).otherwise("")), number_text)
        measure = F.when(letters.rlike("pC$"), "%").when(letters.rlike("u$"), lookup(UNIT_OF, last))
        ordinal = F.when(kind == "ordinal", F.concat(F.lit("ord:"), lookup(ORDINALS, last).cast("string")))
        minute = F.when(closing == "y media", 30).when(closing == "en punto", 0).when(closing == "menos cuarto", 45).otherwise(15)
        spoken_date = F.coalesce(day(second, lookup(MONTHS, F.get(of, F.lit(1))), first), F.concat(F.lit("num:"), first.cast("string")))
        spoken_clock = clock(F.when((kind == "clock") & (closing == "menos cuarto"), (first + 23) % 24).otherwise(first), F.when(kind == "pair", second).otherwise(minute))
        return F.when(kind == "date", spoken_date).when(kind.isin("clock", "pair"), spoken_clock).otherwise(F.coalesce(ordinal, with_unit(number, measure)))

    return let(kind, of_kind)
