"""Canonical tokens of Spanish texts: written and spoken forms of one quantity become one value, with the span they stand on.

Each rule's matches are spans; the order of the rules decides among matches that overlap; number phrases are looked for in the words that no
rule has claimed; what is left are words. All of it are arrays of the text's own row. Then runs of tokens that say one thing the long way are folded. Texts are read in composed
form (NFC): lower case and without marks each character is still one, so offsets are those of the text. A number phrase of over twelve words is read whole.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import numbers as N
from quirework.functions import spoken as S
from quirework.functions.arrays import let, marked, occurrences, unmarked

from .claims import chosen, covered, folded, overlapping

_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_CORE = r"(?:\d{1,3}(?:[.,]\d{3})+(?:,\d+)?|\d{1,3}(?:\s\d{3})+|\d+(?:[.,]\d+)?)"
_UNIT = "(?:" + "|".join(sorted(S.UNIT_OF, key=lambda w: (-len(w), w))) + "|[$]|€)"
# Words before which a Roman numeral is a number, and names after which it is an ordinal.
STRUCTURAL = "capitulos?|partes?|libros?|seccion|secciones|tomos?|actos?|escenas?|volumenes|volumen|anexos?|apendices?|siglos?"
REGNAL = (
    "alfonso|fernando|felipe|carlos|isabel|juan|juana|enrique|pedro|jaime|sancho|ramiro|garcia|luis|napoleon|pio|leon|gregorio|benedicto|inocencio|clemente|"
    "urbano|bonifacio|pablo|francisco|leonor|urraca|catalina|maria|ricardo|eduardo|jorge|guillermo|federico|amadeo|alejandro"
)
TIME = r"\d{1,2}:\d{2}"
NUMERIC_DATE = r"(?<!\d)(\d{1,2})[/-](\d{1,2})[/-](\d{4})(?!\d)"
TEXTUAL_DATE = _BEFORE + r"(\d{1,2})\s+de\s+([a-z]+)\s+del?\s+(\d{3,4})" + _AFTER


class Rule(NamedTuple):
    """A pattern over plain text; the value of a match (null: none); where in the match the token begins, if not at its start."""

    pattern: str
    value: Callable[[Column], Column]
    begins: str | None = None


def _part(pattern: str, i: int) -> Callable[[Column], Column]:
    return lambda m: F.regexp_extract(m, pattern, i)


def _spaced_unit(text: Column) -> Column:
    bare = F.regexp_replace(text, r"\s", "")
    return F.when(bare.rlike("^(%|por)"), "%").when(bare == "€", "EUR").when(bare != "", S.lookup(S.UNIT_OF, bare))


def _decimal(m: Column) -> Column:
    p = r"^(\d+)\s+coma\s+(\d{1,3}(?:\s+\d)*)(?:\s*(.*))?$"
    number = F.concat(_part(p, 1)(m), F.lit(","), F.regexp_replace(_part(p, 2)(m), r"\s", ""))
    return S.with_unit(S.number_text(number), _spaced_unit(_part(p, 3)(m)))


def _quantity(m: Column) -> Column:
    p = f"^({_CORE})(.*)$"
    return S.with_unit(S.number_text(_part(p, 1)(m)), _spaced_unit(_part(p, 2)(m)))


def _roman(m: Column) -> Column:
    return N.roman_value(F.regexp_extract(m, r"([a-z]+)$", 1)).cast("string")


def _regnal(m: Column) -> Column:
    n = _roman(m)
    return F.concat(F.when(n.cast("int") <= 10, "ord:").otherwise("num:"), n)


def _time(m: Column) -> Column:
    hour, minute = (F.split(m, ":")[i].cast("int") for i in (0, 1))
    return F.when((hour <= 23) & (minute <= 59), S.clock(hour, minute))


_ORDINAL = _BEFORE + r"(\d+)(?:\.?[ºª]|\.?er|\.?to|\.?ra|\.?ro|\.?o|\.?a)" + _AFTER
_PERCENT = _BEFORE + r"(\d+(?:[.,]\d+)?)\s*(?:%|por\s+(?:ciento|cien|100))" + _AFTER
#: In order: an earlier rule claims before a later one.
RULES = [
    Rule(_ORDINAL, lambda m: F.concat(F.lit("ord:"), S.number_text(F.regexp_extract(m, r"^(\d+)", 1)))),
    Rule(NUMERIC_DATE, lambda m: S.day(_part(NUMERIC_DATE, 3)(m), _part(NUMERIC_DATE, 2)(m), _part(NUMERIC_DATE, 1)(m))),
    Rule(TEXTUAL_DATE, lambda m: S.day(_part(TEXTUAL_DATE, 3)(m), S.lookup(S.MONTHS, _part(TEXTUAL_DATE, 2)(m)), _part(TEXTUAL_DATE, 1)(m))),
    Rule(_BEFORE + rf"(\d+)\s+coma\s+(\d{{1,3}}(?:\s+\d)*)(?:\s*(?:%|por\s+(?:ciento|cien|100)(?![\p{{L}}\p{{N}}_])|{_UNIT}))?" + _AFTER, _decimal),
    Rule(_BEFORE + rf"(?:{STRUCTURAL})\s+[ivxlcdm]{{1,15}}" + _AFTER, lambda m: F.concat(F.lit("num:"), _roman(m)), "([a-z]+)$"),
    Rule(_BEFORE + rf"(?:{REGNAL})\s+[ivxl]{{1,6}}" + _AFTER, _regnal, "([a-z]+)$"),
    Rule(_PERCENT, lambda m: S.with_unit(S.number_text(_part(_PERCENT, 1)(m)), F.lit("%"))),
    Rule(TIME, _time),
    Rule(_BEFORE + rf"{_CORE}(?:\s*{_UNIT})?(?:\s*%)?" + _AFTER, _quantity),
]
#: Numeric dates and times claim whatever was claimed before.
ALWAYS = [1, 7]


def expects_time(text: Column) -> Column:
    return N.folded(text).rlike(TIME)


def expects_date(text: Column) -> Column:
    plain = N.folded(text)
    return plain.rlike(NUMERIC_DATE) | plain.rlike(TEXTUAL_DATE)


_SPAN = "array<struct<rule:int,begin:int,end:int,value:string>>"


def _written_spans(plain: Column) -> Column:
    """rule, begin, end, value of what the rules claim."""

    def of(i: int, r: Rule) -> Column:
        begin = lambda m: m["end"] - F.length(F.regexp_extract(m["match"], r.begins, 1)) if r.begins else m["begin"]
        return F.transform(occurrences(marked(plain, r.pattern)), lambda m: F.struct(F.lit(i).alias("rule"), begin(m).cast("int").alias("begin"), m["end"].alias("end"), r.value(m["match"]).alias("value")))

    found = F.filter(F.concat(*[of(i, r) for i, r in enumerate(RULES)]), lambda s: s["value"].isNotNull())
    by_place = lambda spans: F.sort_array(F.transform(spans, lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"))))
    return let(found, lambda spans: F.when(let(by_place(spans), overlapping), chosen(spans, _SPAN, ALWAYS)).otherwise(spans))


def _span(begin: Column, end: Column, value: Column) -> Column:
    return F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end"), value.alias("value"))


def _spoken_spans(words: Column, time: Column, date: Column) -> Column:
    """begin, end, value of number phrases in the words (begin, end, value, covered) that no rule has claimed."""
    # a letter is a word
    letters = F.array_join(F.transform(words, lambda w: F.when(w["covered"], "#").otherwise(S.letter(w["value"]))), "")
    value = lambda f: let(F.transform(F.slice(words, f["begin"] + 1, f["end"] - f["begin"]), lambda w: w["value"]), lambda ws: S.phrase_value(f["match"], ws, time, date))
    found = F.transform(occurrences(let(letters, lambda x: S.phrases(x, time, date))), lambda f: _span(F.get(words, f["begin"])["begin"], F.get(words, f["end"] - 1)["end"], value(f)))
    return F.filter(found, lambda s: s["value"].isNotNull())


def _cut(text: Column, begin: Column, end: Column) -> Column:
    return F.substring(text, begin + 1, end - begin)


def _clock_pairs(numbers: Column, plain: Column) -> Column:
    """Two numbers with nothing but blanks between them, the second of two digits, are a time: for texts where one is expected."""

    def pair(x: Column, i: Column) -> Column:
        def both(next_: Column) -> Column:
            minute = F.regexp_extract(F.regexp_extract(next_["value"], r"^(?:num:(\d+)|measure:(\d+):h)$", 0), r"(\d+)", 1)
            raw, gap = F.regexp_extract(_cut(plain, next_["begin"], next_["end"]), r"^(\d+)", 1), _cut(plain, x["end"], next_["begin"])
            hour = F.regexp_extract(x["value"], r"^num:(\d+)$", 1)
            fits = (hour != "") & (minute != "") & (F.length(raw) == 2) & gap.rlike(r"^\s*$") & (hour.try_cast("int") <= 23) & (minute.try_cast("int") <= 59)
            return F.when(fits, _span(x["begin"], next_["end"], S.clock(hour, minute)))

        return let(F.get(numbers, i + 1), both)

    def joined(pairs: Column) -> Column:
        # in a chain of such pairs every other one counts
        joins = F.array_join(F.transform(pairs, lambda p: F.when(p.isNull(), ".").otherwise("j")), "")
        takes = F.translate(F.replace(joins, F.lit("jj"), F.lit("t.")), "j", "t")
        own = lambda takes, x, i: F.when(F.get(takes, i) == "t", F.get(pairs, i)).otherwise(x)
        # a number that the one before has taken goes
        return let(F.split(takes, ""), lambda takes: F.array_compact(F.transform(numbers, lambda x, i: F.when(F.coalesce(F.get(takes, i - 1) != "t", F.lit(True)), own(takes, x, i)))))

    return let(F.transform(numbers, pair), joined)


# Spoken company forms, letters that are no words, names of letters and of marks.
COMPANIES = {"sociedad limitada unipersonal": "slu", "sociedad anonima unipersonal": "sau", "sociedad limitada": "sl", "sociedad anonima": "sa"}
LONE = "bcdfghjklmnpqrstvwxz"
LETTER_NAMES = {
    "a": "a", "be": "b", "ce": "c", "de": "d", "e": "e", "efe": "f", "ge": "g", "hache": "h", "i": "i", "jota": "j", "ka": "k", "ele": "l", "eme": "m", "ene": "n", "o": "o", "pe": "p",
    "cu": "q", "ere": "r", "erre": "r", "ese": "s", "te": "t", "u": "u", "uve": "v", "equis": "x", "ye": "y", "zeta": "z", "ceta": "z",
}
LETTER_PAIRS = {"uve doble": "w", "doble uve": "w", "doble ve": "w", "doble u": "w", "i griega": "y", "doble ese": "ss"}
MARKS = ["tilde", "dieresis", "cedilla", "barra", "anillo", "virgulilla", "caron", "colita", "breve", "punto"]
WEAK = ["a", "e", "i", "o", "u", "de", "te", "ese", "ye"]
ACCENTS = ["grave", "agudo", "circunflejo"]


def _kinds(table: Callable[[Column], dict[str, Column]]) -> Callable[[Column], Column]:
    """Of a token the first letter whose condition holds, else a point."""

    def kind(token: Column) -> Column:
        out = None
        for letter, condition in table(token).items():
            out = F.when(condition, letter) if out is None else out.when(condition, letter)
        return out.otherwise(".")

    return kind


def _revalued(tokens: Column, value: Callable[[Column], Column]) -> Column:
    return F.transform(tokens, lambda t: F.struct(value(t).alias("value"), *[t[c].alias(c) for c in ("begin", "end", "surface", "gap")]))


def fold_companies(tokens: Column) -> Column:
    """Spoken company forms become org:."""
    names = lambda t: {"S": t["value"] == "sociedad", "L": t["value"] == "limitada", "A": t["value"] == "anonima", "U": t["value"] == "unipersonal"}
    return folded(tokens, _kinds(names), "S[LA]U?", lambda p: F.concat(F.lit("org:"), S.lookup(COMPANIES, F.array_join(p, " "))))


def fold_short_companies(tokens: Column) -> Column:
    """Abbreviated company forms become org:."""
    whole = lambda t: t["value"].isin(*COMPANIES.values()) & (F.upper(t["surface"]) == t["surface"])
    tokens = _revalued(tokens, lambda t: F.when(whole(t), F.concat(F.lit("org:"), t["value"])).otherwise(t["value"]))

    def short(t: Column) -> dict[str, Column]:
        v, dotted = t["value"], F.coalesce(t["gap"].rlike(r"^\s*\.?\s*$"), F.lit(False))
        return {"s": (v == "s") & dotted, "l": v.isin("l", "a") & dotted, "m": v.isin("l", "a"), "u": v == "u"}

    return folded(tokens, _kinds(short), "slu|s[lm]", lambda p: F.concat(F.lit("org:"), F.array_join(p, "")))


def fold_codes(tokens: Column) -> Column:
    """A letter joined to a number becomes code:."""
    tokens = _revalued(tokens, lambda t: F.when(t["value"].rlike(f"^[{LONE}][0-9]+$"), F.concat(F.lit("code:"), t["value"])).otherwise(t["value"]))
    kinds = lambda t: {"c": t["value"].rlike(f"^[{LONE}]$") & F.coalesce(t["gap"].isin("", "-", " "), F.lit(False)), "n": t["value"].rlike("^num:[0-9]+$")}
    return folded(tokens, _kinds(kinds), "cn", lambda p: F.concat(F.lit("code:"), p[0], F.substring(p[1], F.lit(5), F.length(p[1]))))


def fold_spoken(tokens: Column) -> Column:
    """Hours after a time go; euros with cents are one amount."""
    kinds = lambda v: {
        "T": F.startswith(v, F.lit("time:")), "H": v.isin("h", "horas", "hora"), "E": v.rlike(r"^measure:[0-9]+:EUR$"), "C": v == "con", "N": v.rlike("^num:[0-9]{1,2}$"), "c": v.isin("centimo", "centimos"),
    }

    def value(p: Column) -> Column:
        cents = F.lpad(F.substring(p[2], F.lit(5), F.length(p[2])), 2, "0")
        amount = S.number_text(F.concat(F.split(p[0], ":")[1], F.lit(","), cents))
        return F.when(F.startswith(p[0], F.lit("time:")), p[0]).otherwise(F.concat(F.lit("measure:"), amount, F.lit(":EUR")))

    return folded(tokens, _kinds(lambda t: kinds(t["value"])), "TH|ECNc?", value)


def fold_spelled(tokens: Column) -> Column:
    """Three letters or more, by their names or as they are, with one at least that is no everyday word, become spell:."""
    kinds = lambda v: {
        "D": v == "doble", "V": v == "uve", "W": v == "ve", "I": v == "i", "G": v == "griega", "U": v == "u", "E": v == "ese", "C": v == "con", "M": v.isin(*MARKS), "A": v == "acento", "R": v.isin(*ACCENTS),
        "s": v.isin(*[n for n in LETTER_NAMES if n not in WEAK]) | v.rlike(f"^[{LONE}]$"), "w": v.isin(*WEAK) | v.rlike(r"^\p{L}$"),
    }
    mark, strong = "(?:C[MA]R?)?", "(?:VD|D[VWUE]|IG|[Vs])"
    unit = f"(?:{strong}|[IUEw]){mark}"

    def value(p: Column) -> Column:
        said = F.regexp_replace(F.array_join(p, " "), f" con (?:{'|'.join(MARKS)}|acento)(?: (?:{'|'.join(ACCENTS)}))?(?= |$)", "")
        for pair, letter in LETTER_PAIRS.items():
            said = F.regexp_replace(said, f"(?<![^ ]){pair}(?![^ ])", letter)
        return F.concat(F.lit("spell:"), F.array_join(F.transform(F.split(said, " "), lambda w: F.coalesce(S.lookup(LETTER_NAMES, w), w)), ""))

    return folded(tokens, _kinds(lambda t: kinds(t["value"])), f"(?=(?:{unit})*?{strong})(?:{unit}){{3,}}", value)


def _with_gaps(text: Column, tokens: Column) -> Column:
    """Tokens with what stands between a token and the next, and the token itself, as written."""
    gap = lambda s, t, i: F.when(F.get(s["tokens"], i + 1).isNotNull(), _cut(s["text"], t["end"], F.get(s["tokens"], i + 1)["begin"]))
    each = lambda s, t, i: F.struct(t["value"].alias("value"), t["begin"].alias("begin"), t["end"].alias("end"), _cut(s["text"], t["begin"], t["end"]).alias("surface"), gap(s, t, i).alias("gap"))
    return let(F.struct(text.alias("text"), tokens.alias("tokens")), lambda s: F.transform(s["tokens"], lambda t, i: each(s, t, i)))


def with_tokens(rows: DataFrame, name: str, text: Column, time: Column, date: Column, folds: bool = True) -> DataFrame:
    """Rows with a column ``name``: value, begin, end, surface, gap of the tokens of a text, in order; null for a null text.

    ``time`` and ``date`` say whether spoken clock times and dates are expected in the text. All of it is told from the row: nothing is shuffled.
    A column for each step, as the analysis of one expression would take a round for each value named in it.
    """
    step = lambda c: F.col(f"__{c}")
    plain, words, by_rule, numbers, tokens = map(step, ("plain", "words", "by_rule", "numbers", "tokens"))
    out = rows.withColumns({"__text": text, "__time": F.coalesce(time, F.lit(False)), "__date": F.coalesce(date, F.lit(False))}).withColumn("__plain", unmarked(N.folded(step("text"))))
    out = out.withColumn("__words", F.transform(occurrences(marked(plain, r"[\p{L}\p{N}]+")), lambda m: _span(m["begin"], m["end"], m["match"])))
    out = out.withColumn("__by_rule", _written_spans(plain)).withColumn("__each", covered(words, by_rule))
    out = out.withColumn("__spoken", let(F.struct(step("each").alias("words"), step("time").alias("time"), step("date").alias("date")), lambda s: _spoken_spans(s["words"], s["time"], s["date"])))
    out = out.withColumn("__numbers", F.sort_array(F.concat(F.transform(by_rule, lambda r: _span(r["begin"], r["end"], r["value"])), step("spoken"))))
    pairs = let(F.struct(numbers.alias("numbers"), plain.alias("plain")), lambda s: _clock_pairs(s["numbers"], s["plain"]))
    out = out.withColumn("__numbers", F.when(step("time"), pairs).otherwise(numbers))
    left = F.transform(F.filter(covered(words, numbers), lambda w: ~w["covered"]), lambda w: _span(w["begin"], w["end"], w["value"]))
    out = out.withColumn("__tokens", F.sort_array(F.concat(left, numbers))).withColumn("__tokens", _with_gaps(step("text"), tokens))
    for fold in (fold_companies, fold_short_companies, fold_codes, fold_spoken, fold_spelled) if folds else ():
        out = out.withColumn("__tokens", fold(tokens))
    return out.select(*rows.columns, F.when(step("text").isNotNull(), tokens).alias(name))


def canonical_tokens(texts: DataFrame, key: list[str], folds: bool = True) -> DataFrame:
    """key, k, value, begin, end, surface: the tokens of texts (key, text, time, date), in order."""
    rows = with_tokens(texts.select(*key, "text", "time", "date"), "__found", F.col("text"), F.col("time"), F.col("date"), folds)
    # an explode that drops empty arrays would look for them before, and compute all steps for it again
    return rows.select(*key, F.posexplode_outer("__found").alias("k", "t")).filter("k is not null").select(*key, "k", "t.value", "t.begin", "t.end", "t.surface")
