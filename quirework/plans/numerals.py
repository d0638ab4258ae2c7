"""Queries of number words, numerals and match keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.functions import numbers as N
from quirework.plans.registry import query


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _group_sql(n: str, gender: str) -> str:
    small, big = _list(N.below_hundred(gender)), _list(N.hundreds(gender))
    return f"CASE WHEN {n} = 100 THEN 'cien' WHEN {n} < 100 THEN {small}[{n} % 100 + 1] WHEN {n} % 100 = 0 THEN {big}[{n} // 100 + 1] ELSE {big}[{n} // 100 + 1] || ' ' || {small}[{n} % 100 + 1] END"


def _cardinal_sql(n: str, gender: str) -> str:
    millions, thousands, rest = f"(abs({n}) // 1000000)", f"(abs({n}) // 1000 % 1000)", f"(abs({n}) % 1000)"
    return (
        f"concat_ws(' ', CASE WHEN {n} < 0 THEN 'menos' END, CASE WHEN {millions} = 1 THEN 'un millón' WHEN {millions} > 1 THEN {_group_sql(millions, 'm')} || ' millones' END, "
        f"CASE WHEN {thousands} = 1 THEN 'mil' WHEN {thousands} > 1 THEN {_group_sql(thousands, 'f' if gender == 'f' else 'm')} || ' mil' END, CASE WHEN {rest} > 0 THEN {_group_sql(rest, gender)} WHEN {n} = 0 THEN 'cero' END)"
    )


_NUMBERS = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 50 = 0 THEN CAST(l_partkey % 3 * 1000000 AS BIGINT) ELSE CAST(floor(l_extendedprice * l_quantity) AS BIGINT) - 20000 END AS n FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n, {_cardinal_sql('n', 'n')} AS plain, {_cardinal_sql('n', 'f')} AS feminine FROM ({_NUMBERS}) WHERE abs(n) < 1000000000")
def cardinal_words(t):
    """NUM16, NUM22: integers in words, plain and before a feminine noun."""
    n = F.when(F.col("l_partkey") % 50 == 0, F.col("l_partkey") % 3 * 1_000_000).otherwise(F.floor(F.col("l_extendedprice") * F.col("l_quantity")) - 20000).cast("bigint")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", n.alias("n")).filter(F.abs("n") < 1_000_000_000)
    return rows.withColumns({"plain": N.cardinal(F.col("n")), "feminine": N.cardinal(F.col("n"), "f")})


def _ordinal_sql(n: str, gender: str, short: bool) -> str:
    bend = lambda words: [w[:-1] + "a" if gender == "f" and w else w for w in words]
    units = bend([{"primero": "primer", "tercero": "tercer"}.get(w, w) if short and gender == "m" else w for w in N.ORDINAL_UNITS])
    return f"CASE WHEN {n} BETWEEN 1 AND 99 THEN trim({_list(bend(N.ORDINAL_TENS))}[{n} // 10 + 1] || ' ' || {_list(units)}[{n} % 10 + 1]) END"


@query(f"SELECT doc_id, {_ordinal_sql('n', 'm', False)} AS plain, {_ordinal_sql('n', 'f', False)} AS feminine, {_ordinal_sql('n', 'm', True)} AS short FROM (SELECT doc_id, doc_id % 120 AS n FROM documents)")
def ordinal_words(t):
    """NUM17: ordinals from 1 to 99 in words; null outside."""
    n = F.col("doc_id") % 120
    return t("documents").select("doc_id", N.ordinal(n).alias("plain"), N.ordinal(n, "f").alias("feminine"), N.ordinal(n, short=True).alias("short"))


#: Words made of Roman digits, canonical and not.
_ROMAN = "regexp_replace(regexp_replace(regexp_replace(CAST(event_id % 4100 AS VARCHAR), '[0-3]', 'I', 'g'), '[4-6]', 'X', 'g'), '[789]', 'V', 'g')"


def _roman_sql(x: str) -> str:
    pattern = "^(M{0,3})(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
    digit = lambda k: f"(list_position({_list(N.ROMAN[k])}, regexp_extract(upper({x}), '{pattern}', {4 - k})) - 1)"
    return f"CASE WHEN {x} <> '' AND regexp_matches(upper({x}), '{pattern}') THEN CAST(length(regexp_extract(upper({x}), '{pattern}', 1)) * 1000 + {digit(2)} * 100 + {digit(1)} * 10 + {digit(0)} AS INTEGER) END"


@query(f"SELECT event_id, numeral, {_roman_sql('numeral')} AS value FROM (SELECT event_id, {_ROMAN} AS numeral FROM events)")
def roman_values(t):
    """NUM21: canonical Roman numerals as integers, all others null."""
    text = F.col("event_id") % 4100
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text.cast("string"), "[0-3]", "I"), "[4-6]", "X"), "[789]", "V")
    return t("events").select("event_id", text.alias("numeral")).withColumn("value", N.roman_value(F.col("numeral")))


_WRITTEN = "CASE CAST(l_partkey % 4 AS INT) WHEN 0 THEN (1 + l_suppkey) || '.' || (100 + l_partkey % 900) || ',' || (l_partkey % 10) || '0' WHEN 1 THEN '00' || l_partkey || ',500' WHEN 2 THEN l_suppkey || ' ' || (100 + l_partkey % 900) ELSE l_partkey || '.' || l_suppkey END"


@query(
    rf"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, written, CASE WHEN regexp_matches(written, '^([0-9]{{1,3}}([. ][0-9]{{3}})+|[0-9]+)(,[0-9]+)?$') THEN
  coalesce(nullif(regexp_replace(split_part(regexp_replace(written, '[. ]', '', 'g'), ',', 1), '^0+', ''), ''), '0') || coalesce('.' || nullif(regexp_replace(split_part(written, ',', 2), '0+$', ''), ''), '') END AS value
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_WRITTEN} AS written FROM lineitem)
"""
)
def written_numbers(t):
    """NUM30, NUM18: written numbers with grouping dots or spaces and a decimal comma as plain decimals; what is none is null."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(_WRITTEN).alias("written"))
    return rows.withColumn("value", N.written_number(F.col("written")))


@query(r"SELECT doc_id, pos, trim(regexp_replace(strip_accents(lower(line)), '[^\p{L}\p{N}_]+', ' ', 'g')) AS key FROM (SELECT doc_id, unnest(l) AS line, CAST(unnest(range(len(l))) AS INTEGER) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE lang IN ('es', 'fr') AND text IS NOT NULL))")
def match_keys(t):
    """STR07-09: keys of lines for which marks, case and punctuation do not count."""
    lines = t("documents").filter("lang in ('es', 'fr') and text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("doc_id", "pos", N.match_key(F.col("line")).alias("key"))


_F = r"(a|as|ción|ciones|sión|siones|dad|dades|tud|tudes|umbre|umbres)$"
_M = "('problema', 'sistema', 'tema', 'programa', 'clima', 'idioma', 'mapa', 'planeta', 'poeta', 'artista', 'día')"


@query(rf"SELECT word, CASE WHEN regexp_replace(word, 's$', '') IN {_M} AND regexp_matches(regexp_replace(word, 's$', ''), '(ma|pa|ta)$') THEN 'm' WHEN regexp_matches(word, '{_F}') THEN 'f' ELSE 'm' END AS gender FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS word FROM documents WHERE lang = 'es')")
def noun_genders(t):
    """NUM19: gender of the Spanish vocabulary by endings."""
    from quirework.functions import text as T

    return t("documents").filter("lang = 'es'").select(F.explode(T.words(F.col("text"))).alias("word")).distinct().select("word", N.gender_of(F.col("word")).alias("gender"))
