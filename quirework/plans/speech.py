"""Spoken forms of single values, and the verdict on a recording, as column expressions with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.functions import numbers as N
from quirework.functions import text as T
from quirework.plans.numerals import _cardinal_sql, _list, _ordinal_sql, _roman_sql
from quirework.plans.registry import query

_TIME = "lpad('' || (event_id % 26), 2, '0') || ':' || lpad('' || (event_id * 7 % 63), 2, '0')"


@query(
    f"""
WITH x AS (SELECT event_id, {_TIME} AS written, CAST(event_id % 26 AS BIGINT) AS h, CAST(event_id * 7 % 63 AS BIGINT) AS m, event_id % 2 = 0 AS said FROM events),
y AS (SELECT *, CASE WHEN h = 1 THEN 'una' WHEN h = 21 THEN {_cardinal_sql('h', 'f')} ELSE {_cardinal_sql('h', 'n')} END AS hw, {_cardinal_sql('m', 'n')} AS mw FROM x)
SELECT event_id, written, CASE WHEN h <= 23 AND m <= 59 THEN hw || CASE WHEN h <= 12 AND m = 0 THEN ' en punto' WHEN h <= 12 AND m = 15 THEN ' y cuarto' WHEN h <= 12 AND m = 30 THEN ' y media' WHEN h <= 12 THEN ' y ' || mw WHEN m = 0 THEN ' horas' WHEN m < 10 THEN ' cero ' || mw ELSE ' ' || mw END || CASE WHEN said AND NOT (h > 12 AND m = 0) THEN ' horas' ELSE '' END END AS spoken FROM y
"""
)
def spoken_times(t):
    """NUM03, NUM04: clock times in words, on the twelve-hour dial with quarter and half, after it as hours and minutes; impossible ones are left."""
    h, m, said = F.col("event_id") % 26, F.col("event_id") * 7 % 63, F.col("event_id") % 2 == 0
    hours = F.when(h == 1, "una").when(h == 21, N.cardinal(h, "f")).otherwise(N.cardinal(h))
    minutes = N.cardinal(m)
    tail = (
        F.when((h <= 12) & (m == 0), " en punto").when((h <= 12) & (m == 15), " y cuarto").when((h <= 12) & (m == 30), " y media").when(h <= 12, F.concat(F.lit(" y "), minutes))
        .when(m == 0, " horas").when(m < 10, F.concat(F.lit(" cero "), minutes)).otherwise(F.concat(F.lit(" "), minutes))
    )
    spoken = F.concat(hours, tail, F.when(said & ~((h > 12) & (m == 0)), " horas").otherwise(""))
    return t("events").select("event_id", F.expr(_TIME).alias("written"), F.when((h <= 23) & (m <= 59), spoken).alias("spoken"))


_DATE = "lpad('' || (o_orderkey % 33), 2, '0') || '/' || lpad('' || (o_custkey % 14), 2, '0') || '/' || (1900 + o_orderkey % 200)"


@query(
    f"""
WITH x AS (SELECT o_orderkey, {_DATE} AS written, CAST(o_orderkey % 33 AS BIGINT) AS d, CAST(o_custkey % 14 AS BIGINT) AS m, CAST(1900 + o_orderkey % 200 AS BIGINT) AS y FROM orders),
v AS (SELECT *, try_cast(y || '-' || lpad('' || m, 2, '0') || '-' || lpad('' || d, 2, '0') AS DATE) IS NOT NULL AS valid FROM x)
SELECT o_orderkey, written, valid, CASE WHEN valid THEN {_cardinal_sql('d', 'n')} || ' de ' || {_list(T.MONTHS)}[m] || ' de ' || {_cardinal_sql('y', 'n')} END AS spoken FROM v
"""
)
def spoken_dates(t):
    """NUM02: dates, day first, in words; one that does not exist is flagged and left."""
    d, m, y = F.col("o_orderkey") % 33, F.col("o_custkey") % 14, 1900 + F.col("o_orderkey") % 200
    valid = F.try_to_timestamp(F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), F.lit("yyyy-MM-dd")).isNotNull()
    spoken = F.concat_ws(" de ", N.cardinal(d), F.get(F.array(*map(F.lit, T.MONTHS)), (m - 1).cast("int")), N.cardinal(y))
    return t("orders").select("o_orderkey", F.expr(_DATE).alias("written"), valid.alias("valid"), F.when(valid, spoken).alias("spoken"))


# Signs with their names, one and many, and the gender.
NAMES = {"€": ("euro", "euros", "m"), "$": ("dólar", "dólares", "m"), "£": ("libra", "libras", "f"), "km": ("kilómetro", "kilómetros", "m"), "t": ("tonelada", "toneladas", "f")}
SIGNS = [*NAMES, "%", "‰"]


@query(
    f"WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 11 = 0 THEN CAST(1 AS BIGINT) WHEN l_partkey % 13 = 0 THEN CAST(l_suppkey % 9 * 1000000 AS BIGINT) ELSE CAST(l_partkey * 3 AS BIGINT) END AS n, {_list(SIGNS)}[CAST(l_suppkey % 7 + 1 AS INT)] AS sign FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n || ' ' || sign AS written, CASE sign "
    + " ".join(f"WHEN '{s}' THEN {_cardinal_sql('n', g)} || CASE WHEN n >= 1000000 AND n % 1000000 = 0 THEN ' de' ELSE '' END || ' ' || CASE WHEN n = 1 THEN '{one}' ELSE '{many}' END" for s, (one, many, g) in NAMES.items())
    + f" WHEN '%' THEN {_cardinal_sql('n', 'n')} || ' por ciento' ELSE {_cardinal_sql('n', 'n')} || ' por mil' END AS spoken FROM x"
)
def spoken_amounts(t):
    """NUM06, NUM07, NUM08: amounts of money, shares and measures in words that agree with the noun; round millions take "de"."""
    n = F.when(F.col("l_partkey") % 11 == 0, 1).when(F.col("l_partkey") % 13 == 0, F.col("l_suppkey") % 9 * 1_000_000).otherwise(F.col("l_partkey") * 3).cast("bigint")
    x = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", n.alias("n"), F.get(F.array(*map(F.lit, SIGNS)), (F.col("l_suppkey") % 7).cast("int")).alias("sign"))
    n = F.col("n")
    of = F.when((n >= 1_000_000) & (n % 1_000_000 == 0), " de").otherwise("")
    plain = N.cardinal(n)
    spoken = F.when(F.col("sign") == "%", F.concat(plain, F.lit(" por ciento"))).when(F.col("sign") == "‰", F.concat(plain, F.lit(" por mil")))
    for sign, (one, many, gender) in NAMES.items():
        spoken = spoken.when(F.col("sign") == sign, F.concat(N.cardinal(n, gender), of, F.lit(" "), F.when(n == 1, one).otherwise(many)))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(" ", "n", "sign").alias("written"), spoken.alias("spoken"))


_MARK = "(doc_id % 130) || CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN '.º' WHEN 1 THEN '.ª' ELSE '.er' END"


@query(
    f"SELECT doc_id, {_MARK} AS written, CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN {_ordinal_sql('(doc_id % 130)', 'm', False)} WHEN 1 THEN {_ordinal_sql('(doc_id % 130)', 'f', False)} ELSE {_ordinal_sql('(doc_id % 130)', 'm', True)} END AS spoken, doc_id % 130 NOT BETWEEN 1 AND 99 AS flagged FROM documents"
)
def spoken_ordinals(t):
    """NUM05: ordinals with their mark in words, of its gender; numbers too high to read safely are flagged."""
    k, n = F.col("doc_id") % 3, F.col("doc_id") % 130
    spoken = F.when(k == 0, N.ordinal(n)).when(k == 1, N.ordinal(n, "f")).otherwise(N.ordinal(n, short=True))
    return t("documents").select("doc_id", F.expr(_MARK).alias("written"), spoken.alias("spoken"), (~n.between(1, 99)).alias("flagged"))


_CHAPTER = "CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'Capítulo ' WHEN 1 THEN 'Siglo ' ELSE 'Luis ' END || translate('' || (event_id % 30), '0123456789', 'XXIIIVVVVV')"
_ROMAN_WORD = "regexp_extract(written, ' ([IVXLCDM]+)$', 1)"


@query(
    rf"""
WITH x AS (SELECT event_id, {_CHAPTER} AS written FROM events), y AS (SELECT *, CAST({_roman_sql(_ROMAN_WORD)} AS BIGINT) AS n FROM x)
SELECT event_id, written, CASE WHEN n IS NOT NULL AND regexp_matches(written, '^(Capítulo|Siglo|Parte|Tomo) ') THEN regexp_extract(written, '^([^ ]+) ', 1) || ' ' || {_cardinal_sql('n', 'n')} ELSE written END AS spoken FROM y
"""
)
def structural_romans(t):
    """NUM10, NUM24: a Roman numeral after a structural word is read as a number; after any other word it stays."""
    x = t("events").select("event_id", F.expr(_CHAPTER).alias("written"))
    n = N.roman_value(F.regexp_extract("written", " ([IVXLCDM]+)$", 1)).cast("bigint")
    spoken = F.when(n.isNotNull() & F.col("written").rlike("^(Capítulo|Siglo|Parte|Tomo) "), F.concat(F.regexp_extract("written", "^([^ ]+) ", 1), F.lit(" "), N.cardinal(n))).otherwise(F.col("written"))
    return x.select("event_id", "written", spoken.alias("spoken"))


@query(
    f"""
WITH d AS (SELECT CAST(range AS BIGINT) AS value, {_cardinal_sql('CAST(range AS BIGINT)', 'n')} AS words FROM range(1000)), a AS (SELECT value, regexp_replace(regexp_replace(words, 'veintiuno$', 'veintiún'), 'uno$', 'un') AS words FROM d),
s AS (SELECT o_orderkey, CAST(o_orderkey * 37 % 1000000 AS BIGINT) AS n FROM orders), w AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'y ' ELSE '' END || {_cardinal_sql('n', 'n')} AS said FROM s),
p AS (SELECT *, CASE WHEN said = 'mil' OR starts_with(said, 'mil ') THEN '' WHEN contains(said, ' mil') THEN regexp_extract(said, '^(.*) mil( |$)', 1) END AS thousands, trim(CASE WHEN said = 'mil' OR starts_with(said, 'mil ') THEN substring(said, 4) WHEN contains(said, ' mil') THEN regexp_extract(said, ' mil(.*)$', 1) ELSE said END) AS rest FROM w)
SELECT p.o_orderkey AS o_orderkey, said, CASE WHEN thousands IS NOT NULL AND thousands <> '' AND a.value IS NULL OR rest <> '' AND d.value IS NULL THEN NULL ELSE CASE WHEN thousands IS NULL THEN 0 WHEN thousands = '' THEN 1000 ELSE a.value * 1000 END + CASE WHEN rest = '' THEN 0 ELSE d.value END END AS value
FROM p LEFT JOIN a ON a.words = p.thousands LEFT JOIN d ON d.words = p.rest
"""
)
def parsed_numbers(t):
    """NUM27, NUM29: number words back to the integer, by a join with the words of 0 to 999; what says no number is null."""
    d = t("orders").sparkSession.range(1000).select(F.col("id").alias("value")).withColumn("words", N.cardinal(F.col("value")))
    a = d.select(F.col("value").alias("k"), F.regexp_replace(F.regexp_replace("words", "veintiuno$", "veintiún"), "uno$", "un").alias("thousands"))
    said = F.concat(F.when(F.col("o_orderkey") % 10 == 0, "y ").otherwise(""), N.cardinal(F.col("o_orderkey") * 37 % 1_000_000))
    w = t("orders").select("o_orderkey", said.alias("said"))
    mil = (F.col("said") == "mil") | F.startswith("said", F.lit("mil "))
    some = F.contains("said", F.lit(" mil"))
    p = w.withColumns({
        "thousands": F.when(mil, "").when(some, F.regexp_extract("said", "^(.*) mil( |$)", 1)),
        "rest": F.trim(F.when(mil, F.expr("substring(said, 4)")).when(some, F.regexp_extract("said", " mil(.*)$", 1)).otherwise(F.col("said"))),
    })
    p = p.join(F.broadcast(a), "thousands", "left").join(F.broadcast(d.withColumnRenamed("words", "rest")), "rest", "left")  # a thousand rows each
    unknown = ((F.col("thousands") != "") & F.col("k").isNull()) | ((F.col("rest") != "") & F.col("value").isNull())
    value = F.when(F.col("thousands").isNull(), 0).when(F.col("thousands") == "", 1000).otherwise(F.col("k") * 1000) + F.when(F.col("rest") == "", 0).otherwise(F.col("value"))
    return p.select("o_orderkey", "said", F.when(F.coalesce(unknown, F.lit(False)), None).otherwise(value).cast("bigint").alias("value"))


# Clusters that Spanish does not write, and the letters' names.
CLUSTERS = [("sch", "ch"), ("tz", "ts"), ("sh", "ch"), ("ph", "f"), ("th", "t"), ("ck", "k"), ("oo", "u"), ("ee", "i"), ("w", "u"), ("k", "c")]
LETTERS = {"a": "a", "b": "be", "c": "ce", "d": "de", "e": "e", "f": "efe", "g": "ge", "h": "hache", "i": "i", "j": "jota", "k": "ka", "l": "ele", "m": "eme", "n": "ene", "ñ": "eñe", "o": "o", "p": "pe", "q": "cu", "r": "erre", "s": "ese", "t": "te", "u": "u", "v": "uve", "w": "uve doble", "x": "equis", "y": "i griega", "z": "zeta"}
PASSES = 4


def _respelled_sql(c: str) -> str:
    for _ in range(PASSES):
        for a, b in CLUSTERS:
            c = f"replace({c}, '{a}', '{b}')"
    return c


@query(
    r"SELECT word, "
    + _respelled_sql("word")
    + " AS respelled, array_to_string(list_transform(list_filter(string_split(strip_accents(word), ''), lambda x: x <> ''), lambda x: CASE x "
    + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LETTERS.items() if a != "ñ")
    + r" ELSE x END), ' ') AS spelled FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+')) AS word FROM documents WHERE lang IN ('en', 'de')) WHERE NOT regexp_matches(word, '[ßøæ]')"
)
def respelled_words(t):
    """STR26, STR31, STR35: foreign clusters rewritten, four passes of all rules in turn; words without marks, letter by letter by their names."""
    w = t("documents").filter("lang in ('en', 'de')").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-öø-ÿ]+)"), F.lit(1))).alias("word")).distinct().filter(~F.col("word").rlike("[ßøæ]"))
    out = F.col("word")
    for _ in range(PASSES):
        for a, b in CLUSTERS:
            out = F.replace(out, F.lit(a), F.lit(b))
    names = F.create_map(*[F.lit(x) for pair in LETTERS.items() if pair[0] != "ñ" for x in pair])
    spelled = F.array_join(F.transform(F.filter(F.split(N.folded(F.col("word")), ""), lambda x: x != ""), lambda x: F.coalesce(names[x], x)), " ")
    return w.select("word", out.alias("respelled"), spelled.alias("spelled"))


_LABEL = "CASE CAST(event_id % 5 AS INT) WHEN 0 THEN '' || (event_id % 500) WHEN 1 THEN ' xiv ' WHEN 2 THEN 'A-' || user_id WHEN 3 THEN 'XL' ELSE '12345678' END"


@query(
    rf"""
SELECT event_id, label, CASE WHEN regexp_matches(trim(label), '^[0-9]{{1,6}}$') THEN 'normal' WHEN regexp_matches(trim(label), '(?i)^[ivxlcdm]{{1,8}}$') THEN 'front' ELSE 'special' END AS kind,
       CASE WHEN regexp_matches(trim(label), '^[0-9]{{1,6}}$') THEN try_cast(trim(label) AS INTEGER) WHEN regexp_matches(trim(label), '(?i)^[ivxlcdm]{{1,8}}$') THEN {_roman_sql('trim(label)')} END AS value
FROM (SELECT event_id, {_LABEL} AS label FROM events)
"""
)
def page_kinds(t):
    """STR12: a page label is normal, front matter or special, and its value."""
    x = t("events").select("event_id", F.expr(_LABEL).alias("label")).withColumn("p", F.trim("label"))
    number, roman = F.col("p").rlike("^[0-9]{1,6}$"), F.col("p").rlike("(?i)^[ivxlcdm]{1,8}$")
    return x.select("event_id", "label", F.when(number, "normal").when(roman, "front").otherwise("special").alias("kind"), F.when(number, F.col("p").try_cast("int")).when(roman, N.roman_value(F.col("p"))).alias("value"))


_SIGNAL = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS seconds, l_discount * 40 AS lead_s, l_tax * 40 AS trail_s, CAST(l_partkey % 50 AS DOUBLE) / 10 AS inner_s, CAST(l_suppkey % 80 AS DOUBLE) - 70 AS rms, CAST(l_partkey % 1000 AS DOUBLE) / 20000 AS clipped, l_partkey % 23 = 0 AS corrupt, l_partkey % 600 AS characters FROM lineitem"


@query(
    f"""
WITH s AS (SELECT *, greatest(0.05, seconds - lead_s - trail_s) AS speech FROM ({_SIGNAL})), r AS (SELECT *, characters / speech AS rate FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN corrupt THEN 'failed' WHEN seconds < 0.2 THEN 'failed' WHEN reasons <> '' THEN 'needs_review' ELSE 'passed' END AS status, CASE WHEN corrupt THEN 'corrupt' WHEN seconds < 0.2 THEN 'short' ELSE reasons END AS reasons
FROM (SELECT *, concat_ws(',', CASE WHEN rms < -50 THEN 'silent' END, CASE WHEN lead_s > 2 THEN 'leading' END, CASE WHEN trail_s > 2 THEN 'trailing' END, CASE WHEN inner_s > 3 OR rms < -50 AND seconds > 3 THEN 'silence' END, CASE WHEN clipped > 0.02 THEN 'clipping' END,
      CASE WHEN characters >= 25 AND rms >= -50 AND rate > 30 THEN 'fast' END, CASE WHEN characters >= 25 AND rms >= -50 AND rate < 4 THEN 'slow' END) AS reasons FROM r)
"""
)
def recording_verdicts(t):
    """CMP23, CMP38: a recording fails if it is corrupt or too short, and is looked at for silence, clipping, and a pace that does not fit its text."""
    c = F.col
    s = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c("l_quantity").alias("seconds"), (c("l_discount") * 40).alias("lead_s"), (c("l_tax") * 40).alias("trail_s"), ((c("l_partkey") % 50).cast("double") / 10).alias("inner_s"),
        ((c("l_suppkey") % 80).cast("double") - 70).alias("rms"), ((c("l_partkey") % 1000).cast("double") / 20000).alias("clipped"), (c("l_partkey") % 23 == 0).alias("corrupt"), (c("l_partkey") % 600).alias("characters"),
    )
    s = s.withColumn("rate", c("characters") / F.greatest(F.lit(0.05), c("seconds") - c("lead_s") - c("trail_s")))
    paced = (c("characters") >= 25) & (c("rms") >= -50)
    reasons = F.concat_ws(
        ",", F.when(c("rms") < -50, "silent"), F.when(c("lead_s") > 2, "leading"), F.when(c("trail_s") > 2, "trailing"), F.when((c("inner_s") > 3) | ((c("rms") < -50) & (c("seconds") > 3)), "silence"), F.when(c("clipped") > 0.02, "clipping"),
        F.when(paced & (c("rate") > 30), "fast"), F.when(paced & (c("rate") < 4), "slow"),
    )
    s = s.withColumn("reasons", reasons)
    return s.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(c("corrupt") | (c("seconds") < 0.2), "failed").when(c("reasons") != "", "needs_review").otherwise("passed").alias("status"), F.when(c("corrupt"), "corrupt").when(c("seconds") < 0.2, "short").otherwise(c("reasons")).alias("reasons"))


@query(
    """
WITH c AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS w FROM conversations WHERE role = 'user'), n AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS w FROM conversations WHERE role = 'assistant')
SELECT c.conv_id AS conv_id, c.turn AS turn, len(list_filter(list_distinct(c.w), lambda x: NOT list_contains(n.w, x))) = 0 AS explained, CAST(len(list_filter(list_distinct(c.w), lambda x: NOT list_contains(n.w, x))) AS INTEGER) AS unexplained FROM c JOIN n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1
"""
)
def explained_differences(t):
    """CMP15: whether all differing words stand in the normalised text."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿ]+)"), F.lit(1))
    c = t("conversations").filter("role = 'user'").select("conv_id", "turn", words.alias("w"))
    n = t("conversations").filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), words.alias("v"))
    left = F.array_except("w", "v")
    return c.join(n, ["conv_id", "turn"]).select("conv_id", "turn", (F.size(left) == 0).alias("explained"), F.size(left).alias("unexplained"))


_EVIDENCE = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS spoken_rank, round(1 - l_discount, 2) AS spoken_match, CAST(l_partkey % 3 AS INT) AS written_rank, round(1 - l_tax, 2) AS written_match, l_suppkey % 4 AS pieces, l_suppkey % 9 = 0 AS failed_audio, l_partkey % 7 = 0 AS in_changes, l_linenumber AS take FROM lineitem"


@query(
    f"""
WITH b AS (SELECT *, CASE WHEN written_rank < spoken_rank OR written_rank = spoken_rank AND written_match > spoken_match THEN 'written' ELSE 'spoken' END AS reference FROM ({_EVIDENCE})),
v AS (SELECT *, CASE reference WHEN 'written' THEN written_rank ELSE spoken_rank END AS rank FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, reference, CASE rank WHEN 0 THEN 'verified' WHEN 1 THEN 'ambiguous' ELSE 'likely_error' END AS verdict,
       CASE WHEN failed_audio THEN 'audio' WHEN rank = 0 THEN 'none' WHEN in_changes THEN 'normalisation' ELSE 'reading' END AS origin,
       CASE WHEN failed_audio AND take <= 2 THEN 'retake' WHEN failed_audio THEN 'needs_human_review' WHEN rank = 0 THEN 'accept' WHEN rank = 1 THEN 'accept_flagged' WHEN in_changes THEN 'accept_flagged' WHEN take <= 2 THEN 'retake' ELSE 'needs_human_review' END AS action
FROM v
"""
)
def diagnoses(t):
    """CMP09, CMP11, CMP12: the better of two references by verdict, then by match; and the decision: where the fault lies and what to do."""
    c = F.col
    s = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(c("l_returnflag") == "N", 0).when(c("l_returnflag") == "A", 1).otherwise(2).alias("spoken_rank"), F.round(1 - c("l_discount"), 2).alias("spoken_match"),
        (c("l_partkey") % 3).cast("int").alias("written_rank"), F.round(1 - c("l_tax"), 2).alias("written_match"), (c("l_suppkey") % 9 == 0).alias("failed"), (c("l_partkey") % 7 == 0).alias("in_changes"), c("l_linenumber").alias("take"),
    )
    spoken, written = F.struct(c("spoken_rank").alias("rank"), (-c("spoken_match")).alias("m"), F.lit("spoken").alias("reference")), F.struct(c("written_rank").alias("rank"), (-c("written_match")).alias("m"), F.lit("written").alias("reference"))
    s = s.withColumn("best", F.least(spoken, written)).withColumn("rank", c("best.rank"))
    verdict = F.when(c("rank") == 0, "verified").when(c("rank") == 1, "ambiguous").otherwise("likely_error")
    origin = F.when(c("failed"), "audio").when(c("rank") == 0, "none").when(c("in_changes"), "normalisation").otherwise("reading")
    action = (
        F.when(c("failed") & (c("take") <= 2), "retake").when(c("failed"), "needs_human_review").when(c("rank") == 0, "accept").when((c("rank") == 1) | c("in_changes"), "accept_flagged")
        .when(c("take") <= 2, "retake").otherwise("needs_human_review")
    )
    return s.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c("best.reference").alias("reference"), verdict.alias("verdict"), origin.alias("origin"), action.alias("action"))


# ---------------------------------------------------------------- whole texts: changes, flags, phrases

_SENTENCE = "'El ' || event_id || ' y ' || (user_id * 1001) || ' & ' || (event_id % 7) || ' son + de ' || coalesce(props, '')"


def _words_sql(body: str) -> str:
    return f"array_to_string(list_transform(string_split({body}, ' '), lambda w: CASE WHEN regexp_matches(w, '^[0-9]{{1,9}}$') THEN {_cardinal_sql('CAST(w AS BIGINT)', 'n')} ELSE w END), ' ')"


@query(f"SELECT event_id, {_words_sql('written')} AS spoken FROM (SELECT event_id, {_SENTENCE} AS written FROM events)")
def numbers_in_text(t):
    """NUM09, NUM23: the whole numbers of a text in words, all else as it was."""
    word = lambda w: F.when(w.rlike("^[0-9]{1,9}$"), N.cardinal(w.try_cast("bigint"))).otherwise(w)
    return t("events").select("event_id", F.expr(_SENTENCE).alias("written")).select("event_id", F.array_join(F.transform(F.split("written", " "), word), " ").alias("spoken"))


# Signs that are read.
SIGNS_READ = [("&", "y"), ("+", "más"), ("=", "igual a"), ("×", "por"), ("§", "párrafo")]


def _signs_sql(c: str) -> str:
    for sign, word in SIGNS_READ:
        c = f"replace({c}, ' {sign} ', ' {word} ')"
    return c


@query(f"SELECT event_id, {_signs_sql('written')} AS spoken, CAST(len(regexp_extract_all(written, ' [&+=×§] ')) AS INTEGER) AS changes FROM (SELECT event_id, {_SENTENCE} AS written FROM events)")
def symbols_in_text(t):
    """NUM13: signs between spaces are read by their name."""
    out = F.col("written")
    for sign, word in SIGNS_READ:
        out = F.replace(out, F.lit(f" {sign} "), F.lit(f" {word} "))
    return t("events").select("event_id", F.expr(_SENTENCE).alias("written")).select("event_id", out.alias("spoken"), F.regexp_count("written", F.lit(" [&+=×§] ")).alias("changes"))


@query(
    r"""
WITH c AS (SELECT conv_id, turn, text, CAST(length(text) // 3 AS BIGINT) AS a, CAST(2 * length(text) // 3 AS BIGINT) AS b FROM conversations)
SELECT conv_id, turn, md5(substring(text, 1, a) || '[uno]' || substring(text, a + 4, b - a - 3) || '[dos]' || substring(text, b + 3)) AS rendered_md5 FROM c WHERE length(text) > 30
"""
)
def spliced_changes(t):
    """NUM20, ARR07: changes with their spans put into a text in order, one fold over the sorted spans."""
    n = F.length("text")
    a, b = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
    change = lambda start, width, new: F.struct(start.alias("begin"), (start + width).alias("end"), F.lit(new).alias("new"))
    c = t("conversations").filter(F.length("text") > 30).select("conv_id", "turn", "text", F.array_sort(F.array(change(b, 2, "[dos]"), change(a, 3, "[uno]"))).alias("changes"))
    text = F.col("text")

    def step(s, x):
        return F.struct(F.concat(s["out"], F.substr(text, s["at"] + 1, x["begin"] - s["at"]), x["new"]).alias("out"), x["end"].alias("at"))

    done = F.aggregate("changes", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))
    return c.select("conv_id", "turn", F.md5(done.cast("binary")).alias("rendered_md5"))


@query(
    r"""
WITH d AS (SELECT doc_id, text || ' ISO ' || upper(source) || ' XIV http://x' || doc_id || '.es/a' AS text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals FROM d)
SELECT doc_id, CASE WHEN letters >= 6 AND capitals > 0.8 * letters THEN '' ELSE array_to_string(list_filter(regexp_extract_all(text, '(?:^|[^A-Za-zÀ-ÿ0-9])([A-Z]{2,6})(?:$|[^A-Za-zÀ-ÿ0-9])', 1), lambda x: NOT regexp_matches(x, '^(M{0,3})(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$')), ' ') END AS acronyms, array_to_string(regexp_extract_all(text, 'https?://[a-z0-9./-]+'), ' ') AS urls FROM l
"""
)
def watch_list(t):
    """NUM15: acronyms (no Roman numerals, none in a text set in capitals) and addresses that are worth listening for."""
    d = t("documents").filter("text is not null").select("doc_id", F.concat("text", F.lit(" ISO "), F.upper("source"), F.lit(" XIV http://x"), "doc_id", F.lit(".es/a")).alias("text"))
    letters, capitals = F.length(F.regexp_replace("text", "[^A-Za-z]", "")), F.length(F.regexp_replace("text", "[^A-Z]", ""))
    found = F.filter(F.regexp_extract_all("text", F.lit("(?:^|[^A-Za-zÀ-ÿ0-9])([A-Z]{2,6})(?:$|[^A-Za-zÀ-ÿ0-9])"), F.lit(1)), lambda x: N.roman_value(x).isNull())
    shouting = (letters >= 6) & (capitals > F.lit(0.8) * letters)
    return d.select("doc_id", F.when(shouting, "").otherwise(F.array_join(found, " ")).alias("acronyms"), F.array_join(F.regexp_extract_all("text", F.lit("(https?://[a-z0-9./-]+)"), F.lit(1)), " ").alias("urls"))


@query(
    r"""
WITH c AS (SELECT conv_id, turn, unnest(p) AS phrase, unnest(range(len(p))) AS k FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^.?!…\n]{0,179}[.?!…\n]|[^.?!…\n]{180}|[^.?!…\n]+$') AS p FROM conversations)),
o AS (SELECT *, coalesce(sum(length(phrase)) OVER (PARTITION BY conv_id, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c)
SELECT conv_id, turn, CAST(start AS BIGINT) AS text_start, CAST(start + length(phrase) AS BIGINT) AS text_end, CAST(start * 50 AS BIGINT) AS start_ms, CAST((start + length(phrase)) * 50 AS BIGINT) AS end_ms FROM o WHERE trim(phrase, ' ' || chr(10)) <> ''
"""
)
def timed_phrases(t):
    """SEG11: text with a time for each character falls into phrases at marks and line ends, or after 180 characters."""
    pieces = F.regexp_extract_all("text", F.lit("([^.?!…\n]{0,179}[.?!…\n]|[^.?!…\n]{180}|[^.?!…\n]+$)"), F.lit(1))
    c = t("conversations").select("conv_id", "turn", F.posexplode(pieces).alias("k", "phrase"))
    from quirework.operators import ordered as O

    o = O.running(c, ["conv_id", "turn"], ["k"], F.length("phrase"), "start", inclusive=False).withColumn("stop", F.col("start") + F.length("phrase"))
    o = o.filter(F.trim("phrase", F.lit(" \n")) != "")
    big = lambda c, name: c.cast("bigint").alias(name)
    return o.select("conv_id", "turn", big(F.col("start"), "text_start"), big(F.col("stop"), "text_end"), big(F.col("start") * 50, "start_ms"), big(F.col("stop") * 50, "end_ms"))


@query(
    f"""
WITH u AS (SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, line, CASE WHEN turn % 2 = 0 THEN line || ' ' || (turn * 21 + 1) ELSE line END AS written FROM (SELECT conv_id, turn, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations)) WHERE trim(line) <> ''),
s AS (SELECT *, {_words_sql('written')} AS spoken FROM u)
SELECT conv_id, turn, pos, left(sha256(concat_ws(':', conv_id, turn, pos, 'paragraph', written)), 24) AS unit_id, md5(spoken) AS spoken_md5, spoken <> written AS changed, CASE WHEN regexp_matches(written, '[0-9]') THEN 'number' ELSE '' END AS flags, 'turn ' || turn AS provenance FROM s
"""
)
def narration_units(t):
    """SEG12: chapters as units with their id, what is spoken, whether it differs, flags and provenance."""
    u = t("conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).filter(F.trim("line") != "")
    u = u.withColumn("written", F.when(F.col("turn") % 2 == 0, F.concat_ws(" ", "line", F.col("turn") * 21 + 1)).otherwise(F.col("line")))
    word = lambda w: F.when(w.rlike("^[0-9]{1,9}$"), N.cardinal(w.try_cast("bigint"))).otherwise(w)
    u = u.withColumn("spoken", F.array_join(F.transform(F.split("written", " "), word), " "))
    return u.select(
        "conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), T.unit_id(F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("pos").cast("string"), F.lit("paragraph"), F.col("written")).alias("unit_id"),
        F.md5(F.col("spoken").cast("binary")).alias("spoken_md5"), (F.col("spoken") != F.col("written")).alias("changed"), F.when(F.col("written").rlike("[0-9]"), "number").otherwise("").alias("flags"), F.concat(F.lit("turn "), "turn").alias("provenance"),
    )


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-zà-öø-ÿ0-9]+')) AS INTEGER) AS words, md5(array_to_string(regexp_extract_all(lower(text), '[a-zà-öø-ÿ0-9]+'), ' ')) AS words_md5 FROM documents WHERE text IS NOT NULL")
def word_lists(t):
    """STR02: the word list of a text, in lower case."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-öø-ÿ0-9]+)"), F.lit(1))
    return t("documents").filter("text is not null").select("doc_id", F.size(w).alias("words"), F.md5(F.array_join(w, " ").cast("binary")).alias("words_md5"))


@query(
    """
SELECT conv_id, '{' || string_agg('"' || turn || '":"' || CASE WHEN turn % 3 = 1 THEN '' ELSE role || length(text) END || '"', ',' ORDER BY turn) || '}' AS edits, CAST(count(*) FILTER (turn % 3 = 1) AS BIGINT) AS deleted FROM conversations GROUP BY conv_id
"""
)
def edit_maps(t):
    """ARR06, SRC40: the edits of a draft as a map from slot to text, empty for a deleted one, read back from its JSON."""
    pairs = F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 3 == 1, "").otherwise(F.concat("role", F.length("text"))).alias("text"))))
    edits = F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["turn"].cast("string"), x["text"])))
    rows = t("conversations").groupBy("conv_id").agg(F.to_json(edits).alias("edits"))
    back = F.from_json("edits", "map<string,string>")
    return rows.select("conv_id", "edits", F.size(F.filter(F.map_values(back), lambda x: x == "")).cast("bigint").alias("deleted"))
