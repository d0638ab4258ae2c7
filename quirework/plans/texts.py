"""Text rules, templates, validation of semi-structured records, and small lookups, as column expressions with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import markup as M
from quirework.operators import ordered as O
from quirework.plans.registry import n, query

# ---------------------------------------------------------------- clean-up and marks


#: Texts with the faults that the rules look for, put in by number.
_DIRTY = "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN replace(text, ', ', '-' || chr(10)) WHEN 1 THEN replace(text, '. ', ' [Ilustración: x' || doc_id || '] _') || '_' WHEN 2 THEN replace(text, ' ', '  ') || chr(10) ELSE text END"


@query(rf"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(dirty, '([a-z])-[ \t]*\n[ \t]*([a-z])', '\1\2', 'g'), '[ \t\n\r\f]+', ' ', 'g'))) AS joined_md5 FROM (SELECT doc_id, {_DIRTY} AS dirty FROM documents WHERE text IS NOT NULL)")
def rejoined_lines(t):
    """STR03, SEG08, STR15: hyphens at line ends go before a lower-case letter, other line ends are spaces; runs of white space are one space."""
    d = t("documents").filter("text is not null").select("doc_id", F.expr(_DIRTY.replace("chr(10)", "'\\n'")).alias("dirty"))
    return d.select("doc_id", F.md5(T.squeezed(F.regexp_replace("dirty", r"([a-z])-[ \t]*\n[ \t]*([a-z])", "$1$2")).cast("binary")).alias("joined_md5"))


@query(
    rf"""
SELECT doc_id, CAST(len(regexp_extract_all(dirty, '\[Ilustración[^\]]*\]')) AS INTEGER) AS dropped, regexp_extract(dirty, '\[Ilustración[^\]]*\]') AS first_drop, md5(regexp_replace(regexp_replace(dirty, '\[Ilustración[^\]]*\]', '', 'g'), '_([^_]*)_', '\1', 'g')) AS kept_md5
FROM (SELECT doc_id, {_DIRTY} AS dirty FROM documents WHERE text IS NOT NULL)
"""
)
def transcriber_marks(t):
    """STR17, ARR04: marks of the transcriber go, underscores around words go; what was dropped is kept as a record."""
    d = t("documents").filter("text is not null").select("doc_id", F.expr(_DIRTY.replace("chr(10)", "'\\n'")).alias("dirty"))
    marks = r"\[Ilustración[^\]]*\]"
    kept = F.regexp_replace(F.regexp_replace("dirty", marks, ""), "_([^_]*)_", "$1")
    return d.select("doc_id", F.regexp_count("dirty", F.lit(marks)).alias("dropped"), F.regexp_extract("dirty", marks, 0).alias("first_drop"), F.md5(kept.cast("binary")).alias("kept_md5"))


def _blocks_sql() -> str:
    some = lambda names: ", ".join(f"'{n}'" for n in names)
    tag, unread = (p.replace("'", "''") for p in (M.TAG, M.UNREAD))
    text = "text"
    for name, char in M.ENTITIES.items():
        text = "replace({}, '&{};', '{}')".format(text, name, char.replace("'", "''"))
    return rf"""
WITH c AS (SELECT page_id, regexp_replace(html, '{unread}', '', 'g') AS h FROM pages WHERE html IS NOT NULL),
r AS (SELECT page_id, unnest(range(len(string_split_regex(h, '{tag}')))) AS pos, unnest(string_split_regex(h, '{tag}')) AS piece, unnest(list_concat(regexp_extract_all(h, '{tag}'), [NULL])) AS written FROM c),
n AS (SELECT *, coalesce(lower(regexp_extract(written, '^</?([a-zA-Z0-9:-]+)', 1)), '') AS name, coalesce(starts_with(written, '</'), false) AS closes, coalesce(ends_with(written, '/>'), false) AS whole FROM r),
k AS (SELECT *, name IN ({some(M.BLOCKS)}) AND NOT whole AS is_block FROM n),
s AS (SELECT *, sum(CAST(is_block AS INTEGER)) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after FROM k),
x AS (SELECT page_id, after - CAST(is_block AS INTEGER) AS block, string_agg(piece || CASE WHEN name = 'br' THEN ' ' ELSE '' END, '' ORDER BY pos) AS text, count(*) FILTER (NOT is_block AND name = 'a' AND regexp_matches(written, '(?i)\shref\s*=')) AS links FROM s GROUP BY 1, 2),
e AS (SELECT page_id, after AS block, name, closes, lag(name) OVER w AS ln, coalesce(NOT lag(closes) OVER w, false) AS opened FROM s WHERE is_block WINDOW w AS (PARTITION BY page_id ORDER BY after)),
d AS (SELECT *, CASE WHEN closes AND name = 'p' AND NOT coalesce(opened AND ln = 'p', false) THEN 0 WHEN closes THEN -1 ELSE 1 END
  - CASE WHEN opened AND (ln = 'p' AND NOT (name = 'p' AND closes) OR NOT closes AND ln = name AND name IN ({some(M.ENDS_ITS_KIND)})) THEN 1 ELSE 0 END AS step,
  CASE WHEN name NOT IN ({some(M.LEFT_OUT)}) THEN 0 WHEN closes THEN -1 ELSE 1 END AS o FROM e),
f AS (SELECT *, sum(step) OVER w AS depth, sum(o) OVER w AS outside FROM d WINDOW w AS (PARTITION BY page_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT page_id, block, depth, outside, last_value(CASE WHEN NOT closes THEN name END IGNORE NULLS) OVER (PARTITION BY page_id, depth ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tag FROM f),
y AS (SELECT page_id, block, tag, depth, links, trim(regexp_replace({text}, '[ \t\n\r\f]+', ' ', 'g')) AS text FROM x JOIN g USING (page_id, block) WHERE outside = 0)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY block) - 1 AS BIGINT) AS ordinal, tag, CAST(depth AS INTEGER) AS depth, text, CAST(links AS INTEGER) AS links FROM y WHERE text <> ''
"""


@query(_blocks_sql())
def html_blocks(t):
    """SRC05, SRC06, SRC08, SRC22: the blocks of a page from its stream of tags: element, depth, text and links; scripts, styles, comments and navigation do not count."""
    return M.blocks(t("pages"), "page_id", "html")


@query(
    r"""
WITH s AS (SELECT conv_id, turn, unnest(p) AS sentence, unnest(range(len(p))) AS k FROM (SELECT conv_id, turn, string_split(regexp_replace(regexp_replace(text, '([.!?…]+[»"'')]*)([ \n]+)([^ \na-zß-öø-ÿ])', '\1\2' || chr(1) || '\3', 'g'), '(Sr|Sra|Dr|Dra|pág|núm)([.][ \n]+)' || chr(1), '\1\2', 'g'), chr(1)) AS p FROM conversations))
SELECT conv_id, turn, CAST(k AS INTEGER) AS position, CAST(start AS BIGINT) AS start_char, CAST(start + length(rtrim(sentence, ' ' || chr(10))) AS BIGINT) AS end_char FROM (SELECT *, coalesce(sum(length(sentence)) OVER (PARTITION BY conv_id, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s)
"""
)
def sentence_units(t):
    """SEG04, SEG05: sentences with exact offsets: a mark ends one where white space and no lower-case letter follow, and no abbreviation goes before."""
    cut = F.regexp_replace("text", "([.!?…]+[»\"')]*)([ \n]+)([^ \na-zß-öø-ÿ])", "$1$2\u0001$3")
    cut = F.regexp_replace(cut, "(Sr|Sra|Dr|Dra|pág|núm)([.][ \n]+)\u0001", "$1$2")
    s = t("conversations").select("conv_id", "turn", F.posexplode(F.split(cut, "\u0001", -1)).alias("position", "sentence"))
    s = O.running(s, ["conv_id", "turn"], ["position"], F.length("sentence"), "start_char", inclusive=False)
    return s.select("conv_id", "turn", "position", F.col("start_char").cast("bigint").alias("start_char"), (F.col("start_char") + F.length(F.rtrim("sentence", F.lit(" \n")))).cast("bigint").alias("end_char"))


@query(
    r"""
WITH c AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS pos FROM conversations),
b AS (SELECT *, regexp_matches(c, '[A-Za-zÀ-ÿ]') AS letter FROM c),
s AS (SELECT conv_id, turn, pos, c, count(*) FILTER (letter) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS before, count(*) FILTER (letter) OVER (PARTITION BY conv_id, turn) AS letters FROM b)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS BIGINT) AS mark, CASE WHEN c IN ('.', '!', '?', '…') THEN 'sentence' ELSE 'clause' END AS kind, round(before / nullif(letters, 0), 6) AS spoken FROM s WHERE c IN ('.', '!', '?', '…', ',', ';', ':')
"""
)
def pause_marks(t):
    """SEG14: punctuation marks with the share of letters spoken before each."""
    # of letters and marks alone, a mark's place less the marks before it is the number of letters before it
    kept = F.regexp_replace("text", "[^A-Za-zÀ-ÿ.!?…,;:]", "")
    c = t("conversations").select("conv_id", "turn", F.length(F.regexp_replace(kept, "[.!?…,;:]", "")).alias("letters"), F.split(kept, "").alias("chars"))
    marks = F.array_compact(F.transform("chars", lambda c, i: F.when(c.isin(".", "!", "?", "…", ",", ";", ":"), F.struct(i.alias("at"), c.alias("c")))))
    # outer: else the marks would be looked for twice, to drop texts without any before
    c = c.select("conv_id", "turn", "letters", F.posexplode_outer(marks).alias("pos", "m")).filter("pos is not null")
    kind = F.when(F.col("m.c").isin(".", "!", "?", "…"), "sentence").otherwise("clause")
    return c.select("conv_id", "turn", (F.col("pos") + 1).cast("bigint").alias("mark"), kind.alias("kind"), F.round((F.col("m.at") - F.col("pos")) / F.nullif("letters", F.lit(0)), 6).alias("spoken"))


@query(r"SELECT doc_id, CAST(k AS INTEGER) AS ordinal, number, before FROM (SELECT doc_id, unnest(range(len(m))) AS k, regexp_extract(unnest(m), '\(([0-9]+)\)$', 1) AS number, regexp_extract(unnest(m), '^(.*)\([0-9]+\)$', 1) AS before FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[,.] ', ' (' || (doc_id % 90) || ') ', 'g'), '[^()\n]{1,12}\([0-9]+\)') AS m FROM documents WHERE text IS NOT NULL))")
def note_references(t):
    """SRC12, SRC24: the note references of a text in order, each with the twelve characters before it."""
    marked = F.regexp_replace(F.col("text"), F.lit("[,.] "), F.concat(F.lit(" ("), F.col("doc_id") % 90, F.lit(") ")))
    d = t("documents").filter("text is not null").select("doc_id", F.posexplode(F.regexp_extract_all(marked, F.lit(r"([^()\n]{1,12}\([0-9]+\))"), F.lit(1))).alias("ordinal", "m"))
    return d.select("doc_id", "ordinal", F.regexp_extract("m", r"\(([0-9]+)\)$", 1).alias("number"), F.regexp_extract("m", r"^(.*)\([0-9]+\)$", 1).alias("before"))


# ---------------------------------------------------------------- words


_WORDS = r"(SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS word FROM documents)"


@query(
    rf"""
SELECT word, regexp_matches(word, '^[A-Z]{{2,6}}$') AS acronym, NOT regexp_matches(lower(word), '[kw]|sh|th|ck|oo|ee|[bcdfghjkmpqtvx]$') AND regexp_matches(lower(word), '[aeiouáéíóú]') AS spanish_shape, array_to_string(regexp_extract_all(upper(word), '[A-Z]'), ' ') AS spelled,
       CASE WHEN lower(word) IN ('the', 'and') THEN 'never' WHEN regexp_matches(word, '^[A-Z]{{2,6}}$') THEN 'always' WHEN regexp_matches(lower(word), 'sh|th|ck|oo|ee') THEN 'strong' WHEN regexp_matches(lower(word), '[kw]') THEN 'weak' ELSE 'none' END AS decision
FROM {_WORDS} WHERE NOT regexp_matches(word, '[ßÿ×÷]')
"""
)
def word_shapes(t):
    """STR30, STR32, STR34, STR37, STR38: acronyms, words of Spanish shape, spelling letter by letter, and the decision whether a foreign word is spelled."""
    w = t("documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-zÀ-ÿ]+)"), F.lit(1))).alias("word")).distinct().filter(~F.col("word").rlike("[ßÿ×÷]"))
    low = F.lower("word")
    acronym = F.col("word").rlike("^[A-Z]{2,6}$")
    shape = ~low.rlike("[kw]|sh|th|ck|oo|ee|[bcdfghjkmpqtvx]$") & low.rlike("[aeiouáéíóú]")
    decision = F.when(low.isin("the", "and"), "never").when(acronym, "always").when(low.rlike("sh|th|ck|oo|ee"), "strong").when(low.rlike("[kw]"), "weak").otherwise("none")
    return w.select("word", acronym.alias("acronym"), shape.alias("spanish_shape"), F.array_join(F.regexp_extract_all(F.upper("word"), F.lit("([A-Z])"), F.lit(1)), " ").alias("spelled"), decision.alias("decision"))


@query(
    r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS word FROM documents WHERE doc_id % 2 = 0), b AS (SELECT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS word FROM benchmark)
SELECT DISTINCT word FROM (SELECT word FROM w WHERE length(word) > 12 UNION SELECT word FROM b WHERE length(word) > 10)
"""
)
def doubtful_words(t):
    """AGG16, SET02: the set of doubted words of two sources."""
    words = lambda df: df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿ]+)"), F.lit(1))).alias("word"))
    a = words(t("documents").filter("doc_id % 2 = 0")).filter(F.length("word") > 12)
    return a.unionAll(words(t("benchmark")).filter(F.length("word") > 10)).distinct()


@query(r"SELECT item_id, regexp_replace(regexp_replace(text, '\bthe\b', 'de', 'g'), '\bof\b', 'ov', 'g') AS text FROM benchmark")
def lexicon_replaced(t):
    """STR39, STR40, SRT07: whole words replaced by the lexicon, longer keys first."""
    out = F.col("text")
    for word, said in sorted({"of": "ov", "the": "de"}.items(), key=lambda e: (-len(e[0]), e[0])):
        out = F.regexp_replace(out, rf"\b{word}\b", said)
    return t("benchmark").select("item_id", out.alias("text"))


_SOUND = "replace(replace(replace(replace(replace({}, 'ch', chr(1)), 'qu', 'k'), 'll', 'y'), 'v', 'b'), 'h', '')"


@query(
    rf"""
WITH p AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS a, regexp_extract_all(replace(replace(lower(text), 'v', 'b'), 'h', CASE WHEN item_id % 2 = 0 THEN '' ELSE 'x' END), '[a-z]+') AS b FROM benchmark)
SELECT item_id, len(a) = len(b) AND len(list_filter(list_zip(a, b), lambda p: {_SOUND.format('p[1]')} <> {_SOUND.format('p[2]')})) = 0 AS same_sound FROM p
"""
)
def same_sounds(t):
    """STR24: two texts sound alike if word for word their keys are equal."""
    sound = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("ch"), F.lit("\u0001")), F.lit("qu"), F.lit("k")), F.lit("ll"), F.lit("y")), F.lit("v"), F.lit("b")), F.lit("h"), F.lit(""))
    word = F.lit("([a-z]+)")
    other = F.replace(F.replace(F.lower("text"), F.lit("v"), F.lit("b")), F.lit("h"), F.when(F.col("item_id") % 2 == 0, "").otherwise("x"))
    p = t("benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), word, F.lit(1)).alias("a"), F.regexp_extract_all(other, word, F.lit(1)).alias("b"))
    alike = F.forall(F.zip_with("a", "b", lambda x, y: F.coalesce(sound(x) == sound(y), F.lit(False))), lambda x: x)
    return p.select("item_id", ((F.size("a") == F.size("b")) & alike).alias("same_sound"))


# ---------------------------------------------------------------- clocks, templates, log fields


_CLOCK = "CASE CAST(event_id % 6 AS INT) WHEN 0 THEN (event_id % 3) || ':' || lpad('' || (event_id % 70), 2, '0') || ':' || lpad('' || (event_id % 60), 2, '0') || '.5' WHEN 1 THEN lpad('' || (event_id % 75), 2, '0') || ':' || lpad('' || (event_id % 60), 2, '0') WHEN 2 THEN (event_id % 900) || 's' WHEN 3 THEN (event_id % 9000) || 'ms' WHEN 4 THEN (event_id % 90) || '.25min' ELSE 'npt' END"
_FULL, _PART, _COUNT = r"^([0-9]+):([0-5][0-9]):([0-5][0-9](\.[0-9]+)?)$", r"^([0-5][0-9]):([0-5][0-9](\.[0-9]+)?)$", r"^([0-9]+(\.[0-9]+)?)(h|min|ms|s)?$"


@query(
    rf"""
SELECT event_id, clock, CASE WHEN regexp_matches(clock, '{_FULL}') THEN try_cast(regexp_extract(clock, '{_FULL}', 1) AS DOUBLE) * 3600 + try_cast(regexp_extract(clock, '{_FULL}', 2) AS DOUBLE) * 60 + try_cast(regexp_extract(clock, '{_FULL}', 3) AS DOUBLE)
  WHEN regexp_matches(clock, '{_PART}') THEN try_cast(regexp_extract(clock, '{_PART}', 1) AS DOUBLE) * 60 + try_cast(regexp_extract(clock, '{_PART}', 2) AS DOUBLE)
  WHEN regexp_matches(clock, '{_COUNT}') THEN try_cast(regexp_extract(clock, '{_COUNT}', 1) AS DOUBLE) * CASE regexp_extract(clock, '{_COUNT}', 3) WHEN 'h' THEN 3600.0 WHEN 'min' THEN 60.0 WHEN 'ms' THEN 0.001 ELSE 1.0 END END AS seconds
FROM (SELECT event_id, {_CLOCK} AS clock FROM events)
"""
)
def clock_seconds(t):
    """STR42, STR43: full, partial and counted clock values in seconds; what is none is null."""
    e = t("events").select("event_id", F.expr(_CLOCK).alias("clock"))
    return e.withColumn("seconds", T.clock_seconds(F.col("clock")))


@query(
    """
SELECT o_orderkey, 'T' || o_orderkey || CASE WHEN o_custkey % 4 = 0 THEN '' ELSE ', De A' || o_custkey END AS title, replace(replace('{n} de {month}', '{n}', '' || (o_orderkey % 28 + 1)), '{month}', 'm' || month(o_orderdate)) AS day,
       (o_orderkey % 3) || CASE WHEN o_orderkey % 3 = 1 THEN ' parte' ELSE ' partes' END AS parts, left(regexp_replace('Libro ' || o_orderkey || ': /x?' || o_custkey, '[\\\\/:*?"<>|]+', '', 'g'), 80) AS download
FROM orders
"""
)
def templates(t):
    """STR44, STR45, STR46, STR14: title and author, filled templates, plurals, and a name without the characters that files may not have."""
    part = F.col("o_orderkey") % 3
    return t("orders").select(
        "o_orderkey", F.concat(F.lit("T"), "o_orderkey", F.when(F.col("o_custkey") % 4 == 0, "").otherwise(F.concat(F.lit(", De A"), "o_custkey"))).alias("title"),
        F.replace(F.replace(F.lit("{n} de {month}"), F.lit("{n}"), (F.col("o_orderkey") % 28 + 1).cast("string")), F.lit("{month}"), F.concat(F.lit("m"), F.month("o_orderdate"))).alias("day"),
        F.concat(part, F.when(part == 1, " parte").otherwise(" partes")).alias("parts"), F.left(F.regexp_replace(F.concat(F.lit("Libro "), "o_orderkey", F.lit(": /x?"), "o_custkey"), r'[\\/:*?"<>|]+', ""), F.lit(80)).alias("download"),
    )


@query("SELECT event_id, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN CASE WHEN value > 10 THEN 'yes' ELSE 'no' END WHEN 1 THEN '' || (event_id % 1000) || '.' || lpad('' || (user_id % 1000), 3, '0') ELSE left(coalesce(props, '{}'), 240) END AS field, event_type || ' ' || user_id || ' ' || event_id AS line FROM events")
def log_fields(t):
    """STR21, SNK19: values as a log shows them (yes or no, three decimals, JSON of 240 characters at most), beside the line for people."""
    field = (
        F.when(F.col("event_id") % 3 == 0, F.when(F.col("value") > 10, "yes").otherwise("no")).when(F.col("event_id") % 3 == 1, F.concat_ws(".", F.col("event_id") % 1000, F.lpad((F.col("user_id") % 1000).cast("string"), 3, "0")))
        .otherwise(F.left(F.coalesce("props", F.lit("{}")), F.lit(240)))
    )
    return t("events").select("event_id", field.alias("field"), F.concat_ws(" ", "event_type", "user_id", "event_id").alias("line"))


@query(
    r"""
SELECT page_id, CASE WHEN list_has_any(string_split_regex(lower(class), '[ _-]+'), ['box', 'boxed', 'recuadro']) THEN 'boxed' WHEN list_has_any(string_split_regex(lower(class), '[ _-]+'), ['shaded', 'sombreado']) THEN 'shaded' END AS by_class,
       CASE WHEN regexp_matches(style, '(^|;) *border *:') AND NOT regexp_matches(style, 'border *: *(none|0)') THEN 'boxed' WHEN regexp_matches(style, '(^|;) *background(-color)? *: *#[0-9a-f]+') THEN 'shaded' END AS by_style
FROM (SELECT page_id, CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'Text_Box' WHEN 1 THEN 'note shaded-1' WHEN 2 THEN 'boxer' ELSE '' END AS class, CASE CAST(page_id % 5 AS INT) WHEN 0 THEN 'border: 1px' WHEN 1 THEN 'color:red; border:none' WHEN 2 THEN 'background:#eee' ELSE 'margin:0' END AS style FROM pages)
"""
)
def frame_kinds(t):
    """STR18, STR19: boxed or shaded by the words of a class, or by the style itself."""
    p = t("pages").select(
        "page_id", F.expr("CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'Text_Box' WHEN 1 THEN 'note shaded-1' WHEN 2 THEN 'boxer' ELSE '' END").alias("class"),
        F.expr("CASE CAST(page_id % 5 AS INT) WHEN 0 THEN 'border: 1px' WHEN 1 THEN 'color:red; border:none' WHEN 2 THEN 'background:#eee' ELSE 'margin:0' END").alias("style"),
    )
    words = F.split(F.lower("class"), "[ _-]+")
    has = lambda *w: F.arrays_overlap(words, F.array(*map(F.lit, w)))
    style = F.col("style")
    return p.select(
        "page_id", F.when(has("box", "boxed", "recuadro"), "boxed").when(has("shaded", "sombreado"), "shaded").alias("by_class"),
        F.when(style.rlike("(^|;) *border *:") & ~style.rlike("border *: *(none|0)"), "boxed").when(style.rlike("(^|;) *background(-color)? *: *#[0-9a-f]+"), "shaded").alias("by_style"),
    )


# ---------------------------------------------------------------- records, edits, overlays


_RECORD = """CASE CAST(event_id % 6 AS INT) WHEN 0 THEN '{"k": ' || (event_id % 150) || ', "title": "t' || event_id || '", "extra": 1}' WHEN 1 THEN '{"k": "x", "title": ""}' WHEN 2 THEN '{"title": "only"}' WHEN 3 THEN '{broken' WHEN 4 THEN '{"k": ' || event_id || ', "title": " "}' ELSE props END"""


@query(
    f"""
SELECT event_id, CASE WHEN NOT json_valid(r) THEN 'unreadable' WHEN k IS NULL THEN 'no number' WHEN k NOT BETWEEN 0 AND 200 THEN 'out of range' WHEN title IS NULL THEN 'no title' WHEN trim(title) = '' THEN 'empty title' ELSE 'fine' END AS problem, CASE WHEN k BETWEEN 0 AND 200 THEN k ELSE 80 END AS value
FROM (SELECT event_id, r, CASE WHEN json_valid(r) THEN try_cast(json_extract_string(r, '$.k') AS BIGINT) END AS k, CASE WHEN json_valid(r) THEN json_extract_string(r, '$.title') END AS title FROM (SELECT event_id, {_RECORD} AS r FROM events))
"""
)
def record_checks(t):
    """SRC35, SRC41, PRJ21, ARR09: JSON records read by type and rule; unknown keys are ignored, a record that cannot be read gives the default."""
    r = t("events").select("event_id", F.expr(_RECORD).alias("r"))
    k, title = F.get_json_object("r", "$.k").try_cast("bigint"), F.get_json_object("r", "$.title")
    readable = F.try_parse_json("r").isNotNull()
    r = r.select("event_id", readable.alias("readable"), k.alias("k"), title.alias("title"))
    problem = (
        F.when(~F.col("readable"), "unreadable").when(F.col("k").isNull(), "no number").when(~F.col("k").between(0, 200), "out of range").when(F.col("title").isNull(), "no title")
        .when(F.trim("title") == "", "empty title").otherwise("fine")
    )
    return r.select("event_id", problem.alias("problem"), F.when(F.col("k").between(0, 200), F.col("k")).otherwise(80).alias("value"))


@query(
    """
WITH m AS (SELECT o_orderkey, o_orderpriority AS base, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN '  new ' || o_custkey WHEN 2 THEN o_orderpriority END AS asked, o_orderkey % 4 < 3 AS has_key FROM orders)
SELECT o_orderkey, CASE WHEN has_key THEN trim(coalesce(asked, '')) ELSE base END AS value, has_key AND trim(coalesce(asked, '')) = '' AS refused, CASE WHEN has_key AND trim(coalesce(asked, '')) <> base THEN 'submitted' ELSE 'book' END AS origin FROM m
"""
)
def metadata_overlay(t):
    """ARR10, JON20: a submitted key wins even when blank (a blank title is refused), else the book's own value stands."""
    o = t("orders")
    k = F.col("o_orderkey") % 4
    m = o.select("o_orderkey", F.col("o_orderpriority").alias("base"), F.when(k == 0, "").when(k == 1, F.concat(F.lit("  new "), "o_custkey")).when(k == 2, F.col("o_orderpriority")).alias("asked"), (k < 3).alias("has_key"))
    value = F.trim(F.coalesce("asked", F.lit("")))
    return m.select("o_orderkey", F.when(F.col("has_key"), value).otherwise(F.col("base")).alias("value"), (F.col("has_key") & (value == "")).alias("refused"), F.when(F.col("has_key") & (value != F.col("base")), "submitted").otherwise("book").alias("origin"))


@query(
    """
WITH e AS (SELECT event_id, user_id AS section, CAST(event_id % 12 AS BIGINT) AS paragraph FROM events WHERE event_type = 'click'), s AS (SELECT conv_id AS section, count(*) AS n FROM conversations GROUP BY 1)
SELECT event_id, CASE WHEN n IS NULL THEN 'unknown section' ELSE 'no such paragraph' END AS problem FROM e LEFT JOIN s ON s.section = e.section WHERE n IS NULL OR paragraph >= n
"""
)
def edit_references(t):
    """PRJ20: edits of sections or paragraphs that the book does not have."""
    e = t("events").filter("event_type = 'click'").select("event_id", F.col("user_id").alias("section"), (F.col("event_id") % 12).alias("paragraph"))
    s = t("conversations").groupBy(F.col("conv_id").alias("section")).agg(n().alias("n"))
    rows = e.join(s, "section", "left").filter(F.col("n").isNull() | (F.col("paragraph") >= F.col("n")))
    return rows.select("event_id", F.when(F.col("n").isNull(), "unknown section").otherwise("no such paragraph").alias("problem"))


@query(
    """
WITH f AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'signup' THEN 'ARCHIVO ' || (event_id % 7) ELSE event_type || ': ' || floor(value) END AS line FROM events),
m AS (SELECT *, last_value(CASE WHEN starts_with(line, 'ARCHIVO ') THEN CAST(substring(line, 9) AS INTEGER) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS file FROM f)
SELECT user_id, coalesce(file, 0) AS file, CAST(count(*) FILTER (key = 'view') AS BIGINT) AS views, max(CASE WHEN key = 'click' THEN word END) AS click, CAST(count(*) AS BIGINT) AS fields FROM (SELECT *, split_part(line, ': ', 1) AS key, split_part(line, ': ', 2) AS word FROM m WHERE NOT starts_with(line, 'ARCHIVO ')) GROUP BY user_id, coalesce(file, 0)
"""
)
def form_fields(t):
    """SRC34: the fields of a production sheet by file: a mark holds for the lines after it, up to the next one."""
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit("ARCHIVO "), F.col("event_id") % 7)).otherwise(F.concat("event_type", F.lit(": "), F.format_string("%.1f", F.floor("value").cast("double"))))
    f = t("events").select("user_id", "event_id", "ts", line.alias("line"))
    mark = F.when(F.startswith("line", F.lit("ARCHIVO ")), F.expr("substring(line, 9)").try_cast("int"))
    m = O.carried(f, ["user_id"], ["ts", "event_id"], mark, "file").filter(~F.startswith("line", F.lit("ARCHIVO ")))
    m = m.select("user_id", F.coalesce("file", F.lit(0)).alias("file"), F.split_part("line", F.lit(": "), F.lit(1)).alias("key"), F.split_part("line", F.lit(": "), F.lit(2)).alias("word"))
    return m.groupBy("user_id", "file").agg(F.count_if(F.col("key") == "view").alias("views"), F.max(F.when(F.col("key") == "click", F.col("word"))).alias("click"), n().alias("fields"))


# ---------------------------------------------------------------- provenance, storage, small views


@query(
    """
WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS key FROM documents), h AS (SELECT item_id, text FROM benchmark)
SELECT key, CAST(count(*) AS BIGINT) AS records, min(doc_id) AS first, max(doc_id) AS last FROM d GROUP BY key HAVING count(*) > 1
"""
)
def provenance_lists(t):
    """SRC43: texts that stand several times, with their records: how many, the first and the last."""
    d = t("documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"))
    return d.groupBy("key").agg(n().alias("records"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("records > 1")


@query(
    """
WITH e AS (SELECT p_partkey, p_name AS part, lower(p_type) AS kind FROM part), h AS (SELECT p_partkey AS id, lower(p_type) AS kind FROM part WHERE p_partkey % 9 = 0), x AS (SELECT kind, min(id) AS id FROM h GROUP BY kind),
w AS (SELECT e.p_partkey, min(h.id) AS id FROM (SELECT *, split_part(kind, ' ', 1) AS word FROM e) e JOIN (SELECT id, split_part(kind, ' ', 1) AS word FROM h) h ON h.word = e.word GROUP BY 1)
SELECT e.p_partkey AS entry, coalesce(x.id, w.id) AS source, x.id IS NOT NULL AS exact FROM e LEFT JOIN x ON x.kind = e.kind LEFT JOIN w ON w.p_partkey = e.p_partkey
"""
)
def index_sources(t):
    """JON25: an index entry takes the heading with its text, else the first one that begins with its word."""
    e = t("part").select(F.col("p_partkey").alias("entry"), F.lower("p_type").alias("kind")).withColumn("word", F.split_part("kind", F.lit(" "), F.lit(1)))
    h = e.filter("entry % 9 = 0")
    x = h.groupBy("kind").agg(F.min("entry").alias("same"))
    w = h.groupBy("word").agg(F.min("entry").alias("like"))
    return e.join(x, "kind", "left").join(w, "word", "left").select("entry", F.coalesce("same", "like").alias("source"), F.col("same").isNotNull().alias("exact"))


@query("SELECT source, CAST(count(*) AS BIGINT) AS entries, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes FROM documents GROUP BY source")
def cache_usage(t):
    """AGG23: entries and bytes of a cache."""
    return t("documents").groupBy("source").agg(n().alias("entries"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))


@query("SELECT doc_id, left(hex(encode(coalesce(text, ''))), 6) = '494433' OR left(hex(encode(coalesce(text, ''))), 4) = 'FFFB' AS mp3 FROM documents")
def audio_magic(t):
    """PRJ18: whether bytes begin as an MP3 does."""
    head = F.hex(F.coalesce("text", F.lit("")).cast("binary"))
    return t("documents").select("doc_id", (F.startswith(head, F.lit("494433")) | F.startswith(head, F.lit("FFFB"))).alias("mp3"))


@query("SELECT conv_id, turn, role IN ('assistant', 'system') OR (role = 'user' AND turn = 0) AS from_sheet, regexp_matches(text, '[0-9]') <> regexp_matches(substring(text, 2), '[0-9]') OR regexp_matches(text, '^[0-9]') AS value_differs FROM conversations")
def provenance_flags(t):
    """PRJ16, PRJ17: units that come from the production sheet by their role, and differences that touch a value."""
    number = lambda c: c.rlike("[0-9]")
    return t("conversations").select("conv_id", "turn", (F.col("role").isin("assistant", "system") | ((F.col("role") == "user") & (F.col("turn") == 0))).alias("from_sheet"), ((number(F.col("text")) != number(F.expr("substring(text, 2)"))) | F.col("text").rlike("^[0-9]")).alias("value_differs"))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the') ORDER BY doc_id LIMIT 60")
def first_hits(t):
    """UI04: the first sixty hits of a search."""
    return t("documents").filter(F.contains(F.lower("text"), F.lit("the"))).select("doc_id", "source").orderBy("doc_id").limit(60)


@query("SELECT conv_id, CAST(count(DISTINCT CASE WHEN role = 'assistant' THEN length(text) % 7 END) AS BIGINT) AS notes, CAST(sum(len(regexp_extract_all(text, chr(10)))) AS BIGINT) AS page_breaks FROM conversations GROUP BY conv_id")
def section_counters(t):
    """UI05, UI08: distinct notes and page breaks of a section."""
    return t("conversations").groupBy("conv_id").agg(F.count_distinct(F.when(F.col("role") == "assistant", F.length("text") % 7)).alias("notes"), F.sum(F.regexp_count("text", F.lit("\n"))).cast("bigint").alias("page_breaks"))


@query(
    """
SELECT event_id, array_to_string(list_transform(list_sort(list_filter(r, lambda x: x[1] < x[2] AND x[2] <= 100)), lambda x: x[1] || '-' || x[2]), ' ') AS ranges
FROM (SELECT event_id, [[event_id % 90, event_id % 90 + user_id % 30], [user_id, event_id % 100], [event_id % 50, event_id % 50]] AS r FROM events)
"""
)
def highlight_ranges(t):
    """UI13: ranges to highlight, empty and impossible ones dropped, in order."""
    pair = lambda a, b: F.array(a, b)
    i, u = F.col("event_id"), F.col("user_id")
    r = F.array(pair(i % 90, i % 90 + u % 30), pair(u, i % 100), pair(i % 50, i % 50))
    kept = F.array_sort(F.filter(r, lambda x: (x[0] < x[1]) & (x[1] <= 100)))
    return t("events").select("event_id", F.array_join(F.transform(kept, lambda x: F.concat_ws("-", x[0], x[1])), " ").alias("ranges"))


@query("SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_nationkey % 5 = 0 DESC, s_suppkey) AS BIGINT) AS place FROM supplier")
def voice_order(t):
    """UI15, SRT06: the catalogue of voices, Peninsular ones first, else as it was: a dimension, so one window is enough."""
    v = t("supplier").withColumn("all", F.lit(0))
    return O.numbered(v, ["all"], [(F.col("s_nationkey") % 5 == 0).desc(), "s_suppkey"], "place").select("s_suppkey", "place")


@query(
    r"""
SELECT doc_id, CASE WHEN regexp_matches(title, '^(indice|contenido|sumario)') THEN 'contents' WHEN regexp_matches(title, '^(isbn|copyright|deposito legal)') THEN 'imprint' WHEN regexp_matches(title, '^(bibliografia|notas|apendice)') THEN 'back matter' WHEN regexp_matches(title, '^(prologo|prefacio|dedicatoria)') THEN 'front matter' ELSE 'body' END AS category,
       NOT regexp_matches(title, '^(isbn|copyright|deposito legal|indice|contenido|sumario)') AS included
FROM (SELECT doc_id, trim(strip_accents(lower(CASE CAST(doc_id % 8 AS INT) WHEN 0 THEN 'Índice ' || doc_id WHEN 1 THEN 'PRÓLOGO' WHEN 2 THEN ' Copyright 20' || doc_id WHEN 3 THEN 'Bibliografía' ELSE coalesce(text, '') END))) AS title FROM documents)
"""
)
def section_plan(t):
    """PRJ01, PRJ03, PRJ04: sections classified by their title, and whether they are narrated."""
    from quirework.functions import numbers as N

    title = F.expr("CASE CAST(doc_id % 8 AS INT) WHEN 0 THEN 'Índice ' || doc_id WHEN 1 THEN 'PRÓLOGO' WHEN 2 THEN ' Copyright 20' || doc_id WHEN 3 THEN 'Bibliografía' ELSE coalesce(text, '') END")
    d = t("documents").select("doc_id", F.trim(N.folded(title)).alias("title"))
    begins = lambda p: F.col("title").rlike(f"^({p})")
    category = F.when(begins("indice|contenido|sumario"), "contents").when(begins("isbn|copyright|deposito legal"), "imprint").when(begins("bibliografia|notas|apendice"), "back matter").when(begins("prologo|prefacio|dedicatoria"), "front matter").otherwise("body")
    return d.select("doc_id", category.alias("category"), (~begins("isbn|copyright|deposito legal|indice|contenido|sumario")).alias("included"))
