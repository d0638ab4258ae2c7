"""Contents lists, page labels, photo inserts and the layout of scanned pages, as relations.

Stand-ins: lines of documents become rows of a contents list by their number, events of a user the pages of a book.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import numbers as N
from quirework.functions import text as T
from quirework.operators import ordered as O
from quirework.plans.numerals import _roman_sql
from quirework.plans.registry import n, query

_LINES = "SELECT doc_id, CAST(pos AS BIGINT) AS pos, regexp_replace(line, '[^A-Za-z ]', '', 'g') AS line FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
#: A row of a contents list: leaders, a wide gap, one space, or no page; pages run on, with some Roman and some that run backwards.
_ROW = (
    "CASE CAST((doc_id + pos) % 6 AS INT) WHEN 0 THEN line || 'x ..... ' || (pos * 3 + doc_id % 50) WHEN 1 THEN line || 'x     ' || (pos * 3 + doc_id % 50) WHEN 2 THEN line || 'x ' || (pos * 3 + doc_id % 40) "
    "WHEN 3 THEN line || 'x .... xiv' WHEN 4 THEN 'Capítulo ' || (pos + 1) ELSE line || 'x' END"
)


def _entries(t) -> DataFrame:
    lines = t("documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.regexp_replace("line", "[^A-Za-z ]", "").alias("line"))
    rows = lines.select("doc_id", "pos", F.expr(_ROW).alias("row"))
    label, page = T.contents_row(F.col("row"))
    # step by step: each step uses the one before several times, and would run its patterns as often
    rows = rows.select("doc_id", "pos", label.alias("label"), F.lower(page).alias("page"))
    digits = F.col("page").rlike("^[0-9]+$")
    rows = rows.withColumn("digits", digits).withColumn("roman", F.when(~F.col("digits"), N.roman_value(F.col("page"))))
    place = F.when(F.col("digits"), 100_000 + F.col("page").try_cast("int")).otherwise(F.col("roman"))
    return rows.select("doc_id", "pos", F.trim(F.regexp_replace("label", "[ .]+", " ")).alias("label"), "page", place.cast("bigint").alias("place"))


_LEADERS = r"^(.*?\S)\s*(?:\.{2,}|…+|\s{3,})[\s.…]*([0-9]{1,4}|[ivxlcdmIVXLCDM]+)\s*$"
_SINGLE = r"^(.*\S)\s([0-9]{1,4})\s*$"
_PARSED = rf"""
SELECT doc_id, pos, trim(regexp_replace(CASE WHEN lead THEN regexp_extract(row, '{_LEADERS}', 1) WHEN one THEN regexp_extract(row, '{_SINGLE}', 1) ELSE trim(row) END, '[ .]+', ' ', 'g')) AS label,
       lower(CASE WHEN lead THEN regexp_extract(row, '{_LEADERS}', 2) WHEN one THEN regexp_extract(row, '{_SINGLE}', 2) ELSE '' END) AS page
FROM (SELECT *, regexp_matches(row, '{_LEADERS}') AS lead, regexp_matches(row, '{_SINGLE}') AND NOT regexp_matches(lower(regexp_extract(row, '{_SINGLE}', 1)), '(cap[ií]tulo|parte|libro|secci[oó]n)$') AS one FROM (SELECT doc_id, pos, {_ROW} AS row FROM ({_LINES})))
"""
_PLACED = f"SELECT *, CASE WHEN regexp_matches(page, '^[0-9]+$') THEN 100000 + CAST(page AS BIGINT) ELSE CAST({_roman_sql('page')} AS BIGINT) END AS place FROM ({_PARSED})"


@query(f"SELECT doc_id, pos, label, page, place FROM ({_PLACED})")
def contents_rows(t):
    """STR10, STR11: label and page of each row of a contents list, and the order of its page: Roman front matter before Arabic pages."""
    return _entries(t)


@query(
    f"""
SELECT doc_id, pos, label, page FROM (SELECT *, last_value(place IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({_PLACED})) WHERE place < before
"""
)
def contents_backwards(t):
    """AGG17, WIN09: rows of the contents list whose page lies before the last one seen."""
    before = F.last("place", ignorenulls=True).over(O.before(["doc_id"], ["pos"]))
    return _entries(t).withColumn("before", before).filter("place < before").select("doc_id", "pos", "label", "page")


#: A turn's first sentence is its heading. An entry says the heading's words, begins or ends it, or says something else; every fifth heading has none.
_HEAD = "regexp_extract(text, '^([^.!?]*)', 1)"
_LABEL = f"CASE CAST(turn % 4 AS INT) WHEN 0 THEN {_HEAD} WHEN 1 THEN regexp_extract({_HEAD}, '^([^ ]+ [^ ]+)', 1) WHEN 2 THEN regexp_extract({_HEAD}, '([^ ]+ [^ ]+)$', 1) ELSE 'nada de esto' END"
_KEY = "trim(regexp_replace(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
_HEADS = f"SELECT conv_id AS book, CAST(turn AS BIGINT) AS pos, {_KEY.format(_HEAD)} AS key FROM conversations"
_LABELS = f"SELECT conv_id AS book, CAST(turn AS BIGINT) AS pos, {_KEY.format(_LABEL)} AS key FROM conversations WHERE turn % 5 <> 4"


@query(
    f"""
WITH RECURSIVE h AS ({_HEADS}), e AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY pos) AS k FROM ({_LABELS}) WHERE key <> ''),
c AS (SELECT e.book AS book, e.k AS k, e.pos AS entry, h.pos AS heading, h.key = e.key AS exact FROM e JOIN h ON h.book = e.book AND (h.key = e.key OR length(e.key) >= 5 AND (ends_with(h.key, ' ' || e.key) OR starts_with(h.key, e.key || ' ')))),
w AS (SELECT DISTINCT book, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS last, CAST(NULL AS BIGINT) AS entry, CAST(NULL AS BIGINT) AS heading FROM e
  UNION ALL
  SELECT w.book, e.k, coalesce(m.heading, w.last), e.pos, m.heading FROM w JOIN e ON e.book = w.book AND e.k = w.k + 1
  LEFT JOIN LATERAL (SELECT coalesce(min(c.heading) FILTER (c.exact), CASE WHEN count(*) FILTER (NOT c.exact) = 1 THEN min(c.heading) FILTER (NOT c.exact) END) AS heading FROM c WHERE c.book = w.book AND c.k = w.k + 1 AND c.heading > w.last) m ON true)
SELECT book, entry, heading FROM w WHERE heading IS NOT NULL
"""
)
def matched_sections(t):
    """JON09: entries meet headings in order: the same words, else the only one left that begins or ends with them; the cursor only moves on.

    Candidates are joined per book; the walk is one fold over a book's entries.
    """
    key = lambda c: N.match_key(c)
    c = t("conversations")
    h = c.select(F.col("conv_id").alias("book"), F.col("turn").cast("bigint").alias("heading"), key(F.expr(_HEAD)).alias("h_key"))
    label = F.expr(_LABEL)
    e = c.filter("turn % 5 <> 4").select(F.col("conv_id").alias("book"), F.col("turn").cast("bigint").alias("entry"), key(label).alias("e_key")).filter("e_key <> ''")
    exact = F.col("h_key") == F.col("e_key")
    part = (F.length("e_key") >= 5) & (F.endswith("h_key", F.concat(F.lit(" "), "e_key")) | F.startswith("h_key", F.concat("e_key", F.lit(" "))))
    found = e.join(h, "book").filter(exact | part).groupBy("book", "entry").agg(
        F.array_sort(F.collect_list(F.when(exact, F.col("heading")))).alias("exact"), F.array_sort(F.collect_list(F.when(~exact, F.col("heading")))).alias("part")
    )
    books = found.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("entry", "exact", "part"))).alias("entries"))

    def step(state, x):
        after = lambda a: F.filter(a, lambda i: i > state["last"])
        one = F.when(F.size(after(x["part"])) == 1, F.get(after(x["part"]), F.lit(0)))
        hit = F.coalesce(F.get(after(x["exact"]), F.lit(0)), one)
        pair = F.struct(x["entry"].alias("entry"), hit.alias("heading"))
        return F.struct(F.coalesce(hit, state["last"]).alias("last"), F.when(hit.isNull(), state["out"]).otherwise(F.array_append(state["out"], pair)).alias("out"))

    start = F.struct(F.lit(-1).cast("bigint").alias("last"), F.array().cast("array<struct<entry:bigint,heading:bigint>>").alias("out"))
    return books.select("book", F.explode(F.aggregate("entries", start, step, lambda s: s["out"])).alias("m")).select("book", "m.entry", "m.heading")


@query(
    """
WITH RECURSIVE b AS (SELECT conv_id, turn, lower(text) AS text, regexp_extract_all(lower(text), '[a-z]+') AS words FROM conversations),
w AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS k, CAST(1 AS BIGINT) AS cursor, CAST(NULL AS BIGINT) AS start FROM b
  UNION ALL
  SELECT conv_id, turn, k + 1, CASE WHEN at_ > 0 THEN cursor + at_ - 1 + len_ ELSE cursor END, CASE WHEN at_ > 0 THEN cursor + at_ - 1 END
  FROM (SELECT w.*, strpos(substring(b.text, w.cursor), b.words[w.k + 1]) AS at_, length(b.words[w.k + 1]) AS len_ FROM w JOIN b ON b.conv_id = w.conv_id AND b.turn = w.turn WHERE w.k < len(b.words)))
SELECT w.conv_id AS conv_id, w.turn AS turn, k AS word, start - 1 AS begins, start - 1 + length(b.words[k]) AS ends FROM w JOIN b ON b.conv_id = w.conv_id AND b.turn = w.turn WHERE start IS NOT NULL
"""
)
def word_positions(t):
    """JON14: the words that a recogniser heard, found in the transcript one after the other; the cursor never goes back."""
    low = F.lower("text")
    b = t("conversations").select("conv_id", "turn", low.alias("text"), F.regexp_extract_all(low, F.lit("([a-z]+)"), F.lit(1)).alias("words"))

    def step(state, w):
        at = F.call_function("locate", w, F.col("text"), state["cursor"]).cast("bigint")
        begins = F.when(at > 0, at - 1)
        return F.struct(F.when(at > 0, (at + F.length(w)).cast("int")).otherwise(state["cursor"]).alias("cursor"), F.array_append(state["out"], begins).alias("out"))

    start = F.struct(F.lit(1).alias("cursor"), F.array().cast("array<bigint>").alias("out"))
    found = b.select("conv_id", "turn", F.posexplode(F.arrays_zip(F.aggregate("words", start, step, lambda s: s["out"]).alias("begins"), F.col("words").alias("w"))).alias("k", "p"))
    rows = found.select("conv_id", "turn", (F.col("k") + 1).cast("bigint").alias("word"), F.col("p")["begins"].alias("begins"), (F.col("p")["begins"] + F.length(F.col("p")["w"])).cast("bigint").alias("ends"))
    return rows.filter("begins is not null")


_PAGE_TEXT = "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN (doc_id % 900) || chr(10) || text WHEN 1 THEN chr(10) || text || chr(10) || ' ' || (doc_id % 900) || ' ' WHEN 2 THEN (doc_id + 10000) || chr(10) || text ELSE text END"


@query(
    f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split({_PAGE_TEXT}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN regexp_matches(lines[1], '^[0-9]{{1,4}}$') THEN lines[1] WHEN regexp_matches(lines[-1], '^[0-9]{{1,4}}$') THEN lines[-1] END AS label FROM l
"""
)
def printed_labels(t):
    """SRC32: the printed page number: the first line that is not blank, if it is one to four digits, else the last one."""
    text = F.when(F.col("doc_id") % 4 == 0, F.concat_ws("\n", F.col("doc_id") % 900, "text")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("\n"), "text", F.lit("\n "), F.col("doc_id") % 900, F.lit(" "))).when(F.col("doc_id") % 4 == 2, F.concat_ws("\n", F.col("doc_id") + 10000, "text")).otherwise(F.col("text"))
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    rows = t("documents").filter("text is not null").select("doc_id", F.get(lines, F.lit(0)).alias("first"), F.try_element_at(lines, F.lit(-1)).alias("last"))
    number = "^[0-9]{1,4}$"
    return rows.select("doc_id", F.when(F.col("first").rlike(number), F.col("first")).when(F.col("last").rlike(number), F.col("last")).alias("label"))


_RANGE = "CASE CAST(event_id % 5 AS INT) WHEN 0 THEN (event_id % 90) || '-' || (event_id % 90 + user_id) WHEN 1 THEN ' ' || (event_id % 90 + 1) || ' - ' || (event_id % 70) WHEN 2 THEN '' || (event_id % 200) WHEN 3 THEN 'all' ELSE '' END"


@query(
    rf"""
WITH r AS (SELECT event_id, {_RANGE} AS asked FROM events),
p AS (SELECT *, try_cast(regexp_extract(asked, '^ *([0-9]+) *(-|$)', 1) AS BIGINT) AS a, try_cast(coalesce(nullif(regexp_extract(asked, '- *([0-9]+) *$', 1), ''), regexp_extract(asked, '^ *([0-9]+) *$', 1)) AS BIGINT) AS b FROM r)
SELECT event_id, asked, CASE WHEN trim(asked) = '' THEN 'all pages' WHEN a IS NULL OR b IS NULL THEN 'not a range' WHEN a > b THEN 'backwards' WHEN a > 120 THEN 'past the end' ELSE 'fine' END AS answer,
       CASE WHEN a <= b AND a <= 120 THEN greatest(a, 1) END AS first, CASE WHEN a <= b AND a <= 120 THEN least(b, 120) END AS last FROM p
"""
)
def page_ranges(t):
    """PRJ11, SRC04: page ranges as written, read and held to a document of 120 pages; backward ones and those past the end are refused."""
    r = t("events").select("event_id", F.expr(_RANGE).alias("asked"))
    a = F.regexp_extract("asked", r"^ *([0-9]+) *(-|$)", 1).try_cast("bigint")
    b = F.coalesce(F.nullif(F.regexp_extract("asked", r"- *([0-9]+) *$", 1), F.lit("")), F.regexp_extract("asked", r"^ *([0-9]+) *$", 1)).try_cast("bigint")
    r = r.withColumns({"a": a, "b": b})
    answer = F.when(F.trim("asked") == "", "all pages").when(F.col("a").isNull() | F.col("b").isNull(), "not a range").when(F.col("a") > F.col("b"), "backwards").when(F.col("a") > 120, "past the end").otherwise("fine")
    valid = (F.col("a") <= F.col("b")) & (F.col("a") <= 120)
    return r.select("event_id", "asked", answer.alias("answer"), F.when(valid, F.greatest("a", F.lit(1))).alias("first"), F.when(valid, F.least("b", F.lit(120))).alias("last"))


@query(
    """
WITH p AS (SELECT user_id AS book, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS page, event_type IN ('click', 'error') AS photo, CASE WHEN event_type = 'view' THEN NULL ELSE event_id % 3 = 0 END AS numbered FROM events),
l AS (SELECT *, CASE WHEN NOT photo OR numbered THEN page - CAST(floor(page / 40) AS BIGINT) END AS label FROM p),
q AS (SELECT *, page - row_number() OVER (PARTITION BY book, photo ORDER BY page) AS island FROM l),
r AS (SELECT book, min(page) AS first, max(page) AS last, count(label) AS labels FROM q WHERE photo GROUP BY book, island)
SELECT r.book AS book, r.first AS first, r.last AS last, r.labels = 0 AND coalesce(b.label - a.label = 1, false) AS strong FROM r LEFT JOIN l a ON a.book = r.book AND a.page = r.first - 1 LEFT JOIN l b ON b.book = r.book AND b.page = r.last + 1
"""
)
def photo_inserts(t):
    """SRC30: runs of photo pages; strong if none of them is numbered and the pages around print consecutive numbers."""
    p = O.numbered(t("events").select(F.col("user_id").alias("book"), "ts", "event_id", "event_type"), ["book"], ["ts", "event_id"], "page")
    p = p.withColumn("photo", F.col("event_type").isin("click", "error"))
    numbered = (F.col("event_type") != "view") & (F.col("event_id") % 3 == 0)
    p = p.withColumn("label", F.when(~F.col("photo") | numbered, F.col("page") - F.floor(F.col("page") / 40)))
    w = Window.partitionBy("book").orderBy("page")
    p = p.withColumns({"before": F.lag("label").over(w), "after": F.lead("label").over(w)})
    q = p.filter("photo").withColumn("island", F.col("page") - F.row_number().over(w))
    r = q.groupBy("book", "island").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.count("label").alias("labels"), F.min_by("before", "page").alias("before"), F.max_by("after", "page").alias("after"))
    return r.select("book", "first", "last", ((F.col("labels") == 0) & F.coalesce(F.col("after") - F.col("before") == 1, F.lit(False))).alias("strong"))


@query(
    """
WITH c AS (SELECT page_id, CAST(len(regexp_extract_all(html, '<a ')) AS INTEGER) AS images, CAST(len(regexp_extract_all(html, '<p>')) * 10 AS INTEGER) AS words, contains(url, '7') AS named FROM pages),
i AS (SELECT *, images > 0 AND words <= greatest(40, 40 * images / 2) AS is_insert FROM c)
SELECT page_id, images, words, is_insert, is_insert AND named AS strong, CASE WHEN NOT is_insert THEN 'text' WHEN named OR page_id BETWEEN 40 AND 90 THEN 'used' ELSE 'left out' END AS choice FROM i
"""
)
def insert_pages(t):
    """SRC31, PRJ10: pages that are photo inserts by their images and few other words, strong ones by name, and which are used: by evidence or a confirmed range."""
    c = t("pages").select("page_id", F.regexp_count("html", F.lit("<a ")).alias("images"), (F.regexp_count("html", F.lit("<p>")) * 10).alias("words"), F.contains("url", F.lit("7")).alias("named"))
    i = c.withColumn("is_insert", (F.col("images") > 0) & (F.col("words") <= F.greatest(F.lit(40), 40 * F.col("images") / 2)))
    choice = F.when(~F.col("is_insert"), "text").when(F.col("named") | F.col("page_id").between(40, 90), "used").otherwise("left out")
    return i.select("page_id", "images", "words", "is_insert", (F.col("is_insert") & F.col("named")).alias("strong"), choice.alias("choice"))


@query(
    """
SELECT doc_id, CASE WHEN chars >= 25 THEN CASE WHEN ratio >= 0.5 AND chars < 400 THEN 'mixed' ELSE 'text' END WHEN ratio > 0.05 THEN 'image_only' ELSE 'blank' END AS status FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN doc_id % 30 ELSE length(trim(coalesce(text, ''))) END AS chars, (doc_id % 10) / 10 AS ratio FROM documents)
"""
)
def page_statuses(t):
    """SRC17: a page is text, mixed, image only or blank by its characters and the share of its images."""
    d = t("documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") % 30).otherwise(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("chars"), (F.col("doc_id") % 10 / 10).alias("ratio"))
    status = F.when(F.col("chars") >= 25, F.when((F.col("ratio") >= 0.5) & (F.col("chars") < 400), "mixed").otherwise("text")).when(F.col("ratio") > 0.05, "image_only").otherwise("blank")
    return d.select("doc_id", status.alias("status"))


@query(
    r"""
WITH p AS (SELECT doc_id % 40 AS book, doc_id AS page, list_filter(list_transform(string_split(CASE WHEN doc_id % 3 < 2 THEN 'Libro ' || (doc_id % 40) || ' - ' || doc_id || chr(10) || text ELSE text END, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
e AS (SELECT DISTINCT book, page, lower(trim(regexp_replace(regexp_replace(edge, '[0-9]+', '#', 'g'), '[ \t\n\r\f]+', ' ', 'g'))) AS mask FROM (SELECT book, page, unnest(list_distinct([l[1], l[-1]])) AS edge FROM p WHERE len(l) > 0) WHERE length(edge) <= 120 AND NOT regexp_matches(edge, '[.!?…]$')),
n AS (SELECT book, count(*) AS pages FROM p GROUP BY 1)
SELECT e.book AS book, mask, CAST(count(*) AS BIGINT) AS on_pages FROM e JOIN n ON n.book = e.book WHERE pages >= 3 GROUP BY e.book, mask, pages HAVING count(*) >= greatest(3, CAST(floor(0.4 * pages + 0.999) AS BIGINT))
"""
)
def running_heads(t):
    """AGG11, STR05, STR06: lines that stand first or last on two fifths of a book's pages, three at least, digits masked; long ones and ends of sentences do not count."""
    d = t("documents").filter("text is not null")
    text = F.when(F.col("doc_id") % 3 < 2, F.concat(F.lit("Libro "), F.col("doc_id") % 40, F.lit(" - "), "doc_id", F.lit("\n"), "text")).otherwise(F.col("text"))
    p = d.select((F.col("doc_id") % 40).alias("book"), F.col("doc_id").alias("page"), F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: x != "").alias("l"))
    edges = p.filter(F.size("l") > 0).select("book", "page", F.explode(F.array(F.get("l", F.lit(0)), F.element_at("l", -1))).alias("edge")).filter((F.length("edge") <= 120) & ~F.col("edge").rlike(r"[.!?…]\z"))
    masks = edges.select("book", "page", T.masked(F.col("edge")).alias("mask")).distinct().groupBy("book", "mask").agg(n().alias("on_pages"))
    pages = p.groupBy("book").agg(n().alias("pages"))
    least = F.greatest(F.lit(3), F.floor(F.lit(0.4) * F.col("pages") + 0.999))
    return masks.join(pages, "book").filter((F.col("pages") >= 3) & (F.col("on_pages") >= least)).select("book", "mask", "on_pages")


@query("SELECT user_id AS document, arg_min(props, (ts, event_id)) AS title FROM events WHERE event_type = 'view' GROUP BY 1")
def first_titles(t):
    """SRC09, WIN18: the first title of each document in a table of contents wins."""
    return t("events").filter("event_type = 'view'").groupBy(F.col("user_id").alias("document")).agg(F.min_by("props", F.struct("ts", "event_id")).alias("title"))


_HEADING = "CASE WHEN doc_id % 2 = 0 AND pos % 9 = 4 THEN 'Capítulo ' || (pos // 9 + 1) WHEN doc_id % 4 = 2 AND pos % 11 = 7 THEN 'XIV' ELSE line END"


@query(
    rf"""
WITH l AS (SELECT doc_id, pos, {_HEADING} AS line FROM ({_LINES})), h AS (SELECT *, regexp_matches(line, '^(Cap[ií]tulo|Parte|Libro|Secci[oó]n|Pr[oó]logo|Ep[ií]logo)( |$)') OR {_roman_sql('line')} IS NOT NULL AS head FROM l),
g AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc_id) AS heads, count(*) FILTER (head) OVER (PARTITION BY doc_id ORDER BY pos) AS chapter FROM h)
SELECT doc_id, CASE WHEN heads < 2 THEN 0 ELSE chapter END AS chapter, CASE WHEN heads < 2 THEN 'generated' WHEN min(chapter) = 0 THEN 'Prólogo' ELSE arg_min(line, pos) END AS title, CAST(count(*) FILTER (NOT head) AS BIGINT) AS lines FROM g GROUP BY doc_id, CASE WHEN heads < 2 THEN 0 ELSE chapter END, heads
"""
)
def text_chapters(t):
    """SRC20, SRC21: plain text falls into chapters at lines that are headings or Roman numerals; with fewer than two it is one, what stands before the first is a prologue."""
    lines = t("documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    line = F.regexp_replace("line", "[^A-Za-z ]", "")
    shown = F.when(F.expr("doc_id % 2 = 0 AND pos % 9 = 4"), F.concat(F.lit("Capítulo "), F.floor(F.col("pos") / 9) + 1)).when(F.expr("doc_id % 4 = 2 AND pos % 11 = 7"), "XIV").otherwise(line)
    h = lines.select("doc_id", "pos", shown.alias("line")).withColumn("head", F.col("line").rlike("^(Cap[ií]tulo|Parte|Libro|Secci[oó]n|Pr[oó]logo|Ep[ií]logo)( |$)") | N.roman_value(F.col("line")).isNotNull())
    g = O.running(h, ["doc_id"], ["pos"], F.col("head").cast("int"), "chapter")
    heads = h.groupBy("doc_id").agg(F.count_if("head").alias("heads"))
    g = g.join(heads, "doc_id").withColumn("chapter", F.when(F.col("heads") < 2, 0).otherwise(F.col("chapter")).cast("bigint"))
    rows = g.groupBy("doc_id", "chapter", "heads").agg(F.min_by("line", "pos").alias("first"), F.count_if(~F.col("head")).alias("lines"))
    title = F.when(F.col("heads") < 2, "generated").when(F.col("chapter") == 0, "Prólogo").otherwise(F.col("first"))
    return rows.select("doc_id", "chapter", title.alias("title"), "lines")


@query(
    """
WITH w AS (SELECT l_orderkey AS page, l_suppkey % 2 AS block, l_linenumber % 2 AS par, l_partkey % 3 AS line, l_partkey AS pos, 'w' || l_partkey || '_' || l_suppkey AS word, CAST(floor(l_discount * 1100) AS BIGINT) - 5 AS conf FROM lineitem),
l AS (SELECT page, block, par, line, string_agg(word, ' ' ORDER BY pos, word) AS text, min(pos) AS first FROM w GROUP BY ALL),
p AS (SELECT page, block, par, string_agg(text, chr(10) ORDER BY line) AS text, min(first) AS first FROM l GROUP BY ALL),
c AS (SELECT page, round(avg(conf) FILTER (conf >= 0), 6) AS confidence, coalesce(string_agg(word, ' ' ORDER BY pos, word) FILTER (conf >= 0 AND conf < 60), '') AS doubtful FROM w GROUP BY page)
SELECT c.page AS page, string_agg(text, '/' ORDER BY first, block, par) AS text, any_value(confidence) AS confidence, any_value(doubtful) AS doubtful FROM p JOIN c ON c.page = p.page GROUP BY c.page
"""
)
def ocr_pages(t):
    """SRC28, AGG26: recognised words to lines and paragraphs in the order they were first seen, the mean confidence, and the words under 60."""
    w = t("lineitem").select(
        F.col("l_orderkey").alias("page"), (F.col("l_suppkey") % 2).alias("block"), (F.col("l_linenumber") % 2).alias("par"), (F.col("l_partkey") % 3).alias("line"), F.col("l_partkey").alias("pos"),
        F.concat(F.lit("w"), "l_partkey", F.lit("_"), "l_suppkey").alias("word"), (F.floor(F.col("l_discount") * 1100) - 5).cast("bigint").alias("conf"),
    )
    joined = lambda items, sep: F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda x: x["t"]), sep)
    l = w.groupBy("page", "block", "par", "line").agg(joined(F.struct("pos", "word", F.col("word").alias("t")), " ").alias("text"), F.min("pos").alias("first"))  # noqa: E741
    p = l.groupBy("page", "block", "par").agg(joined(F.struct("line", F.col("text").alias("t")), "\n").alias("text"), F.min("first").alias("first"))
    low = F.when((F.col("conf") >= 0) & (F.col("conf") < 60), F.struct("pos", "word", F.col("word").alias("t")))
    c = w.groupBy("page").agg(F.round(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), 6).alias("confidence"), joined(low, " ").alias("doubtful"))
    return p.groupBy("page").agg(joined(F.struct("first", "block", "par", F.col("text").alias("t")), "/").alias("text")).join(c, "page")


@query(
    rf"""
WITH c AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM ({_LINES}) WHERE trim(line) <> ''),
g AS (SELECT *, count(*) FILTER (before IS NULL OR NOT (regexp_matches(before, '[a-z] *$') AND regexp_matches(line, '^ *[a-z]'))) OVER (PARTITION BY doc_id ORDER BY pos) AS paragraph FROM c)
SELECT doc_id, CAST(paragraph AS BIGINT) AS paragraph, string_agg(trim(line), ' ' ORDER BY pos) AS text FROM g GROUP BY doc_id, paragraph
"""
)
def joined_paragraphs(t):
    """SRC19: a paragraph that a page break cut, ending and going on in lower case, is one again."""
    # told from the text itself: its lines that hold letters, the joints between them, and what stands between other line ends
    lines = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z \n]", ""), "\n", -1), lambda x: F.trim(x) != "")
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"(?<=[a-z]) *\n *(?=[a-z])", " ")
    d = t("documents").filter("text is not null").select("doc_id", F.posexplode_outer(F.split(joined, "\n", -1)).alias("at", "part"))
    return d.filter("part <> ''").select("doc_id", (F.col("at") + 1).cast("bigint").alias("paragraph"), F.trim("part").alias("text"))


@query(
    r"""
WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: CAST(len(regexp_extract_all(x, '[^ \n\t]+')) AS BIGINT)) AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, greatest(120, least(1200, CAST((list_sum(w) + 4) // 5 AS BIGINT))) AS target FROM l),
f AS (SELECT doc_id, w, target, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS acc, CAST(1 AS BIGINT) AS section, CAST(NULL AS BIGINT) AS mine FROM s
  UNION ALL
  SELECT doc_id, w, target, i + 1, CASE WHEN full_ THEN 0 ELSE acc + w[i + 1] END, CASE WHEN full_ THEN section + 1 ELSE section END, section FROM (SELECT *, acc + w[i + 1] >= target AND section < 5 AND i + 1 < len(w) AS full_ FROM f WHERE i < len(w)))
SELECT doc_id, mine AS section, min(i) - 1 AS first, CAST(count(*) AS BIGINT) AS lines, CAST(sum(w[i]) AS BIGINT) AS words FROM f WHERE mine IS NOT NULL GROUP BY doc_id, mine
"""
)
def nav_sections(t):
    """AGG25: up to five sections of like length for a text without chapters; one ends where its words reach the target, and counting starts anew.

    One fold over a document's line lengths.
    """
    words = F.transform(F.split("text", "\n", -1), lambda x: F.size(F.regexp_extract_all(x, F.lit(r"([^ \n\t]+)"), F.lit(1))).cast("bigint"))
    d = t("documents").filter("text is not null").select("doc_id", words.alias("w"))
    total = F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + x)
    d = d.withColumn("target", F.greatest(F.lit(120), F.least(F.lit(1200), F.floor((total + 4) / 5))))

    def step(s, x):
        full = (s["acc"] + x >= F.col("target")) & (s["section"] < 5) & (s["i"] + 1 < F.size("w"))
        return F.struct((s["i"] + 1).alias("i"), F.when(full, F.lit(0)).otherwise(s["acc"] + x).cast("bigint").alias("acc"), F.when(full, s["section"] + 1).otherwise(s["section"]).cast("bigint").alias("section"), F.array_append(s["out"], s["section"]).alias("out"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("acc"), F.lit(1).cast("bigint").alias("section"), F.array().cast("array<bigint>").alias("out"))
    rows = d.select("doc_id", F.posexplode(F.arrays_zip(F.aggregate("w", start, step, lambda s: s["out"]).alias("s"), F.col("w").alias("n"))).alias("i", "z"))
    return rows.groupBy("doc_id", F.col("z")["s"].alias("section")).agg(F.min(F.col("i").cast("bigint")).alias("first"), n().alias("lines"), F.sum(F.col("z")["n"]).alias("words"))
