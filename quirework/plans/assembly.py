"""A book put together: sections folded by level, references placed by page, provenance cut by sizes, texts packed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirework.operators import ordered as O
from quirework.plans.registry import n, query

_PARTS = "SELECT conv_id AS book, turn, CAST(2 + length(text) % 3 AS BIGINT) AS level, regexp_extract(text, '^([^ ,.]+)', 1) AS title, turn % 3 = 2 AS untitled FROM conversations"


@query(
    f"""
WITH s AS (SELECT *, min(level) FILTER (NOT untitled AND level > 2) OVER (PARTITION BY book) AS sub FROM ({_PARTS})),
g AS (SELECT *, CASE WHEN untitled THEN 0 ELSE 1 END AS opens, CASE WHEN untitled THEN NULL WHEN level = 2 THEN 1 WHEN level = sub THEN 2 ELSE 3 END AS depth FROM s),
r AS (SELECT *, sum(CASE WHEN opens = 1 AND depth <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY turn) AS section FROM g)
SELECT book, CAST(section AS BIGINT) AS section, coalesce(arg_min(title, turn) FILTER (depth <= 2), '') AS title, CAST(coalesce(min(depth) FILTER (depth <= 2), 1) AS INTEGER) AS depth, CAST(count(*) AS BIGINT) AS parts, CAST(count(*) FILTER (depth = 3) AS BIGINT) AS inner_headings FROM r GROUP BY book, section
"""
)
def folded_sections(t):
    """AGG24: a chapter's parts fold into sections: those of its own level stand beside each other, the least deeper level makes sub-chapters, deeper headings and untitled parts belong to what goes before."""
    s = t("conversations").select(F.col("conv_id").alias("book"), "turn", (2 + F.length("text") % 3).cast("bigint").alias("level"), F.regexp_extract("text", "^([^ ,.]+)", 1).alias("title"), (F.col("turn") % 3 == 2).alias("untitled"))
    sub = F.min(F.when(~F.col("untitled") & (F.col("level") > 2), F.col("level"))).over(Window.partitionBy("book"))
    s = s.withColumn("sub", sub).withColumn("depth", F.when(F.col("untitled"), None).when(F.col("level") == 2, 1).when(F.col("level") == F.col("sub"), 2).otherwise(3))
    opens = F.coalesce((F.col("depth") <= 2).cast("int"), F.lit(0))
    s = O.running(s, ["book"], ["turn"], opens, "section")
    first = F.min(F.when(F.col("depth") <= 2, F.struct("turn", "title")))["title"]
    return s.groupBy("book", F.col("section").cast("bigint").alias("section")).agg(
        F.coalesce(first, F.lit("")).alias("title"), F.coalesce(F.min(F.when(F.col("depth") <= 2, F.col("depth"))), F.lit(1)).alias("depth"), n().alias("parts"), F.count_if(F.col("depth") == 3).alias("inner_headings"),
    )


@query(
    """
WITH p AS (SELECT user_id AS book, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS pos, CASE WHEN event_type IN ('view', 'click') THEN CAST(floor(event_id / 40) AS BIGINT) END AS page, event_id % 7 AS document FROM events),
i AS (SELECT o_orderkey AS insert_id, o_custkey % 150 AS book, o_orderkey % 260 AS last_page, o_orderkey % 9 AS previous FROM orders WHERE o_orderkey % 5 = 0),
a AS (SELECT i.insert_id, min(p.pos) FILTER (p.page > i.last_page AND i.insert_id % 2 = 0) AS before_, max(p.pos) FILTER (p.document = i.previous) AS after_, max(p.pos) AS last FROM i JOIN p ON p.book = i.book GROUP BY i.insert_id)
SELECT insert_id, CASE WHEN before_ IS NOT NULL THEN before_ - 1 ELSE coalesce(after_, last) END AS after_position, CASE WHEN before_ IS NOT NULL THEN 'page' WHEN after_ IS NOT NULL THEN 'document' ELSE 'end' END AS rule FROM a
"""
)
def placed_references(t):
    """JON23: a photo insert is mentioned before the first paragraph on a later page, else after the last one of the document before it, else at the end."""
    p = O.numbered(t("events").select(F.col("user_id").alias("book"), "event_id", "ts", "event_type"), ["book"], ["ts", "event_id"], "pos")
    p = p.select("book", "pos", F.when(F.col("event_type").isin("view", "click"), F.floor(F.col("event_id") / 40)).alias("page"), (F.col("event_id") % 7).alias("document"))
    i = t("orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("insert_id"), (F.col("o_custkey") % 150).alias("book"), (F.col("o_orderkey") % 260).alias("last_page"), (F.col("o_orderkey") % 9).alias("previous"))
    # the first position on a page after p is the least over all later pages; of a book's pages and documents there are few
    pages = p.filter("page is not null").groupBy("book", "page").agg(F.min("pos").alias("first"))
    later = pages.withColumn("first", F.min("first").over(Window.partitionBy("book").orderBy(F.desc("page")).rowsBetween(Window.unboundedPreceding, 0)))
    spans = later.withColumn("from_page", F.coalesce(F.lag("page").over(Window.partitionBy("book").orderBy("page")), F.lit(-1)))
    before = i.filter("insert_id % 2 = 0").join(spans, "book").filter((F.col("last_page") >= F.col("from_page")) & (F.col("last_page") < F.col("page"))).select("insert_id", F.col("first").alias("before"))
    after = p.groupBy("book", F.col("document").alias("previous")).agg(F.max("pos").alias("after"))
    last = p.groupBy("book").agg(F.max("pos").alias("last"))
    rows = i.join(last, "book").join(before, "insert_id", "left").join(after, ["book", "previous"], "left")
    return rows.select("insert_id", F.when(F.col("before").isNotNull(), F.col("before") - 1).otherwise(F.coalesce("after", "last")).alias("after_position"), F.when(F.col("before").isNotNull(), "page").when(F.col("after").isNotNull(), "document").otherwise("end").alias("rule"))


@query(
    """
WITH f AS (SELECT user_id AS book, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS pos FROM events),
g AS (SELECT conv_id AS book, turn AS slot, CAST(3 + length(text) % 20 AS BIGINT) AS size FROM conversations),
o AS (SELECT *, CAST(sum(size) OVER (PARTITION BY book ORDER BY slot) - size AS BIGINT) AS first FROM g)
SELECT o.book AS book, slot, size, CAST(count(f.pos) AS BIGINT) AS got, min(event_id) AS first_record, count(f.pos) = size AS whole FROM o LEFT JOIN f ON f.book = o.book AND f.pos > o.first AND f.pos <= o.first + o.size GROUP BY o.book, slot, size
"""
)
def regrouped_provenance(t):
    """WIN20: a flat sequence of records cut by the sizes of groups; a group that does not get all its records is not whole."""
    f = O.numbered(t("events").select(F.col("user_id").alias("book"), "event_id", "ts"), ["book"], ["ts", "event_id"], "pos")
    g = t("conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("slot"), (3 + F.length("text") % 20).cast("bigint").alias("size"))
    g = O.running(g, ["book"], ["slot"], F.col("size"), "first", inclusive=False)
    # the positions of a group, one row each, so that the join is an equi join
    places = g.select("book", "slot", "size", F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("size"))).alias("pos"))
    return places.join(f, ["book", "pos"], "left").groupBy("book", "slot", "size").agg(F.count("event_id").alias("got"), F.min("event_id").alias("first_record"), (F.count("event_id") == F.col("size")).alias("whole"))


@query(
    """
WITH b AS (SELECT conv_id AS book, turn, role, regexp_extract(text, '^([^ ,.]+)', 1) AS title FROM conversations),
p AS (SELECT book, 0 AS matter, 0 AS k, 'Título' AS title FROM b GROUP BY book UNION ALL SELECT book, 0, 1, 'Aviso legal' FROM b GROUP BY book UNION ALL SELECT book, 0, 2, 'Índice' FROM b GROUP BY book
  UNION ALL SELECT book, 1, turn, title FROM b WHERE role = 'user' UNION ALL SELECT book, 2, turn, 'Fotografía ' || title FROM b WHERE role <> 'user' AND turn % 4 = 1 UNION ALL SELECT book, 3, 0, 'Fin de la obra' FROM b GROUP BY book)
SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY matter, k) AS BIGINT) AS ordinal, title, matter IN (1, 2) AS indexed FROM p
"""
)
def assembled_books(t):
    """WIN21, WIN15: three initial sections, the body, the photographs and the closing phrase, numbered in reading order; the index lists body and photographs."""
    b = t("conversations").select(F.col("conv_id").alias("book"), "turn", "role", F.regexp_extract("text", "^([^ ,.]+)", 1).alias("title"))
    books = b.select("book").distinct()
    fixed = [(0, 0, "Título"), (0, 1, "Aviso legal"), (0, 2, "Índice"), (3, 0, "Fin de la obra")]
    p = books.select("book", F.explode(F.array(*[F.struct(F.lit(m).alias("matter"), F.lit(k).cast("bigint").alias("k"), F.lit(x).alias("title")) for m, k, x in fixed])).alias("f")).select("book", "f.*")
    p = p.unionAll(b.filter("role = 'user'").select("book", F.lit(1), "turn", "title")).unionAll(b.filter("role <> 'user' and turn % 4 = 1").select("book", F.lit(2), "turn", F.concat(F.lit("Fotografía "), "title")))
    return O.numbered(p, ["book"], ["matter", "k"], "ordinal").select("book", "ordinal", "title", F.col("matter").isin(1, 2).alias("indexed"))


_SPANS = "SELECT l_suppkey AS document, l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 9 < 6 THEN 11.2 WHEN l_partkey % 9 < 8 THEN 8.0 + l_linenumber / 10.0 ELSE 15.4 END AS size, CAST(l_quantity AS BIGINT) AS chars, l_discount * 10 AS y, l_partkey % 2 = 0 AS numbered FROM lineitem"


@query(
    f"""
WITH m AS (SELECT document, arg_min(s, (-chars, s)) AS body FROM (SELECT document, round(size * 2) / 2 AS s, sum(chars) AS chars FROM ({_SPANS}) GROUP BY ALL) GROUP BY document)
SELECT s.document AS document, body, CAST(count(*) FILTER (size >= body + 2.5) AS BIGINT) AS headings, CAST(count(*) FILTER (size < body + 2.5 AND size <= body - 1.25 AND y > 0.7 AND numbered) AS BIGINT) AS footnotes, CAST(count(*) AS BIGINT) AS spans FROM ({_SPANS}) s JOIN m ON m.document = s.document GROUP BY s.document, body
"""
)
def body_fonts(t):
    """SRC18: the size of the body is the one that most characters have, rounded to halves; larger spans are headings, smaller numbered ones low on the page are footnotes."""
    size = F.when(F.col("l_partkey") % 9 < 6, 11.2).when(F.col("l_partkey") % 9 < 8, 8.0 + F.col("l_linenumber") / 10.0).otherwise(15.4)
    s = t("lineitem").select(F.col("l_suppkey").alias("document"), size.alias("size"), F.col("l_quantity").cast("bigint").alias("chars"), (F.col("l_discount") * 10).alias("y"), (F.col("l_partkey") % 2 == 0).alias("numbered"))
    m = s.groupBy("document", (F.round(F.col("size") * 2) / 2).alias("s")).agg(F.sum("chars").alias("chars")).groupBy("document").agg(F.min_by("s", F.struct(-F.col("chars"), F.col("s"))).alias("body"))
    big = F.col("size") >= F.col("body") + 2.5
    return s.join(m, "document").groupBy("document", "body").agg(F.count_if(big).alias("headings"), F.count_if(~big & (F.col("size") <= F.col("body") - 1.25) & (F.col("y") > 0.7) & F.col("numbered")).alias("footnotes"), n().alias("spans"))


@query(
    """
WITH c AS (SELECT conv_id AS chapter, turn, role, text, CASE WHEN role = 'user' THEN 'Heading ' || (1 + turn % 4) ELSE 'Normal' END AS style FROM conversations),
k AS (SELECT *, nullif(regexp_extract(style, '(?i)^(heading|título) ?([1-9])', 2), '') AS level FROM c), f AS (SELECT *, row_number() OVER (PARTITION BY chapter, level IS NOT NULL ORDER BY turn) = 1 AND level IS NOT NULL AS title FROM k),
r AS (SELECT chapter, turn, 0 AS part, CASE WHEN title THEN 'title' WHEN level IS NOT NULL THEN 'heading' ELSE 'text' END AS kind, level, md5(text) AS text_md5 FROM f
  UNION ALL SELECT f.chapter, d.item_id, 1, 'note', NULL, md5('Nota ' || d.item_id || '. ' || d.text) FROM f JOIN benchmark d ON d.item_id = (f.chapter * 7 + f.turn * 3) % 60 WHERE NOT title)
SELECT chapter, CAST(row_number() OVER (PARTITION BY chapter ORDER BY part, turn, text_md5) AS BIGINT) AS ordinal, kind, CAST(level AS INTEGER) AS level, text_md5 FROM r
"""
)
def chapter_blocks(t):
    """SRC11, SRC15, SRC26: levels by the name of a style, the first heading is the chapter's title, and the notes that its paragraphs refer to stand at its end."""
    c = t("conversations").select(F.col("conv_id").alias("chapter"), "turn", "text", F.when(F.col("role") == "user", F.concat(F.lit("Heading "), 1 + F.col("turn") % 4)).otherwise("Normal").alias("style"))
    level = F.nullif(F.regexp_extract("style", "(?i)^(heading|título) ?([1-9])", 2), F.lit(""))
    c = c.withColumn("level", level)
    first = F.min(F.when(F.col("level").isNotNull(), F.col("turn"))).over(Window.partitionBy("chapter"))
    c = c.withColumn("title", F.coalesce(F.col("turn") == first, F.lit(False)))
    kind = F.when(F.col("title"), "title").when(F.col("level").isNotNull(), "heading").otherwise("text")
    blocks = c.select("chapter", "turn", F.lit(0).alias("part"), kind.alias("kind"), F.col("level").cast("int").alias("level"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
    notes = t("benchmark").select("item_id", F.md5(F.concat(F.lit("Nota "), "item_id", F.lit(". "), "text").cast("binary")).alias("text_md5"))
    cited = c.filter(~F.col("title")).select("chapter", ((F.col("chapter") * 7 + F.col("turn") * 3) % 60).alias("item_id")).join(notes, "item_id")
    rows = blocks.unionAll(cited.select("chapter", "item_id", F.lit(1), F.lit("note"), F.lit(None).cast("int"), "text_md5"))
    return O.numbered(rows, ["chapter"], ["part", "turn", "text_md5"], "ordinal").select("chapter", "ordinal", "kind", "level", "text_md5")


_FILE = "'libro' || page_id || CASE CAST(page_id % 6 AS INT) WHEN 0 THEN '.PDF' WHEN 1 THEN '.epub' WHEN 2 THEN '.exe' WHEN 3 THEN '' WHEN 4 THEN '.docx' ELSE '.tar.xml' END"


@query(rf"SELECT page_id, suffix, CASE WHEN suffix NOT IN ('.pdf', '.txt', '.xml', '.docx', '.epub') THEN 'unknown format' WHEN bytes = 0 THEN 'empty' WHEN bytes > 6000 THEN 'too large' ELSE 'fine' END AS answer FROM (SELECT page_id, lower(regexp_extract({_FILE}, '\.[^.]+$')) AS suffix, octet_length(encode(CASE WHEN page_id % 10 = 9 THEN '' ELSE html END)) AS bytes FROM pages)")
def upload_checks(t):
    """SRC02, SRC42: uploads by suffix and size."""
    p = t("pages").select("page_id", F.lower(F.regexp_extract(F.expr(_FILE), r"\.[^.]+$", 0)).alias("suffix"), F.octet_length(F.when(F.col("page_id") % 10 == 9, "").otherwise(F.col("html"))).alias("bytes"))
    answer = F.when(~F.col("suffix").isin(".pdf", ".txt", ".xml", ".docx", ".epub"), "unknown format").when(F.col("bytes") == 0, "empty").when(F.col("bytes") > 6000, "too large").otherwise("fine")
    return p.select("page_id", "suffix", answer.alias("answer"))


@query(
    r"""
WITH RECURSIVE s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])[ \n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(regexp_replace(x, '[ \n]+', ' ', 'g'))), lambda x: x <> '') AS p FROM conversations),
f AS (SELECT conv_id, turn, 0 AS i, CAST(0 AS BIGINT) AS size, CAST(1 AS BIGINT) AS passage, CAST(NULL AS BIGINT) AS mine FROM s
  UNION ALL SELECT conv_id, turn, i + 1, CASE WHEN fits THEN size + 1 + n ELSE n END, CASE WHEN fits THEN passage ELSE passage + 1 END, CASE WHEN fits THEN passage ELSE passage + 1 END
  FROM (SELECT f.*, CAST(length(s.p[f.i + 1]) AS BIGINT) AS n, f.i = 0 OR f.size + 1 + length(s.p[f.i + 1]) <= 800 AS fits FROM f JOIN s ON s.conv_id = f.conv_id AND s.turn = f.turn WHERE f.i < len(s.p)))
SELECT f.conv_id AS conv_id, f.turn AS turn, mine AS passage, CAST(count(*) AS BIGINT) AS sentences, md5(string_agg(s.p[f.i], ' ' ORDER BY f.i)) AS text_md5 FROM f JOIN s ON s.conv_id = f.conv_id AND s.turn = f.turn WHERE mine IS NOT NULL GROUP BY 1, 2, 3
"""
)
def packed_passages(t):
    """SEG01, SEG02: sentences packed in order into passages of at most 800 characters, one fold over a text's sentences; a longer sentence is a passage of its own."""
    p = F.filter(F.transform(F.split(F.regexp_replace("text", "([.!?…])[ \n]+", "$1\u0001"), "\u0001", -1), lambda x: F.trim(F.regexp_replace(x, "[ \n]+", " "))), lambda x: x != "")
    s = t("conversations").select("conv_id", "turn", p.alias("p"))

    def step(a, x):
        fits = (F.size(a["out"]) == 0) | (a["size"] + 1 + F.length(x) <= 800)
        passage = F.when(fits, a["passage"]).otherwise(a["passage"] + 1).cast("bigint")
        return F.struct(F.when(fits & (F.size(a["out"]) > 0), a["size"] + 1 + F.length(x)).otherwise(F.when(fits, a["size"] + 1 + F.length(x)).otherwise(F.length(x))).cast("bigint").alias("size"), passage.alias("passage"), F.array_append(a["out"], passage).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("passage"), F.array().cast("array<bigint>").alias("out"))
    rows = s.select("conv_id", "turn", F.posexplode(F.arrays_zip(F.aggregate("p", start, step, lambda a: a["out"]).alias("passage"), F.col("p").alias("t"))).alias("i", "z"))
    texts = F.array_sort(F.collect_list(F.struct("i", F.col("z")["t"].alias("t"))))
    return rows.groupBy("conv_id", "turn", F.col("z")["passage"].alias("passage")).agg(n().alias("sentences"), F.md5(F.array_join(F.transform(texts, lambda x: x["t"]), " ").cast("binary")).alias("text_md5"))


@query(
    r"""
SELECT doc_id, CASE WHEN rows >= 0.5 * total THEN 'lines' ELSE 'paragraphs' END AS kind, CASE WHEN rows >= 0.5 * total THEN total ELSE blocks END AS pieces, title FROM (
  SELECT doc_id, CAST(len(l) AS INTEGER) AS total, CAST(len(list_filter(l, lambda x: regexp_matches(x, '[0-9] *$'))) AS INTEGER) AS rows, CAST(len(list_filter(string_split(p, chr(10) || chr(10)), lambda x: trim(x) <> '')) AS INTEGER) AS blocks,
         CASE WHEN regexp_matches(l[1], '^Capítulo [0-9]+$') AND len(l) > 1 THEN l[1] || '. ' || md5(l[2]) ELSE md5(l[1]) END AS title
  FROM (SELECT doc_id, p, list_filter(string_split(p, chr(10)), lambda x: trim(x) <> '') AS l FROM (SELECT doc_id, CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN replace(text, chr(10), ' ' || doc_id || chr(10)) WHEN 1 THEN 'Capítulo ' || (doc_id % 50) || chr(10) || text ELSE replace(text, chr(10), chr(10) || chr(10)) END AS p FROM documents WHERE text IS NOT NULL AND trim(replace(text, chr(10), ' ')) <> '')))
"""
)
def page_paragraphs(t):
    """SEG06, SEG07, SEG09: a page falls into paragraphs at blank lines, an index keeps its lines, and a chapter's number and the line below it are one heading."""
    p = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.concat(F.lit(" "), "doc_id", F.lit("\n")))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Capítulo "), F.col("doc_id") % 50, F.lit("\n"), "text")).otherwise(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    d = t("documents").filter("text is not null").filter(F.trim(F.replace("text", F.lit("\n"), F.lit(" "))) != "").select("doc_id", p.alias("p"))
    d = d.withColumn("l", F.filter(F.split("p", "\n", -1), lambda x: F.trim(x) != ""))
    rows = F.size(F.filter("l", lambda x: x.rlike("[0-9] *$")))
    index = rows >= F.lit(0.5) * F.size("l")
    blocks = F.size(F.filter(F.split("p", "\n\n", -1), lambda x: F.trim(x) != ""))
    head, second = F.get("l", F.lit(0)), F.get("l", F.lit(1))
    title = F.when(head.rlike("^Capítulo [0-9]+$") & (F.size("l") > 1), F.concat(head, F.lit(". "), F.md5(second.cast("binary")))).otherwise(F.md5(head.cast("binary")))
    return d.select("doc_id", F.when(index, "lines").otherwise("paragraphs").alias("kind"), F.when(index, F.size("l")).otherwise(blocks).alias("pieces"), title.alias("title"))


@query(
    """
WITH v AS (SELECT doc_id, md5(coalesce(text, '')) AS audio, md5(coalesce(source, '')) AS spoken, lang AS verdict FROM documents WHERE doc_id % 2 = 0), q AS (SELECT doc_id, md5(coalesce(text, '')) AS audio, md5(coalesce(CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE source END, '')) AS spoken FROM documents WHERE doc_id % 2 = 1),
s AS (SELECT audio, spoken, min(doc_id) AS stored FROM v GROUP BY ALL) SELECT q.doc_id AS doc_id, s.stored AS stored, s.stored IS NOT NULL AS reused FROM q LEFT JOIN s ON s.audio = q.audio AND s.spoken = q.spoken
"""
)
def verdict_reuse(t):
    """EVT07, EVT08, EVT09: a stored verdict serves again only where both the audio and the text spoken are the same."""
    key = lambda c: F.md5(F.coalesce(c, F.lit("")).cast("binary"))
    stored = t("documents").filter("doc_id % 2 = 0").groupBy(key(F.col("text")).alias("audio"), key(F.col("source")).alias("spoken")).agg(F.min("doc_id").alias("stored"))
    asked = t("documents").filter("doc_id % 2 = 1").select("doc_id", key(F.col("text")).alias("audio"), key(F.when(F.col("doc_id") % 5 == 0, "changed").otherwise(F.col("source"))).alias("spoken"))
    return asked.join(stored, ["audio", "spoken"], "left").select("doc_id", "stored", F.col("stored").isNotNull().alias("reused"))


@query(
    """
WITH p AS (SELECT conv_id, list(turn ORDER BY turn) AS ids FROM conversations GROUP BY 1), a AS (SELECT conv_id, ids, [CAST(conv_id % 3 AS BIGINT), CAST(conv_id % 9 AS BIGINT)] AS chosen FROM p)
SELECT conv_id, CASE WHEN conv_id % 10 = 9 THEN 'none chosen' WHEN len(list_filter(chosen, lambda x: NOT list_contains(ids, x))) > 0 THEN 'unknown section' ELSE 'fine' END AS answer FROM a
"""
)
def chosen_sections(t):
    """PRJ02: the sections chosen for narration must all be in the plan, and there must be some."""
    p = t("conversations").groupBy("conv_id").agg(F.collect_set("turn").alias("ids"))
    chosen = F.array(F.col("conv_id") % 3, F.col("conv_id") % 9)
    return p.select("conv_id", F.when(F.col("conv_id") % 10 == 9, "none chosen").when(F.size(F.array_except(chosen, "ids")) > 0, "unknown section").otherwise("fine").alias("answer"))


@query(
    """
WITH v AS (SELECT s_suppkey, s_nationkey % 5 = 0 AS peninsular, s_nationkey % 3 AS provider, s_acctbal > 0 AS available FROM supplier), j AS (SELECT o_orderkey, o_custkey % 3 AS provider, o_orderkey % 4 = 0 AS strict FROM orders),
b AS (SELECT provider, min(s_suppkey) FILTER (available) AS any_voice, min(s_suppkey) FILTER (available AND peninsular) AS strict_voice FROM v GROUP BY provider)
SELECT o_orderkey, CASE WHEN strict THEN strict_voice ELSE coalesce(strict_voice, any_voice) END AS voice FROM j LEFT JOIN b ON b.provider = j.provider
"""
)
def resolved_voices(t):
    """JON28: a job's voice by priority: the first Peninsular one of its provider, else any, unless only Peninsular ones may be used."""
    v = t("supplier").select("s_suppkey", (F.col("s_nationkey") % 5 == 0).alias("peninsular"), (F.col("s_nationkey") % 3).cast("bigint").alias("provider"), (F.col("s_acctbal") > 0).alias("available"))
    b = v.groupBy("provider").agg(F.min(F.when(F.col("available"), F.col("s_suppkey"))).alias("any_voice"), F.min(F.when(F.col("available") & F.col("peninsular"), F.col("s_suppkey"))).alias("strict_voice"))
    j = t("orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("provider"), (F.col("o_orderkey") % 4 == 0).alias("strict"))
    return j.join(b, "provider", "left").select("o_orderkey", F.when(F.col("strict"), F.col("strict_voice")).otherwise(F.coalesce("strict_voice", "any_voice")).alias("voice"))


@query(
    """
SELECT conv_id, CASE WHEN bool_or(severity = 'blocking') THEN 'failed' WHEN bool_or(severity = 'warning') THEN 'needs_review' ELSE 'passed' END AS status, string_agg(severity || ':' || turn, ',' ORDER BY turn) AS issues
FROM (SELECT conv_id, turn, CASE WHEN length(text) % 40 = 0 THEN 'blocking' WHEN length(text) % 7 = 0 THEN 'warning' ELSE 'info' END AS severity FROM conversations) GROUP BY conv_id
"""
)
def extraction_reports(t):
    """ARR03, ARR05: a report's issues in order, and its status by the worst of them."""
    severity = F.when(F.length("text") % 40 == 0, "blocking").when(F.length("text") % 7 == 0, "warning").otherwise("info")
    rows = t("conversations").select("conv_id", "turn", severity.alias("severity")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "severity"))).alias("issues"))
    has = lambda s: F.exists("issues", lambda x: x["severity"] == s)
    return rows.select("conv_id", F.when(has("blocking"), "failed").when(has("warning"), "needs_review").otherwise("passed").alias("status"), F.array_join(F.transform("issues", lambda x: F.concat_ws(":", x["severity"], x["turn"])), ",").alias("issues"))


@query("SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS sequence FROM conversations ORDER BY conv_id, turn")
def ordered_units(t):
    """SRT03: units in the order of chapter and sequence."""
    return O.numbered(t("conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "sequence").orderBy("conv_id", "turn")
