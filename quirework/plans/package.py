"""Checks on a built package: what was planned against what was built, position by position.

Stand-ins: a conversation is a book, its turns are the planned sections; the built ones are the same turns with faults that
follow from the numbers (a level changed, a section lost, a text cut). Events of a user are the clips of an audio file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.operators import ordered as O
from quirework.plans.registry import n, query

#: Stand-in columns, in words that both engines read alike. Heading: the first word of the text; page marks: every third section.
WORD = "regexp_extract(text, '^([^ ,.]+)', 1)"
PLANNED = f"SELECT conv_id AS book, turn, CAST(length(text) % 2 + 1 AS BIGINT) AS level, {WORD} AS heading, text FROM conversations"
KEPT = "NOT (conv_id % 11 = 3 AND turn = 1)"
LEVEL = "CASE WHEN conv_id % 7 = 2 AND turn % 4 = 1 THEN 3 ELSE CAST(length(text) % 2 + 1 AS BIGINT) END"
BUILT_TEXT = "CASE WHEN conv_id % 5 = 4 AND turn < 3 THEN replace(text, ' ', '  ') WHEN conv_id % 13 = 6 AND turn = 0 THEN substring(text, 2) ELSE text END"
BUILT = f"SELECT conv_id AS book, turn, {LEVEL} AS level, {WORD} AS heading, {BUILT_TEXT} AS text FROM conversations WHERE {KEPT}"


def planned(t) -> DataFrame:
    return t("conversations").select(F.col("conv_id").alias("book"), "turn", (F.length("text") % 2 + 1).cast("bigint").alias("level"), F.expr(WORD).alias("heading"), "text")


def built(t) -> DataFrame:
    return t("conversations").filter(KEPT).select(F.col("conv_id").alias("book"), "turn", F.expr(LEVEL).alias("level"), F.expr(WORD).alias("heading"), F.expr(BUILT_TEXT).alias("text"))


def _placed(df: DataFrame) -> DataFrame:
    """Sections numbered from 1 in reading order."""
    return O.numbered(df, ["book"], ["turn"], "position")


_POSITION = "CAST(row_number() OVER (PARTITION BY book ORDER BY turn) AS BIGINT) AS position"
_SQUEEZE = "trim(regexp_replace({}, '[ \\n]+', ' ', 'g'))"


def _squeeze(c: str):
    return F.trim(F.regexp_replace(c, "[ \n]+", " "))


@query(
    f"""
WITH p AS (SELECT *, {_POSITION} FROM ({PLANNED})), b AS (SELECT *, {_POSITION} FROM ({BUILT})),
j AS (SELECT coalesce(p.book, b.book) AS book, position, p.heading IS DISTINCT FROM b.heading AS title, {_SQUEEZE.format('p.text')} IS DISTINCT FROM {_SQUEEZE.format('b.text')} AS words FROM (SELECT * FROM p WHERE position <= 3) p FULL JOIN (SELECT * FROM b WHERE position <= 3) b USING (book, position))
SELECT book, CAST(count(*) AS BIGINT) AS files, CAST(count(*) FILTER (title) AS BIGINT) AS titles, CAST(count(*) FILTER (words) AS BIGINT) AS texts, CASE WHEN count(*) FILTER (title OR words) > 0 THEN 'failed' ELSE 'passed' END AS status FROM j GROUP BY book
"""
)
def initial_files(t):
    """CMP28: the first three sections, in order, say word for word what was planned."""
    p, b = (_placed(x(t)).filter("position <= 3").select("book", "position", F.col("heading").alias(f"{k}_heading"), _squeeze("text").alias(f"{k}_text")) for k, x in (("p", planned), ("b", built)))
    differ = lambda c: ~F.col(f"p_{c}").eqNullSafe(F.col(f"b_{c}"))
    return p.join(b, ["book", "position"], "full_outer").groupBy("book").agg(
        n().alias("files"), F.count_if(differ("heading")).alias("titles"), F.count_if(differ("text")).alias("texts"), F.when(F.count_if(differ("heading") | differ("text")) > 0, "failed").otherwise("passed").alias("status")
    )


@query(
    f"""
WITH p AS (SELECT *, {_POSITION} FROM ({PLANNED})), b AS (SELECT *, {_POSITION} FROM ({BUILT})),
j AS (SELECT book, p.level AS wanted, b.level AS found FROM p FULL JOIN b USING (book, position))
SELECT book, CAST(count(wanted) AS BIGINT) AS planned, CAST(count(found) AS BIGINT) AS built, CAST(count(*) FILTER (wanted IS DISTINCT FROM found) AS BIGINT) AS differ, max(found) AS depth, CASE WHEN count(wanted) <> count(found) OR count(*) FILTER (wanted IS DISTINCT FROM found) > 0 OR max(found) > 2 THEN 'failed' ELSE 'passed' END AS status FROM j GROUP BY book
"""
)
def hierarchy(t):
    """CMP29: as many sections as planned, each on its level, and no deeper navigation than two."""
    p, b = _placed(planned(t)).select("book", "position", F.col("level").alias("wanted")), _placed(built(t)).select("book", "position", F.col("level").alias("found"))
    differ = F.count_if(~F.col("wanted").eqNullSafe(F.col("found")))
    rows = p.join(b, ["book", "position"], "full_outer").groupBy("book").agg(F.count("wanted").alias("planned"), F.count("found").alias("built"), differ.alias("differ"), F.max("found").alias("depth"))
    return rows.withColumn("status", F.when((F.col("planned") != F.col("built")) | (F.col("differ") > 0) | (F.col("depth") > 2), "failed").otherwise("passed"))


_MARKS = "SELECT conv_id AS book, turn, CAST(10 + turn // 2 AS VARCHAR) AS label, turn % 5 = 3 AND conv_id % 3 = 0 AS has_audio, NOT (conv_id % 17 = 5 AND turn = 0) AS resolved FROM conversations WHERE turn % 3 <> 1"
_TARGETS = "SELECT conv_id AS book, turn, CASE WHEN conv_id % 19 = 7 AND turn = 2 THEN '?' ELSE CAST(10 + turn // 2 AS VARCHAR) END AS label FROM conversations WHERE turn % 3 <> 1 AND NOT (conv_id % 23 = 9 AND turn = 3)"


@query(
    f"""
WITH m AS (SELECT *, {_POSITION} FROM ({_MARKS})), g AS (SELECT *, {_POSITION} FROM ({_TARGETS})),
j AS (SELECT coalesce(m.book, g.book) AS book, m.label AS label, coalesce(m.has_audio, false) AS loud, m.resolved = false AS lost, m.label IS DISTINCT FROM g.label AS differ, count(*) OVER (PARTITION BY m.book, m.label) > 1 AND m.label IS NOT NULL AS again FROM m FULL JOIN g USING (book, position))
SELECT book, CAST(count(label) AS BIGINT) AS pages, CAST(count(*) FILTER (loud) AS BIGINT) AS loud, CAST(count(*) FILTER (lost) AS BIGINT) AS lost, CAST(count(*) FILTER (differ) AS BIGINT) AS misaligned, CAST(count(DISTINCT CASE WHEN again THEN label END) AS BIGINT) AS repeated, max(CAST(label AS BIGINT)) AS highest,
       CASE WHEN count(*) FILTER (loud OR lost OR differ) > 0 THEN 'failed' WHEN count(*) FILTER (again) > 0 THEN 'warning' ELSE 'passed' END AS status
FROM j GROUP BY book
"""
)
def page_marks(t):
    """CMP30: page marks are silent and lead somewhere, the page list has the same labels in order; repeated labels are a warning."""
    c = t("conversations").filter("turn % 3 <> 1").select(F.col("conv_id").alias("book"), "turn", (F.floor(F.col("turn") / 2) + 10).cast("string").alias("label"))
    marks = _placed(c.withColumns({"has_audio": F.expr("turn % 5 = 3 AND book % 3 = 0"), "resolved": F.expr("NOT (book % 17 = 5 AND turn = 0)")}))
    targets = _placed(c.filter("NOT (book % 23 = 9 AND turn = 3)").withColumn("label", F.when(F.expr("book % 19 = 7 AND turn = 2"), "?").otherwise(F.col("label")))).select("book", "position", F.col("label").alias("target"))
    counts = marks.groupBy("book", "label").agg((n() > 1).alias("again"))
    rows = marks.join(counts, ["book", "label"]).join(targets, ["book", "position"], "full_outer")
    loud, lost, differ, again = F.coalesce("has_audio", F.lit(False)), ~F.coalesce("resolved", F.lit(True)), ~F.col("label").eqNullSafe(F.col("target")), F.coalesce("again", F.lit(False))
    return rows.groupBy("book").agg(
        F.count("label").alias("pages"), F.count_if(loud).alias("loud"), F.count_if(lost).alias("lost"), F.count_if(differ).alias("misaligned"), F.count_distinct(F.when(again, F.col("label"))).alias("repeated"),
        F.max(F.col("label").cast("bigint")).alias("highest"), F.when(F.count_if(loud | lost | differ) > 0, "failed").when(F.count_if(again) > 0, "warning").otherwise("passed").alias("status"),
    )


@query(
    f"""
WITH s AS (SELECT *, CASE WHEN turn % 3 = 0 THEN CAST(10 + turn AS VARCHAR) END AS mark FROM ({BUILT})),
p AS (SELECT book, turn, level, heading, last_value(mark IGNORE NULLS) OVER (PARTITION BY book ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page FROM s)
SELECT book, coalesce(string_agg(CASE WHEN page IS NULL THEN heading || '.' ELSE heading || '. Página ' || page || '.' END, ' | ' ORDER BY turn) FILTER (level <= 2), '') AS entries, CAST(count(*) FILTER (level <= 2 AND page IS NULL) AS BIGINT) AS unpaged FROM p GROUP BY book
"""
)
def index_entries(t):
    """CMP31: the entries that the index must have: sections down to the second level with the page in effect where they begin, in order."""
    s = built(t).withColumn("mark", F.when(F.col("turn") % 3 == 0, (F.col("turn") + 10).cast("string")))
    p = O.carried(s, ["book"], ["turn"], F.col("mark"), "page").withColumn("listed", F.col("level") <= 2)
    entry = F.when(F.col("page").isNull(), F.concat("heading", F.lit("."))).otherwise(F.concat("heading", F.lit(". Página "), "page", F.lit(".")))
    rows = p.groupBy("book").agg(F.array_sort(F.collect_list(F.when(F.col("listed"), F.struct("turn", entry.alias("entry"))))).alias("all"), F.count_if(F.col("listed") & F.col("page").isNull()).alias("unpaged"))
    return rows.select("book", F.array_join(F.transform("all", lambda x: x["entry"]), " | ").alias("entries"), "unpaged")


_NOTES = "SELECT conv_id AS book, turn, CASE WHEN conv_id % 6 = 1 AND turn = 1 THEN 'Nota sin número. ' ELSE 'Nota ' || (turn + 1) || '. ' END || " + WORD + " || CASE WHEN conv_id % 9 = 4 AND turn = 2 THEN '' ELSE ' Fin de nota ' || CASE WHEN conv_id % 14 = 8 THEN turn ELSE turn + 1 END || '.' END AS note FROM conversations"


@query(
    rf"""
WITH x AS (SELECT book, note, regexp_extract(note, '^Nota ([0-9]+)\.( |$)', 1) AS number FROM ({_NOTES}))
SELECT book, CAST(count(*) AS BIGINT) AS notes, CAST(count(*) FILTER (number = '') AS BIGINT) AS no_opening, CAST(count(*) FILTER (number <> '' AND NOT ends_with(note, 'Fin de nota ' || number || '.')) AS BIGINT) AS no_closing FROM x GROUP BY book
"""
)
def note_templates(t):
    """CMP32, SRC25: each note begins with its number and ends with the same one."""
    text = F.concat(
        F.when(F.expr("conv_id % 6 = 1 AND turn = 1"), "Nota sin número. ").otherwise(F.concat(F.lit("Nota "), F.col("turn") + 1, F.lit(". "))), F.expr(WORD),
        F.when(F.expr("conv_id % 9 = 4 AND turn = 2"), "").otherwise(F.concat(F.lit(" Fin de nota "), F.when(F.expr("conv_id % 14 = 8"), F.col("turn")).otherwise(F.col("turn") + 1), F.lit("."))),
    )
    x = t("conversations").select(F.col("conv_id").alias("book"), text.alias("note")).withColumn("number", F.regexp_extract("note", r"^Nota ([0-9]+)\.( |$)", 1))
    unclosed = (F.col("number") != "") & ~F.endswith("note", F.concat(F.lit("Fin de nota "), "number", F.lit(".")))
    return x.groupBy("book").agg(n().alias("notes"), F.count_if(F.col("number") == "").alias("no_opening"), F.count_if(unclosed).alias("no_closing"))


_FRAMES = "SELECT conv_id AS book, turn // 3 AS frame, turn, CASE turn % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'text' ELSE 'close' END AS kind, CASE WHEN conv_id % 8 = 5 AND turn = 4 THEN 1 ELSE 0 END AS sequence FROM conversations WHERE NOT (conv_id % 10 = 7 AND turn = 3)"


@query(
    f"""
SELECT book, frame, arg_min(kind, turn) = 'open' AS opened, arg_max(kind, turn) = 'close' AND count(*) > 1 AS closed, count(*) > 2 AS filled, count(DISTINCT sequence) = 1 AS together FROM ({_FRAMES}) GROUP BY book, frame
"""
)
def frames(t):
    """CMP33: every frame is announced first and last, holds a text, and lies in one sequence."""
    kind = F.when(F.col("turn") % 3 == 0, "open").when(F.col("turn") % 3 == 1, "text").otherwise("close")
    x = t("conversations").filter("NOT (conv_id % 10 = 7 AND turn = 3)").select(F.col("conv_id").alias("book"), F.floor(F.col("turn") / 3).alias("frame"), "turn", kind.alias("kind"), F.when(F.expr("conv_id % 8 = 5 AND turn = 4"), 1).otherwise(0).alias("sequence"))
    return x.groupBy("book", "frame").agg((F.min_by("kind", "turn") == "open").alias("opened"), ((F.max_by("kind", "turn") == "close") & (n() > 1)).alias("closed"), (n() > 2).alias("filled"), (F.count_distinct("sequence") == 1).alias("together"))


@query(
    """
WITH x AS (SELECT conv_id AS book, turn, CASE WHEN conv_id % 12 = 5 AND turn > 1 THEN turn + 2 ELSE turn + 1 END AS number, (conv_id * 13 + turn * 7) % 2000 AS image FROM conversations WHERE role = 'user' OR turn % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY turn) AS k FROM x)
SELECT book, CAST(count(*) AS BIGINT) AS photos, CAST(count(*) FILTER (number <> k) AS BIGINT) AS misnumbered, CAST(count(*) FILTER (p_partkey IS NULL) AS BIGINT) AS no_image, CASE WHEN count(*) FILTER (number <> k) > 0 THEN 'failed' WHEN count(*) FILTER (p_partkey IS NULL) > 0 THEN 'warning' ELSE 'passed' END AS status
FROM r LEFT JOIN (SELECT DISTINCT p_partkey FROM part WHERE p_size > 3) ON p_partkey = image GROUP BY book
"""
)
def photo_numbers(t):
    """CMP34, JON22: photographs are numbered from 1 on in order; an image that is not in the manifest is a warning."""
    x = t("conversations").filter("role = 'user' or turn % 2 = 1").select(F.col("conv_id").alias("book"), "turn", F.when(F.expr("conv_id % 12 = 5 AND turn > 1"), F.col("turn") + 2).otherwise(F.col("turn") + 1).alias("number"), F.expr("(conv_id * 13 + turn * 7) % 2000").alias("image"))
    manifest = t("part").filter("p_size > 3").select(F.col("p_partkey").alias("image")).distinct().withColumn("there", F.lit(True))
    rows = O.numbered(x, ["book"], ["turn"], "k").join(manifest, "image", "left")
    wrong, absent = F.count_if(F.col("number") != F.col("k")), F.count_if(F.col("there").isNull())
    return rows.groupBy("book").agg(n().alias("photos"), wrong.alias("misnumbered"), absent.alias("no_image"), F.when(wrong > 0, "failed").when(absent > 0, "warning").otherwise("passed").alias("status"))


_CLOSING = "SELECT conv_id AS book, turn, CASE WHEN turn = m AND conv_id % 9 <> 4 OR conv_id % 15 = 2 AND turn = 0 THEN 'Fin de la obra' ELSE text END AS text FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations)"


@query(
    f"""
SELECT book, CAST(count(*) FILTER (text = 'Fin de la obra') AS BIGINT) AS said, arg_max(text, turn) = 'Fin de la obra' AS last, CASE WHEN count(*) FILTER (text = 'Fin de la obra') = 1 AND arg_max(text, turn) = 'Fin de la obra' THEN 'passed' ELSE 'failed' END AS status FROM ({_CLOSING}) GROUP BY book
"""
)
def closing_phrase(t):
    """CMP35: the closing phrase is read once, and last."""
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    x = t("conversations").withColumn("m", last).select(F.col("conv_id").alias("book"), "turn", F.when(F.expr("turn = m AND conv_id % 9 <> 4 OR conv_id % 15 = 2 AND turn = 0"), "Fin de la obra").otherwise(F.col("text")).alias("text"))
    said, at_end = F.count_if(F.col("text") == "Fin de la obra"), F.max_by("text", "turn") == "Fin de la obra"
    return x.groupBy("book").agg(said.alias("said"), at_end.alias("last"), F.when((said == 1) & at_end, "passed").otherwise("failed").alias("status"))


_CLIPS = "SELECT user_id AS audio, event_id, ts, floor(value * 1000) AS begin_ms, floor(value * 1000) + CASE WHEN event_id % 31 = 0 THEN 0 ELSE event_id % 900 END AS end_ms, 190000 + user_id * 10 AS total_ms, event_id % 12000 AS target FROM events"


@query(
    f"""
WITH c AS (SELECT *, max(end_ms) OVER (PARTITION BY audio ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({_CLIPS}))
SELECT audio, event_id, CASE WHEN d.doc_id IS NULL THEN 'no target' WHEN end_ms <= begin_ms THEN 'empty' WHEN end_ms > total_ms + 20 THEN 'past the end' WHEN begin_ms < before - 20 THEN 'before the last one ends' ELSE 'fine' END AS problem
FROM c LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d ON d.doc_id = target
"""
)
def clip_checks(t):
    """CMP37, CMP20, JON18: each clip leads to a text, is not empty, ends within its audio and does not begin before the last one ends."""
    ms = F.floor(F.col("value") * 1000)
    c = t("events").select(F.col("user_id").alias("audio"), "event_id", "ts", ms.alias("begin_ms"), (ms + F.when(F.col("event_id") % 31 == 0, 0).otherwise(F.col("event_id") % 900)).alias("end_ms"), (F.col("user_id") * 10 + 190000).alias("total_ms"), (F.col("event_id") % 12000).alias("doc_id"))
    c = c.withColumn("before", F.max("end_ms").over(O.before(["audio"], ["ts", "event_id"])))
    rows = c.join(t("documents").select("doc_id").distinct().withColumn("there", F.lit(True)), "doc_id", "left")
    problem = (
        F.when(F.col("there").isNull(), "no target").when(F.col("end_ms") <= F.col("begin_ms"), "empty").when(F.col("end_ms") > F.col("total_ms") + 20, "past the end")
        .when(F.col("begin_ms") < F.col("before") - 20, "before the last one ends").otherwise("fine")
    )
    return rows.select("audio", "event_id", problem.alias("problem"))


_ELAPSED = "SELECT conv_id AS book, turn, CAST(length(text) * 10 AS BIGINT) AS ms, CASE WHEN conv_id % 16 = 3 AND turn > 2 THEN 40 WHEN conv_id % 16 = 4 THEN 1 ELSE 0 END AS off, 22050 * (1 + CASE WHEN conv_id % 20 = 11 AND turn = 1 THEN 1 ELSE 0 END) AS rate FROM conversations"


@query(
    f"""
WITH e AS (SELECT *, coalesce(sum(ms) OVER (PARTITION BY book ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS own FROM ({_ELAPSED})),
d AS (SELECT *, own + off AS declared FROM e)
SELECT book, CAST(count(*) FILTER (abs(own - declared) > 1.5) AS BIGINT) AS late, abs(sum(ms) - (sum(ms) + max(off))) > 1.5 AS wrong_total, CAST(count(DISTINCT rate) AS BIGINT) AS formats,
       CASE WHEN count(*) FILTER (abs(own - declared) > 1.5) > 0 OR count(DISTINCT rate) > 1 THEN 'failed' ELSE 'passed' END AS status FROM d GROUP BY book
"""
)
def timing_checks(t):
    """CMP25, AGG21, AGG22: declared elapsed times against the running sum (1.5 ms), and one audio format for all files."""
    off = F.when(F.expr("conv_id % 16 = 3 AND turn > 2"), 40).when(F.expr("conv_id % 16 = 4"), 1).otherwise(0)
    e = t("conversations").select(F.col("conv_id").alias("book"), "turn", (F.length("text") * 10).cast("bigint").alias("ms"), off.alias("off"), F.when(F.expr("conv_id % 20 = 11 AND turn = 1"), 44100).otherwise(22050).alias("rate"))
    e = O.running(e, ["book"], ["turn"], F.col("ms"), "own", inclusive=False).withColumn("declared", F.col("own") + F.col("off"))
    late = F.count_if(F.abs(F.col("own") - F.col("declared")) > 1.5)
    wrong = F.abs(F.sum("ms") - (F.sum("ms") + F.max("off"))) > 1.5
    return e.groupBy("book").agg(late.alias("late"), wrong.alias("wrong_total"), F.count_distinct("rate").alias("formats"), F.when((late > 0) | (F.count_distinct("rate") > 1), "failed").otherwise("passed").alias("status"))


_STATUS = f"""
SELECT p.book AS book, 'levels' AS name, CASE WHEN count(*) FILTER (p.level IS DISTINCT FROM b.level) > 0 THEN 'failed' ELSE 'passed' END AS status FROM ({PLANNED}) p LEFT JOIN ({BUILT}) b ON p.book = b.book AND p.turn = b.turn GROUP BY p.book
UNION ALL SELECT book, 'closing', CASE WHEN arg_max(text, turn) = 'Fin de la obra' THEN 'passed' ELSE 'failed' END FROM ({_CLOSING}) GROUP BY book
UNION ALL SELECT book, 'formats', CASE WHEN count(DISTINCT rate) > 1 THEN 'warning' ELSE 'passed' END FROM ({_ELAPSED}) GROUP BY book
"""


@query(f"SELECT book, string_agg(name || '=' || status, ',' ORDER BY name) AS checks, CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'passed' END AS status FROM ({_STATUS}) GROUP BY book")
def check_summary(t):
    """AGG19, AGG20, CMP26: all checks of a book by name, and failed if any of them failed."""
    p, b = planned(t).select("book", "turn", "level"), built(t).select("book", "turn", F.col("level").alias("found"))
    levels = p.join(b, ["book", "turn"], "left").groupBy("book").agg(F.when(F.count_if(~F.col("level").eqNullSafe(F.col("found"))) > 0, "failed").otherwise("passed").alias("status"))
    closing = closing_phrase(t).select("book", F.when(F.col("last"), "passed").otherwise("failed").alias("status"))
    formats = timing_checks(t).select("book", F.when(F.col("formats") > 1, "warning").otherwise("passed").alias("status"))
    every = [x.select("book", F.lit(k).alias("name"), "status") for k, x in (("levels", levels), ("closing", closing), ("formats", formats))]
    rows = every[0].unionAll(every[1]).unionAll(every[2])
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", "status"))), ",")
    return rows.groupBy("book").agg(text.alias("checks"), F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise("passed").alias("status"))


_PRODUCED = "SELECT conv_id AS book, turn, conv_id || '-' || turn AS unit_id, CASE WHEN conv_id % 6 = 2 AND turn = 1 THEN 'x' || text WHEN conv_id % 8 = 3 AND turn = 2 THEN 'otra' ELSE text END AS text, CASE WHEN conv_id % 5 = 1 AND turn = 0 THEN 'failed' ELSE 'verified' END AS state, CASE WHEN conv_id % 21 = 4 THEN NULL WHEN conv_id % 22 = 5 AND turn = 1 THEN 0 ELSE length(text) END AS bytes FROM conversations WHERE NOT (conv_id % 9 = 7 AND turn = 0)"
_FIXED = "SELECT DISTINCT user_id || '-' || (event_id % 4) AS unit_id FROM events WHERE event_type = 'purchase'"


def _produced(t) -> DataFrame:
    text = F.when(F.expr("conv_id % 6 = 2 AND turn = 1"), F.concat(F.lit("x"), "text")).when(F.expr("conv_id % 8 = 3 AND turn = 2"), "otra").otherwise(F.col("text"))
    size = F.when(F.expr("conv_id % 21 = 4"), None).when(F.expr("conv_id % 22 = 5 AND turn = 1"), 0).otherwise(F.length("text"))
    state = F.when(F.expr("conv_id % 5 = 1 AND turn = 0"), "failed").otherwise("verified")
    return t("conversations").filter("NOT (conv_id % 9 = 7 AND turn = 0)").select(F.col("conv_id").alias("book"), "turn", F.concat_ws("-", "conv_id", "turn").alias("unit_id"), text.alias("text"), state.alias("state"), size.alias("bytes"))


@query(
    f"""
WITH e AS (SELECT conv_id AS book, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS position, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
p AS (SELECT x.book, x.unit_id, x.text, f.unit_id IS NOT NULL AS corrected, CAST(row_number() OVER (PARTITION BY x.book ORDER BY x.turn) AS BIGINT) AS position, count(*) OVER (PARTITION BY x.book) AS m FROM ({_PRODUCED}) x LEFT JOIN ({_FIXED}) f ON f.unit_id = x.unit_id)
SELECT coalesce(e.book, p.book) AS book, coalesce(e.position, p.position) AS position, CASE WHEN p.text IS NULL THEN 'missing' WHEN e.text IS NULL THEN 'extra' ELSE 'changed' END AS kind
FROM e FULL JOIN p ON e.book = p.book AND e.position = p.position WHERE e.text IS DISTINCT FROM p.text AND NOT (coalesce(p.corrected, false) AND e.n = p.m)
"""
)
def source_to_units(t):
    """CMP18, WIN14: the expected units against the produced ones, position by position; where both are as many, a reviewer's correction stands for the text it replaced."""
    size = lambda name: F.count("*").over(Window.partitionBy("book")).alias(name)
    e = _placed(t("conversations").select(F.col("conv_id").alias("book"), "turn", "text")).select("book", "position", F.col("text").alias("expected"), size("n"))
    fixed = t("events").filter("event_type = 'purchase'").select(F.concat_ws("-", "user_id", F.col("event_id") % 4).alias("unit_id")).distinct().withColumn("corrected", F.lit(True))
    p = _placed(_produced(t)).join(fixed, "unit_id", "left").select("book", "position", F.col("text").alias("produced"), F.coalesce("corrected", F.lit(False)).alias("corrected"), size("m"))
    rows = e.join(p, ["book", "position"], "full_outer").filter(~F.col("expected").eqNullSafe(F.col("produced")) & ~F.coalesce(F.col("corrected") & (F.col("n") == F.col("m")), F.lit(False)))
    return rows.select("book", "position", F.when(F.col("produced").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("changed").alias("kind"))


@query(
    f"""
WITH e AS (SELECT conv_id AS book, text, count(*) AS n FROM conversations GROUP BY ALL), p AS (SELECT book, text, count(*) AS m FROM ({_PRODUCED}) GROUP BY ALL)
SELECT p.book AS book, md5(p.text) AS text_md5, CAST(m - coalesce(n, 0) AS BIGINT) AS more FROM p LEFT JOIN e ON e.book = p.book AND e.text = p.text WHERE m > coalesce(n, 0)
"""
)
def overproduced_units(t):
    """AGG18, SET02: texts produced more often than expected."""
    e = t("conversations").groupBy(F.col("conv_id").alias("book"), "text").agg(n().alias("n"))
    p = _produced(t).groupBy("book", "text").agg(n().alias("m")).join(e, ["book", "text"], "left")
    more = F.col("m") - F.coalesce("n", F.lit(0))
    return p.filter(more > 0).select("book", F.md5(F.col("text").cast("binary")).alias("text_md5"), more.alias("more"))


@query(f"SELECT unit_id, CASE WHEN state <> 'verified' THEN 'state ' || state WHEN coalesce(bytes, 0) = 0 THEN 'no audio' ELSE 'fine' END AS problem FROM ({_PRODUCED})")
def units_to_audio(t):
    """CMP19: every unit is verified and has audio that is not empty."""
    problem = F.when(F.col("state") != "verified", F.concat(F.lit("state "), "state")).when(F.coalesce("bytes", F.lit(0)) == 0, "no audio").otherwise("fine")
    return _produced(t).select("unit_id", problem.alias("problem"))


@query(
    """
WITH s AS (SELECT conv_id AS book, turn, CASE WHEN turn % 4 = 3 THEN '' ELSE regexp_extract(text, '^([^ ,.]+)', 1) END AS title, text, CAST(turn // 2 AS BIGINT) AS chapter FROM conversations),
u AS (SELECT book, chapter, turn, -1 AS part, title AS text FROM s WHERE title <> '' AND turn % 2 = 0 UNION ALL SELECT book, chapter, turn, pos, line FROM (SELECT book, chapter, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM s) WHERE trim(line) <> '')
SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY turn, part) AS BIGINT) AS ordinal, chapter, part = -1 AS heading, md5(text) AS text_md5 FROM u
"""
)
def expected_units(t):
    """WIN14, SEG13, PRJ22: the units to narrate in order: a section's heading, unless it has none, then its paragraphs; blank ones have none."""
    s = t("conversations").select(F.col("conv_id").alias("book"), "turn", F.when(F.col("turn") % 4 == 3, "").otherwise(F.expr(WORD)).alias("title"), "text", F.floor(F.col("turn") / 2).alias("chapter"))
    heads = s.filter("title <> '' and turn % 2 = 0").select("book", "chapter", "turn", F.lit(-1).alias("part"), F.col("title").alias("line"))
    parts = s.select("book", "chapter", "turn", F.posexplode(F.split("text", "\n", -1)).alias("part", "line")).filter(F.trim("line") != "")
    rows = O.numbered(heads.unionAll(parts), ["book"], ["turn", "part"], "ordinal")
    return rows.select("book", "ordinal", "chapter", (F.col("part") == -1).alias("heading"), F.md5(F.col("line").cast("binary")).alias("text_md5"))


@query(
    """
WITH f AS (SELECT conv_id AS chapter, count(*) AS n, count(*) FILTER (length(text) > 100) AS framed FROM conversations GROUP BY 1) SELECT chapter, n >= 1 AND framed >= 4 AND framed >= 0.9 * n AS layout FROM f
"""
)
def layout_frames(t):
    """AGG15: a frame that covers four paragraphs or more and nine tenths of its chapter is layout, not a box."""
    f = t("conversations").groupBy(F.col("conv_id").alias("chapter")).agg(n().alias("n"), F.count_if(F.length("text") > 100).alias("framed"))
    return f.select("chapter", ((F.col("framed") >= 4) & (F.col("framed") >= F.lit(0.9) * F.col("n"))).alias("layout"))


@query(
    """
WITH p AS (SELECT user_id AS unit_id, event_id, CAST(floor(value * 100) AS BIGINT) AS moment, CASE WHEN event_type = 'click' THEN CAST(event_id % 50 AS BIGINT) ELSE 0 END AS pause FROM events)
SELECT unit_id, event_id, moment, CAST(moment + sum(pause) OVER (PARTITION BY unit_id ORDER BY moment RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS shifted FROM p
"""
)
def shifted_times(t):
    """WIN07: a moment moves by all pauses at or before it."""
    p = t("events").select(F.col("user_id").alias("unit_id"), "event_id", F.floor(F.col("value") * 100).cast("bigint").alias("moment"), F.when(F.col("event_type") == "click", F.col("event_id") % 50).otherwise(0).alias("pause"))
    so_far = Window.partitionBy("unit_id").orderBy("moment").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return p.select("unit_id", "event_id", "moment", (F.col("moment") + F.sum("pause").over(so_far)).cast("bigint").alias("shifted"))


@query(
    """
WITH c AS (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS BIGINT) AS clip, CAST(length(text) AS BIGINT) AS ms FROM conversations),
b AS (SELECT conv_id, CAST(sum(total) OVER (PARTITION BY conv_id % 10 ORDER BY conv_id) - total AS BIGINT) AS start_ms FROM (SELECT conv_id, sum(length(text)) AS total FROM conversations GROUP BY 1) WHERE conv_id % 9 <> 8),
f AS (SELECT user_id AS conv_id, event_id % 4 AS turn, event_id, greatest(0, CAST(floor(value * 10) AS BIGINT) - CAST(event_id % 120 AS BIGINT)) AS trimmed FROM events WHERE event_type = 'error'),
x AS (SELECT f.conv_id % 10 AS book, f.conv_id AS chapter, event_id, least(clip + ms, clip + trimmed) AS chapter_ms, start_ms + least(clip + ms, clip + trimmed) AS book_ms FROM f JOIN c ON c.conv_id = f.conv_id AND c.turn = f.turn LEFT JOIN b ON b.conv_id = f.conv_id)
SELECT *, CAST(row_number() OVER (PARTITION BY book ORDER BY book_ms NULLS LAST, chapter, chapter_ms, event_id) AS BIGINT) AS listed FROM x
"""
)
def fault_locations(t):
    """JON21, SRT04: a moment in a unit's own audio as a time of its chapter's file and of the book (if the chapter has a start), listed by book time, unknown ones last."""
    c = O.running(t("conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("ms")), ["conv_id"], ["turn"], F.col("ms"), "clip", inclusive=False)
    totals = c.groupBy("conv_id").agg(F.sum("ms").alias("total")).filter("conv_id % 9 <> 8").withColumn("book", F.col("conv_id") % 10)
    starts = O.running(totals, ["book"], ["conv_id"], F.col("total"), "start_ms", inclusive=False).select("conv_id", "start_ms")
    trimmed = F.greatest(F.lit(0), F.floor(F.col("value") * 10).cast("bigint") - F.col("event_id") % 120)
    f = t("events").filter("event_type = 'error'").select(F.col("user_id").alias("conv_id"), (F.col("event_id") % 4).alias("turn"), "event_id", trimmed.alias("trimmed"))
    rows = f.join(c, ["conv_id", "turn"]).join(starts, "conv_id", "left").withColumn("chapter_ms", F.least(F.col("clip") + F.col("ms"), F.col("clip") + F.col("trimmed")).cast("bigint"))
    rows = rows.select((F.col("conv_id") % 10).alias("book"), F.col("conv_id").alias("chapter"), "event_id", "chapter_ms", (F.col("start_ms") + F.col("chapter_ms")).cast("bigint").alias("book_ms"))
    return O.numbered(rows, ["book"], [F.col("book_ms").asc_nulls_last(), "chapter", "chapter_ms", "event_id"], "listed")
