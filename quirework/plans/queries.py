"""The registered queries of the document and production analytics: name -> (plan, SQL).

The supplied tables stand in for the engine's own relations: orders for jobs, lineitem for units,
events for events and attempts, conversations for the ordered units of a chapter, documents for
sources, labels for reviewer decisions, benchmark for reference passages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import ordered as O
from quirework.operators import relational as R
from quirework.plans.registry import PLANS, SQL, query, tables
from quirework.plans.registry import n as _n

__all__ = ["PLANS", "SQL", "queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, plan=plan: plan(tables(spark, sf_dir))) for name, plan in PLANS.items()}


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def _text_key(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.md5(F.coalesce("text", F.lit("")).cast("binary")))


# ---------------------------------------------------------------- units and lines


@query(
    r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
o AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS text_start FROM l)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, left(sha256(concat_ws(':', source, doc_id, pos, 'paragraph', line)), 24) AS unit_id, text_start, CAST(text_start + length(line) AS BIGINT) AS text_end
FROM o WHERE trim(line, ' ' || chr(9)) <> ''
"""
)
def unit_ids(t):
    """SEG03: one unit per non-blank line, with a stable id and half-open offsets."""
    lines = t("documents").filter("text is not null").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = O.running(lines, ["doc_id"], ["pos"], F.length("line") + 1, "text_start", inclusive=False)
    return lines.filter(F.trim("line", F.lit(" \t")) != "").select(
        "doc_id",
        F.col("pos").cast("bigint").alias("pos"),
        T.unit_id(F.col("source"), F.col("doc_id").cast("string"), F.col("pos").cast("string"), F.lit("paragraph"), F.col("line")).alias("unit_id"),
        F.col("text_start").cast("bigint").alias("text_start"),
        (F.col("text_start") + F.length("line")).cast("bigint").alias("text_end"),
    )


@query(
    r"""
SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(l, list_prepend(NULL, l)), lambda p: p[1] IS DISTINCT FROM p[2]), lambda p: p[1]), chr(10)) AS text FROM (
  SELECT doc_id, list_transform(string_split(regexp_replace(text, '[­﻿]', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))) AS l
  FROM documents WHERE text IS NOT NULL)
"""
)
def clean_lines(t):
    """STR01: soft hyphens out, white space squeezed, a line equal to the one before dropped."""
    return t("documents").filter("text is not null").select("doc_id", T.clean_lines(F.col("text")).alias("text"))


@query(
    r"""
SELECT doc_id, CAST(es AS INTEGER) AS es, CAST(en AS INTEGER) AS en, CASE WHEN es + en < 3 THEN 'es' WHEN es / (es + en) >= 0.8 THEN 'es' WHEN es / (es + en) <= 0.2 THEN 'en' ELSE 'multi' END AS language FROM (
  SELECT doc_id, len(list_filter(w, lambda x: x IN ({es}))) + len(regexp_extract_all(lower(text), '[áéíóúüñ¿¡]')) AS es, len(list_filter(w, lambda x: x IN ({en}))) AS en
  FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL))
""".format(es=", ".join(f"'{w}'" for w in T.STOP_ES), en=", ".join(f"'{w}'" for w in T.STOP_EN))
)
def language_vote(t):
    """STR22: stop words and accents vote for es, en or multi."""
    w = T.words(F.col("text"))
    count = lambda stop: F.size(F.filter(w, lambda x: x.isin(*stop)))
    d = t("documents").filter("text is not null").select("doc_id", (count(T.STOP_ES) + F.regexp_count(F.lower("text"), F.lit(T.ACCENTS_ES))).alias("es"), count(T.STOP_EN).alias("en"))
    share = F.col("es") / (F.col("es") + F.col("en"))
    vote = F.when(F.col("es") + F.col("en") < 3, "es").when(share >= 0.8, "es").when(share <= 0.2, "en").otherwise("multi")
    return d.withColumn("language", vote)


@query(
    r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)bearer [A-Za-z0-9._\-]+', 'Bearer <redacted>', 'g'), '(?i)(sk|key|api|tok)[-_][A-Za-z0-9]{16,}', '<redacted>', 'g'), '[0-9a-fA-F]{32,}', '<redacted>', 'g') AS text
FROM documents WHERE text IS NOT NULL
"""
)
def redacted(t):
    """STR20: tokens, keys and long hexadecimal strings masked."""
    return t("documents").filter("text is not null").select("doc_id", T.redacted(F.col("text")).alias("text"))


@query(
    r"""
SELECT doc_id, unnest(list_concat(list_transform(regexp_extract_all(text, '[\p{L}]+[0-9]+[\p{L}]+'), lambda x: {'code': 'mixed', 'found': x}),
                                  list_transform(regexp_extract_all(text, '[\p{Ll}]{2,}- [\p{Ll}]{2,}'), lambda x: {'code': 'broken', 'found': x})), recursive := true)
FROM documents
"""
)
def ocr_suspects(t):
    """STR04: words that mix letters and digits or are cut by a hyphen."""
    mixed, broken = T.suspects(F.col("text"))
    rows = lambda code, found: F.transform(found, lambda x: F.struct(F.lit(code).alias("code"), x.alias("found")))
    return t("documents").filter("text is not null").select("doc_id", F.explode(F.concat(rows("mixed", mixed), rows("broken", broken))).alias("s")).select("doc_id", "s.*")


@query(
    r"""
WITH l AS (SELECT doc_id, source, lower(trim(regexp_replace(regexp_replace(unnest(string_split(text, chr(10))), '[0-9]+', '#', 'g'), '[ \t\n\r\f]+', ' ', 'g'))) AS mask FROM documents WHERE text IS NOT NULL),
n AS (SELECT source, count(*) AS docs FROM documents WHERE text IS NOT NULL GROUP BY source)
SELECT source, mask, CAST(count(DISTINCT doc_id) AS BIGINT) AS n FROM l JOIN n USING (source) WHERE mask <> '' AND docs >= 3
GROUP BY source, mask, docs HAVING count(DISTINCT doc_id) >= greatest(3, CAST(floor(0.02 * docs + 0.999) AS BIGINT))
"""
)
def repeated_lines(t):
    """Masked lines that repeat over a source's documents; running_heads has the rule for page edges."""
    docs = t("documents").filter("text is not null")
    sizes = docs.groupBy("source").agg(_n().alias("docs"))
    lines = docs.select("doc_id", "source", F.explode(F.split("text", "\n", -1)).alias("line"))
    each = lines.select("doc_id", "source", T.masked(F.col("line")).alias("mask")).filter("mask <> ''")
    counted = each.groupBy("source", "mask", "doc_id").agg(F.lit(1).alias("one")).groupBy("source", "mask").agg(_n().alias("n"))
    least = F.greatest(F.lit(3), F.floor(F.lit(0.02) * F.col("docs") + 0.999))
    return counted.join(sizes, "source").filter((F.col("docs") >= 3) & (F.col("n") >= least)).select("source", "mask", "n")


@query(
    """
SELECT word, {key} AS phonetic FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM documents WHERE lang = 'es')
""".format(key="".join("replace(" for _ in T.PHONETIC) + "translate(lower(word), 'áéíóúü', 'aeiouu')" + "".join(", " + ", ".join("'" + x.replace("\u0001", "' || chr(1) || '").replace("\u0002", "' || chr(2) || '") + "'" for x in r) + ")" for r in T.PHONETIC))
)
def phonetic_keys(t):
    """STR23: Peninsular phonetic keys of the Spanish vocabulary."""
    vocabulary = t("documents").filter("lang = 'es'").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return vocabulary.select("word", T.phonetic_key(F.col("word")).alias("phonetic"))


@query(
    r"""
SELECT doc_id, CAST(concat('0x', substr(sha256(text || chr(0) || 'take=2'), 1, 8)) AS BIGINT) AS seed,
       left(trim(regexp_replace(regexp_replace(translate(text, 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunAEIOUUN'), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g')), 80) AS file_name
FROM documents WHERE text IS NOT NULL
"""
)
def take_seeds(t):
    """NUM36, STR13: seed of a unit's second take, and a safe file name of eighty characters at most."""
    d = t("documents").filter("text is not null")
    return d.select("doc_id", T.take_seed(F.col("text"), F.lit(2)).alias("seed"), T.safe_name(F.col("text")).alias("file_name"))


# ---------------------------------------------------------------- multisets and coverage


_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(
    rf"""
WITH s AS (SELECT item, count(*) AS s FROM (SELECT unnest({_W}) AS item FROM documents) GROUP BY item),
p AS (SELECT item, count(*) AS p FROM (SELECT unnest({_W}) AS item FROM benchmark) GROUP BY item)
SELECT item, CAST(greatest(0, coalesce(s, 0) - coalesce(p, 0)) AS BIGINT) AS missing, CAST(greatest(0, coalesce(p, 0) - coalesce(s, 0)) AS BIGINT) AS added
FROM s FULL JOIN p USING (item) WHERE coalesce(s, 0) <> coalesce(p, 0)
"""
)
def word_bag_difference(t):
    """SET01, AGG09: words of the sources beyond those produced, and the other way round."""
    items = lambda d: d.select(T.words(F.col("text")).alias("items"))
    return R.bag_difference(items(t("documents")), items(t("benchmark")), None, [])


@query(
    rf"""
WITH s AS (SELECT lang, item, count(*) AS s FROM (SELECT lang, unnest({_W}) AS item FROM documents) GROUP BY ALL),
p AS (SELECT lang, item, count(*) AS p FROM (SELECT lang, unnest({_W}) AS item FROM documents SEMI JOIN labels USING (doc_id)) GROUP BY ALL)
SELECT lang, CAST(sum(s) AS BIGINT) AS words, CAST(sum(greatest(0, s - coalesce(p, 0))) AS BIGINT) AS missing, round(1 - sum(greatest(0, s - coalesce(p, 0))) / sum(s), 6) AS coverage
FROM s LEFT JOIN p USING (lang, item) GROUP BY lang
"""
)
def coverage(t):
    """AGG09: per language, the share of source words that the labelled documents account for."""
    docs = t("documents").select("doc_id", "lang", T.words(F.col("text")).alias("items"))
    s = R.bag(docs, ["lang"], F.col("items"), "s")
    p = R.bag(docs.join(t("labels").select("doc_id").distinct(), "doc_id", "left_semi"), ["lang"], F.col("items"), "p")
    missing = F.sum(F.greatest(F.lit(0), F.col("s") - F.coalesce("p", F.lit(0))))
    out = s.join(p, ["lang", "item"], "left").groupBy("lang").agg(F.sum("s").alias("words"), missing.alias("missing"))
    return out.withColumn("coverage", F.round(1 - F.col("missing") / F.col("words"), 6))


@query(
    rf"""
WITH s AS (SELECT item, count(*) AS s FROM (SELECT unnest({_W}) AS item FROM documents) GROUP BY item),
p AS (SELECT DISTINCT unnest({_W}) AS item FROM benchmark)
SELECT item, CAST(s AS BIGINT) AS missing FROM s ANTI JOIN p USING (item) ORDER BY s DESC, item LIMIT 12
"""
)
def top_missing_words(t):
    """AGG10, SRT05: the twelve most frequent words that no passage has (a top-k report)."""
    s = R.bag(t("documents"), [], T.words(F.col("text")), "missing")
    p = t("benchmark").select(F.explode(T.words(F.col("text"))).alias("item")).distinct()
    return s.join(p, "item", "left_anti").orderBy(F.desc("missing"), "item").limit(12)


@query("SELECT md5(text) AS key, CAST(count(*) - 1 AS BIGINT) AS extra, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY md5(text) HAVING count(*) > 1")
def overproduced_texts(t):
    """AGG18: texts produced more often than once."""
    return _text_key(t("documents").filter("text is not null")).groupBy("key").agg((_n() - 1).alias("extra"), F.min("doc_id").alias("first_doc")).filter("extra > 0")


@query(
    """
SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(coalesce(text, ''))) AS owner, doc_id > min(doc_id) OVER (PARTITION BY md5(coalesce(text, ''))) AS hit FROM documents
"""
)
def cache_dedupe(t):
    """EVT06: the first document of a content key makes it, the others reuse it."""
    return R.first_of_key(_text_key(t("documents")).select("doc_id", "key"), "key", "doc_id").select("doc_id", "owner", "hit")


@query("SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS fingerprint, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id")
def group_fingerprint(t):
    """EVT11: fingerprint of a chapter over its units in order."""
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", "text").alias("line"))))
    return t("conversations").groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").cast("binary"), 256).alias("fingerprint"), _n().alias("n"))


# ---------------------------------------------------------------- jobs and units


@query("SELECT o_orderstatus AS state, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def state_counts(t):
    """AGG01: jobs per state."""
    return t("orders").groupBy(F.col("o_orderstatus").alias("state")).agg(_n().alias("n"))


@query(
    """
SELECT l_orderkey AS job_id, CAST(count(*) AS BIGINT) AS units, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS failed,
       CAST(count(*) FILTER (l_linestatus = 'O') AS BIGINT) AS pending, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS attempts, max(l_shipdate) AS updated_at
FROM lineitem GROUP BY 1
"""
)
def job_rollup(t):
    """AGG02, UI12: conditional counts and sums per job."""
    return t("lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(
        _n().alias("units"),
        F.count_if(F.col("l_returnflag") == "R").alias("failed"),
        F.count_if(F.col("l_linestatus") == "O").alias("pending"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("attempts"),
        F.max("l_shipdate").alias("updated_at"),
    )


@query(
    """
SELECT coalesce(nullif(l_returnflag, 'N'), CASE WHEN l_linestatus = 'O' THEN 'open' WHEN l_discount > 0.05 THEN 'reviewed' ELSE 'automatic' END) AS source, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1
"""
)
def verification_sources(t):
    """AGG03: units by how they were verified."""
    derived = F.when(F.col("l_linestatus") == "O", "open").when(F.col("l_discount") > 0.05, "reviewed").otherwise("automatic")
    return t("lineitem").groupBy(F.coalesce(F.nullif("l_returnflag", F.lit("N")), derived).alias("source")).agg(_n().alias("n"))


@query(
    """
SELECT l_suppkey AS voice, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(w) AS BIGINT) AS words, round(sum(e) / nullif(sum(w), 0), 4) AS rate, CAST(count(*) FILTER (e > 0) AS BIGINT) AS units_with_errors
FROM (SELECT l_suppkey, CAST(round(l_discount * 100) AS BIGINT) AS e, CAST(l_quantity AS BIGINT) AS w FROM lineitem) GROUP BY 1
"""
)
def micro_rate(t):
    """AGG04, AGG06: micro-averaged error rate, errors over words."""
    units = t("lineitem").select(F.col("l_suppkey").alias("voice"), F.round(F.col("l_discount") * 100).cast("bigint").alias("e"), F.col("l_quantity").cast("bigint").alias("w"))
    out = units.groupBy("voice").agg(F.sum("e").alias("errors"), F.sum("w").alias("words"), F.count_if(F.col("e") > 0).alias("units_with_errors"))
    return out.withColumn("rate", F.round(F.col("errors") / F.nullif("words", F.lit(0)), 4))


@query("SELECT o_orderkey AS job_id, o_orderstatus AS state, l_linenumber AS sequence, l_returnflag AS unit_state FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def job_units(t):
    """JON01: each job with its units."""
    units = t("lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("sequence"), F.col("l_returnflag").alias("unit_state"))
    return t("orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("state")).join(units, "job_id", "left")


@query("SELECT o_orderkey AS job_id, o_orderstatus AS state FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
def jobs_without_units(t):
    """JON05: jobs that have no unit."""
    return t("orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("state")).join(t("lineitem").select(F.col("l_orderkey").alias("job_id")), "job_id", "left_anti")


@query("SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents SEMI JOIN labels USING (doc_id) GROUP BY source")
def acknowledged_semi(t):
    """JON06-08: documents with a reviewer's decision, per source."""
    return t("documents").select("doc_id", "source").join(t("labels").select("doc_id"), "doc_id", "left_semi").groupBy("source").agg(_n().alias("n"))


@query(
    """
SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice > 1000.5
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
"""
)
def latest_active_job(t):
    """SRT01: the newest active job of each customer."""
    active = t("orders").filter("o_orderstatus in ('O', 'P') and o_totalprice > 1000.5").select("o_custkey", "o_orderkey", "o_orderdate")
    return R.latest(active, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    """
SELECT o_custkey, o_orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 5 OR o_orderdate < TIMESTAMP '1996-01-01 00:00:00'
"""
)
def retention_keep_n(t):
    """SRT02, EVT16: jobs beyond the five newest of a customer, or too old."""
    jobs = t("orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return R.expired(jobs, ["o_custkey"], ["o_orderdate", "o_orderkey"], 5, F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")).select("o_custkey", "o_orderkey")


@query(
    """
SELECT l_orderkey AS job_id, CASE min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) WHEN 0 THEN 'failed' WHEN 1 THEN 'review' ELSE 'verified' END AS state FROM lineitem GROUP BY 1
"""
)
def section_status(t):
    """AGG12, UI09: the worst state of a section's units."""
    units = t("lineitem").select(F.col("l_orderkey").alias("job_id"), F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "review").otherwise("verified").alias("s"))
    return R.priority_fold(units, ["job_id"], "s", ["failed", "review", "verified"])


@query(
    """
SELECT l_orderkey AS job_id, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS r, CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS a, min(l_linenumber) AS first_page, max(l_linenumber) AS last_page,
       CASE WHEN count(*) FILTER (l_linestatus = 'O') = 0 THEN CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) END AS duration
FROM lineitem GROUP BY 1
"""
)
def section_map(t):
    """AGG13: counts by state, first and last page, and the duration if no unit is missing."""
    done = F.when(F.count_if(F.col("l_linestatus") == "O") == 0, F.sum(F.col("l_quantity").cast("bigint")))
    return t("lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "A").alias("a"),
        F.min("l_linenumber").alias("first_page"), F.max("l_linenumber").alias("last_page"), done.alias("duration"),
    )


@query("SELECT c_mktsegment, n_name, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def catalogue_lookup(t):
    """JON27: jobs by the attributes of two dimensions."""
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_name").agg(_n().alias("n"))


# ---------------------------------------------------------------- ordered units


@query(
    r"""
SELECT conv_id, turn, CASE WHEN length(p) <= 500 THEN p ELSE regexp_replace(right(p, 500), '^[^ \n]*[ \n]+', '') END AS previous,
       CASE WHEN length(f) <= 500 THEN f ELSE regexp_replace(left(f, 500), '[ \n]+[^ \n]*$', '') END AS following
FROM (SELECT conv_id, turn, trim(lag(text) OVER w) AS p, trim(lead(text) OVER w) AS f FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
"""
)
def unit_context(t):
    """WIN01, WIN02: each unit's neighbours, cut at a word's edge."""
    return O.neighbours(t("conversations"), ["conv_id"], ["turn"], "text").select("conv_id", "turn", "previous", "following")


@query("SELECT conv_id, turn, coalesce(lead(role) OVER w = role, false) AS continues FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def unit_continues(t):
    """WIN03: whether the next unit goes on in the same paragraph."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select("conv_id", "turn", F.coalesce(F.lead("role").over(w) == F.col("role"), F.lit(False)).alias("continues"))


_CLIPS = "SELECT conv_id, turn, length(text) AS ms, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + turn % 3 AS start, sum(length(text)) OVER (PARTITION BY conv_id) + 7 AS total FROM conversations"


def _clips(t) -> DataFrame:
    c = t("conversations").select("conv_id", "turn", F.length("text").alias("ms"))
    c = O.running(c, ["conv_id"], ["turn"], F.col("ms"), "start", inclusive=False)
    return c.withColumns({"start": F.col("start") + F.col("turn") % 3, "total": F.sum("ms").over(Window.partitionBy("conv_id")) + 7})


@query(
    f"""
WITH c AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM ({_CLIPS}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE least(max(CASE WHEN i = 0 THEN 0 ELSE greatest(start - i, 0) END) OVER (PARTITION BY conv_id ORDER BY turn), total - n) + i END AS begin_ms FROM c)
SELECT conv_id, turn, CAST(begin_ms AS BIGINT) AS begin_ms, CAST(coalesce(lead(begin_ms) OVER (PARTITION BY conv_id ORDER BY turn), total) AS BIGINT) AS end_ms FROM b
"""
)
def clip_tiling(t):
    """WIN05: clips without gaps, strictly increasing."""
    return O.tiled_clips(_clips(t), ["conv_id"], ["turn"], "start", "total").select("conv_id", "turn", "begin_ms", "end_ms")


@query("SELECT conv_id, turn, CAST(sum(floor(length(text) * 1.25)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS end_ms FROM conversations")
def cumulative_clips(t):
    """WIN06, AGG21: scaled running duration."""
    c = t("conversations").withColumn("scaled", F.floor(F.length("text") * F.lit(1.25)))
    return O.running(c, ["conv_id"], ["turn"], F.col("scaled"), "end_ms").select("conv_id", "turn", F.col("end_ms").cast("bigint").alias("end_ms"))


@query(
    """
SELECT user_id, event_id, CASE WHEN d IS NULL THEN 'first' WHEN d > 3600000000 THEN 'gap' WHEN d < 60000000 THEN 'overlap' ELSE 'follows' END AS relation
FROM (SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
"""
)
def clip_gaps(t):
    """WIN08: gap or overlap between consecutive rows."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = F.col("us") - F.lag("us").over(w)
    kind = F.when(d.isNull(), "first").when(d > 3_600_000_000, "gap").when(d < 60_000_000, "overlap").otherwise("follows")
    return t("events").withColumn("us", _micros("ts")).select("user_id", "event_id", kind.alias("relation"))


@query(
    """
SELECT conv_id, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY first_turn, role) AS BIGINT) AS play_order FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY ALL)
"""
)
def play_order(t):
    """WIN11, WIN13: distinct targets numbered by first appearance."""
    targets = t("conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("at"))
    return O.numbered(targets, ["conv_id"], ["at", "role"], "play_order").select("conv_id", "role", "play_order")


@query(
    """
SELECT event_type, min(event_id) AS first, max(event_id) AS last, CAST(count(*) AS BIGINT) AS n
FROM (SELECT event_type, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events) GROUP BY event_type, g
"""
)
def photo_runs(t):
    """Runs of consecutive numbers of each kind."""
    return O.islands(t("events").select("event_type", "event_id"), ["event_type"], "event_id")


@query(
    """
SELECT user_id, event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page FROM events
"""
)
def page_carry_forward(t):
    """SRC23, JON10: the page in effect, carried forward."""
    return O.carried(t("events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "view", F.col("value")), "page").select("user_id", "event_id", "page")


@query(
    """
SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE event_type <> 'error') WHERE p IS DISTINCT FROM event_type
"""
)
def page_changes(t):
    """WIN17: rows where the page differs from the last one seen, some rows skipped."""
    seen = t("events").filter("event_type <> 'error'")
    return O.changes(seen, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query(
    """
SELECT user_id, event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run
FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS c FROM events)
"""
)
def frame_runs(t):
    """JON26, WIN10: numbered runs of equal values."""
    return O.runs(t("events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "run")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS BIGINT) AS attempt FROM events")
def attempt_number(t):
    """SNK04, WIN04: next attempt number of each key."""
    return O.numbered(t("events"), ["user_id", "event_type"], ["ts", "event_id"], "attempt").select("event_id", "attempt")


@query(
    """
SELECT a.conv_id, a.turn, max(b.turn) AS parent FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn AND length(b.text) % 4 < length(a.text) % 4 GROUP BY 1, 2
"""
)
def heading_parents(t):
    """WIN12: the nearest earlier entry of a smaller level."""
    c = t("conversations").select("conv_id", "turn", (F.length("text") % 4).alias("level"))
    return O.parents(c, ["conv_id"], "turn", "level", [0, 1, 2, 3]).select("conv_id", "turn", "parent")


@query(
    """
SELECT conv_id, turn FROM (SELECT conv_id, turn, min(CAST(i = 1 OR b + length(text) <= 1500 AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS fits FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations)) WHERE fits = 1
"""
)
def preview_units(t):
    """WIN16, EXT15: the first units of a chapter that fit a length."""
    return O.within_budget(t("conversations"), ["conv_id"], ["turn"], F.length("text"), 1500).select("conv_id", "turn")


@query(
    """
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE i % 20 = 19 OR event_type = 'error' OR i = n - 1
"""
)
def checkpoints(t):
    """WIN19: every 20th row, the urgent ones and the last."""
    return O.checkpoints(t("events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id")


@query("SELECT user_id, event_id, CAST(r AS BIGINT) AS repeat FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(value AS BIGINT) ORDER BY ts, event_id) - 1 AS r FROM events) WHERE r > 0")
def duplicate_markers(t):
    """AGG14: markers that repeat an earlier one."""
    e = t("events").withColumn("page", F.rint("value").cast("bigint"))
    return O.numbered(e, ["user_id", "event_type", "page"], ["ts", "event_id"], "k").filter("k > 1").select("user_id", "event_id", (F.col("k") - 1).alias("repeat"))


# ---------------------------------------------------------------- joins by position, order and interval


@query(
    """
WITH l AS (SELECT doc_id, md5(coalesce(text, '')) AS key, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS r FROM documents),
p AS (SELECT doc_id AS record_id, md5(coalesce(text, '')) AS key, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY md5(coalesce(text, ''))) AS n FROM documents WHERE source <> 'src1')
SELECT l.doc_id, p.record_id FROM l LEFT JOIN p ON l.key = p.key AND p.k = least(l.r, p.n)
"""
)
def nth_occurrence_join(t):
    """JON03, JON04: the k-th copy of a text takes the k-th record, the last one serves the rest."""
    docs = _text_key(t("documents")).select("doc_id", "source", "key")
    records = docs.filter("source <> 'src1'").select("key", F.col("doc_id").alias("record_id"))
    return O.kth_occurrence(docs.select("doc_id", "key"), "key", "doc_id", records, "record_id").select("doc_id", "record_id")


@query(
    """
WITH a AS (SELECT user_id, event_id, epoch_us(ts) AS s, epoch_us(ts) + 300000000 AS e FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, event_id AS r_id, epoch_us(ts) AS s, epoch_us(ts) + 5400000000 AS e FROM events WHERE event_type = 'view')
SELECT a.event_id, CAST(count(*) AS BIGINT) AS n, min(b.s) AS first_start, max(b.e) AS last_end FROM a JOIN b ON a.user_id = b.user_id AND b.s < a.e AND b.e > a.s GROUP BY 1
"""
)
def interval_join(t):
    """JON11, JON12, JON15: spans of one user that overlap."""
    e = t("events").withColumn("start", _micros("ts"))
    a = e.filter("event_type = 'click'").select("user_id", "event_id", "start", (F.col("start") + 300_000_000).alias("end"))
    b = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("id"), "start", (F.col("start") + 5_400_000_000).alias("end"))
    return R.overlap_join(a, b, ["user_id"]).groupBy("event_id").agg(_n().alias("n"), F.min("r_start").alias("first_start"), F.max("r_end").alias("last_end"))


@query(
    """
SELECT c.event_id, (SELECT max(v.ts) FROM events v WHERE v.user_id = c.user_id AND v.event_type = 'view' AND v.ts <= c.ts) AS previous,
       (SELECT min(v.ts) FROM events v WHERE v.user_id = c.user_id AND v.event_type = 'view' AND v.ts >= c.ts) AS following FROM events c WHERE c.event_type = 'click'
"""
)
def as_of_join(t):
    """JON13, JON24, UI07: the last mark at or before, the first at or after."""
    e = t("events")
    clicks = e.filter("event_type = 'click'").select("user_id", "event_id", "ts")
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("ts").alias("at"))
    out = R.as_of(R.as_of(clicks, views, ["user_id"], "ts", "at", "previous"), views, ["user_id"], "ts", "at", "following", forward=True)
    return out.select("event_id", "previous", "following")


@query(
    """
WITH u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, md5(text) AS expected FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, md5(text) AS actual FROM conversations WHERE role = 'assistant')
SELECT conv_id, CAST(position AS BIGINT) AS position, expected, actual FROM u FULL JOIN a USING (conv_id, position) WHERE expected IS DISTINCT FROM actual
"""
)
def positional_full_outer(t):
    """JON16, JON19: the i-th expected against the i-th actual."""
    c = t("conversations").select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("value"))
    return R.positional_diff(c.filter("role = 'user'"), c.filter("role = 'assistant'"), ["conv_id"], ["turn"], "value")


@query(
    """
SELECT o_orderkey AS job_id, 'customer' AS missing FROM orders ANTI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey
UNION ALL SELECT DISTINCT l_orderkey, 'part' FROM lineitem ANTI JOIN (SELECT p_partkey FROM part WHERE p_size > 1) p ON l_partkey = p_partkey
"""
)
def dangling_references(t):
    """JON17, JON18, SET05: references whose target is missing, per kind."""
    a = t("orders").join(t("customer").filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.col("o_orderkey").alias("job_id"), F.lit("customer").alias("missing"))
    b = t("lineitem").join(t("part").filter("p_size > 1"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select(F.col("l_orderkey").alias("job_id"), F.lit("part").alias("missing")).distinct()
    return a.unionAll(b)


@query(
    """
WITH e AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'edited ' || doc_id END AS new, doc_id % 3 < 2 AS edited FROM labels)
SELECT doc_id, CASE WHEN edited THEN new ELSE source END AS source FROM documents LEFT JOIN e USING (doc_id) WHERE NOT (coalesce(edited, false) AND new = '')
"""
)
def edit_overlay(t):
    """PRJ19, UI14: slots replaced or deleted by edits."""
    k = F.col("doc_id") % 3
    edits = t("labels").filter(k < 2).select("doc_id", F.when(k == 0, "").otherwise(F.concat(F.lit("edited "), F.col("doc_id"))).alias("source"))
    return R.overlay(t("documents").select("doc_id", "source"), edits, "doc_id", "source")


# ---------------------------------------------------------------- sets, nested values, clocks


@query(
    """
WITH s AS (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events WHERE value > 20 GROUP BY 1)
SELECT user_id, CAST(len(kinds) AS INTEGER) AS n, list_has_all(kinds, ['view', 'click']) AS complete, list_has_any(kinds, ['error', 'signup']) AS flagged FROM s
"""
)
def set_predicates(t):
    """SET03, SET04, SET06: subset and intersection tests on distinct sets."""
    s = t("events").filter("value > 20").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    need, bad = (F.array(*map(F.lit, x)) for x in (["view", "click"], ["error", "signup"]))
    return s.select("user_id", F.size("kinds").alias("n"), (F.size(F.array_except(need, "kinds")) == 0).alias("complete"), F.arrays_overlap("kinds", bad).alias("flagged"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def event_json(t):
    """SRC38, ARR01: typed reading of the details."""
    e = t("events").withColumn("p", F.from_json(F.coalesce("props", F.lit("{}")), "k bigint"))
    return e.groupBy("event_type").agg(_n().alias("n"), F.sum("p.k").alias("k"))


@query(
    """
SELECT event_id, printf('%d:%02d:%02d.%d', tenths // 36000, tenths % 36000 // 600, tenths % 600 // 10, tenths % 10) AS clock FROM (SELECT event_id, CAST(floor(value * 60 * 10 + 0.5) AS BIGINT) AS tenths FROM events)
"""
)
def clock_texts(t):
    """STR41: seconds as h:mm:ss.t."""
    return t("events").select("event_id", T.clock_text(F.col("value") * 60).alias("clock"))


@query(
    """
SELECT source, lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(CASE WHEN quality >= 0 THEN quality END), 6) AS confidence FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang
"""
)
def source_report(t):
    """SNK20, AGG26: totals and mean confidence per source and language."""
    d = t("documents").select("doc_id", "source", "lang", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy("source", "lang").agg(_n().alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg(F.when(F.col("quality") >= 0, F.col("quality"))), 6).alias("confidence"))


@query(
    """
SELECT o_orderkey, CASE month(o_orderdate) {months} END || ' de ' || year(o_orderdate) AS month FROM orders
""".format(months=" ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(T.MONTHS)))
)
def months(t):
    """NUM35: a date as "octubre de 2026"."""
    return t("orders").select("o_orderkey", T.month_of(F.col("o_orderdate")).alias("month"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1), ''), 'und') AS lang, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS paragraphs FROM pages")
def page_profiles(t):
    """Language, title and blocks of a page, by built-ins."""
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    return t("pages").select("page_id", F.coalesce(F.nullif(lang, F.lit("")), F.lit("und")).alias("lang"), F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.regexp_count("html", F.lit("<p>")).alias("paragraphs"))


# ---------------------------------------------------------------- keys, queues and checks


@query("SELECT doc_id, sha256(concat_ws(chr(0), lang, source, text)) AS cache_key FROM documents WHERE text IS NOT NULL")
def cache_keys(t):
    """EVT10, EVT12: content key over an identity's parts, joined by NUL."""
    return t("documents").filter("text is not null").select("doc_id", F.sha2(F.concat_ws("\0", "lang", "source", "text").cast("binary"), 256).alias("cache_key"))


@query("SELECT doc_id FROM documents WHERE md5(coalesce(text, '')) NOT IN (SELECT md5(coalesce(text, '')) FROM documents WHERE source = 'src0')")
def idempotent_submissions(t):
    """EVT13, EVT07: submissions whose content has not been seen."""
    docs = _text_key(t("documents")).select("doc_id", "source", "key")
    return docs.join(docs.filter("source = 'src0'").select("key"), "key", "left_anti").select("doc_id")


@query(
    """
SELECT l_orderkey AS job_id, l_linenumber AS sequence, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'needs_human_review' END AS state,
       CASE WHEN l_discount >= 0.08 THEN 'critical' WHEN l_discount >= 0.04 THEN 'major' ELSE 'minor' END AS severity, CASE WHEN l_tax > 0.05 THEN 'retake' ELSE 'accept_flagged' END AS action
FROM lineitem WHERE l_returnflag = 'R' OR (l_returnflag = 'A' AND l_linestatus = 'O')
"""
)
def review_queue(t):
    """PRJ12, PRJ13, UI02: units that wait for a decision, with severity and action."""
    u = t("lineitem").filter("l_returnflag = 'R' or (l_returnflag = 'A' and l_linestatus = 'O')")
    severity = F.when(F.col("l_discount") >= 0.08, "critical").when(F.col("l_discount") >= 0.04, "major").otherwise("minor")
    return u.select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("sequence"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("needs_human_review").alias("state"),
        severity.alias("severity"), F.when(F.col("l_tax") > 0.05, "retake").otherwise("accept_flagged").alias("action"),
    )


@query("SELECT doc_id, CAST(strpos(lower(text), 'the and') AS INTEGER) AS position FROM documents WHERE contains(lower(text), 'the and')")
def search_units(t):
    """UI03: units that hold a phrase, whatever its case, and where."""
    return t("documents").filter(F.contains(F.lower("text"), F.lit("the and"))).select("doc_id", F.instr(F.lower("text"), "the and").alias("position"))


@query(
    r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(line, '[0-9]+[ ]*$')) AS rows, max(length(line)) AS longest, count(*) FILTER (regexp_matches(line, '[.!?]$')) AS ends,
             bool_or(length(line) > 40 AND regexp_matches(line, '[.!?]$')) AS prose FROM l GROUP BY doc_id)
SELECT doc_id, rows >= 3 AND rows >= 0.6 * n AS contents, n <= 6 AND longest <= 90 AND ends <= n // 3 AS title_page, prose FROM a
"""
)
def content_flags(t):
    """PRJ05-09: what a section's paragraphs alone say of its kind."""
    lines = t("documents").filter("text is not null").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    ends = F.col("line").rlike(r"[.!?]\z")
    a = lines.groupBy("doc_id").agg(_n().alias("n"), F.count_if(F.col("line").rlike(r"[0-9]+[ ]*\z")).alias("rows"), F.max(F.length("line")).alias("longest"), F.count_if(ends).alias("ends"), F.bool_or((F.length("line") > 40) & ends).alias("prose"))
    contents = (F.col("rows") >= 3) & (F.col("rows") >= F.lit(0.6) * F.col("n"))
    title = (F.col("n") <= 6) & (F.col("longest") <= 90) & (F.col("ends") <= F.floor(F.col("n") / 3))
    return a.select("doc_id", contents.alias("contents"), title.alias("title_page"), "prose")


@query(
    """
SELECT user_id, event_id FROM (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM events) WHERE value < most
"""
)
def navigation_breaks(t):
    """Rows whose value is below one seen before."""
    most = F.max("value").over(O.before(["user_id"], ["ts", "event_id"]))
    return t("events").withColumn("most", most).filter("value < most").select("user_id", "event_id")


@query(
    """
SELECT conv_id, turn, CAST(own AS BIGINT) AS own, CAST(declared AS BIGINT) AS declared FROM (
  SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS own, turn * 300 AS declared FROM conversations) WHERE abs(own - declared) > 150
"""
)
def declared_totals(t):
    """Own running totals against declared ones, with a wide tolerance; timing_checks has the checks of a package."""
    c = O.running(t("conversations"), ["conv_id"], ["turn"], F.length("text"), "own", inclusive=False).withColumn("declared", F.col("turn") * 300)
    return c.filter(F.abs(F.col("own") - F.col("declared")) > 150).select("conv_id", "turn", F.col("own").cast("bigint").alias("own"), "declared")


@query(
    """
SELECT e.user_id, e.event_id FROM events e JOIN (SELECT user_id, sum(CAST(round(value * 100) AS BIGINT)) AS total, count(*) AS n FROM events GROUP BY user_id) r USING (user_id)
WHERE value >= 1 AND CAST(round(value * 100) AS BIGINT) * 2 * n > 5 * total
"""
)
def slow_words(t):
    """CMP13: rows of a second or more that take over two and a half times their speaker's mean."""
    e = t("events").withColumn("c", F.round(F.col("value") * 100).cast("bigint"))
    pace = e.groupBy("user_id").agg(F.sum("c").alias("total"), _n().alias("n"))
    return e.join(pace, "user_id").filter((F.col("value") >= 1) & (F.col("c") * 2 * F.col("n") > 5 * F.col("total"))).select("user_id", "event_id")


@query(
    """
SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, count(*) FILTER (position <> turn + 1) = 0 AS numbered, CAST(count(DISTINCT role) AS BIGINT) AS roles, arg_max(role, turn) = 'assistant' AS closed
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations) GROUP BY conv_id
"""
)
def structure_checks(t):
    """Numbers run from the start, kinds, and what closes a conversation; the checks of a package are in package.py."""
    c = O.numbered(t("conversations"), ["conv_id"], ["turn"], "position")
    return c.groupBy("conv_id").agg(
        _n().alias("turns"), (F.count_if(F.col("position") != F.col("turn") + 1) == 0).alias("numbered"), F.countDistinct("role").alias("roles"), (F.max_by("role", "turn") == "assistant").alias("closed"),
    )


# ---------------------------------------------------------------- kernels without SQL


@query()
def take_states(t):
    """EVT02: the machine of takes over the event log."""
    from quirework.streaming.events import take_states as states

    e = O.numbered(t("events"), ["user_id"], ["ts", "event_id"], "take")
    verdict = F.when(F.col("event_type") == "view", "verified").when(F.col("event_type") == "click", "ambiguous").otherwise("likely_error")
    return states(e.select(F.col("user_id").cast("string").alias("unit_id"), F.col("take").cast("int").alias("take"), verdict.alias("verdict"), (F.col("event_type") == "error").alias("problem")))


from quirework.plans import assembly, comparison, contents, numerals, package, records, release, speech, texts  # noqa: E402, F401 - they register their queries
