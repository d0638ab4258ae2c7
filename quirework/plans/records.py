"""The production log as relations: the state of a key is its newest row; edits and drafts are rules over rows.

Stand-ins: events of a user are the rows of a log, a draft, or a lexicon.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.operators import relational as R
from quirework.plans.registry import n, query


@query(
    """
SELECT user_id AS unit_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS updated_at, CAST(count(*) AS BIGINT) AS writes, arg_max(value, (ts, event_id)) FILTER (value > 20) AS last_large FROM events GROUP BY user_id
"""
)
def latest_rows(t):
    """SNK05, SNK06, SRC36, UI12: every update is a row; the newest one (by time, then by its number) is the state, and a column keeps its last value that was set."""
    order = F.struct("ts", "event_id")
    large = F.max(F.when(F.col("value") > 20, F.struct("ts", "event_id", "value")))["value"]
    return t("events").groupBy(F.col("user_id").alias("unit_id")).agg(F.max_by("event_type", order).alias("state"), F.max("ts").alias("updated_at"), n().alias("writes"), large.alias("last_large"))


_TERMS = "SELECT CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || (user_id % 25) AS term, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'p' || event_id END AS said, event_id % 13 = 0 AS deleted, ts, event_id FROM events"


@query(
    f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY lower(term) ORDER BY ts DESC, event_id DESC) AS k FROM ({_TERMS}) WHERE deleted OR (length(trim(term)) BETWEEN 1 AND 200 AND trim(said) <> ''))
SELECT term, said, CAST(length(term) AS INTEGER) AS length FROM r WHERE k = 1 AND NOT deleted
"""
)
def lexicon_view(t):
    """SNK07, SNK08, SNK09, SNK11, SRC39: upserts by a key whose case does not count, the newest one wins; blank entries are refused, deleted ones are gone; longest keys come first."""
    term = F.concat(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.col("user_id") % 25)
    rows = t("events").select(term.alias("term"), F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("p"), "event_id")).alias("said"), (F.col("event_id") % 13 == 0).alias("deleted"), "ts", "event_id")
    rows = rows.filter(F.col("deleted") | (F.length(F.trim("term")).between(1, 200) & (F.trim("said") != ""))).withColumn("key", F.lower("term"))
    return R.latest(rows, ["key"], ["ts", "event_id"]).filter(~F.col("deleted")).select("term", "said", F.length("term").alias("length")).orderBy(F.desc("length"), "term")


@query(
    """
WITH RECURSIVE w AS (SELECT user_id AS draft, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS k, CAST(floor(value) AS BIGINT) % 4 AS slack FROM events),
s AS (SELECT DISTINCT draft, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS revision, CAST(NULL AS BIGINT) AS event_id, false AS accepted FROM w
  UNION ALL SELECT s.draft, w.k, CASE WHEN w.slack < 3 THEN s.revision + 1 ELSE s.revision END, w.event_id, w.slack < 3 FROM s JOIN w ON w.draft = s.draft AND w.k = s.k + 1)
SELECT draft, event_id, accepted, revision FROM s WHERE event_id IS NOT NULL
"""
)
def draft_revisions(t):
    """SNK10: a save is accepted if it was made on the current revision and makes the next one, else it is refused.

    One fold over a draft's saves in order; a save's base is the current revision, or an older one.
    """
    saves = t("events").groupBy(F.col("user_id").alias("draft")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.floor("value") % 4).cast("bigint").alias("slack")))).alias("saves"))

    def step(s, x):
        base = s["revision"] - F.when(x["slack"] < 3, F.lit(0)).otherwise(F.lit(1))
        ok = base == s["revision"]
        revision = s["revision"] + ok.cast("bigint")
        return F.struct(revision.alias("revision"), F.array_append(s["out"], F.struct(x["event_id"].alias("event_id"), ok.alias("accepted"), revision.alias("revision"))).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("revision"), F.array().cast("array<struct<event_id:bigint,accepted:boolean,revision:bigint>>").alias("out"))
    return saves.select("draft", F.explode(F.aggregate("saves", start, step, lambda s: s["out"])).alias("o")).select("draft", "o.event_id", "o.accepted", "o.revision")


@query("SELECT user_id AS unit_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS attempt FROM events WHERE user_id < 1000000 AND event_type IN ('click', 'error')")
def attempt_scan(t):
    """SRC37: attempts of a job, of one kind of outcome if asked, in order."""
    from quirework.operators import ordered as O

    rows = t("events").filter((F.col("user_id") < 1_000_000) & F.col("event_type").isin("click", "error"))
    return O.numbered(rows.withColumn("unit_id", F.col("user_id")), ["unit_id"], ["ts", "event_id"], "attempt").select("unit_id", "event_id", "attempt").orderBy("unit_id", "attempt")


@query(
    """
SELECT o_orderstatus, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS jobs, CAST(count(l_orderkey) AS BIGINT) AS units, CAST(2 AS BIGINT) AS batches
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderstatus
"""
)
def published_jobs(t):
    """SNK02: orders and their lines published together in two batches, the second one twice; readers see each batch once."""
    import uuid

    from quirework.operators.written import shared_folder
    from quirework.sources.published import Published

    orders = t("orders").select("o_orderkey", "o_orderstatus")
    lines = t("lineitem").select("l_orderkey", "l_linenumber")
    spark = orders.sparkSession
    store = Published(spark, f"{shared_folder(spark)}/quirework/{spark.sparkContext.applicationId}/published-{uuid.uuid4().hex}")
    for batch, of in (("finished", "o_orderstatus = 'F'"), ("others", "o_orderstatus <> 'F'"), ("others", "o_orderstatus <> 'F'")):
        jobs = orders.filter(of)
        store.publish(batch, {"jobs": jobs, "units": lines.join(jobs.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")})
    units = store.read("units").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("units"))
    found = store.read("jobs").join(units, "o_orderkey", "left").groupBy("o_orderstatus")
    return found.agg(F.count("*").alias("jobs"), F.coalesce(F.sum("units"), F.lit(0)).alias("units")).withColumn("batches", F.lit(len(store.commits())).cast("bigint"))
