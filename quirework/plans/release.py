"""May a book ship: the release decision, review queues, decisions and reports, as relations.

Stand-ins: orders are jobs, lineitem rows their units, events the issues that extraction reported, acknowledgements,
decisions and release requests; customers carry the package checks of their orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.plans.registry import n, query

# Issue codes that a reviewer may acknowledge.
ACKNOWLEDGEABLE = ["broken_word", "encoding_damage", "epub_footer", "image_unchecked", "ocr_low_confidence", "outside_chapter", "suspicious_token", "text_in_image", "unaccounted_words"]

#: Columns of the stand-in relations, in words that both engines read alike.
JOB = "CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'assembling' WHEN 3 THEN 'cancelled' WHEN 4 THEN 'failed' ELSE 'completed' END"
UNIT = (
    "CASE WHEN l_quantity > 49.5 THEN 'failed' WHEN l_quantity > 48.5 THEN 'pending' WHEN l_quantity > 47.5 THEN 'generating' "
    "WHEN l_quantity > 46.5 THEN 'needs_human_review' WHEN l_quantity > 45.5 THEN 'unresolved' ELSE 'verified' END"
)
ACOUSTIC = "CASE WHEN l_tax > 0.075 AND l_partkey % 3 = 0 THEN 'failed' WHEN l_discount < 0.005 AND l_partkey % 7 = 0 THEN 'skipped' WHEN l_discount > 0.095 THEN 'needs_review' WHEN l_partkey % 97 = 0 THEN NULL ELSE 'passed' END"
ACTION = "CASE WHEN l_suppkey % 5 = 0 THEN 'accept_flagged' ELSE 'accept' END"
SEVERITY = "CASE WHEN event_type = 'error' AND value > 30 THEN 'blocking' WHEN event_type IN ('error', 'click') THEN 'warning' ELSE 'info' END"
CODE = "CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'broken_word' WHEN 1 THEN 'ocr_low_confidence' WHEN 2 THEN 'missing_page' ELSE 'text_in_image' END"
CHECK = "CASE WHEN c_acctbal < -500 THEN 'failed' WHEN c_acctbal > 9000 THEN 'not_run' ELSE 'passed' END"
DTD = "CASE WHEN c_custkey % 40 = 0 THEN 'failed' WHEN c_custkey % 40 = 1 THEN 'not_run' ELSE 'passed' END"


def units(t) -> DataFrame:
    """job_id, unit_id, sequence, state, acoustic, action, attempts, retakes, words, errors of every unit."""
    return t("lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("unit_id"), F.col("l_linenumber").alias("sequence"),
        F.expr(UNIT).alias("state"), F.expr(ACOUSTIC).alias("acoustic"), F.expr(ACTION).alias("action"), F.floor("l_quantity").cast("bigint").alias("words"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("errors"),
    )


def issues(t) -> DataFrame:
    """job_id, severity, code, id of every reported issue: the id is code, place and the first 40 characters."""
    e = t("events").select(F.col("user_id").alias("job_id"), "event_id", F.expr(SEVERITY).alias("severity"), F.expr(CODE).alias("code"), F.concat(F.lit("p. "), F.col("event_id") % 30).alias("place"), F.coalesce("props", F.lit("")).alias("text"))
    return e.select("job_id", "event_id", "severity", "code", F.concat_ws(":", "code", "place", F.left("text", F.lit(40))).alias("id"))


_UNITS = f"SELECT l_orderkey AS job_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS unit_id, l_linenumber AS sequence, {UNIT} AS state, {ACOUSTIC} AS acoustic, {ACTION} AS action, CAST(floor(l_quantity) AS BIGINT) AS words, CAST(round(l_discount * 100) AS BIGINT) AS errors FROM lineitem"
_ISSUES = f"SELECT user_id AS job_id, event_id, {SEVERITY} AS severity, {CODE} AS code, {CODE} || ':p. ' || (event_id % 30) || ':' || left(coalesce(props, ''), 40) AS id FROM events"
_ACKS = "SELECT DISTINCT job_id, id FROM i WHERE event_id % 3 = 0 AND code IN ({})".format(", ".join(f"'{c}'" for c in ACKNOWLEDGEABLE))


def acknowledged(t) -> DataFrame:
    """job_id, id of acknowledged issues: only codes that may be acknowledged count."""
    return issues(t).filter((F.col("event_id") % 3 == 0) & F.col("code").isin(*ACKNOWLEDGEABLE)).select("job_id", "id").distinct()


@query(f"WITH i AS ({_ISSUES}), a AS ({_ACKS}) SELECT i.job_id, i.event_id, i.severity, i.id, i.severity = 'warning' AND a.id IS NULL AS open, i.code IN ({', '.join(repr(c) for c in ACKNOWLEDGEABLE)}) AS acknowledgeable FROM i LEFT JOIN a ON i.job_id = a.job_id AND i.id = a.id")
def issue_status(t):
    """PRJ14, PRJ15, EVT20: the composite key of each issue, whether it may be acknowledged, and whether it is open."""
    a = acknowledged(t).withColumn("seen", F.lit(True))
    rows = issues(t).join(a, ["job_id", "id"], "left")
    return rows.select("job_id", "event_id", "severity", "id", ((F.col("severity") == "warning") & F.col("seen").isNull()).alias("open"), F.col("code").isin(*ACKNOWLEDGEABLE).alias("acknowledgeable"))


@query(
    f"""
WITH u AS ({_UNITS})
SELECT job_id, CAST(count(*) AS BIGINT) AS segments, coalesce(string_agg(unit_id, ',' ORDER BY unit_id) FILTER (acoustic = 'failed' AND state = 'verified'), '') AS failed,
       coalesce(string_agg(unit_id, ',' ORDER BY unit_id) FILTER (coalesce(acoustic, 'none') IN ('unavailable', 'skipped', 'not_performed', 'none')), '') AS unchecked, CAST(count(*) FILTER (acoustic = 'needs_review') AS BIGINT) AS suspicious
FROM u GROUP BY job_id
"""
)
def audio_integrity(t):
    """AGG05: ids of units with bad audio, ids of unchecked ones (no status counts as unchecked), and how many are suspicious."""
    ids = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("unit_id")))), ",")
    unchecked = F.coalesce("acoustic", F.lit("none")).isin("unavailable", "skipped", "not_performed", "none")
    return units(t).groupBy("job_id").agg(n().alias("segments"), ids((F.col("acoustic") == "failed") & (F.col("state") == "verified")).alias("failed"), ids(unchecked).alias("unchecked"), F.count_if(F.col("acoustic") == "needs_review").alias("suspicious"))


def decision(t) -> DataFrame:
    """One row a job: state, blockers, reviews, and the status of each dimension."""
    u = units(t).groupBy("job_id").agg(
        n().alias("segments"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state").isin("pending", "generating")).alias("pending"),
        F.count_if(F.col("state").isin("needs_human_review", "unresolved")).alias("awaiting"), F.count_if(F.col("state") == "verified").alias("verified"),
        F.count_if((F.col("acoustic") == "failed") & (F.col("state") == "verified")).alias("bad_audio"),
        F.count_if(F.coalesce("acoustic", F.lit("none")).isin("unavailable", "skipped", "not_performed", "none")).alias("unchecked"),
        F.sum("words").alias("words"), F.sum("errors").alias("errors"), F.count_if((F.col("state") == "verified") & (F.col("action") == "accept_flagged")).alias("to_listen"),
    )
    opened = issues(t).join(acknowledged(t).withColumn("seen", F.lit(True)), ["job_id", "id"], "left")
    i = opened.groupBy("job_id").agg(n().alias("reported"), F.count_if(F.col("severity") == "blocking").alias("blocking"), F.count_if((F.col("severity") == "warning") & F.col("seen").isNull()).alias("warnings"))
    c = t("customer").select("c_custkey", F.expr(CHECK).alias("completeness"), F.expr(DTD).alias("dtd"))
    jobs = t("orders").select(F.col("o_orderkey").alias("job_id"), "o_custkey", F.expr(JOB).alias("job_state"), (F.col("o_orderkey") % 97 == 0).alias("simulated"), (F.col("o_orderkey") % 5 == 0).alias("asked"))
    rows = jobs.join(u, "job_id", "left").join(i, "job_id", "left").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    zero = {k: 0 for k in ("segments", "failed", "pending", "awaiting", "verified", "bad_audio", "unchecked", "reported", "blocking", "warnings", "words", "errors", "to_listen")}
    rows = rows.fillna(zero | {"completeness": "not_run", "dtd": "not_run"})
    col = F.col
    blockers = F.array_compact(F.array(
        F.when(col("failed") > 0, F.concat(col("failed"), F.lit(" segments failed"))), F.when(col("blocking") > 0, F.concat(col("blocking"), F.lit(" blocking issues"))),
        F.when(col("simulated"), F.lit("simulated audio")), F.when(col("bad_audio") > 0, F.concat(col("bad_audio"), F.lit(" segments with bad audio"))),
        F.when(col("completeness") == "failed", F.lit("incomplete")), F.when(col("dtd") == "failed", F.lit("invalid package")),
    ))
    reviews = F.array_compact(F.array(
        F.when(col("warnings") > 0, F.concat(col("warnings"), F.lit(" open warnings"))), F.when(col("awaiting") > 0, F.concat(col("awaiting"), F.lit(" await a decision"))),
        F.when(col("pending") > 0, F.concat(col("pending"), F.lit(" not narrated"))), F.when((col("unchecked") > 0) & ~col("simulated"), F.concat(col("unchecked"), F.lit(" unchecked"))),
    ))
    rows = rows.withColumns({"blockers": blockers, "reviews": reviews})
    state = (
        F.when((col("job_state") == "queued") & (col("verified") == 0), "PENDING").when(col("job_state").isin("queued", "running"), "GENERATING").when(col("job_state") == "assembling", "VALIDATING")
        .when((F.size("blockers") > 0) | (col("job_state") == "failed"), "BLOCKED").when((F.size("reviews") > 0) | (col("job_state") != "completed"), "NEEDS_REVIEW").otherwise("PASSED")
    )
    stopped = (col("job_state") == "cancelled") & (col("state") != "BLOCKED")
    rows = rows.withColumn("state", state).withColumns({"blockers": F.when(stopped, F.array_append("blockers", F.lit("stopped before the end"))).otherwise(col("blockers")), "state": F.when(stopped, "BLOCKED").otherwise(col("state"))})
    failed = (col("dtd") == "failed") | (col("completeness") == "failed")
    return rows.withColumns({
        "technical": F.when(col("failed") > 0, "failed").when(col("job_state") == "completed", "passed").otherwise("in_progress"),
        "source": F.when(col("blocking") > 0, "failed").when(col("warnings") > 0, "needs_review").when(col("reported") > 0, "passed").otherwise("not_run"),
        "content": F.when(col("simulated"), "simulated").when(col("awaiting") > 0, "needs_review").when((col("segments") > 0) & (col("verified") == col("segments")), "passed").otherwise("in_progress"),
        "audio": F.when(col("simulated"), "simulated").when(col("bad_audio") > 0, "failed").when(col("unchecked") > 0, "partial").otherwise("passed"),
        "package": F.when(failed, "failed").when((col("dtd") == "passed") & (col("completeness") == "passed"), "passed").otherwise("not_run"),
        "wer": F.round(col("errors") / F.nullif("words", F.lit(0)), 4),
    })


_DECISION = f"""
u AS (SELECT job_id, count(*) AS segments, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state IN ('pending', 'generating')) AS pending,
        count(*) FILTER (state IN ('needs_human_review', 'unresolved')) AS awaiting, count(*) FILTER (state = 'verified') AS verified, count(*) FILTER (acoustic = 'failed' AND state = 'verified') AS bad_audio,
        count(*) FILTER (coalesce(acoustic, 'none') IN ('unavailable', 'skipped', 'not_performed', 'none')) AS unchecked, sum(words) AS words, sum(errors) AS errors,
        count(*) FILTER (state = 'verified' AND action = 'accept_flagged') AS to_listen FROM ({_UNITS}) GROUP BY job_id),
i AS ({_ISSUES}), a AS ({_ACKS}),
s AS (SELECT i.job_id, count(*) AS reported, count(*) FILTER (severity = 'blocking') AS blocking, count(*) FILTER (severity = 'warning' AND a.id IS NULL) AS warnings FROM i LEFT JOIN a ON a.job_id = i.job_id AND a.id = i.id GROUP BY i.job_id),
j AS (SELECT o_orderkey AS job_id, {JOB} AS job_state, o_orderkey % 97 = 0 AS simulated, o_orderkey % 5 = 0 AS asked, coalesce(segments, 0) AS segments, coalesce(failed, 0) AS failed, coalesce(pending, 0) AS pending, coalesce(awaiting, 0) AS awaiting,
        coalesce(verified, 0) AS verified, coalesce(bad_audio, 0) AS bad_audio, coalesce(unchecked, 0) AS unchecked, coalesce(reported, 0) AS reported, coalesce(blocking, 0) AS blocking, coalesce(warnings, 0) AS warnings,
        coalesce(words, 0) AS words, coalesce(errors, 0) AS errors, coalesce(to_listen, 0) AS to_listen, coalesce({CHECK}, 'not_run') AS completeness, CASE WHEN c_custkey IS NULL THEN 'not_run' ELSE {DTD} END AS dtd
      FROM orders LEFT JOIN u ON u.job_id = o_orderkey LEFT JOIN s ON s.job_id = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey),
d AS (SELECT *, concat_ws('; ', CASE WHEN failed > 0 THEN failed || ' segments failed' END, CASE WHEN blocking > 0 THEN blocking || ' blocking issues' END, CASE WHEN simulated THEN 'simulated audio' END,
        CASE WHEN bad_audio > 0 THEN bad_audio || ' segments with bad audio' END, CASE WHEN completeness = 'failed' THEN 'incomplete' END, CASE WHEN dtd = 'failed' THEN 'invalid package' END) AS blockers,
      concat_ws('; ', CASE WHEN warnings > 0 THEN warnings || ' open warnings' END, CASE WHEN awaiting > 0 THEN awaiting || ' await a decision' END, CASE WHEN pending > 0 THEN pending || ' not narrated' END,
        CASE WHEN unchecked > 0 AND NOT simulated THEN unchecked || ' unchecked' END) AS reviews FROM j),
e AS (SELECT *, CASE WHEN job_state = 'queued' AND verified = 0 THEN 'PENDING' WHEN job_state IN ('queued', 'running') THEN 'GENERATING' WHEN job_state = 'assembling' THEN 'VALIDATING'
        WHEN blockers <> '' OR job_state = 'failed' THEN 'BLOCKED' WHEN reviews <> '' OR job_state <> 'completed' THEN 'NEEDS_REVIEW' ELSE 'PASSED' END AS reached FROM d)
"""


@query(
    f"""
WITH {_DECISION}
SELECT job_id, CASE WHEN job_state = 'cancelled' THEN 'BLOCKED' ELSE reached END AS state, CASE WHEN job_state = 'cancelled' AND reached <> 'BLOCKED' THEN concat_ws('; ', nullif(blockers, ''), 'stopped before the end') ELSE blockers END AS blockers, reviews,
       CASE WHEN failed > 0 THEN 'failed' WHEN job_state = 'completed' THEN 'passed' ELSE 'in_progress' END AS technical,
       CASE WHEN blocking > 0 THEN 'failed' WHEN warnings > 0 THEN 'needs_review' WHEN reported > 0 THEN 'passed' ELSE 'not_run' END AS source,
       CASE WHEN simulated THEN 'simulated' WHEN awaiting > 0 THEN 'needs_review' WHEN segments > 0 AND verified = segments THEN 'passed' ELSE 'in_progress' END AS content,
       CASE WHEN simulated THEN 'simulated' WHEN bad_audio > 0 THEN 'failed' WHEN unchecked > 0 THEN 'partial' ELSE 'passed' END AS audio,
       CASE WHEN dtd = 'failed' OR completeness = 'failed' THEN 'failed' WHEN dtd = 'passed' AND completeness = 'passed' THEN 'passed' ELSE 'not_run' END AS package,
       round(errors / nullif(words, 0), 4) AS wer, CAST(to_listen AS BIGINT) AS to_listen
FROM e
"""
)
def release_state(t):
    """CMP16: may this job ship, with blockers, open reviews and the status of each dimension."""
    return decision(t).select("job_id", "state", F.array_join("blockers", "; ").alias("blockers"), F.array_join("reviews", "; ").alias("reviews"), "technical", "source", "content", "audio", "package", "wer", "to_listen")


@query(
    f"""
WITH {_DECISION}
SELECT job_id, CASE WHEN reached = 'PASSED' AND asked THEN 'RELEASED' WHEN asked THEN 'refused: ' || CASE WHEN job_state = 'cancelled' THEN 'BLOCKED' ELSE reached END END AS answer FROM e WHERE asked
"""
)
def release_requests(t):
    """EVT21: a passed book that is asked for becomes released, any other request is refused with the state."""
    rows = decision(t).filter("asked")
    return rows.select("job_id", F.when(F.col("state") == "PASSED", "RELEASED").otherwise(F.concat(F.lit("refused: "), F.col("state"))).alias("answer"))


OUTCOME = "CASE WHEN state = 'verified' AND action = 'accept_flagged' THEN 'auto' WHEN state = 'verified' AND errors > 7 THEN 'corrected' WHEN state = 'verified' THEN 'correct' WHEN state = 'needs_human_review' THEN 'review' WHEN state IN ('unresolved', 'failed') THEN state ELSE 'pending' END"
OUTCOMES = ["correct", "corrected", "auto", "review", "unresolved", "failed", "pending"]


def _outcome():
    verified = F.col("state") == "verified"
    return (
        F.when(verified & (F.col("action") == "accept_flagged"), "auto").when(verified & (F.col("errors") > 7), "corrected").when(verified, "correct")
        .when(F.col("state") == "needs_human_review", "review").when(F.col("state").isin("unresolved", "failed"), F.col("state")).otherwise("pending")
    )


@query(
    f"WITH u AS (SELECT *, {OUTCOME} AS outcome FROM ({_UNITS})) SELECT job_id, CAST(count(*) AS BIGINT) AS segments, "
    + ", ".join(f"CAST(count(*) FILTER (outcome = '{o}') AS BIGINT) AS {o}" for o in OUTCOMES)
    + " FROM u GROUP BY job_id"
)
def outcome_totals(t):
    """AGG07, AGG08: every unit's outcome (accepted on its own, corrected by a retake, ...) and the totals of a job."""
    rows = units(t).withColumn("outcome", _outcome())
    return rows.groupBy("job_id").agg(n().alias("segments"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])


@query(f"SELECT job_id, string_agg(printf('%-12s %4d %3d %s', state, words, errors, unit_id), chr(10) ORDER BY unit_id, printf('%-12s %4d %3d', state, words, errors)) AS log FROM ({_UNITS}) GROUP BY job_id")
def unit_log(t):
    """SNK23: a text log of fixed columns, one line a unit."""
    line = F.format_string("%-12s %4d %3d %s", "state", "words", "errors", "unit_id")
    rows = units(t).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("unit_id", line.alias("line")))).alias("lines"))
    return rows.select("job_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("log"))


@query(f"WITH u AS (SELECT *, {OUTCOME} AS outcome FROM ({_UNITS})) SELECT job_id, '{{\"job\":' || job_id || ',\"units\":[' || string_agg('{{\"id\":\"' || unit_id || '\",\"outcome\":\"' || outcome || '\",\"words\":' || words || '}}', ',' ORDER BY unit_id, outcome, words) || ']}}' AS report FROM u GROUP BY job_id")
def json_report(t):
    """SNK22, SNK20, ARR02: one nested JSON document a job."""
    rows = units(t).withColumn("outcome", _outcome()).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(F.col("unit_id").alias("id"), "outcome", "words"))).alias("units"))
    return rows.select("job_id", F.to_json(F.struct(F.col("job_id").alias("job"), "units")).alias("report"))


_EVENTS = "SELECT user_id AS unit_id, event_id, ts, CASE event_type WHEN 'view' THEN 'accept' WHEN 'click' THEN 'retry' WHEN 'purchase' THEN 'correct' ELSE 'note' END AS decision, value FROM events"


def _decisions(t) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "accept").when(F.col("event_type") == "click", "retry").when(F.col("event_type") == "purchase", "correct").otherwise("note")
    return t("events").select(F.col("user_id").alias("unit_id"), "event_id", "ts", kind.alias("decision"), "value")


@query(
    f"""
WITH e AS ({_EVENTS}), d AS (SELECT * FROM e WHERE decision <> 'note'),
p AS (SELECT *, coalesce(lag(decision) OVER (PARTITION BY unit_id ORDER BY ts, event_id), 'retry') AS before FROM d)
SELECT unit_id, event_id, decision, before = 'retry' AS applied, CASE WHEN before <> 'retry' THEN 'conflict' WHEN decision = 'retry' THEN 'pending' ELSE 'verified' END AS state FROM p
"""
)
def decisions(t):
    """EVT19: a decision applies to a unit that waits for one, that is first or after a retry; else it is a conflict and nothing changes."""
    d = _decisions(t).filter("decision <> 'note'")
    before = F.coalesce(F.lag("decision").over(Window.partitionBy("unit_id").orderBy("ts", "event_id")), F.lit("retry"))
    d = d.withColumn("before", before)
    state = F.when(F.col("before") != "retry", "conflict").when(F.col("decision") == "retry", "pending").otherwise("verified")
    return d.select("unit_id", "event_id", "decision", (F.col("before") == "retry").alias("applied"), state.alias("state"))


@query(f"SELECT unit_id, string_agg(event_id || ' ' || decision || ' ' || CAST(floor(value) AS BIGINT), chr(10) ORDER BY ts, event_id) AS log FROM ({_EVENTS}) WHERE decision <> 'note' GROUP BY unit_id")
def review_log(t):
    """SNK24: one line for each human decision, in order."""
    d = _decisions(t).filter("decision <> 'note'").withColumn("line", F.format_string("%d %s %d", "event_id", "decision", F.floor("value")))
    rows = d.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "line"))).alias("lines"))
    return rows.select("unit_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("log"))


@query(
    """
SELECT o_orderkey AS job_id, l_linenumber AS sequence, l_partkey AS part, CASE WHEN verdict = 'verified' OR pieces = 0 THEN '' WHEN defect THEN '' WHEN verdict = 'ambiguous' THEN 'minor' WHEN words < 12 OR match < 0.95 OR span > 2 OR is_value THEN '' ELSE 'long passage' END AS reason,
       CASE WHEN defect THEN 'critical' WHEN is_value AND pieces > 0 THEN 'major' WHEN pieces > 0 THEN 'minor' ELSE 'none' END AS severity
FROM (SELECT o_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'N' THEN 'verified' WHEN 'A' THEN 'ambiguous' ELSE 'likely_error' END AS verdict, CAST(l_discount * 100 AS INT) AS pieces, l_tax > 0.07 AS defect,
             CAST(l_quantity AS INT) AS words, 1 - l_tax AS match, l_suppkey % 4 AS span, l_partkey % 6 = 0 AS is_value FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
"""
)
def auto_acceptance(t):
    """CMP10, CMP14: why a difference may be accepted without a person (a long passage nearly all matched, only short differences, no defect, no value), and the worst severity."""
    rows = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("job_id"), F.col("l_linenumber").alias("sequence"), F.col("l_partkey").alias("part"),
        F.when(F.col("l_returnflag") == "N", "verified").when(F.col("l_returnflag") == "A", "ambiguous").otherwise("likely_error").alias("verdict"), F.round(F.col("l_discount") * 100).cast("int").alias("pieces"),
        (F.col("l_tax") > 0.07).alias("defect"), F.col("l_quantity").cast("int").alias("words"), (1 - F.col("l_tax")).alias("match"), (F.col("l_suppkey") % 4).alias("span"), (F.col("l_partkey") % 6 == 0).alias("is_value"),
    )
    col = F.col
    reason = (
        F.when((col("verdict") == "verified") | (col("pieces") == 0), "").when(col("defect"), "").when(col("verdict") == "ambiguous", "minor")
        .when((col("words") < 12) | (col("match") < 0.95) | (col("span") > 2) | col("is_value"), "").otherwise("long passage")
    )
    severity = F.when(col("defect"), "critical").when(col("is_value") & (col("pieces") > 0), "major").when(col("pieces") > 0, "minor").otherwise("none")
    return rows.select("job_id", "sequence", "part", reason.alias("reason"), severity.alias("severity"))


@query(f"SELECT o_orderkey AS job_id, {JOB} AS was, CASE WHEN {JOB} = 'running' THEN 'queued' ELSE {JOB} END AS now, coalesce(reset, 0) AS units_reset FROM orders LEFT JOIN (SELECT l_orderkey, CAST(count(*) FILTER ({UNIT} = 'generating') AS BIGINT) AS reset FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def restarted_jobs(t):
    """EVT14: after a crash what was being generated is pending again, what ran is queued."""
    from quirework.streaming.events import recovered

    reset = recovered(units(t).withColumn("was", F.col("state"))).filter("was <> state").groupBy("job_id").agg(n().alias("units_reset"))
    jobs = recovered(t("orders").select(F.col("o_orderkey").alias("job_id"), F.expr(JOB).alias("state")).withColumn("was", F.col("state")))
    return jobs.join(reset, "job_id", "left").select("job_id", "was", F.col("state").alias("now"), F.coalesce("units_reset", F.lit(0)).alias("units_reset"))


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 3600 SECOND OR event_type NOT IN ('purchase', 'error')")
def live_tasks(t):
    """EVT17: finished tasks are forgotten an hour after their end; others stay."""
    finished = F.col("event_type").isin("purchase", "error")
    return t("events").filter((F.col("ts") >= F.lit("2024-01-20").cast("timestamp") - F.expr("INTERVAL 3600 SECOND")) | ~finished).select("event_id", "user_id")


_SECTION = "SELECT job_id, sequence, string_agg(unit_id || ':' || state, ' ' ORDER BY unit_id || ':' || state) AS units, CAST(count(*) FILTER (state = 'verified') AS BIGINT) AS verified, CAST(count(*) FILTER (state IN ('failed', 'needs_human_review', 'unresolved')) AS BIGINT) AS problems, CAST(sum(words) AS BIGINT) AS words FROM ({}) GROUP BY job_id, sequence"


@query(
    f"SELECT job_id, CAST(count(*) AS BIGINT) AS sections, string_agg('[' || sequence || ': ' || units || ' = ' || words || ']', ' ' ORDER BY sequence) AS structure, CAST(sum(verified) AS BIGINT) AS verified, CAST(sum(problems) AS BIGINT) AS problems FROM ({_SECTION.format(_UNITS)}) JOIN orders ON o_orderkey = job_id GROUP BY job_id"
)
def job_structure(t):
    """PRJ23, AGG27, JON02, UI01, UI06, UI10, UI11: jobs with their sections in order, each with its units and their live state, and counters."""
    s = units(t).groupBy("job_id", "sequence").agg(
        F.array_sort(F.collect_list(F.concat_ws(":", "unit_id", "state"))).alias("units"), F.count_if(F.col("state") == "verified").alias("verified"),
        F.count_if(F.col("state").isin("failed", "needs_human_review", "unresolved")).alias("problems"), F.sum("words").alias("words"),
    )
    s = s.join(t("orders").select(F.col("o_orderkey").alias("job_id")), "job_id")
    text = F.concat(F.lit("["), F.col("sequence"), F.lit(": "), F.array_join("units", " "), F.lit(" = "), F.col("words"), F.lit("]"))
    rows = s.groupBy("job_id").agg(n().alias("sections"), F.array_sort(F.collect_list(F.struct("sequence", text.alias("text")))).alias("all"), F.sum("verified").alias("verified"), F.sum("problems").alias("problems"))
    return rows.select("job_id", "sections", F.array_join(F.transform("all", lambda x: x["text"]), " ").alias("structure"), "verified", "problems")
