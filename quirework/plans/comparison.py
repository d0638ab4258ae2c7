"""Comparing what was written with what was heard: alignments, canonical tokens, differences and verdicts.

Conversations give pairs of texts (a question and its answer). Customers give sentences with numbers and amounts, written as in a book and
as they are said; faults of a recogniser are planted into some of the latter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import alignment as A
from quirework.functions import numbers as N
from quirework.functions import text as T
from quirework.operators import canonical as C
from quirework.operators import review as R
from quirework.operators.written import written

from .registry import query

_TURNS = """
q AS (SELECT conv_id, turn, role, text AS expected, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS heard FROM conversations),
p AS (SELECT conv_id, turn, regexp_extract_all(lower(expected), '[\\p{L}\\p{N}]+') AS a, regexp_extract_all(lower(heard), '[\\p{L}\\p{N}]+') AS b FROM q WHERE role = 'user' AND heard IS NOT NULL AND expected IS NOT NULL)"""


def _turn_pairs(t) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t("conversations").select("conv_id", "turn", "role", F.col("text").alias("expected"), F.lead("text").over(w).alias("heard"))
    c = c.filter("role = 'user' and heard is not null and expected is not null").drop("role")
    # pairs cost as much as their lengths' product: they are dealt to all tasks, however small the table is
    parts = int(c.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return c.select("conv_id", "turn", T.words(F.col("expected")).alias("a"), T.words(F.col("heard")).alias("b")).repartition(parts, "conv_id", "turn")


@query(
    rf"""
WITH RECURSIVE {_TURNS},
d AS (
  SELECT conv_id, turn, a, b, len(a) AS n, len(b) AS m, 0 AS t, 0 AS low_one, [{{'c': 0, 'o': 0, 's': 0, 'd': 0, 'i': 0}}] AS one, 0 AS low_two, CAST([] AS STRUCT(c INTEGER, o INTEGER, s INTEGER, d INTEGER, i INTEGER)[]) AS two FROM p
  UNION ALL
  SELECT conv_id, turn, a, b, n, m, t + 1, greatest(0, t + 1 - n),
    list_transform(range(greatest(0, t + 1 - n), least(t + 1, m) + 1), lambda j: list_min([
      CASE WHEN j >= 1 AND t + 1 - j >= 1 THEN {{'c': two[j - low_two].c + CAST(a[t + 1 - j] <> b[j] AS INTEGER), 'o': 0, 's': two[j - low_two].s + CAST(a[t + 1 - j] <> b[j] AS INTEGER), 'd': two[j - low_two].d, 'i': two[j - low_two].i}} END,
      CASE WHEN t + 1 - j >= 1 THEN {{'c': one[j + 1 - low_one].c + 1, 'o': 1, 's': one[j + 1 - low_one].s, 'd': one[j + 1 - low_one].d + 1, 'i': one[j + 1 - low_one].i}} END,
      CASE WHEN j >= 1 THEN {{'c': one[j - low_one].c + 1, 'o': 2, 's': one[j - low_one].s, 'd': one[j - low_one].d, 'i': one[j - low_one].i + 1}} END])),
    low_one, one
  FROM d WHERE t < n + m),
e AS (SELECT *, one[m + 1 - low_one] AS x FROM d WHERE t = n + m)
SELECT conv_id, turn, CAST(n AS INTEGER) AS expected_words, CAST(m AS INTEGER) AS heard_words, CAST(x.s AS INTEGER) AS substitutions, CAST(x.d AS INTEGER) AS deletions, CAST(x.i AS INTEGER) AS insertions, CAST(n - x.s - x.d AS INTEGER) AS matches,
  CASE WHEN n > 0 THEN round((x.s + x.d + x.i) / n, 4) WHEN m > 0 THEN 1.0 ELSE 0.0 END AS wer FROM e
"""
)
def alignment_counts(t):
    """CMP04: substitutions, deletions, insertions and matches of the words of each answer against its question, ties in a fixed order."""
    p = _turn_pairs(t).select("conv_id", "turn", "a", "b").withColumn("c", A.edit_counts(F.col("a"), F.col("b")))
    n, m, errors = F.size("a"), F.size("b"), F.col("c.substitutions") + F.col("c.deletions") + F.col("c.insertions")
    return p.select("conv_id", "turn", n.alias("expected_words"), m.alias("heard_words"), "c.*", A.error_rate(errors, n, m).alias("wer"))


@query()
def wer_pairs(t):
    """CMP05: word and character error rates to four places, for pairs of any length (the reference leaves out the characters of very long ones). No SQL: DuckDB's distance counts bytes."""
    joined = lambda c: F.array_join(c, " ")
    p = _turn_pairs(t).select("conv_id", "turn", "a", "b", joined("a").alias("x"), joined("b").alias("y"))
    p = p.withColumns({"c": A.edit_counts(F.col("a"), F.col("b")), "distance": A.edit_distance(F.col("x"), F.col("y"))})
    errors = F.col("c.substitutions") + F.col("c.deletions") + F.col("c.insertions")
    cer = F.when(F.length("x") > 0, F.round(F.col("distance") / F.length("x"), 4)).otherwise(0.0)
    return p.select("conv_id", "turn", F.size("a").alias("expected_words"), F.size("b").alias("heard_words"), "c.*", A.error_rate(errors, F.size("a"), F.size("b")).alias("wer"), cer.alias("cer"))


def _sentences(t) -> DataFrame:
    """c_custkey, expected, heard: each customer's number and balance, written and said; faults in some of what was heard."""
    key, balance = F.col("c_custkey"), F.abs(F.col("c_acctbal").cast("decimal(15,2)"))
    euros, cents = F.floor(balance).cast("bigint"), F.round((balance - F.floor(balance)) * 100).cast("bigint")
    thousands = F.floor(euros / 1000).cast("bigint")
    grouped = F.when(euros >= 1000, F.concat(thousands.cast("string"), F.lit("."), F.lpad((euros % 1000).cast("string"), 3, "0"))).otherwise(euros.cast("string"))
    expected = F.concat(F.lit("El cliente "), key.cast("string"), F.lit(" debe "), grouped, F.lit(","), F.lpad(cents.cast("string"), 2, "0"), F.lit(" € en la cuenta "), F.col("c_name"), F.lit("."))
    fault = F.crc32(F.col("c_name").cast("binary")) % 12

    def said(n: Column) -> Column:
        return F.concat(N.cardinal(n, "m"), F.when(n == 1, " euro").otherwise(" euros"), F.when(cents > 0, F.concat(F.lit(" con "), N.cardinal(cents, "m"), F.when(cents == 1, " céntimo").otherwise(" céntimos"))).otherwise(""))

    heard = F.concat(
        F.lit("el cliente "), N.cardinal(key), F.when(fault == 1, " debe debe ").when(fault == 2, " de debe ").otherwise(" debe "), F.when(fault == 3, said(euros + 1)).otherwise(said(euros)),
        F.when(fault == 4, " en cuenta ").when(fault == 5, " en la quenta ").when(fault == 6, " en la ventana ").otherwise(" en la cuenta "), F.col("c_name"), F.when(fault == 7, " y nada").otherwise(""),
    )
    rows = t("customer").select("c_custkey", expected.alias("expected"), heard.alias("heard")).filter("expected is not null and heard is not null")
    # a small table is one file: its texts are dealt to all tasks
    return written(rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "c_custkey"), "sentences")


@query()
def canonical_words(t):
    """NUM25, NUM26, NUM30 to NUM34: the canonical tokens of what is written and of what is said, with their spans. No SQL: the test has hand-made values."""
    s = _sentences(t)
    side = lambda c: s.select("c_custkey", F.lit(c).alias("side"), F.col(c).alias("text"), C.expects_time(F.col("expected")).alias("time"), C.expects_date(F.col("expected")).alias("date"))
    return C.canonical_tokens(side("expected").unionAll(side("heard")), ["c_custkey", "side"])


@query()
def transcript_differences(t):
    """CMP01, CMP02, CMP03, CMP07, CMP08, STR24, STR25: what was heard otherwise, where in both texts, and of what kind. No SQL: held against difflib and hand-made pairs."""
    issues, _ = R.compare(_sentences(t), ["c_custkey"])
    return issues.select("c_custkey", "step", "kind", "missing", "said", "expected_begin", "expected_end", "heard_begin", "heard_end", "difference", "category", "rule", "span")


@query()
def verdicts(t):
    """CMP06: verified, ambiguous or likely an error, with the share of the text that matched. No SQL: hand-made pairs."""
    return R.compare(_sentences(t), ["c_custkey"])[1]
