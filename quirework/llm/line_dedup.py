"""Line dedup: lines whose normalised form stands in many documents stay in one of them only.

Each line is normalised (white space stripped at both ends, A-Z lower-cased) and hashed to 128 bits;
keys of enough code points are counted by distinct documents, and those at or over the threshold lose
their lines in every document but the one with the smallest id. Texts are put together again by the
position of what stays. DataFrame functions only.

Only hashes, ids and positions are shuffled by line; a line found in a third of all documents is
aggregated before its shuffle (its smallest and largest document), and the join back to its documents
is one that adaptive execution splits. Texts move once, by document.

Nulls: a null text is one empty line; rows with a null id belong to no document: they hold no key and
keep all lines. Repeated rows of an id are one document and each lose the same lines. Very long texts are read
whole; what a text drops is a list of its line numbers. Ties: the smallest id keeps the line. Extra columns are not read, whatever
their names; columns to keep may have any name but those of the result. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise

#: White space of the contract: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def duplicate_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """h1, h2, keeper of the keys that stand in at least ``min_docs`` documents."""
    if min_docs <= 2:  # two different documents hold it just if the smallest and the largest differ
        found = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))
        return found.filter("keeper <> last").select("h1", "h2", "keeper")
    each = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    return each.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.count("one").alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2", "keeper")


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: doc_id) + kept (the new text), n_lines, n_dropped for each row."""
    keep = keep or ["doc_id"]
    src = docs.select(*keep, F.col("doc_id").alias("__doc"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    # ids may repeat with other texts: positions belong to a text
    src = src.withColumn("__mark", F.xxhash64("__text"))
    keys = (
        src.filter("__doc is not null")
        .select(F.col("__doc").alias("doc_id"), F.col("__mark").alias("mark"), F.posexplode(F.transform(_lines(F.col("__text")), line_key)).alias("pos", "key"))
        .filter(F.length("key") >= min_chars)
        .select("doc_id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(0x51ED27), F.reverse("key")).alias("h2"))
    )
    repeated = materialise(duplicate_keys(keys, min_docs), "repeated-lines")
    dropped = (
        keys.join(repeated, ["h1", "h2"])
        .filter("doc_id <> keeper")
        .groupBy("doc_id", "mark")
        .agg(F.collect_set("pos").alias("__gone"))
        .select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark"), "__gone")
    )
    lines = _lines(F.col("__text"))
    gone = F.coalesce("__gone", F.array().cast("array<int>"))
    out = src.join(dropped, ["__doc", "__mark"], "left").withColumns({"__lines": lines, "__gone": gone})
    places = F.sequence(F.lit(0), F.size("__lines") - 1)
    stays = F.transform(F.array_except(places, F.col("__gone")), lambda i: F.get("__lines", i))
    kept = F.when(F.size("__gone") == 0, F.col("__text")).otherwise(F.array_join(stays, "\n"))
    return out.select(*keep, kept.alias("kept"), F.size("__lines").cast("bigint").alias("n_lines"), F.size("__gone").cast("bigint").alias("n_dropped"))


def digests(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
rep AS (SELECT key, min(doc_id) AS keeper FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.*, coalesce(r.keeper <> l.doc_id, false) AS gone FROM lines l LEFT JOIN rep r ON l.key = r.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
