import hashlib
from collections import defaultdict

import pytest

from quirework.llm import line_dedup

SCHEMA = "doc_id bigint, text string, key string, pos int, h1 bigint, kept string, n_lines string"


def brute(rows):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                holders[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [d is not None and len(key(x)) >= 10 and len(holders[key(x)]) >= 2 and min(holders[key(x)]) != d for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((d, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


ROWS = [
    (1, "A line that repeats\nown line number one\nshort"),
    (2, "  a LINE that repeats\t\nshort\nown line number two"),
    (3, "a line that repeats\na line that repeats"),
    (4, None), (5, ""), (6, "\n\n"), (7, "ÉCOLE PRIMAIRE X\nécole primaire x"), (8, "école primaire x"),
    (9, "twice in one document\ntwice in one document"),
    (10, "x" * 200_000 + "\na line that repeats"), (None, "a line that repeats"), (11, "123456789\n1234567890"), (12, "123456789\n1234567890"),
    (13, "a line that repeats\nother"), (13, "a line that repeats\nother"),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(d, t, "x", 1, 2, "k", "n") for d, t in ROWS], SCHEMA)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digests(df).collect()]
    assert sorted(got, key=repr) == sorted(brute(ROWS), key=repr)


def test_threshold_of_three(spark):
    rows = [(i, "found in three documents" if i < 3 else "found in two documents!!") for i in range(5)]
    out = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), min_docs=3).collect()}
    assert out == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0}


def test_empty_table(spark):
    assert line_dedup.digests(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("n", [400])
def test_hot_line(spark, n):
    rows = [(i, f"the very same hot line\nown {i}") for i in range(n)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8))
    assert out.agg({"n_dropped": "sum"}).first()[0] == n - 1


def test_plan_has_no_python(spark):
    plan = line_dedup.digests(spark.createDataFrame(ROWS, "doc_id bigint, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
