import datetime as dt

import pytest
from pyspark.sql import functions as F

from quirework.operators import ordered as O
from quirework.operators import relational as R
from quirework.streaming import events as E


def at(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(minutes=n)


TAKES = [("a", 1, "likely_error", False), ("a", 2, "verified", False), ("b", 1, "likely_error", False), ("b", 2, "verified", True), ("b", 3, "likely_error", False), ("b", 4, "verified", False), ("c", 1, "ambiguous", False), ("c", 2, "verified", False)]
WANT = [("a", 1, "retake", 1), ("a", 2, "verified", 1), ("b", 1, "retake", 1), ("b", 2, "retake", 2), ("b", 3, "needs_human_review", 2), ("c", 1, "accept_flagged", 0)]
SCHEMA = "unit_id string, take int, verdict string, problem boolean"


def stream(spark, tmp_path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def drained(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_takes_in_batch_and_stream_agree(spark, tmp_path):
    assert sorted(map(tuple, E.take_states(spark.createDataFrame(TAKES, SCHEMA)).collect())) == WANT
    src = stream(spark, tmp_path, [TAKES[:4], TAKES[4:]], SCHEMA)
    assert sorted(map(tuple, drained(E.take_machine(src), tmp_path, "takes").collect())) == WANT


def test_windowed_counts(spark, tmp_path):
    schema = "k string, ts timestamp, value double"
    rows = [("a", at(1), 1.0), ("a", at(2), 2.0), ("a", at(31), 4.0), ("a", at(65), 0.0)]
    counts = lambda d: E.windowed_counts(d, ["k"], "ts", "10 minutes", "5 minutes")
    batch = {tuple(r) for r in counts(spark.createDataFrame(rows, schema)).collect()}
    assert batch == {(at(0), at(10), "a", 2, 3.0), (at(30), at(40), "a", 1, 4.0), (at(60), at(70), "a", 1, 0.0)}
    out = {tuple(r) for r in drained(counts(stream(spark, tmp_path, [rows], schema)), tmp_path, "counts").collect()}
    assert out == {r for r in batch if r[0] < at(60)}  # the last window is still open
    runs = {(r.start, r.n) for r in E.sessions(spark.createDataFrame(rows, schema), ["k"], "ts", "15 minutes", "5 minutes").collect()}
    assert runs == {(at(1), 2), (at(31), 1), (at(65), 1)}


def test_dedupe_stream(spark, tmp_path):
    src = stream(spark, tmp_path, [[("x", at(0)), ("x", at(1)), ("y", at(1))], [("x", at(2))]], "key string, ts timestamp")
    assert sorted(r.key for r in drained(E.first_of_keys(src, ["key"], "ts", "1 hour"), tmp_path, "firsts").collect()) == ["x", "y"]


def test_retention_and_recovery(spark):
    df = spark.createDataFrame([("a", "generating", at(0)), ("b", "verified", at(60 * 24 * 40))], "u string, state string, ts timestamp")
    assert [r.u for r in E.live(df, "ts", at(60 * 24 * 45)).collect()] == ["b"]
    assert [r.state for r in E.recovered(df).orderBy("u").collect()] == ["pending", "verified"]


def test_clip_tiling_against_a_loop(spark):
    starts = [(0, [1000, 3500, 6000], 9456), (1, [5, 5, 5, 900], 700), (2, [0, 10], 2)]
    rows = [(g, i, s, total) for g, ss, total in starts for i, s in enumerate(ss)]
    got = O.tiled_clips(spark.createDataFrame(rows, "g int, i int, s bigint, total bigint"), ["g"], ["i"], "s", "total").orderBy("g", "i").collect()
    for g, ss, total in starts:
        clips = [(r.begin_ms, r.end_ms) for r in got if r.g == g]
        at_, want = -1, []
        for i, s in enumerate(ss):
            at_ = 0 if i == 0 else min(max(s, at_ + 1), total - (len(ss) - i))
            want.append(at_)
        assert [b for b, _ in clips] == want and [e for _, e in clips] == want[1:] + [total]


def test_overlay_and_references(spark):
    base = spark.createDataFrame([("s:0", "uno"), ("s:1", "dos"), ("s:2", "tres")], "slot string, text string")
    edits = spark.createDataFrame([("s:0", "UNO"), ("s:1", ""), ("s:9", "x")], "slot string, text string")
    assert sorted(map(tuple, R.overlay(base, edits, "slot", "text").collect())) == [("s:0", "UNO"), ("s:2", "tres")]
    assert [r.slot for r in R.require_known(edits, base, "slot").collect()] == ["s:9"]


def test_text_columns(spark):
    from quirework.functions import text as T

    one = lambda f, *v: spark.range(1).select(f(*map(F.lit, v)).alias("x")).first().x
    assert [one(T.clock_seconds, v) for v in ("1500ms", "0:01:02.5", "01:30", "2min", "0:61:00", "x", "1h")] == [1.5, 62.5, 90.0, 120.0, None, None, 3600.0]
    assert one(T.clock_text, 3725.25) == "1:02:05.3"
    assert one(T.dehyphenated, "disca-\npacidad y Sur-\nAmérica") == "discapacidad y Sur- América"
    assert one(T.clean_lines, "a  b\na b\nc­") == "a b\nc"
    assert [one(T.retry_after, v) for v in ("5", "x", "601")] == [5.0, None, None]
    assert one(T.safe_name, "¿Qué año? Sí") == "Que_ano_Si"
    rows = spark.createDataFrame([("Prólogo ……… ix",), ("Capítulo 1",), ("La isla    12",), ("El faro 7",)], "t string").select(*T.contents_row(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [("Prólogo", "ix"), ("Capítulo 1", ""), ("La isla", "12"), ("El faro", "7")]
