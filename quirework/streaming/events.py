"""Event-time forms of the production log, on Structured Streaming.

The batch forms live in ``operators``; these keep the same results over an unbounded input:
deduplication of content keys, windowed counts with late data, retention by time to live, and the
per-unit machine of takes (accept, retake, escalate).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_of_keys(events: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """One row per key within the watermark: in-flight and repeated submissions coalesce."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, by: list[str], time: str, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per (sliding) window; rows later than ``delay`` are dropped by the watermark."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return (
        events.withWatermark(time, delay).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "value")
    )


def sessions(events: DataFrame, by: list[str], time: str, gap: str, delay: str) -> DataFrame:
    """Runs of events without a gap."""
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def next_state(verdict: str, retakes: int, most: int, problem: bool) -> tuple[str, int]:
    """(state, retakes) after one take."""
    if verdict == "verified" and not problem:
        return "verified", retakes
    if verdict == "ambiguous" and not problem:
        return "accept_flagged", retakes
    return ("retake", retakes + 1) if retakes < most else ("needs_human_review", retakes)


TAKE_STATE = "retakes int, done boolean"
TAKE_OUT = "unit_id string, take int, state string, retakes int"


def take_machine(takes: DataFrame, most: int = 2, time_to_live: str = "30 days") -> DataFrame:
    """unit_id, take, state, retakes of each take (unit_id, take, verdict, problem), in order of takes; takes after the end are ignored."""
    ms = int(pd.Timedelta(time_to_live).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        retakes, done = state.get if state.exists else (0, False)
        rows = pd.concat(list(batches)).sort_values("take")
        out = []
        for r in rows.itertuples():
            if done:
                break
            name, retakes = next_state(r.verdict, retakes, most, bool(r.problem))
            done = name != "retake"
            out.append((key[0], r.take, name, retakes))
        state.update((retakes, done))
        state.setTimeoutDuration(ms)
        yield pd.DataFrame(out, columns=["unit_id", "take", "state", "retakes"])

    return takes.groupBy("unit_id").applyInPandasWithState(step, TAKE_OUT, TAKE_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def take_states(takes: DataFrame, most: int = 2) -> DataFrame:
    """The same over a finished log, with windows only: the k-th take that is neither verified nor ambiguous is a retake while k <= most."""
    from pyspark.sql import Window

    w = Window.partitionBy("unit_id").orderBy("take")
    problem = F.coalesce(F.col("problem"), F.lit(False))
    good = F.when((F.col("verdict") == "verified") & ~problem, "verified").when((F.col("verdict") == "ambiguous") & ~problem, "accept_flagged")
    rows = takes.withColumn("good", good).withColumn("bad", F.sum(F.col("good").isNull().cast("int")).over(w))
    state = F.coalesce("good", F.when(F.col("bad") <= most, "retake").otherwise("needs_human_review"))
    rows = rows.withColumns({"state": state, "retakes": F.least("bad", F.lit(most)).cast("int")})
    ended = F.coalesce(F.max((F.col("state") != "retake").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("ended", ended).filter("ended = 0").select("unit_id", "take", "state", "retakes")


def live(rows: DataFrame, time: str, now, days: int = 30) -> DataFrame:
    """Rows younger than their time to live at ``now``."""
    return rows.filter(F.col(time) >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def recovered(units: DataFrame) -> DataFrame:
    """After a crash: what was being generated is pending again."""
    return units.withColumn("state", F.when(F.col("state") == "generating", "pending").when(F.col("state") == "running", "queued").otherwise(F.col("state")))
