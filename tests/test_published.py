"""Tables published together, and a stream that appends each batch once."""

import pytest
from pyspark.sql import functions as F

from quirework.sources.published import Published, append_events


def tables(spark, job, units=3):
    jobs = spark.createDataFrame([(job, "queued")], "job_id int, state string")
    children = spark.range(units).select(F.lit(job).alias("job_id"), F.col("id").alias("sequence"))
    return {"jobs": jobs, "units": children}


def test_nothing_is_seen_of_a_batch_that_failed_between_its_tables(spark, tmp_path):
    store = Published(spark, str(tmp_path))
    assert store.read("jobs") is None and store.publish("a", tables(spark, 1))
    broken = tables(spark, 2)
    broken["units"] = broken["units"].withColumn("sequence", F.raise_error(F.lit("no")).cast("bigint"))
    with pytest.raises(Exception, match="no"):
        store.publish("b", broken)
    assert [r.job_id for r in store.read("jobs").collect()] == [1] and store.read("units").count() == 3
    assert store.publish("b", tables(spark, 2, 5))
    assert sorted(r.job_id for r in store.read("jobs").collect()) == [1, 2] and store.read("units").count() == 8


def test_a_replay_adds_nothing(spark, tmp_path):
    store = Published(spark, str(tmp_path))
    assert store.publish("a", tables(spark, 1)) and not store.publish("a", tables(spark, 1, 9))
    assert store.read("units").count() == 3 and len(store.commits()) == 1


def test_a_stream_starts_again_without_loss_or_doubles(spark, tmp_path):
    source, root, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    write = lambda a, b: spark.range(a, b).coalesce(1).write.mode("append").parquet(source)
    write(0, 10)

    def run(sink):
        q = spark.readStream.schema("id bigint").parquet(source).writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()

    run(append_events(root))
    write(10, 25)

    def fails_after_publishing(batch, batch_id):
        append_events(root)(batch, batch_id)
        raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        run(fails_after_publishing)
    run(append_events(root))  # the same batch again
    write(25, 30)
    run(append_events(root))
    assert sorted(r.id for r in Published(spark, root).read("events").collect()) == list(range(30))
