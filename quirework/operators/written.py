"""Tables written between the rounds of a loop, so that lineage stays short and a lost executor costs one round."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only where it is unset and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-quirework-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quirework/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
