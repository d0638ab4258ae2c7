"""Tables that are published together: a parent and its children, or one batch of a stream, become visible at once or not at all.

A batch writes each of its tables into a folder of its own attempt, then one small manifest that names the attempt, under a
temporary name, and renames it to the batch's name. Readers read what manifests name, so files of an attempt that failed are never seen. A
batch that has a manifest is published already, and publishing it again does nothing: a replay after a failure is safe.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Published:
    """A group of tables in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _manifest(self, batch: str) -> str:
        return f"{self.root}/_commits/{batch}.json"

    def is_published(self, batch: str) -> bool:
        return self.fs.exists(self._path(self._manifest(batch)))

    def publish(self, batch: str, tables: dict[str, DataFrame]) -> bool:
        """Writes all tables of a batch and makes them visible; False if the batch was published before."""
        if self.is_published(batch):
            return False
        attempt = f"{batch}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/{attempt}")
        text = json.dumps({"attempt": attempt, "tables": {name: df.schema.jsonValue() for name, df in tables.items()}})
        staged = self._path(f"{self.root}/_commits/_{attempt}")
        out = self.fs.create(staged, False)
        out.write(bytearray(text.encode()))
        out.close()
        # the one step that counts; it fails if another attempt of the batch has been there first
        if self.fs.rename(staged, self._path(self._manifest(batch))):
            return True
        self.fs.delete(staged, False)
        return False

    def commits(self) -> list[dict]:
        """The manifests, by batch."""
        folder = self._path(f"{self.root}/_commits")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        paths = [f"{self.root}/_commits/{n}" for n in sorted(names) if n.endswith(".json")]
        rows = self.spark.read.text(paths, wholetext=True).collect() if paths else []
        return [json.loads(r.value) for r in rows]

    def read(self, name: str) -> DataFrame | None:
        """A table's rows of all published batches; None before the first one."""
        named = [c for c in self.commits() if name in c["tables"]]
        if not named:
            return None
        schema = T.StructType.fromJson(named[0]["tables"][name])
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{c['attempt']}" for c in named])


def append_events(root: str, table: str = "events") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch of a stream is appended once, whatever is replayed after a restart."""

    def append(batch: DataFrame, batch_id: int) -> None:
        Published(batch.sparkSession, root).publish(f"{batch_id:020d}", {table: batch})

    return append
