"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one Python call works on; batches are cut to this, so memory is bounded whatever the batch.
SLICE_BYTES = 4 << 20

#: Tasks that read a labelled sample.
SAMPLE_PARTS = 16

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and all runs on this machine (tests), one of our own."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-quirework-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return _own_dirs[app]


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet into the shared folder and reads it back.

    Every application writes below a folder of its own name, which can go when it has ended; what a
    query no longer needs while it runs goes by ``drop``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quirework/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quirework_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables of ``materialise`` that nothing will read again."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t._quirework_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Cuts a batch at row ends so that the column ``text`` of each piece holds about SLICE_BYTES at most."""
    start, size = 0, 0
    lengths = pc.binary_length(batch.column(text)).to_pylist()
    for i, n in enumerate(lengths):
        n = n or 0
        if i > start and size + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], list[list]]],
    fields: str,
    text: str,
    keep: list[str],
) -> DataFrame:
    """One output row per row of ``df``: the columns ``keep`` and those that the function gives.

    ``make()`` runs once per task and returns ``texts -> [column, ...]`` in the order of ``fields``;
    null texts reach it as empty ones.
    """
    src = df.select(*keep, F.col(text).alias("__text"))
    extra = T._parse_datatype_string(fields)
    schema = T.StructType([*src.select(*keep).schema.fields, *extra.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            for b in slices(whole, "__text"):
                cols = fn([t or "" for t in b.column("__text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [b.column(k).cast(arrow.field(k).type) for k in keep]
                    + [pa.array(c, type=arrow.field(len(keep) + i).type) for i, c in enumerate(cols)],
                    schema=arrow,
                )

    return src.mapInArrow(run, schema)


def held_out(doc_id: str, folds: int, fold: int):
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds`` (false for null ids)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int) -> DataFrame:
    """label, text of ``rows_per_class`` documents of each class (0 and 1), or of all if there are fewer; written, and read where it is used.

    Taken are the ids with the smallest hashes, so the sample is the same at every run. Only labels of
    documents that are here are counted and thinned, so every place is filled; null texts are empty ones, very long
    ones count like any other; of an id's rows one is taken. Texts of other rows are not moved.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h = F.xxhash64("doc_id").bitwiseAND(0x7FFFFFFFFFFFFFFF).alias("h")
    ids = labels.filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"), h).distinct()
    ids = materialise(ids.join(texts.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled-ids")
    sizes = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = []
    for value, n in sorted(sizes.items()):
        of = ids.filter(F.col("label") == value)
        if n > 2 * rows_per_class + 64:  # twice as many as wanted, so that the sort stays small
            of = of.filter(F.col("h") <= int((2 * rows_per_class + 64) / n * 2.0**63))
        parts.append(of.orderBy("h", "doc_id").limit(rows_per_class))
    if not parts:
        return docs.sparkSession.createDataFrame([], "label int, text string")
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionAll(p)
    # 2 * rows_per_class ids at most, so it can be broadcast; of texts that differ, the smallest
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "h").agg(F.min("text").alias("text"))
    return materialise(found.repartition(SAMPLE_PARTS, "doc_id").select("label", "text"), "labelled-sample")


def labels_of_class(labels: DataFrame, label: str) -> tuple[int, int]:
    """Labels of class 1, and of both."""
    ones, n = labels.filter(F.col(label).isin(0, 1)).agg(F.sum(F.col(label).cast("bigint")), F.count("*")).first()
    return int(ones or 0), int(n)


def read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """Labels and texts of a labelled sample, in pieces of about SLICE_BYTES."""
    for whole in batches:
        for b in slices(whole, "text"):
            yield b.column("label").to_pylist(), b.column("text").to_pylist()
