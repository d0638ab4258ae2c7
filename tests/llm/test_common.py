import os
from types import SimpleNamespace

import pytest

from quirework.llm import _common as c


def fake(master, folder):
    conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_a_cluster_without_a_shared_folder_is_refused():
    assert c.shared_dir(fake("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        c.shared_dir(fake("spark://host:7077", None))


def test_tables_are_written_and_dropped(spark):
    t = c.materialise(spark.range(5), "some")
    path = t._quirework_path.removeprefix("file:")
    assert t.count() == 5 and os.path.isdir(path) and spark.sparkContext.applicationId in path
    c.drop(t)
    assert not os.path.exists(path)


def test_slices_cover_every_row(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(c, "SLICE_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (3, 30, 0, 8, 8)] + [None]})
    assert [x for b in c.slices(batch, "text") for x in b.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert list(c.slices(batch.slice(0, 0), "text")) == []
