"""The corpus pipeline: from raw documents to packed training windows.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever further ones there are and however they are
called: a row travels whole beside what a stage works on. Null and empty texts are scored, kept or dropped like any other and packed
as one end id; repeated rows stay repeated until the Jaccard join drops whole ids; rows with a null id are kept by every stage. An empty table
gives an empty one. Very long texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import jaccard_join, line_dedup, packing, quality, toxicity
from quirework.llm._common import materialise, table


def _beside(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the whole row in one column, so that no further column can clash."""
    return docs.select("doc_id", "text", F.struct("*").alias("__row"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit_outside_fold(docs, table(spark, sf_dir, "labels"))
    return quality.score(_beside(docs), model, keep=("__row",)).filter("predicted = 1").select("__row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    model = toxicity.fit_outside_fold(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(_beside(docs), model, keep=("__row",)).filter("predicted = 0").select("__row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without lines that an earlier one holds; n_chars, where there is one, follows."""
    new = line_dedup.dedup_lines(_beside(docs), keep=["__row"])
    row = F.col("__row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType))
    return new.select(row.alias("__row")).select("__row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id."""
    others = jaccard_join.jaccard_components(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_join", one_of_each_group),
    ("packing", pack),
]

#: Classifiers and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs
