"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import jaccard_join, language, line_dedup, matroska, maxscore, packing, periodic, pieces, quality, range_join, token_counts, toxicity, whitening
from ._common import table


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.payload_digests(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.every_fiftieth(table(spark, sf_dir, "embeddings"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_predictions(table(spark, sf_dir, "documents"))


def op11_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join.range_components(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_matroska, op2_line_dedup, op3_toxicity, op4_quality, op5_maxscore, op6_jaccard_join, op7_sentencepiece, op8_token_counts, op9_packing, op10_language, op11_range_join, op12_periodic_runs, op13_whitening)}
SQL: dict[str, str] = {"op2_line_dedup": line_dedup.SQL, "op5_maxscore": maxscore.SQL, "op11_range_join": range_join.SQL}
