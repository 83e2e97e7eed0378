"""The registered queries of this subpackage: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.llm import context_mixing, language, line_dedup, packing, progressive_jpeg, quality_classifier, quality_rules, secrets, sentencepiece_bpe, simhash
from inkfathom.llm.common import documents

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kept_text and the number of removed lines."""
    done = line_dedup.dedup(documents(spark, sf_dir))
    return done.select("doc_id", F.col("text").alias("kept_text"), "n_removed_lines")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive_jpeg.store(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(documents(spark, sf_dir), public_tokenizers.path(PIECE_BPE))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_quality_rules, op2_line_dedup, op3_secret_scans, op4_media_columns, op5_simhash, op6_language_id, op7_quality_classifier, op8_lm_scoring, op9_best_fit_packing, op10_sentencepiece)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """The others cannot be said in SQL, or not over whole tables; their tests use brute force."""
    return {"op1_quality_rules": quality_rules.SQL, "op2_line_dedup": line_dedup.SQL}
