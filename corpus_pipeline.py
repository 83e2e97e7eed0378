"""A training corpus from the table of documents, stage by stage: each is written and read again before the next.

What the stages do with nulls, empty and long texts, ties, repeated rows, empty tables and columns of any name stands with their operators:
keep_good, dedup, keep_first, redact and pack. All but the last return the columns that they get.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkfathom.llm import line_dedup, near_texts, packing, quality_classifier, secrets
from inkfathom.llm.common import cut, documents, drop
from inkfathom.llm.queries import BYTE_BPE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learned from labels of the stage's own input, does not reject."""
    return quality_classifier.keep_good(docs, documents(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of three lines or more that stand earlier in the corpus; n_chars follows the text."""
    return with_length(line_dedup.dedup(docs).select(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (a similarity of 0.8 or more of five-word shingles), that of the smallest doc_id."""
    return near_texts.keep_first(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With credentials in the text replaced by their kind; n_chars follows the text."""
    return with_length(secrets.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in training sequences."""
    return packing.pack(docs, public_tokenizers.path(BYTE_BPE))


def with_length(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("secret_scans", secret_scans), ("best_fit_packing", packed)]

#: SQL cannot train the classifier nor tokenize; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over table documents. A stage's table is removed when the next one's is written; the last one's stays for the result."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
