"""The question file: a JSON array of {question, expected_section: string or list, source?}."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def expected_list(raw: Column) -> Column:
    """A list from JSON text that is a list of strings, or else one string."""
    return F.coalesce(F.when(raw.rlike(r"^\s*\["), F.from_json(raw, "array<string>")), F.array(raw))


def load_questions(spark: SparkSession, path: str | Path) -> DataFrame:
    """qid, question, expected and source; raises for a file that is missing, malformed or empty."""
    rows = spark.read.schema("question string, expected_section string, source string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(str(path), multiLine=True).cache()
    try:
        if not rows.limit(1).count():
            raise ValueError("the question file is empty")
        if rows.where(F.col("_bad").isNotNull() | F.col("question").isNull() | F.col("expected_section").isNull()).limit(1).count():
            raise ValueError("the question file is malformed")
        got = rows.drop("_bad").collect()
    finally:
        rows.unpersist()
    table = spark.createDataFrame([(i, r.question, r.expected_section, r.source) for i, r in enumerate(got)], "qid int, question string, raw string, source string")
    return table.select("qid", "question", expected_list(F.col("raw")).alias("expected"), "source")
