"""Quality classifier: learned vectors of hashed words, word pairs and byte n-grams, averaged over a text, with a softmax."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.common import crc_mod, map_texts
from inkfathom.llm.subword import SAMPLE, Features, Model, sample, train

FEATURES = Features(grams=(1, 2, 3), lower=False, words=True)
THRESHOLD = 0.7


def learn(rows: DataFrame, marks: DataFrame, size: int = SAMPLE) -> Model:
    """A model from rows (doc_id, text) and marks (doc_id, label); label is 0 or 1, other marks are left out."""
    return train(*sample(rows, FEATURES, size, marks.where(F.col("label").isin(0, 1))), FEATURES)


def _predict(columns: dict[str, list], model) -> dict[str, list]:
    m: Model = model.value
    at = m.classes.index(1) if 1 in m.classes else None
    p = m.probabilities(columns["text"])[:, at] if at is not None else [0.5 if not m.classes else 0.0] * len(columns["text"])
    scores = [round(float(x), 6) for x in p]
    return {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}


def classifier(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Learned from the labelled documents whose crc32(doc_id) mod 4 is not 2."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(False)))
    return learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), marks, size)


def score(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of each row of docs (doc_id, text).

    A null text is scored as an empty one, by the classes alone. Without usable labels every score is 0.5; a document labelled twice, or
    an id that repeats, is learned from with each of its labels. Long texts are read whole; a score of exactly 0.7 is predicted 1.
    Other columns are not read, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    model = docs.sparkSession.sparkContext.broadcast(classifier(docs, labels, size))  # BUCKETS rows
    return map_texts(rows, _predict, "doc_id long, held_out boolean, score double, predicted int", (model,))


def keep_good(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns, whatever their names.

    A null text is judged as an empty one; repeated rows all go or all stay; long texts are read whole. Without usable labels, or with
    no label 1 among them, nothing is rejected. An empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(classifier(docs, labels, size))

    def good(texts):
        m: Model = model.value
        at = m.classes.index(1) if 1 in m.classes else None
        for batch in texts:
            yield batch.map(lambda t: at is None or bool(round(float(m.probabilities([t])[0, at]), 6) >= THRESHOLD)).astype(bool)

    from collections.abc import Iterator

    import pandas as pd

    good.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.where(F.pandas_udf(good, "boolean")(F.coalesce("text", F.lit(""))))
