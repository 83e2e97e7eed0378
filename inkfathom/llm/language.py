"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.common import crc_mod, map_texts
from inkfathom.llm.subword import SAMPLE, Features, Model, sample, train

FEATURES = Features(grams=(1, 2, 3, 4))


def learn(rows: DataFrame, size: int = SAMPLE) -> Model:
    """A model from rows (doc_id, text, label); label is the language, rows without one or without text are left out."""
    usable = rows.where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    return train(*sample(usable, FEATURES, size), FEATURES)


def _predict(columns: dict[str, list], model) -> dict[str, list]:
    m: Model = model.value
    p = m.probabilities(columns["text"])
    out = {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "lang_pred": [], "score": [], "rejected": []}
    for text, row in zip(columns["text"], p):
        known = bool(m.classes) and text is not None and any(map(str.isalpha, text))
        best = int(row.argmax()) if known else 0
        out["lang_pred"].append(m.classes[best] if known else "und")
        out["score"].append(round(float(row[best]), 6) if known else 0.0)
        out["rejected"].append(not known or float(row[best]) < m.reject)
    return out


def identify(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each row of docs (doc_id, text, lang).

    Learns from rows whose crc32(doc_id) mod 3 is not 1. und with score 0 where the text is null or has no letter, or nothing
    was learned. rejected: the calibrated score is below that of all but one in a hundred of the right answers on held-back
    training rows. Of classes that score alike the first in order wins. Ids may repeat, and equal texts have equal results; long texts are read
    whole; other columns are not read, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang").alias("label"), F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    model = docs.sparkSession.sparkContext.broadcast(learn(rows.where(~F.col("held_out")).select("doc_id", "text", "label"), size))  # BUCKETS rows
    return map_texts(rows.drop("label"), _predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean", (model,))
