"""Averaged hashed subword embeddings with a softmax on top, trained by stochastic gradient descent in numpy.

A text is a bag of hashed features: n-grams of its bytes in lower case (subwords, with the spaces round them) and, if asked
for, whole words and pairs of neighbouring words, with case as it stands. Each feature has a learned vector; the vectors of a
text are averaged and a linear layer with softmax gives the classes. Once trained, vector and layer are multiplied out,
so that a text costs one look-up and one sum a feature.

Training takes a bounded sample: at most SAMPLE labelled rows, those of the smallest hash of their id, spread over the
classes. Executors turn each row's whole text into counts of buckets, so the driver gets at most SAMPLE times BUCKETS numbers
however long the texts are. The rest of the labelled sample, one in five rows, sets the temperature of the scores.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfathom.llm.common import cut, lower_ascii, map_texts

BUCKETS = 1 << 15
SAMPLE = 3000
#: Classes up to which each has a top-k plan of its own; more are chosen in one window, with the same result.
PLANS = 32
DIM = 16
EPOCHS = 12
_P = np.uint32(16777619)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Features:
    """Which features a text has."""

    grams: tuple[int, ...] = (2, 3, 4)
    lower: bool = True
    words: bool = False
    buckets: int = BUCKETS

    def of(self, data: bytes) -> np.ndarray:
        """Buckets of the features of a text in UTF-8, repeats included; none for a text without a byte that is not white space."""
        raw = np.frombuffer(data, np.uint8)
        blank = _SPACE[raw]
        if blank.all():
            return np.zeros(0, np.int64)
        mask = np.uint32(self.buckets - 1)
        out = []
        cased = np.concatenate([[32], np.where(blank, 32, raw), [32]]).astype(np.uint32)
        b = np.frombuffer(lower_ascii(cased.astype(np.uint8).tobytes()), np.uint8).astype(np.uint32) if self.lower else cased
        for n in self.grams:
            if len(b) >= n:
                h = np.full(len(b) - n + 1, 2166136261 + n, np.uint32)
                for i in range(n):
                    h = (h ^ b[i : len(b) - n + 1 + i]) * _P
                out.append((h ^ (h >> np.uint32(15))) & mask)
        if self.words:
            gap = cased == 32
            starts = np.nonzero(gap[:-1] & ~gap[1:])[0] + 1
            h = np.cumsum(np.where(gap, 0, (cased + np.uint32(1)) * np.uint32(2654435761) ^ cased << np.uint32(7)), dtype=np.uint64)
            ends = np.nonzero(~gap[:-1] & gap[1:])[0]
            w = ((h[ends] - h[starts - 1]) * np.uint64(11400714819323198485) + cased[ends].astype(np.uint64) * np.uint64(97) + cased[starts]) & np.uint64(0xFFFFFFFF)
            w = w.astype(np.uint32) * _P
            w ^= w >> np.uint32(13)
            out.append(w & mask)
            if len(w) > 1:
                pair = np.where(w[1:] == w[:-1], np.uint32(12345), (w[1:] * np.uint32(31) ^ w[:-1]) * _P)  # a repeated word is a feature of its own
                out.append((pair ^ (pair >> np.uint32(11))) & mask)
        return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Model:
    """classes, the score of each bucket for each class, the scores of a text without features, the temperature, and the least sure score that stands."""

    features: Features
    classes: tuple
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject: float

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        z = np.empty((len(texts), len(self.classes)))
        for i, text in enumerate(texts):
            f = self.features.of((text or "").encode())
            z[i] = np.bincount(f, minlength=len(self.table)) @ self.table / len(f) if len(f) > len(self.table) else self.table[f].sum(axis=0) / max(1, len(f))
        return _softmax((z + self.bias) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _bags(columns: dict[str, list], features: Features) -> dict[str, list]:
    found = [np.unique(features.of((t or "").encode()), return_counts=True) for t in columns["text"]]
    return {"doc_id": columns["doc_id"], "label": columns["label"], "bucket": [b.tolist() for b, _ in found], "count": [c.tolist() for _, c in found]}


def sample(rows: DataFrame, features: Features, size: int = SAMPLE, marks: DataFrame | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], list]:
    """Bags and labels of a bounded sample of rows (doc_id, text, label), the same number of each class, one at least.

    marks (doc_id, label) has the labels of rows without that column; it is joined by ids and hashes, so that texts are never shuffled
    for it. The order is by hash of id and text, so it does not depend on how rows are stored.
    """
    key = F.xxhash64("doc_id", "text").alias("key")
    keyed = rows.select("doc_id", key).join(marks, "doc_id").select("key", "label") if marks is not None else rows.select(key, "label")
    keyed = cut(keyed)  # a key and a label a row
    labels = [r.label for r in keyed.where("label is not null").groupBy("label").agg(F.lit(1)).orderBy("label").collect()]  # the model has as many columns
    if not labels:
        return [], []
    share = max(1, size // len(labels))
    # chosen by id and hash first, without the texts; then the texts of those
    if len(labels) > PLANS:
        best = Window.partitionBy("label").orderBy("key")  # each task keeps share rows of a label before the shuffle
        few = keyed.where("label is not null").distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= share).drop("rank")
    else:
        parts = [keyed.where(F.col("label") == F.lit(label)).distinct().orderBy("key").limit(share) for label in labels]
        few = reduce(DataFrame.union, parts)
    kind = keyed.schema["label"].dataType.simpleString()
    chosen = rows.select("doc_id", "text", key).join(F.broadcast(few), "key").select("doc_id", "text", "label").distinct()  # few has size rows
    bags = map_texts(chosen, _bags, f"doc_id long, label {kind}, bucket array<int>, count array<int>", (features,))
    got = bags.toArrow()  # size rows of at most BUCKETS numbers
    ids, labels = got["doc_id"].to_pylist(), got["label"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, str(labels[i])))
    order = [order[i] for i in np.random.default_rng(7).permutation(len(order))]
    bucket, count = (got[n].combine_chunks() for n in ("bucket", "count"))
    return [(bucket[i].values.to_numpy(), count[i].values.to_numpy().astype(np.float32)) for i in order], [labels[i] for i in order]


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list, features: Features, dim: int = DIM, epochs: int = EPOCHS, rate: float = 0.4, weights: dict | None = None, reject_part: float = 0.01) -> Model:
    """Plain stochastic gradient descent over rows, with falling steps; every fifth row is held back to set the temperature.

    weights: of each class's steps, to correct for a sample that was dealt evenly.
    """
    classes = tuple(sorted(set(labels)))
    rng = np.random.default_rng(11)
    vectors = rng.normal(0, 0.3, (features.buckets, dim))
    layer = rng.normal(0, 0.3, (dim, max(1, len(classes))))
    bias = np.zeros(max(1, len(classes)))
    at = {c: i for i, c in enumerate(classes)}
    rows = [(b, c / max(1.0, c.sum()), at[y]) for (b, c), y in zip(bags, labels)]
    held, rest = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    weight = np.array([(weights or {}).get(c, 1.0) for c in classes])
    steps, done = max(1, epochs * len(rest)), 0
    for _ in range(epochs if len(classes) > 1 else 0):
        for i in rng.permutation(len(rest)):
            b, c, y = rest[i]
            step = rate * (1 - done / steps)
            mean = c @ vectors[b]
            g = _softmax(mean @ layer + bias)
            g[y] -= 1
            g *= weight[y]
            back = layer @ g
            layer -= step * np.outer(mean, g)
            bias -= step * 0.1 * g
            vectors[b] -= (step * 20) * c[:, None] * back  # a feature is a small part of its text
            done += 1
    table = vectors @ layer
    z = np.array([c @ table[b] + bias for b, c, _ in held]) if held else np.zeros((0, len(bias)))
    y = np.array([y for _, _, y in held], int)

    def loss(t: float) -> float:
        p = _softmax(z / t)[np.arange(len(y)), y] if len(y) else np.ones(1)
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    temperature = min(np.geomspace(0.25, 8, 41), key=loss)
    right = np.sort(_softmax(z / temperature).max(axis=1)[_softmax(z).argmax(axis=1) == y]) if len(y) else np.zeros(0)
    reject = float(right[int(reject_part * len(right))]) if len(right) else 0.0
    return Model(features, classes, np.ascontiguousarray(table, np.float32), bias, float(temperature), reject)
