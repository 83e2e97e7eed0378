"""Embedding providers and the map that turns texts into unit vectors."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfathom.schemas import DEFAULTS

#: Fixed values of the hashing embedder.
OFFSET, PRIME, MASK = 1469598103934665603, 1099511628211, (1 << 64) - 1


class ContextOverflow(ValueError):
    """A text that does not fit the model's context."""

    def __init__(self, index: int, chars: int, model: str, num_ctx: int):
        super().__init__(f"text {index} of {chars} characters does not fit the context of {num_ctx} of {model}")
        self.index, self.chars, self.model, self.num_ctx = index, chars, model, num_ctx


class Provider(Protocol):
    model: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def normalise(vector) -> np.ndarray:
    v = np.asarray(vector, np.float64)
    norm = float(np.sqrt((v * v).sum()))
    if not np.isfinite(norm) or norm == 0:
        raise ValueError("a vector without direction")
    return v / norm


@lru_cache(1 << 18)
def word_hash(word: str) -> int:
    h = OFFSET
    for byte in word.encode():
        h = (h ^ byte) * PRIME & MASK
    return h


class HashingProvider:
    """Bag of words by 64-bit hash: deterministic, needs no model. Words are runs of letters and digits, three or longer."""

    def __init__(self, dim: int = DEFAULTS.dim, model: str = "hashing-bow"):
        self.dim, self.model = dim, model

    def vector(self, text: str) -> np.ndarray:
        out = np.zeros(self.dim)
        for word in re.findall(r"[^\W_]+", text):
            if len(word) > 2:
                out[word_hash(word.lower()) % self.dim] += 1
        out[0] += 0.01
        return out

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        return [self.vector(t) for t in texts]


class HttpProvider:
    """A model server's embed endpoint; a batch that overflows is sent again text by text to name the one at fault."""

    def __init__(self, url: str = DEFAULTS.url, model: str = DEFAULTS.model, dim: int = DEFAULTS.dim, num_ctx: int = DEFAULTS.num_ctx, opener=urllib.request.urlopen):
        self.url, self.model, self.dim, self.num_ctx, self.opener = url.rstrip("/"), model, dim, num_ctx, opener

    def _post(self, texts: list[str]) -> list[list[float]]:
        body = {"model": self.model, "input": texts, "truncate": False, "options": {"num_ctx": self.num_ctx}}
        request = urllib.request.Request(f"{self.url}/api/embed", json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with self.opener(request, timeout=60) as answer:
                got = json.loads(answer.read())["embeddings"]
        except urllib.error.HTTPError as e:
            said = e.read().decode("utf-8", "replace")[:200]
            if "context length" in said or "exceeds" in said:
                raise OverflowError(said) from e
            raise ValueError(f"the model server answered {e.code}: {said}") from e
        if len(got) != len(texts):
            raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
        return got

    def embed(self, texts: list[str]) -> list[list[float]]:
        try:
            return self._post(texts)
        except OverflowError:
            for i, t in enumerate(texts):
                try:
                    self._post([t])
                except OverflowError as e:
                    raise ContextOverflow(i, len(t), self.model, self.num_ctx) from e
            raise


def embed_texts(provider: Provider, texts: list[str], batch: int = DEFAULTS.batch, prefix: str = "") -> list[np.ndarray]:
    """Unit vectors in order; the prefix goes to the model only."""
    if batch < 1:
        raise ValueError("batch must be over 0")
    out: list[np.ndarray] = []
    for i in range(0, len(texts), batch):
        part = [prefix + t for t in texts[i : i + batch]]
        try:
            got = provider.embed(part)
        except ContextOverflow as e:
            raise ContextOverflow(i + e.index, e.chars, e.model, e.num_ctx) from e
        if len(got) != len(part):
            raise ValueError(f"{len(got)} vectors for {len(part)} texts")
        if bad := next((len(v) for v in got if len(v) != provider.dim), None):
            raise ValueError(f"a vector of {bad} numbers; {provider.dim} were asked for")
        out += map(normalise, got)
    return out


def embed_column(rows: DataFrame, provider: Provider, key: str, text: str, batch: int = DEFAULTS.batch, prefix: str = "") -> DataFrame:
    """key and vector (array of float) of each row, in batches on the executors."""

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            try:
                vectors = embed_texts(provider, part["text"].tolist(), batch, prefix)
            except ContextOverflow as e:
                raise ValueError(f"{part['key'].iloc[e.index]} ({len(part['text'].iloc[e.index])} characters): {e}") from e
            yield pd.DataFrame({"key": part["key"], "vector": [v.astype(np.float32) for v in vectors]})

    kind = dict(rows.dtypes)[key]
    made = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(turn, f"key {kind}, vector array<float>")
    return made.withColumnRenamed("key", key)


def l2_normalised(vector: Column) -> Column:
    """The vector in double over its norm; an error for one without direction."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    safe = F.when((norm > 0) & (norm < float("inf")), norm).otherwise(F.raise_error(F.lit("a vector without direction")).cast("double"))
    return F.transform(wide, lambda x: x / safe)


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def encode_vector(vector) -> bytes:
    return np.asarray(vector, "<f4").tobytes()


def decode_vector(blob: bytes) -> np.ndarray:
    if len(blob) % 4:
        raise ValueError("not a whole number of floats")
    return np.frombuffer(blob, "<f4")
