"""What a model server knows: its embedding models, their sizes and vocabularies, and its chat for rewriting queries."""

from __future__ import annotations

import json
import socket
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.functions.units import WordPiece


CONNECT_SECONDS = 10


def opened(request: urllib.request.Request, timeout: float):
    """An answer within timeout; a server that does not take a connection is given up sooner."""
    at = urllib.parse.urlsplit(request.full_url)
    socket.create_connection((at.hostname, at.port or (443 if at.scheme == "https" else 80)), min(timeout, CONNECT_SECONDS)).close()
    return urllib.request.urlopen(request, timeout=timeout)


class ModelServer:
    def __init__(self, url: str, opener=opened):
        self.url, self.opener = url.rstrip("/"), opener

    def call(self, path: str, body: dict | None = None) -> dict:
        """GET without a body, else POST; errors carry status and text."""
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"})
        try:
            with self.opener(request, timeout=60) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            raise ValueError(f"{path}: the server answered {e.code}: {e.read().decode('utf-8', 'replace')[:200]}") from e
        except (OSError, ValueError) as e:
            raise ValueError(f"{path}: {e}") from e

    def show(self, model: str, verbose: bool = False) -> dict:
        return self.call("/api/show", {"model": model, "verbose": verbose})

    @staticmethod
    def number(info: dict, suffix: str) -> int | None:
        """The number whose key ends so, whatever the architecture's name."""
        return next((int(v) for k, v in (info.get("model_info") or {}).items() if k.endswith(suffix) and isinstance(v, (int, float))), None)

    def embedding_models(self, spark: SparkSession) -> DataFrame:
        """name, dim, context_length, size of models that can embed, by name; those that cannot be shown are left out."""
        rows = []
        for m in self.call("/api/tags").get("models", []):
            try:
                info = self.show(m["name"])
            except ValueError:
                continue
            rows.append((m["name"], info.get("capabilities") or [], self.number(info, ".embedding_length"), self.number(info, ".context_length"), m.get("size")))
        table = spark.createDataFrame(rows, "name string, capabilities array<string>, dim int, context_length int, size long")
        return table.where(F.array_contains("capabilities", "embedding")).drop("capabilities").orderBy("name")

    def dim(self, model: str, probe) -> int:
        """By the model's data, else the length of a vector of the probe."""
        return self.number(self.show(model), ".embedding_length") or len(probe("probe"))

    def word_pieces(self, model: str) -> WordPiece:
        info = self.show(model, verbose=True).get("model_info") or {}
        if (kind := info.get("tokenizer.ggml.model")) != "bert":
            raise ValueError(f"{model} has a tokenizer of kind {kind}; only bert can be counted")
        return WordPiece(info.get("tokenizer.ggml.tokens") or [])

    def rewrite(self, model: str, instruction: str, query: str) -> str:
        body = {"model": model, "stream": False, "options": {"temperature": 0, "num_predict": 128}, "messages": [{"role": "system", "content": instruction}, {"role": "user", "content": query}]}
        said = self.call("/api/chat", body)
        text = (said.get("message") or {}).get("content")
        if not isinstance(text := said.get("response") if text is None else text, str):
            raise ValueError("/api/chat: no text in the answer")
        return text
