"""The index on disk: versions of Parquet tables for each strategy, made current by swapping one small manifest."""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.schemas import CHUNKS, EMBEDDINGS


class Store:
    """Reading never makes anything; a failed replacement leaves what was there."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, Path(root)
        self.manifest = self.root / "manifest.json"

    def exists(self) -> bool:
        return self.manifest.is_file()

    def _read(self) -> dict[str, dict]:
        return json.loads(self.manifest.read_text()) if self.exists() else {}

    def builds(self) -> list[dict]:
        return [{"strategy": s, **b["build"]} for s, b in sorted(self._read().items())]

    def _table(self, name: str, schema: str, strategy: str | None) -> DataFrame:
        found = [b["version"] for s, b in sorted(self._read().items()) if strategy in (None, s)]
        paths = [str(self.root / v / name) for v in found]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def chunks(self, strategy: str | None = None) -> DataFrame:
        return self._table("chunks", CHUNKS, strategy)

    def embeddings(self, strategy: str | None = None) -> DataFrame:
        return self._table("embeddings", EMBEDDINGS, strategy)

    def load(self, strategy: str) -> DataFrame:
        """Chunks with model and vector; source and ordinal are the order that breaks ties."""
        return self.chunks(strategy).join(self.embeddings(strategy).drop("strategy"), "chunk_id")

    def replace(self, build: dict, chunks: DataFrame, vectors: DataFrame) -> None:
        """Puts a strategy's chunks and vectors (chunk_id, model, dim, vector) in place of its old ones, all or nothing."""
        strategy = build["strategy"]
        version = f"{strategy}-{uuid.uuid4().hex}"
        place = self.root / version
        try:
            chunks.write.parquet(str(place / "chunks"))
            vectors.withColumn("strategy", F.lit(strategy)).select(*(x.split(" ")[0] for x in EMBEDDINGS.split(", "))).write.parquet(str(place / "embeddings"))
            c = self.spark.read.schema(CHUNKS).parquet(str(place / "chunks"))
            e = self.spark.read.schema(EMBEDDINGS).parquet(str(place / "embeddings"))
            if c.where(F.col("strategy") != strategy).limit(1).count():
                raise ValueError("a chunk of another strategy")
            for what, rows in (("chunk_id", c), ("vector", e)):
                if again := rows.groupBy("chunk_id").count().where("count > 1").limit(1).collect():
                    raise ValueError(f"{what} stands twice: {again[0].chunk_id}")
            if c.join(e, "chunk_id", "full").where(c.strategy.isNull() | e.strategy.isNull()).limit(1).count():
                raise ValueError("chunks and vectors do not match")
        except Exception:
            shutil.rmtree(place, ignore_errors=True)
            raise
        with self._alone():
            self._swap(strategy, version, build)

    @contextmanager
    def _alone(self):
        """One writer of the manifest at a time."""
        lock = self.root / "manifest.lock"
        for _ in range(600):
            try:
                os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
                break
            except FileExistsError:
                time.sleep(0.1)
        else:
            raise TimeoutError(f"{lock} stays; remove it if no build is running")
        try:
            yield
        finally:
            lock.unlink(missing_ok=True)

    def _swap(self, strategy: str, version: str, build: dict) -> None:
        """Makes a version current. The one before stays for those who read it, until the next."""
        now = self._read()
        was = now.get(strategy, {})
        now[strategy] = {"version": version, "before": was.get("version"), "build": {k: v for k, v in build.items() if k != "strategy"} | {"built_at": datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")}}
        fresh = self.manifest.with_suffix(".new")
        fresh.write_text(json.dumps(now, indent=1))
        os.replace(fresh, self.manifest)
        if was.get("before"):
            shutil.rmtree(self.root / was["before"], ignore_errors=True)

    def chunks_per_strategy(self) -> DataFrame:
        return self.chunks().groupBy("strategy").agg(F.count("*").alias("chunks"))

    def orphans(self) -> DataFrame:
        return self.chunks().join(self.embeddings().select("chunk_id"), "chunk_id", "left_anti")

    def models(self) -> DataFrame:
        return self.embeddings().select("model", "dim").distinct()
