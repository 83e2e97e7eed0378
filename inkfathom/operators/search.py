"""Exact cosine search: candidates by score, a threshold, a rerank by quoted phrases, and the top of that.

Two physical forms: matmul, one numpy product for each Arrow batch and block of queries that keeps the best of each query and batch, so that
what is shuffled is queries times batches times k and never all pairs; and expr, the array functions of Spark, for a few queries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from inkfathom.functions.embed import dot
from inkfathom.schemas import DEFAULTS

#: Queries that a task holds at once; more are done in turns of as many within one pass.
BLOCK = 1024


def validate(top_k: int, candidate_top_k: int, threshold: float | None) -> None:
    if not 1 <= top_k <= 20:
        raise ValueError("top_k must be from 1 to 20")
    if not 1 <= candidate_top_k <= 100:
        raise ValueError("candidate_top_k must be from 1 to 100")
    if threshold is not None and not -1 <= threshold <= 1:
        raise ValueError("the threshold must be from -1 to 1")


def phrases(query: str, straight_quotes: bool = False) -> list[str]:
    """Quoted phrases of two words or more, in lower case: from an opening mark to its closing one before the next opening one."""
    pairs = [("„", "“"), ("«", "»"), *([('"', '"')] if straight_quotes else [])]
    found = []
    for a, b in pairs:
        pattern = f"{a}([^{a}{b}]*){b}"
        found += re.findall(pattern, query)
    return [p.lower() for p in found if len(p.split()) > 1]


def candidates(queries: DataFrame, chunks: DataFrame, k: int, order: list[str], method: str = "matmul") -> DataFrame:
    """For each query (qid, query_vector) the k best chunks (columns order and vector) with score and rank; ties by order.

    A chunk or a query without a vector has no candidates; scores are over the shorter length; one that is not a number comes first. The
    form expr is for BLOCK queries at most, which it broadcasts; more go the other way.
    """
    chunks, queries = chunks.where("vector is not null"), queries.where("query_vector is not null")
    if method == "expr" and queries.limit(BLOCK + 1).count() <= BLOCK:
        pairs = chunks.crossJoin(F.broadcast(queries))  # BLOCK rows at most
        scored = pairs.select("qid", *order, dot(F.col("query_vector"), F.col("vector")).alias("score"))
    else:
        scored = _matmul(chunks, queries, k, order)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), *order)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame) -> list:
    """Broadcast blocks of at most BLOCK queries each, made one after the other; a worker holds one at a time."""
    made, ids, vectors = [], [], []
    for row in queries.select("qid", "query_vector").toLocalIterator():
        ids.append(row.qid)
        vectors.append(row.query_vector)
        if len(ids) == BLOCK:
            made.append(queries.sparkSession.sparkContext.broadcast((ids, vectors)))
            ids, vectors = [], []
    return [*made, *([queries.sparkSession.sparkContext.broadcast((ids, vectors))] if ids else [])]


def _products(a: list, b: list) -> np.ndarray:
    """Products of all of a with all of b, over the shorter length of each pair."""
    out = np.empty((len(a), len(b)))
    sizes = [np.array([len(x) for x in y]) for y in (a, b)]
    for n in np.unique(sizes[0]):
        for m in np.unique(sizes[1]):
            own, other = np.flatnonzero(sizes[0] == n), np.flatnonzero(sizes[1] == m)
            left, right = (np.array([y[i][: min(n, m)] for i in at], np.float64).reshape(len(at), -1) for y, at in ((a, own), (b, other)))
            out[np.ix_(own, other)] = left @ right.T
    return out


def _matmul(chunks: DataFrame, queries: DataFrame, k: int, order: list[str]) -> DataFrame:
    """One pass over the chunks; each batch meets all blocks of queries and keeps its k best of each query."""
    blocks = _blocks(queries)

    kinds = dict(chunks.dtypes)
    schema = T._parse_datatype_string(f"qid {dict(queries.dtypes)['qid']}, " + ", ".join(f"{c} {kinds[c]}" for c in order) + ", score double")
    shape = to_arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.sort_by([(c, "ascending") for c in order])
            vectors = part.column("vector").to_pylist()
            for block in blocks:
                qids, table = block.value
                s = _products(table, vectors)
                best = np.argsort(-np.where(np.isnan(s), np.inf, s), axis=1, kind="stable")[:, :k]
                own = part.select(order).take(pa.array(best.ravel()))
                values = [np.repeat(np.array(qids, object), best.shape[1]).tolist(), *own.columns, np.take_along_axis(s, best, axis=1).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) if not isinstance(v, pa.Array) else v.cast(f.type) for v, f in zip(values, shape)], schema=shape)
                if len(blocks) > 1:
                    del block._value  # read again for the next batch

    return chunks.select(*order, "vector").mapInArrow(score, schema)


def finish(found: DataFrame, order: list[str], top_k: int, threshold: float | None = None, rerank: bool = True) -> DataFrame:
    """Candidates to results: at or over the threshold, those with more of the phrases (array phrases; text) first, the top of them."""
    kept = found if threshold is None else found.where(F.col("score") >= threshold)
    hits = F.size(F.filter("phrases", lambda p: F.contains(F.lower("text"), p))) if rerank and {"phrases", "text"} <= set(found.columns) else F.lit(0)
    scored = kept.withColumn("phrase_hits", hits)
    last = Window.partitionBy("qid").orderBy(F.desc("phrase_hits"), F.desc("score"), *order)
    return scored.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top_k)


def retrieve(queries: DataFrame, chunks: DataFrame, *, top_k: int = DEFAULTS.top_k, candidate_top_k: int = DEFAULTS.candidate_top_k, threshold: float | None = None, rerank: bool = True, order: tuple[str, ...] = ("source", "ordinal"), method: str = "matmul") -> DataFrame:
    """Results of queries (qid, query_vector and perhaps phrases). Text is fetched for candidates only."""
    validate(top_k, candidate_top_k, threshold)
    order = list(order)
    slim = chunks.select(*order, "vector")
    found = candidates(queries.select("qid", "query_vector"), slim, candidate_top_k, order, method)
    rest = [c for c in chunks.columns if c not in (*order, "vector")]
    found = found.join(chunks.select(*order, *rest), order)
    if "phrases" in queries.columns:
        found = found.join(queries.select("qid", "phrases"), "qid")
    return finish(found, order, top_k, threshold, rerank)


def resolve_strategy(builds: list[dict], name: str | None) -> dict:
    """The build of a strategy; without a name the only one there is."""
    names = [b["strategy"] for b in builds]
    if not builds:
        raise ValueError("the index has no builds")
    if name is None:
        if len(builds) > 1:
            raise ValueError(f"several strategies: {', '.join(names)}; name one")
        return builds[0]
    if name not in names:
        raise ValueError(f"no strategy {name}; there are {', '.join(names)}")
    return builds[names.index(name)]


def guard_model(build: dict, vectors: DataFrame, model: str, dim: int) -> None:
    """Model and dimension of the build and of every vector are those of the query."""
    if build["model"] != model:
        raise ValueError(f"the index was built with {build['model']}, not {model}")
    bad = vectors.where((F.col("model") != model) | (F.size("vector") != dim)).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].chunk_id} has a vector of another model or dimension")


def clean_rewrite(said: str, label: str = "Запрос:") -> str:
    """The first line that is not blank, without back quotes and the label before it, 512 characters at most."""
    line = next((x.strip() for x in said.splitlines() if x.strip()), "").strip("`").strip()
    while line.startswith(label):
        line = line.removeprefix(label)
    if not (line := line.strip()):
        raise ValueError("the rewrite is empty")
    return line[:512]


def rewritten(query: str, rewriter=None) -> tuple[str, str | None]:
    """The query to use and, where the rewriter failed or there is none, why the original stands."""
    if rewriter is None:
        return query, "no rewriter"
    try:
        return clean_rewrite(rewriter(query)), None
    except Exception as e:  # any failure of a remote model leaves the query as it is
        return query, str(e)
