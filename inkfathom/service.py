"""The engine behind commands and tools: build, search, status, models, compare; a command line and a stdio loop."""

from __future__ import annotations

import argparse
import inspect
import json
import sys
import time
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.functions.embed import HashingProvider, HttpProvider, Provider, embed_column, embed_texts
from inkfathom.functions.units import Chars, check_budget
from inkfathom.operators import chunking, evaluate, search
from inkfathom.plans import report
from inkfathom.schemas import DEFAULTS
from inkfathom.sources.docx import char_len, check_corpus, read_folder
from inkfathom.sources.models import ModelServer
from inkfathom.sources.questions import load_questions
from inkfathom.sources.store import Store


@dataclass
class Engine:
    spark: SparkSession
    root: str
    provider: Provider
    server: ModelServer | None = None
    rewriter: object = None
    strategy: str | None = None
    document_prefix: str = ""
    query_prefix: str = ""

    @property
    def store(self) -> Store:
        return Store(self.spark, self.root)

    def provider_for(self, model: str | None = None, dim: int | None = None, num_ctx: int | None = None) -> Provider:
        """The engine's provider, or one like it for another model or length; the length of another model is asked of the server."""
        own = self.provider
        if model in (None, own.model) and dim in (None, own.dim) and num_ctx in (None, getattr(own, "num_ctx", None)):
            return own
        if not isinstance(own, HttpProvider):
            return HashingProvider(dim or own.dim, model or own.model)
        made = HttpProvider(own.url, model or own.model, dim or own.dim, num_ctx or own.num_ctx, own.opener)
        if dim is None and made.model != own.model:
            made.dim = self.server.dim(made.model, lambda text: made.embed([text])[0])
        return made

    def build(self, input: str | DataFrame, strategy: str = "all", *, chunk_size=DEFAULTS.chunk_size, overlap=DEFAULTS.overlap, max_section=DEFAULTS.max_section, min_section=DEFAULTS.min_section, unit: str = "chars", units=None, min_chars: int = DEFAULTS.min_chars, model: str | None = None, num_ctx: int = DEFAULTS.num_ctx, batch: int = DEFAULTS.batch, dim: int | None = None) -> list[dict]:
        """Chunks, embeds and replaces each strategy in turn; sizes are checked before the corpus, the corpus before the model."""
        provider = self.provider_for(model, dim, num_ctx)
        if units is None:
            units = Chars() if unit == "chars" else self.server.word_pieces(provider.model)
        check_budget(units, [chunk_size, max_section], self.document_prefix, num_ctx)
        chunkers = chunking.select(strategy, chunk_size=chunk_size, overlap=overlap, max_section=max_section, min_section=min_section, units=units)
        docs = (read_folder(self.spark, input, None) if isinstance(input, str) else input).persist(StorageLevel.DISK_ONLY)  # parsed once
        try:
            check_corpus(docs, min_chars)
            return [self._built(docs, chunker, provider, batch) for chunker in chunkers]
        finally:
            docs.unpersist()

    def _built(self, docs: DataFrame, chunker, provider: Provider, batch: int) -> dict:
        size = docs.agg(F.count("*").alias("files"), F.coalesce(F.sum(char_len(F.col("paragraphs"))), F.lit(0)).alias("chars")).first()
        chunks = chunking.chunk_rows(docs, chunker).persist(StorageLevel.DISK_ONLY)
        vectors = embed_column(chunks, provider, "chunk_id", "text", batch, self.document_prefix).persist(StorageLevel.DISK_ONLY)
        try:
            n = chunks.count()
            began = time.perf_counter()
            vectors.count()
            ms = int(1000 * (time.perf_counter() - began))
            build = {"strategy": chunker.name, "model": provider.model, "dim": provider.dim, "files": size.files, "chars": size.chars, "chunks": n, "embed_ms": ms, "params": chunker.params()}
            self.store.replace(build, chunks, vectors.select("chunk_id", F.lit(provider.model).alias("model"), F.lit(provider.dim).alias("dim"), "vector"))
            return build
        finally:
            vectors.unpersist()
            chunks.unpersist()

    def search(self, query: str, strategy: str | None = None, *, top_k: int = DEFAULTS.top_k, candidate_top_k: int = DEFAULTS.candidate_top_k, similarity_threshold: float | None = None, rewrite: bool = False, rerank: bool = True, straight_quotes: bool = False) -> dict:
        if not query.strip():
            raise ValueError("the query is empty")
        threshold = similarity_threshold
        search.validate(top_k, candidate_top_k, threshold)
        if not self.store.exists():
            raise FileNotFoundError(f"no index at {self.root}")
        build = search.resolve_strategy(self.store.builds(), strategy or self.strategy)
        search.guard_model(build, self.store.embeddings(build["strategy"]), self.provider.model, self.provider.dim)
        used, fallback = search.rewritten(query, self.rewriter) if rewrite else (query, None)
        (vector,) = embed_texts(self.provider, [used], prefix=self.query_prefix)
        asked = search.phrases(used, straight_quotes)
        order = ["source", "ordinal"]
        queries = self.spark.createDataFrame([(0, vector.tolist())], "qid int, query_vector array<double>")
        rows = self.store.load(build["strategy"])
        found = search.candidates(queries, rows.select(*order, "vector"), candidate_top_k, order).join(rows.select(*order, "chunk_id", "section", "text"), order)
        found = found.withColumn("phrases", F.array(*map(F.lit, asked)) if asked else F.array().cast("array<string>")).cache()
        try:
            n = found.count()
            hits = search.finish(found, order, top_k, threshold, rerank).orderBy("rank").select("chunk_id", "source", "section", "score", "text").collect()
        finally:
            found.unpersist()
        return {
            "query": query, "used_query": used, "rewritten": used != query, "rewrite_fallback": fallback, "strategy": build["strategy"], "model": build["model"], "dim": build["dim"],
            "top_k": top_k, "candidate_top_k": candidate_top_k, "threshold": threshold, "candidates": n, "phrases": asked if rerank else [], "hits": [h.asDict() for h in hits],
        }

    def status(self) -> dict:
        def parsed(text):
            try:
                return json.loads(text)
            except (TypeError, ValueError):
                return None

        return {"exists": self.store.exists(), "builds": [b | {"params": parsed(b.get("params"))} for b in self.store.builds()]}

    def models(self) -> list[dict]:
        return [r.asDict() for r in self.server.embedding_models(self.spark).collect()]

    def compare(self, questions: str, out: str | None = None, *, top_k: int = DEFAULTS.top_k, candidate_top_k: int = DEFAULTS.candidate_top_k, similarity_threshold: float | None = None, rewrite_model: str | None = None) -> dict:
        """Every strategy in all modes in one plan: (strategy, mode, question) with chunks, to ranks and figures."""
        threshold = DEFAULTS.threshold if similarity_threshold is None else similarity_threshold
        search.validate(top_k, candidate_top_k, threshold)
        builds = self.store.builds()
        if not builds:
            raise ValueError("the index has no builds")
        provider = self.provider_for(dim=builds[0]["dim"])
        for b in builds:
            search.guard_model(b, self.store.embeddings(b["strategy"]), provider.model, provider.dim)
        questions = load_questions(self.spark, questions)
        rewriter = self.rewriter if rewrite_model is None else lambda text: self.server.rewrite(rewrite_model, REWRITE, text)
        asked = questions.orderBy("qid").collect()
        texts = [q.question for q in asked]
        new = [search.rewritten(t, rewriter) for t in texts]
        vectors = embed_texts(provider, texts, prefix=self.query_prefix), embed_texts(provider, [t for t, _ in new], prefix=self.query_prefix)
        chunks = self.store.chunks().join(self.store.embeddings().select("chunk_id", "vector"), "chunk_id").cache()
        try:
            result = self._compare(builds, questions, asked, vectors, [texts, [t for t, _ in new]], chunks, top_k, candidate_top_k, threshold)
        finally:
            chunks.unpersist()
        result["rewrite_fallbacks"] = sum(why is not None for _, why in new)
        if out:
            report.write(out, result["report"])
        return result

    def _compare(self, builds, questions, asked, vectors, texts, chunks, top_k, candidate_top_k, threshold) -> dict:
        def results(strategy: str, which: int, k: int, ck: int, t: float | None) -> tuple[DataFrame, DataFrame]:
            q = self.spark.createDataFrame([(a.qid, v.tolist(), search.phrases(s)) for a, v, s in zip(asked, vectors[which], texts[which])], "qid int, query_vector array<double>, phrases array<string>")
            own = chunks.where(F.col("strategy") == strategy)
            order = ["source", "ordinal"]
            found = search.candidates(q.drop("phrases"), own.select(*order, "vector"), ck, order).join(own.select(*order, "section", "text"), order).join(q.drop("query_vector"), "qid")
            return found, search.finish(found, order, k, t)

        every, found_all, base = None, None, None
        for b in builds:
            _, r = results(b["strategy"], 0, DEFAULTS.top_k, DEFAULTS.candidate_top_k, None)
            r = r.withColumn("strategy", F.lit(b["strategy"]))
            base = r if base is None else base.unionByName(r)
            for mode, rewrite, filtered in evaluate.MODES:
                f, r = (x.withColumns({"strategy": F.lit(b["strategy"]), "mode": F.lit(mode)}) for x in results(b["strategy"], int(rewrite), top_k, candidate_top_k, threshold if filtered else None))
                every = r if every is None else every.unionByName(r)
                found_all = f if found_all is None else found_all.unionByName(f)
        # strategies and modes without any result still count
        names = self.spark.createDataFrame([(b["strategy"],) for b in builds], "strategy string")
        rank_rows = names.crossJoin(questions.select("qid")).join(evaluate.ranks(base, questions, ["strategy"]), ["strategy", "qid"], "left").cache()
        figures = {r.strategy: r.asDict() for r in evaluate.metrics(rank_rows, ["strategy"]).collect()}
        grid = names.crossJoin(self.spark.createDataFrame([(m,) for m, *_ in evaluate.MODES], "mode string"))
        mode_ranks = grid.crossJoin(questions.select("qid")).join(evaluate.ranks(every, questions, ["strategy", "mode"]), ["strategy", "mode", "qid"], "left")
        counts = evaluate.mode_counts(found_all, every, questions, ["strategy", "mode"])
        modes = [r.asDict() for r in evaluate.metrics(mode_ranks, ["strategy", "mode"]).join(counts, ["strategy", "mode"], "left").fillna(0).collect()]
        at = {m: i for i, (m, *_) in enumerate(evaluate.MODES)}
        modes.sort(key=lambda m: (m["strategy"], at[m["mode"]]))
        shape = {r.strategy: r.asDict() for r in evaluate.boundary_stats(chunks, ["strategy"]).collect()}
        sizes = {r.strategy: r.asDict() for r in evaluate.length_stats(chunks, F.length("text"), ["strategy"]).collect()}
        table = []
        for b in builds:
            s = b["strategy"]
            n = sizes.get(s, {"min": 0, "median": 0, "p95": 0, "max": 0})
            lost = evaluate.unreachable(questions, chunks.where(F.col("strategy") == s)).count()
            table.append({"strategy": s, "unreachable": lost, "lengths": f"{n['min']} / {n['median']} / {n['p95']} / {n['max']}"} | {"chunks": 0} | shape.get(s, {}) | figures[s])
        ranks = {(r.strategy, r.qid): r["rank"] for r in rank_rows.collect()}
        rank_rows.unpersist()
        text = report.render("Comparison of chunking strategies", builds, table, [q.asDict() for q in asked], ranks, modes, {"top_k": top_k, "candidate_top_k": candidate_top_k, "threshold": threshold})
        return {"table": table, "modes": modes, "ranks": ranks, "best": evaluate.best(table)[0], "report": text}


TOOLS = {"index_search": Engine.search, "index_status": Engine.status, "index_models": Engine.models, "index_build": Engine.build, "index_compare": Engine.compare}


def schema_of(tool) -> dict:
    """JSON schema of a tool's arguments, by its signature."""
    kinds = {"str": "string", "int": "integer", "float": "number", "bool": "boolean"}
    found = {n: p for n, p in inspect.signature(tool).parameters.items() if n not in ("self", "units", "straight_quotes")}
    named = {n: next((k for k in kinds if k in str(p.annotation)), None) or kinds_of(p.default) for n, p in found.items()}
    properties = {n: {"type": kinds.get(k, k)} | ({"default": found[n].default} if found[n].default not in (inspect.Parameter.empty, None) else {}) for n, k in named.items()}
    return {"type": "object", "properties": properties, "required": [n for n, p in found.items() if p.default is inspect.Parameter.empty]}


def kinds_of(default) -> str:
    return "integer" if isinstance(default, int) else "string"


def plain(value):
    """What JSON can hold."""
    if isinstance(value, dict):
        return {k if isinstance(k, str) else ":".join(map(str, k)): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value.item() if isinstance(value, np.generic) else value


def call(engine: Engine, tool: str, arguments: dict) -> dict:
    """A tool's result, or its error with all causes."""
    try:
        return {"is_error": False, "result": plain(TOOLS[tool](engine, **arguments))}
    except Exception as e:
        chain, at = [], e
        while at is not None:
            chain.append(str(at) or type(at).__name__)
            at = at.__cause__
        return {"is_error": True, "text": ": ".join(chain)}


def serve(engine: Engine, lines=sys.stdin, out=sys.stdout) -> None:
    """JSON-RPC 2.0 by lines: initialize, tools/list and tools/call."""
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
            method, ident = request.get("method"), request.get("id")
        except (ValueError, AttributeError) as e:
            print(json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": f"not a request: {e}"}}, ensure_ascii=False), file=out, flush=True)
            continue
        if ident is None:
            continue
        if method == "initialize":
            answer = {"result": {"protocolVersion": request.get("params", {}).get("protocolVersion", "2025-03-26"), "capabilities": {"tools": {}}, "serverInfo": {"name": "inkfathom", "version": "0.1"}}}
        elif method == "tools/list":
            answer = {"result": {"tools": [{"name": n, "description": (f.__doc__ or n).strip(), "inputSchema": schema_of(f)} for n, f in TOOLS.items()]}}
        elif method == "tools/call" and (request.get("params") or {}).get("name") in TOOLS:
            done = call(engine, request["params"]["name"], request["params"].get("arguments") or {})
            answer = {"result": {"isError": done["is_error"], "content": [{"type": "text", "text": done["text"] if done["is_error"] else json.dumps(done["result"], ensure_ascii=False)}]}}
        else:
            answer = {"error": {"code": -32601, "message": f"no method {method}"}}
        print(json.dumps({"jsonrpc": "2.0", "id": ident, **answer}, ensure_ascii=False), file=out, flush=True)


def parser() -> argparse.ArgumentParser:
    d = DEFAULTS
    top = argparse.ArgumentParser(prog="inkfathom")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("build", "compare", "serve"):
        p = sub.add_parser(name)
        p.add_argument("--db", required=True)
        p.add_argument("--url", "--ollama-url", default=d.url)
        p.add_argument("--batch", type=int, default=d.batch)
        p.add_argument("--model", default=d.model)
        p.add_argument("--dim", type=int, default=d.dim)
        p.add_argument("--num-ctx", type=int, default=d.num_ctx)
        p.add_argument("--offline", action="store_true", help="the hashing embedder in place of a model server")
        p.add_argument("--document-prefix", default=d.document_prefix)
        p.add_argument("--query-prefix", default=d.query_prefix)
        if name == "build":
            p.add_argument("docs")
            p.add_argument("--strategy", default="all")
            p.add_argument("--unit", choices=("chars", "tokens"), default="chars")
            for flag in ("chunk_size", "overlap", "max_section", "min_section", "min_chars"):
                p.add_argument("--" + flag.replace("_", "-"), type=int, default=getattr(d, flag))
        if name == "compare":
            p.add_argument("questions")
            p.add_argument("--out")
            p.add_argument("--top-k", type=int, default=d.top_k)
            p.add_argument("--candidate-top-k", type=int, default=d.candidate_top_k)
            p.add_argument("--similarity-threshold", type=float)
        if name != "build":
            p.add_argument("--rewrite-model")
        if name == "serve":
            p.add_argument("--strategy")
    return top


REWRITE = "Rewrite the question as a short search query in its own language. Answer with the query only."


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("inkfathom").getOrCreate()
    server = ModelServer(a.url)
    provider = HashingProvider(a.dim) if a.offline else HttpProvider(a.url, a.model, a.dim, a.num_ctx)
    chat = getattr(a, "rewrite_model", None) or a.model
    engine = Engine(spark, a.db, provider, server, None if a.offline else lambda q: server.rewrite(chat, REWRITE, q), getattr(a, "strategy", None), a.document_prefix, a.query_prefix)
    if a.command == "serve":
        serve(engine)
    elif a.command == "build":
        for b in engine.build(a.docs, a.strategy, chunk_size=a.chunk_size, overlap=a.overlap, max_section=a.max_section, min_section=a.min_section, unit=a.unit, batch=a.batch, num_ctx=a.num_ctx, min_chars=a.min_chars):
            print(f"{b['strategy']}: {b['files']} files, {b['chars']} characters, {b['chunks']} chunks, {report.embed_time(b['embed_ms'], b['chunks'])}")
    else:
        print(engine.compare(a.questions, a.out, top_k=a.top_k, candidate_top_k=a.candidate_top_k, similarity_threshold=a.similarity_threshold)["report"])


if __name__ == "__main__":
    main()
