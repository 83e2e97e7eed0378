"""Retrieval evaluation: ranks of the first hit, hit@k, MRR, unreachable questions, length and boundary figures, modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfathom.operators.paragraphs import file_name

MODES = [("baseline", False, False), ("rewrite", True, False), ("filter", False, True), ("rewrite+filter", True, True)]


def matches(section: Column, chunk_source: Column, expected: Column, source: Column) -> Column:
    return F.array_contains(expected, section) & (source.isNull() | (file_name(chunk_source) == source))


def ranks(results: DataFrame, questions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, qid and rank of the first hit (null without one), for every question and every combination of keys in results."""
    hit = results.join(questions.select("qid", "expected", F.col("source").alias("_want")), "qid").where(matches(F.col("section"), F.col("source"), F.col("expected"), F.col("_want")))
    first = hit.groupBy(*keys, "qid").agg(F.min("rank").alias("rank"))
    groups = results.select(*keys).distinct() if keys else None
    every = questions.select("qid") if groups is None else groups.crossJoin(questions.select("qid"))
    return every.join(first, [*keys, "qid"], "left")


def metrics(rank_rows: DataFrame, keys: list[str], ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """hit@k, MRR and the number of questions without a hit, by keys; 0 for no questions."""
    shares = [F.coalesce(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"hit_{k}") for k in ks]
    return rank_rows.groupBy(*keys).agg(*shares, F.coalesce(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"), F.count_if(F.col("rank").isNull()).alias("no_results"))


def unreachable(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions of which no chunk has an expected section: an anti join on each section, then on the question."""
    asked = questions.select("qid", F.explode("expected").alias("section"), F.col("source").alias("want"))
    have = chunks.select("section", file_name(F.col("source")).alias("name")).distinct()
    met = asked.join(have, (asked.section == have.section) & (asked.want.isNull() | (asked.want == have.name)), "left_semi").select("qid").distinct()
    return questions.join(met, "qid", "left_anti")


def length_stats(rows: DataFrame, length: Column, keys: list[str] | None = None) -> DataFrame:
    """Least, median, 95th percentile and greatest by nearest rank."""
    rows = rows.withColumn("_n", length)
    p = [F.expr(f"percentile_disc({q}) within group (order by _n)").cast("long") for q in (0.5, 0.95)]
    zero = F.lit(0).cast("long")
    return rows.groupBy(*(keys or [])).agg(
        F.coalesce(F.min("_n").cast("long"), zero).alias("min"), F.coalesce(p[0], zero).alias("median"), F.coalesce(p[1], zero).alias("p95"), F.coalesce(F.max("_n").cast("long"), zero).alias("max")
    )


def boundary_stats(chunks: DataFrame, keys: list[str]) -> DataFrame:
    share = lambda c: F.round(100 * F.count_if(c) / F.count("*"), 1)
    return chunks.groupBy(*keys).agg(F.count("*").alias("chunks"), F.count_if("crosses_section").alias("crossing"), share(F.col("crosses_section")).alias("crossing_pct"), F.count_if("cut_mid_sentence").alias("cut"), share(F.col("cut_mid_sentence")).alias("cut_pct"))


def mode_counts(found: DataFrame, results: DataFrame, questions: DataFrame, keys: list[str]) -> DataFrame:
    """Average candidates and results of a question, and questions whose candidates were all filtered away, by keys."""
    every = found.select(*keys).distinct().crossJoin(questions.select("qid"))
    c = found.groupBy(*keys, "qid").agg(F.count("*").alias("c"))
    r = results.groupBy(*keys, "qid").agg(F.count("*").alias("r"))
    both = every.join(c, [*keys, "qid"], "left").join(r, [*keys, "qid"], "left").fillna(0, ["c", "r"])
    return both.groupBy(*keys).agg(F.avg("c").alias("candidates"), F.avg("r").alias("results"), F.count_if((F.col("c") > 0) & (F.col("r") == 0)).alias("filtered_all"))


def best(table: list[dict]) -> tuple[str, bool]:
    """The best strategy by MRR, hit@5, fewer chunks, the last on a full tie; and whether the first two figures tie."""
    top = max(enumerate(table), key=lambda x: (x[1]["mrr"], x[1]["hit_5"], -x[1]["chunks"], x[0]))[1]
    tie = len(table) > 1 and all(max(t[k] for t in table) - min(t[k] for t in table) < 1e-9 for k in ("mrr", "hit_5"))
    return top["strategy"], tie
