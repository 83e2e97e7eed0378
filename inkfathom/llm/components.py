"""Connected components by alternating stars, as DataFrame joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.common import cut, drop, few_files


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Each node links its neighbours (of both directions, or only the smaller ones) to the smallest of them and itself.

    The smallest comes from an aggregate with partial sums, so that a node with very many neighbours is no single task's work.
    """
    pairs = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = pairs.join(least, "a").where(F.col("b") > F.col("a")) if both else pairs.join(least, "a")
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not both:
        out = out.union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def smallest_reachable(edges: DataFrame, nodes: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, smallest: the least rank of the nodes in a node's component. edges: a, b, a stored table, may repeat; nodes: node (unique), rank."""
    stars = cut(few_files(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), edges.count()))
    state = None
    for _ in range(most_rounds):
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == (now.n, now.h):
            break
        state = (now.n, now.h)
        if not now.n:
            break
        before, stars = stars, cut(few_files(_star(_star(stars, True), False), now.n))
        drop(before)
    else:
        raise RuntimeError("the components did not settle")
    roots = nodes.join(stars.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", "rank", F.coalesce("root", "node").alias("root"))
    least = roots.groupBy("root").agg(F.min("rank").alias("smallest"))
    return roots.join(least, "root").select("node", "smallest")
