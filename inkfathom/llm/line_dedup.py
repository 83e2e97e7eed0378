"""Line deduplication by overlapping three-line windows.

Consecutive lines are hashed, and so is each window of three of them. Windows that stand more than once in the corpus
keep their first place, by document and position; the later ones are removed, and the positions that removed windows of a
document cover are merged. Lines without a word are kept where they are and count for no window.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.common import SPACE, WORD_SPLIT, cut, unused

LINES = 3
#: Repeated windows with more than this part of all their occurrences are joined by broadcast: fewer than so many.
HOT = 10_000


def _normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), WORD_SPLIT, " "))


def _twice(*columns: Column) -> Column:
    """Two hashes, 128 bits together, so that no two windows of a very large corpus meet by chance."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("second"), *columns).alias("b"))


def windows(docs: DataFrame, size: int = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, place (of the window's first line among the lines with a word, from 0) and hash of each window."""
    lines = F.filter(F.transform(F.split(text_col, "\n"), _normalised), lambda x: x != "")
    hashed = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.transform(lines, lambda x: _twice(x)).alias("h"))
    rows = hashed.where(F.size("h") >= size)
    made = F.transform(F.sequence(F.lit(1), F.size("h") - (size - 1)), lambda i: _twice(*(F.element_at("h", i + j)[x] for j in range(size) for x in "ab")))
    return rows.select("doc_id", "text_hash", F.posexplode(made).alias("place", "hash"))


def repeats(docs: DataFrame, size: int = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and removed: the sorted places of its windows that stand earlier in the corpus."""
    every = cut(windows(docs, size, id_col, text_col))
    at = F.struct("doc_id", "text_hash", "place")
    first = cut(every.groupBy("hash").agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1"))
    # windows of over 1/HOT of all repeated ones, fewer than HOT, go to every task; of the others none is a hot key
    least = (first.agg(F.sum("n")).first()[0] or 0) / HOT
    marked = every.join(F.broadcast(first.where(F.col("n") > least).select("hash", F.col("first").alias("hot"))), "hash", "left")
    rest = marked.where("hot is null").join(first.where(F.col("n") <= least).select("hash", "first"), "hash")
    both = marked.where("hot is not null").select("doc_id", "text_hash", "place", F.col("hot").alias("first")).union(rest.select("doc_id", "text_hash", "place", "first"))
    return both.where(at > F.col("first")).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("place")).alias("removed"))


def without(text: str, removed: list[int], size: int = LINES) -> tuple[str, int]:
    """The text without the lines that the windows from these places on cover, and their number."""
    kept, place, end, starts = [], 0, -1, set(removed)
    lines = text.split("\n")
    for line in lines:
        if line.strip(SPACE):
            if place in starts:
                end = place + size - 1
            place += 1
            if place - 1 <= end:
                continue
        kept.append(line)
    return "\n".join(kept), len(lines) - len(kept)


def _take_out(text: pd.Series, removed: pd.Series, size: pd.Series) -> pd.DataFrame:
    done = [(None, 0) if t is None or r is None else without(t, r, n) for t, r, n in zip(text, removed, size)]
    return pd.DataFrame(done, columns=["text", "n"])


def dedup(docs: DataFrame, size: int = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with repeated passages taken out of the text, and n_removed_lines, which replaces a column of that name.

    A document is an id and a text, in order of id, rows without an id first, and then of the text's hash: different texts under one id are
    compared like others, and rows that repeat both are one document and stay, with one result. A null text stays null; one with
    fewer lines than a window, an empty one among them, stays as it is; a text all of whose lines repeat becomes empty. Long texts are read whole. Every row of docs is kept,
    other columns have any names and are not touched, and an empty table stays empty.
    """
    ident, same, places, done = unused(docs, "_id", "_hash", "_removed", "_done")
    gone = repeats(docs, size, id_col, text_col).select(F.col("doc_id").alias(ident), F.col("text_hash").alias(same), F.col("removed").alias(places))
    joined = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(ident)) & (F.xxhash64(text_col) == F.col(same)), "left").drop(ident, same)
    made = joined.withColumn(done, F.pandas_udf(_take_out, "text string, n long")(F.when(F.col(places).isNotNull(), F.col(text_col)), F.col(places), F.lit(size)))
    text = F.when(F.col(places).isNull(), F.col(text_col)).otherwise(F.col(done)["text"])
    return made.withColumns({text_col: text, "n_removed_lines": F.coalesce(F.col(done)["n"], F.lit(0)).cast("long")}).drop(places, done)


#: The same in DuckDB over table documents: doc_id, kept_text and n_removed_lines.
SQL = r"""
with t as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null),
l as (select doc_id, i, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as k from t),
n as (select doc_id, i, k, row_number() over (partition by doc_id order by i) - 1 as p from l where k <> ''),
w as (select doc_id, p, k, lead(k, 1) over o as k1, lead(k, 2) over o as k2 from n window o as (partition by doc_id order by p)),
f as (select doc_id, p, row_number() over (partition by k, k1, k2 order by doc_id, p) as r from w where k2 is not null),
g as (select distinct doc_id, p + d as p from f, (values (0), (1), (2)) as v(d) where r > 1),
x as (select l.doc_id, l.i, l.line, g.p is not null as gone from l left join n on l.doc_id = n.doc_id and l.i = n.i left join g on n.doc_id = g.doc_id and n.p = g.p)
select d.doc_id, case when d.text is null then null else coalesce(y.kept, '') end as kept_text, coalesce(y.n, 0)::bigint as n_removed_lines
from documents d left join (select doc_id, string_agg(line, chr(10) order by i) filter (not gone) as kept, count(*) filter (gone) as n from x group by doc_id) y on d.doc_id = y.doc_id
"""
