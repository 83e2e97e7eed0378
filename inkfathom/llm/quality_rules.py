"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text: too few words, too many words in repeated eight-word windows. The cross-document rule
counts, for each host (column source), in how many documents a normalised line stands; lines above the limit are taken
out, and a document of which too little is left is rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.common import WORD_SPLIT, cut

LEAST_WORDS = 20
WINDOW = 8
REPEATED_PER_CENT = 30
#: A line stands in too many documents of a host from this number on, and from this part of the host's documents on.
LINE_DOCUMENTS = 50
LINE_PART = 0.005
#: A document is depleted if a smaller part of its words than this is left.
LEFT_PART = 0.3
#: Frequent lines with more than this part of all their occurrences are joined by broadcast: fewer than so many.
HOT = 10_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that stand in a window of words found twice or more in the list, the first time included.

    Windows are compared by 64-bit hash. If none recurs that ends it; else the windows are sorted by hash, those equal to
    a neighbour are repeats, and the parts that their sorted starts cover are added up.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(hashed: Column) -> Column:
        placed = F.array_sort(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(placed, lambda s: F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.get(s, i + 1)["h"] == x["h"])))
        starts = F.array_sort(F.transform(again, lambda x: x["i"]))
        parts = let(starts, lambda s: F.transform(s, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(s, i + 1) - x, F.lit(window)))))
        return F.aggregate(parts, F.lit(0), lambda a, x: a + x)

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(n < window, 0).otherwise(counted).cast("long")


def normalised(line: Column) -> Column:
    """Lower case, words with one space between."""
    return F.array_join(split_words(F.lower(line)), " ")


def line_key(line: Column) -> Column:
    """Two hashes of a normalised line, 128 bits together, so that no two lines of a very large corpus meet by chance."""
    return let(normalised(line), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b")))


def base_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row for each row of docs: its id, a row number, the host's hash, the base counts, and key and words of each line with a word."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(host_col).cast("string")).alias("host"), text.alias("_text"))
    split = rows.withColumns({"_words": split_words(F.col("_text")), "_lines": lines_with_words(F.col("_text"))})
    words, lines = F.col("_words"), F.col("_lines")
    return split.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), "host",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat_words(words).alias("n_repeat_words"),
        F.transform(lines, lambda x: F.struct(line_key(x).alias("line"), F.size(split_words(x)).alias("words"))).alias("lines"),
    )


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, the base counts, base_failed, n_frequent_words (words of lines above the limit), left_part and kept.

    Texts are read once, whole; what follows works on a table of the counts and line hashes. A null text is empty and fails. A null host is a host of its own.
    Rows that repeat an id are one document where documents are counted, with or without the same text, and each has its own words,
    lost words and verdict; a row without an id is a document of its own. Empty tables give no rows; other columns are not read,
    so their names do not matter.
    """
    metrics = cut(base_metrics(docs, id_col, text_col, host_col))
    own_id = F.when(F.col("doc_id").isNull(), F.col("row"))  # with doc_id: a document
    lines = metrics.select("doc_id", own_id.alias("own"), "row", "host", F.explode("lines").alias("x")).select("doc_id", "own", "row", "host", "x.line", "x.words")
    once = lines.groupBy("host", "line", "row").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("own").alias("own"), F.sum("words").alias("words"))
    hosts = metrics.groupBy("host", "doc_id", own_id.alias("own")).agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("documents"))
    per_line = once.groupBy("host", "line", "doc_id", "own").agg(F.count("*").alias("times"))
    counts = per_line.groupBy("host", "line").agg(F.count("*").alias("n"), F.sum("times").alias("times")).where(F.col("n") >= LINE_DOCUMENTS)
    above = cut(counts.join(hosts, "host").where(F.col("n") >= F.col("documents") * LINE_PART).select("host", "line", "times"))
    # lines of over 1/HOT of all rows, fewer than HOT, go to every task; of the others none is a hot key
    least = (above.agg(F.sum("times")).first()[0] or 0) / HOT
    often = F.broadcast(above.where(F.col("times") > least).select("host", "line", F.lit(True).alias("hot")))
    marked = once.join(often, ["host", "line"], "left").select("row", "host", "line", "words", "hot")
    rare = above.where(F.col("times") <= least).select("host", "line")
    found = marked.where("hot").select("row", "words").union(marked.where("hot is null").join(rare, ["host", "line"]).select("row", "words"))
    lost = found.groupBy("row").agg(F.sum("words").cast("long").alias("lost"))
    joined = metrics.drop("lines", "host").join(lost, "row", "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PER_CENT * F.col("n_words"))
    left = F.when(F.col("n_words") > 0, 1 - F.coalesce("lost", F.lit(0)) / F.col("n_words")).otherwise(0.0)
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (left >= LEFT_PART)).alias("kept"), F.coalesce("lost", F.lit(0)).cast("long").alias("n_frequent_words"), F.round(left, 6).alias("left_part"),
    )


#: The same in DuckDB over table documents.
SQL = rf"""
with t as (select doc_id, source, coalesce(text, '') as text from documents),
w as (select doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
g as (select doc_id, unnest(range(1, len(words) - {WINDOW - 2})) as i, words from w where len(words) >= {WINDOW}),
h as (select doc_id, i, array_to_string(words[i:i+{WINDOW - 1}], ' ') as s from g),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as n from h) where n > 1),
c as (select doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from r) group by doc_id),
b as (select w.doc_id, source, lines, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
  coalesce(c.n, 0) as n_repeat_words from w left join c on w.doc_id = c.doc_id),
l as (select doc_id, source, unnest(lines) as line from b),
o as (select doc_id, source, array_to_string(list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' ') as k,
  len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n from l),
p as (select doc_id, source, k, sum(n) as n from o group by 1, 2, 3),
a as (select source, k from p group by 1, 2 having count(*) >= {LINE_DOCUMENTS} and count(*) >= {LINE_PART} * (select count(*) from documents d where d.source is not distinct from p.source)),
x as (select p.doc_id, sum(p.n) as lost from p join a on p.source is not distinct from a.source and p.k = a.k group by 1),
f as (select b.*, coalesce(x.lost, 0) as lost, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEATED_PER_CENT} * n_words as base_failed from b left join x on b.doc_id = x.doc_id)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and (case when n_words > 0 then 1 - lost::double / n_words else 0 end) >= {LEFT_PART} as kept,
  lost::bigint as n_frequent_words, round(case when n_words > 0 then 1 - lost::double / n_words else 0 end, 6) as left_part from f
"""
