"""The paragraph model as DataFrame expressions: normalised lines, offsets, section paths, as-of sections, boundary measures.

Paragraph rows are doc, idx, text, heading (1 to 9 or null); with offsets also start and end in code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfathom.schemas import SECTION_JOIN, WHITE

SENTENCE_END, CLOSERS = ".!?…", "\"'»”)]"


def normalised(text: Column) -> Column:
    """Runs of white space as one space, none at either end."""
    return F.trim(F.regexp_replace(text, f"[{WHITE}]+", " "))


def from_text(rows: DataFrame, doc: str = "doc_id", text: str = "text", heading: Column | None = None) -> DataFrame:
    """A paragraph for each line that holds more than white space; heading is an expression of idx (place among those kept)."""
    lines = F.filter(F.transform(F.split(text, "\n"), normalised), lambda x: x != "")
    made = rows.select(F.col(doc).alias("doc"), F.posexplode(lines).alias("idx", "text"))
    return made.withColumn("heading", (F.lit(None) if heading is None else heading).cast("tinyint"))


def with_offsets(paragraphs: DataFrame) -> DataFrame:
    """start: lengths of those before, each with its newline."""
    before = Window.partitionBy("doc").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    return paragraphs.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def with_sections(paragraphs: DataFrame, levels: int = 9) -> DataFrame:
    """section: the path of the open headings. The last heading of a level is open if no shallower one came after it."""
    so_far = Window.partitionBy("doc").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    last = {n: F.last(F.when(F.col("heading") == n, F.struct("idx", "text")), ignorenulls=True).over(so_far) for n in range(1, levels + 1)}
    rows = paragraphs.withColumns({f"_{n}": c for n, c in last.items()})
    parts = []
    for n in range(1, levels + 1):
        open_ = F.col(f"_{n}").isNotNull()
        for m in range(1, n):
            open_ &= F.col(f"_{m}").isNull() | (F.col(f"_{m}.idx") < F.col(f"_{n}.idx"))
        parts.append(F.when(open_, F.col(f"_{n}.text")))
    return rows.withColumn("section", F.concat_ws(SECTION_JOIN, *parts)).drop(*last and [f"_{n}" for n in last])


def document_text(paragraphs: DataFrame) -> DataFrame:
    """doc, text and char_len: the paragraphs joined by newlines."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n")
    return paragraphs.groupBy("doc").agg(joined.alias("text")).withColumn("char_len", F.length("text"))


def section_at(probes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """probes (doc, pos and others) with the section of the last paragraph that starts at or before pos, else empty.

    An as-of lookup as one sort: paragraphs and probes are united and the last section runs on, so no pair is made.
    """
    names = [c for c in probes.columns if c not in ("doc", "pos")]
    marks = paragraphs.select("doc", F.col("start").alias("pos"), F.lit(0).alias("_kind"), F.struct("section").alias("_s"), F.lit(None).cast(probes.select(F.struct(*(names or ["pos"]))).schema[0].dataType).alias("_rest"))
    asks = probes.select("doc", "pos", F.lit(1).alias("_kind"), F.lit(None).cast("struct<section:string>").alias("_s"), F.struct(*(names or ["pos"])).alias("_rest"))
    run = Window.partitionBy("doc").orderBy("pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    done = marks.union(asks).withColumn("section", F.coalesce(F.last("_s", ignorenulls=True).over(run)["section"], F.lit("")))
    return done.where("_kind = 1").select("doc", "pos", *(F.col(f"_rest.{n}").alias(n) for n in names), "section")


def section_end(paragraphs: DataFrame) -> DataFrame:
    """Headings with end_idx: the next heading of the same or a shallower level, or the number of paragraphs.

    For each level a running minimum from below gives the next heading of that level; no pair is made.
    """
    after = Window.partitionBy("doc").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("doc")
    rows = paragraphs.withColumn("_n", F.max("idx").over(whole) + 1).withColumns({f"_{n}": F.min(F.when(F.col("heading") == n, F.col("idx"))).over(after) for n in range(1, 10)})
    ends = [F.when(F.col("heading") >= n, F.col(f"_{n}")) for n in range(1, 10)]
    return rows.where(F.col("heading").isNotNull()).select("doc", "idx", "heading", F.coalesce(F.least(*ends), F.col("_n")).cast("int").alias("end_idx"))


def crosses_section(spans: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """spans (doc, span_start, span_end) with crosses_section: whether the paragraphs that a span overlaps are not all of one section.

    An interval join within a document: equal on doc, then overlap; the root is the shortest of the paths.
    """
    p = paragraphs.select(F.col("doc").alias("_doc"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("section").alias("_path"))
    hit = (F.col("doc") == F.col("_doc")) & (F.col("_s") < F.col("span_end")) & (F.col("_e") > F.col("span_start"))
    found = spans.join(p, hit, "left").groupBy("doc", "span_start", "span_end").agg(F.collect_set("_path").alias("_paths"))
    root = F.array_sort(F.transform("_paths", lambda x: F.struct(F.length(x).alias("n"), x.alias("path"))))[0]["path"]
    one = F.forall("_paths", lambda x: (x == F.col("_root")) | ((F.col("_root") != "") & x.startswith(F.concat(F.col("_root"), F.lit(SECTION_JOIN)))))
    return found.withColumn("_root", F.when(F.size("_paths") > 0, root)).withColumn("crosses_section", F.coalesce(~one, F.lit(False))).drop("_paths", "_root")


def cut_mid_sentence(text: Column, start: Column, end: Column) -> Column:
    """Whether the span's end stands inside a sentence of text."""
    ended = F.substring(text, start + 1, end - start).rlike(rf"[{SENTENCE_END}][\"'»”)\]]*\z")
    return ~((end == 0) | (end >= F.length(text)) | (F.substring(text, end + 1, F.lit(1)) == "\n") | ended)


def file_name(source: Column) -> Column:
    return F.regexp_extract(source, r"([^/]+)/*$", 1)


def file_stem(source: Column) -> Column:
    """The name without its last extension; a name that only starts with a dot keeps it."""
    return F.regexp_replace(file_name(source), r"(?<=.)\.[^.]*$", "")


def chunk_id(strategy: Column, stem: Column, ordinal: Column) -> Column:
    return F.format_string("%s:%s:%04d", strategy, stem, ordinal)
