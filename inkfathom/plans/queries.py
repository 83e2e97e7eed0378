"""Registered queries of the document index, each over its whole tables, and the same in DuckDB SQL."""

from __future__ import annotations

import atexit
import re
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.functions.embed import HashingProvider, decode_vector, embed_column, encode_vector, l2_normalised
from inkfathom.functions.units import WORD_START, token_count
from inkfathom.operators import chunking, evaluate, paragraphs, search
from inkfathom.operators.paragraphs import chunk_id, from_text, with_offsets, with_sections
from inkfathom.service import Engine, plain
from inkfathom.sources.docx import check_corpus, clashes, parse_column
from inkfathom.sources.questions import expected_list
from inkfathom.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The stated query set of searches: ids divisible by this, against all rows.
EVERY = 50


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(x: Column) -> Column:
    """A finite x to six places as SQL does it: what rounds to zero keeps its sign, which F.round drops."""
    r = F.round(x * 1e6) / 1e6
    return F.when(r == 0, x * 0.0).otherwise(r)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of the documents with a heading at every seventh line, levels 1 to 3 in turn."""
    level = F.when(F.col("idx") % 7 == 0, 1 + F.floor(F.col("idx") / 7) % 3)
    return from_text(table(spark, sf_dir, "documents"), heading=level)


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_sections(with_offsets(lines(spark, sf_dir)), 3)


_P = r"""
with r as (select doc_id as doc, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
n as (select doc, i, trim(regexp_replace(t, '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ') as text from r),
p0 as (select doc, row_number() over (partition by doc order by i) - 1 as idx, text from n where text <> ''),
p1 as (select doc, idx, text, case when idx % 7 = 0 then 1 + (idx // 7) % 3 end as heading,
  coalesce(sum(length(text) + 1) over (partition by doc order by idx rows between unbounded preceding and 1 preceding), 0)::bigint as start from p0),
p2 as (select *, start + length(text) as stop,
  max(case when heading = 1 then idx end) over w as i1, max(case when heading = 2 then idx end) over w as i2, max(case when heading = 3 then idx end) over w as i3,
  last_value(case when heading = 1 then text end ignore nulls) over w as t1, last_value(case when heading = 2 then text end ignore nulls) over w as t2, last_value(case when heading = 3 then text end ignore nulls) over w as t3
  from p1 window w as (partition by doc order by idx rows between unbounded preceding and current row)),
p as (select doc, idx::int as idx, text, heading, start, stop, concat_ws(' > ', t1, case when i2 > coalesce(i1, -1) then t2 end, case when i3 > coalesce(i1, -1) and i3 > coalesce(i2, -1) then t3 end) as section from p2)
"""


@query(_P + "select doc, idx, text from p")
def paragraph_rows(spark, sf_dir):
    return lines(spark, sf_dir).select("doc", "idx", "text")


@query(_P + 'select doc, idx, start, stop from p')
def paragraph_offsets(spark, sf_dir):
    return with_offsets(lines(spark, sf_dir)).select("doc", "idx", "start", F.col("end").alias("stop"))


@query(_P + "select doc, string_agg(text, chr(10) order by idx) as text, length(string_agg(text, chr(10) order by idx)) as char_len from p group by doc")
def document_texts(spark, sf_dir):
    return paragraphs.document_text(lines(spark, sf_dir)).select("doc", "text", F.col("char_len").cast("long").alias("char_len"))


@query(_P + "select doc, idx, section from p")
def section_paths(spark, sf_dir):
    return located(spark, sf_dir).select("doc", "idx", "section")


def spans(rows: DataFrame) -> DataFrame:
    """Spans of 400 characters every 300 over each document."""
    ends = rows.groupBy("doc").agg(F.max("end").alias("n"))
    at = ends.select("doc", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(300).cast("long"))).alias("span_start"))
    return at.select("doc", "span_start", F.least(F.col("span_start") + 400, F.col("n")).alias("span_end"))


_S = _P + ", s as (select doc, span_start, least(span_start + 400, n) as span_end from (select doc, n, unnest(range(0, n, 300)) as span_start from (select doc, max(stop) as n from p group by doc)))"


@query(_S + " select s.doc, span_start as pos, coalesce(p.section, '') as section from s asof left join p on s.doc = p.doc and s.span_start >= p.start")
def section_asof(spark, sf_dir):
    rows = located(spark, sf_dir)
    return paragraphs.section_at(spans(rows).select("doc", F.col("span_start").alias("pos")), rows).select("doc", "pos", "section")


@query(
    _S
    + """, j as (select s.doc, span_start, span_end, section from s join p on s.doc = p.doc and p.start < span_end and p.stop > span_start),
roots as (select doc, span_start, span_end, arg_min(section, length(section)) as root from j group by 1, 2, 3)
select j.doc, j.span_start, j.span_end, not bool_and(section = root or (root <> '' and starts_with(section, root || ' > '))) as crosses_section
from j join roots using (doc, span_start, span_end) group by 1, 2, 3"""
)
def crosses_section(spark, sf_dir):
    rows = located(spark, sf_dir)
    return paragraphs.crosses_section(spans(rows), rows)


@query(
    _S
    + r""", d as (select doc, string_agg(text, chr(10) order by idx) as text from p group by doc)
select s.doc, span_start, span_end, not (span_end = 0 or span_end >= length(text) or text[span_end + 1] = chr(10)
  or regexp_matches(text[span_start + 1:span_end], '[.!?…]["''»”)\]]*\z')) as cut from s join d on s.doc = d.doc"""
)
def cut_mid_sentence(spark, sf_dir):
    rows = with_offsets(lines(spark, sf_dir))
    texts = paragraphs.document_text(rows)
    cut = paragraphs.cut_mid_sentence(F.col("text"), F.col("span_start").cast("int"), F.col("span_end").cast("int"))
    return spans(rows).join(texts, "doc").select("doc", "span_start", "span_end", cut.alias("cut"))


@query(_P + "select a.doc, a.idx, coalesce(min(b.idx), any_value(c.n))::int as end_idx from p a left join p b on a.doc = b.doc and b.idx > a.idx and b.heading <= a.heading join (select doc, count(*) as n from p group by doc) c on a.doc = c.doc where a.heading is not null group by 1, 2")
def section_ends(spark, sf_dir):
    return paragraphs.section_end(lines(spark, sf_dir)).select("doc", "idx", "end_idx")


@query(_P + "select printf('%s:%s:%04d', 'line', 'doc' || doc, idx) as chunk_id, doc, idx from p")
def chunk_ids(spark, sf_dir):
    return lines(spark, sf_dir).select(chunk_id(F.lit("line"), F.format_string("doc%d", F.col("doc")), F.col("idx")).alias("chunk_id"), "doc", "idx")


def packed_lines(spark, sf_dir) -> DataFrame:
    return chunking.documents_of(lines(spark, sf_dir), F.format_string("doc%d.docx", F.col("doc")), F.format_string("doc%d", F.col("doc")))


#: Windows of 1,200 characters that overlap by 200, walked one after the other over lists of places.
_F = (
    _P.replace("with r as", "with recursive r as", 1)
    + r""", d as (select doc, string_agg(text, chr(10) order by idx) as text from p group by doc),
c0 as (select doc, unnest(range(0, length(text))) as i, length(text) as n, text from d),
c1 as (select doc, i, n, substr(text, i + 1, 1) as ch, regexp_matches(substr(text, i + 1, 1), '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]') as white from c0),
c2 as (select *, white and coalesce(last_value(case when not contains('"''»”)]', ch) then ch end ignore nulls) over (partition by doc order by i rows between unbounded preceding and 1 preceding) in ('.', '!', '?', '…'), false) as after from c1),
c3 as (select *, lag(ch) over w as ch0, coalesce(lag(white) over w, false) as white0, coalesce(lag(after) over w, false) as after0 from c2 window w as (partition by doc order by i)),
g as (select doc, any_value(n) as n, list(i) filter (white) as whites, list_append(coalesce(list(i) filter (ch = chr(10) or after), []), any_value(n)) as goods,
  list(i) filter (white0 and not white) as begun, list(i) filter (not white and (ch0 = chr(10) or after0)) as sentences from c3 group by doc),
e(doc, n, a, b, whites, goods, begun, sentences) as (
  select doc, n, -1::bigint, 0::bigint, coalesce(whites, []), goods, coalesce(begun, []), coalesce(sentences, []) from g
  union all
  select doc, n, s, case when s + 1200 >= n then n else greatest(s + 1, coalesce(list_max(list_filter(goods, lambda x: x >= s + 900 and x <= s + 1200)), list_max(list_filter(whites, lambda x: x >= s + 900 and x < s + 1200)), s + 1200)) end, whites, goods, begun, sentences
  from (select doc, n, whites, goods, begun, sentences, case when a < 0 then 0 else greatest(a + 1, coalesce(
      list_min(list_transform(list_filter(sentences, lambda x: x >= greatest(b - 300, a + 1) and x < least(b - 100, b)), lambda x: abs(x - greatest(b - 200, a + 1)) * 1000000000 + x)) % 1000000000,
      list_min(list_filter(begun, lambda x: x >= greatest(b - 200, a + 1) and x < b)), b)) end as s from e where b < n)),
f0 as (select e.doc, e.n, a, b, substr(text, a + 1, b - a) as t, text from e join d on e.doc = d.doc where a >= 0),
f1 as (select doc, n, text, a + length(t) - length(ltrim(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160))) as a, b - length(t) + length(rtrim(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160))) as b from f0),
f2 as (select *, substr(text, a + 1, b - a) as t, row_number() over (partition by doc order by a) - 1 as ordinal from f1 where a < b),
x as (select f2.doc, f2.a, f2.b, list(section) as paths, arg_min(section, length(section)) as root from f2 join p on f2.doc = p.doc and p.start < f2.b and p.stop > f2.a group by 1, 2, 3),
f as (select printf('fixed:doc%d:%04d', f2.doc, ordinal) as chunk_id, 'fixed' as strategy, 'doc' || f2.doc || '.docx' as source, 'doc' || f2.doc || '.docx' as title, y.section, ordinal, f2.a as char_start, f2.b as char_end, f2.t as text,
  not list_bool_and(list_transform(paths, lambda z: z = root or (root <> '' and starts_with(z, root || ' > ')))) as crosses_section,
  not (f2.b >= n or substr(f2.text, f2.b + 1, 1) = chr(10) or regexp_matches(f2.t, '[.!?…]["''»”)\]]*\z')) as cut_mid_sentence
  from f2 join x on f2.doc = x.doc and f2.a = x.a and f2.b = x.b asof join p y on f2.doc = y.doc and f2.a >= y.start)
"""
)


@query(_F + "select * from f")
def fixed_chunks(spark, sf_dir):
    return chunking.chunk_rows(packed_lines(spark, sf_dir), chunking.Fixed())


@query()
def structure_chunks(spark, sf_dir):
    return chunking.chunk_rows(packed_lines(spark, sf_dir), chunking.Structure())


@query(
    _F
    + """select strategy, count(*) as chunks, count(*) filter (crosses_section) as crossing, round(100 * count(*) filter (crosses_section) / count(*), 1) as crossing_pct,
count(*) filter (cut_mid_sentence) as cut, round(100 * count(*) filter (cut_mid_sentence) / count(*), 1) as cut_pct from f group by strategy"""
)
def chunk_boundary_stats(spark, sf_dir):
    return evaluate.boundary_stats(chunking.chunk_rows(packed_lines(spark, sf_dir), chunking.Fixed()), ["strategy"])


PIECES = [WORD_START + x for x in "the of and to in is that for on with as by at be an or re er on en es de la le el die der und".split()] + list("abcdefghijklmnopqrstuvwxyz") + ["ing", "tion", "ent", "ich", "sch"]


#: Words in lower case without marks, then the longest piece that fits, again and again.
_T = rf"""
with recursive d as (select doc_id, lower(strip_accents(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0E-\x1F\x7F]', '', 'g'))) as text from documents),
w as (select doc_id, unnest(regexp_extract_all(text, '[!-/:-@\[-`{{-~¡§«¶·»¿\x{{2010}}-\x{{2027}}\x{{2030}}-\x{{205E}}]|[^!-/:-@\[-`{{-~¡§«¶·»¿\x{{2010}}-\x{{2027}}\x{{2030}}-\x{{205E}}\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+')) as word from d),
u as (select word, '{WORD_START}' || word as s from w group by word),
m(word, s, pos, n) as (select word, s, 1, 0 from u union all
  select word, s, pos + step, n + 1 from (select word, s, pos, n, list_max(list_filter(range(1, {max(map(len, PIECES)) + 1}), lambda k: pos + k - 1 <= length(s) and list_contains({PIECES!r}, substr(s, pos, k)))) as step from m where pos <= length(s)) where step is not null),
t as (select word, coalesce(max(n) filter (pos > length(s)), 1) as n from m group by word)
select d.doc_id, coalesce(c.n, 0)::bigint as tokens from documents d left join (select doc_id, sum(n) as n from w join t using (word) group by doc_id) c on d.doc_id = c.doc_id
"""


@query(_T)
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", token_count(F.coalesce("text", F.lit("")), PIECES).alias("tokens"))


@query(
    r"""
with w as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+')) as word from documents),
k as (select doc_id, lower(word) as word from w where length(word) > 2),
h as (select word, list_reduce(list_prepend(1469598103934665603::hugeint, list_transform(range(0, length(hex(encode(word))) // 2), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::int, 2))::int::hugeint)),
  lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616::hugeint) % 64 as bucket from (select distinct word from k)),
b as (select doc_id, bucket, count(*) as n from k join h using (word) group by 1, 2),
g as (select d.doc_id, r.i, coalesce(b.n, 0) + case when r.i = 0 then 0.01::double else 0 end as x from documents d cross join (select unnest(range(0, 64)) as i) r left join b on b.doc_id = d.doc_id and b.bucket = r.i)
select doc_id, list(round((x / norm)::float::double, 6) order by i) as vector from (select *, sqrt(sum(x * x) over (partition by doc_id)) as norm from g) group by doc_id
"""
)
def bow_embed(spark, sf_dir):
    made = embed_column(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), HashingProvider(64), "doc_id", "text")
    return made.select("doc_id", F.transform("vector", lambda x: F.round(x.cast("double"), 6)).alias("vector"))


@query("select vec_id, list_transform(embedding, lambda x: x::float::double) as vector from embeddings")
def vector_codec(spark, sf_dir):
    """Vectors to blobs of little-endian floats and back."""

    def turn(batches):
        for part in batches:
            yield part.assign(vector=[decode_vector(encode_vector(v)).astype(float) for v in part["vector"]])

    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")).mapInPandas(turn, "vec_id long, vector array<double>")


@query("select vec_id, list_transform(embedding, lambda x: round(x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))), 6)) as vector from embeddings")
def l2_normalize(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(l2_normalised(F.col("embedding")), rounded).alias("vector"))


def vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Chunks (vec_id, label, vector) and queries (qid, query_vector): ids divisible by EVERY."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    return rows, rows.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), F.col("vector").alias("query_vector"))


_V = f"""
with q as (select vec_id as qid, label as want, embedding::double[] as qv from embeddings where vec_id % {EVERY} = 0),
s as (select qid, want, vec_id, label, list_sum(list_transform(list_zip(qv, embedding::double[]), lambda x: x[1] * x[2])) as score from q, embeddings),
c as (select *, row_number() over (partition by qid order by round(score, 9) desc, vec_id) as rank from s qualify rank <= 20)
"""


def ranked(spark, sf_dir, method: str = "matmul", k: int = 20) -> DataFrame:
    rows, asked = vectors(spark, sf_dir)
    found = search.candidates(asked, rows.select("vec_id", "vector"), k, ["vec_id"], method)
    return found.withColumn("score", F.round("score", 6))


@query(_V + "select qid, vec_id, round(score, 6) as score, rank from c where rank <= 10")
def cosine_topk(spark, sf_dir):
    return ranked(spark, sf_dir, k=10)


@query(_V + "select qid, vec_id, round(score, 6) as score, rank from c where rank <= 10")
def cosine_topk_expr(spark, sf_dir):
    return ranked(spark, sf_dir, "expr", 10)


def finished(spark, sf_dir, threshold: float | None, k: int = 5) -> DataFrame:
    return search.finish(ranked(spark, sf_dir).drop("rank"), ["vec_id"], k, threshold)


@query(_V + "select qid, vec_id, row_number() over (partition by qid order by round(score, 6) desc, vec_id) as rank from c where round(score, 6) >= 0.5")
def cosine_threshold(spark, sf_dir):
    return finished(spark, sf_dir, 0.5, 20).select("qid", "vec_id", "rank")


_M = _V + ", m(mode, t) as (values ('baseline', -1.0), ('filter', 0.5)), f as (select mode, qid, vec_id, label, row_number() over (partition by mode, qid order by round(score, 6) desc, vec_id) as rank from c, m where round(score, 6) >= t qualify rank <= 5)"


def modes_of(spark, sf_dir) -> DataFrame:
    """Final results of two modes over the same candidates."""
    return finished(spark, sf_dir, None).withColumn("mode", F.lit("baseline")).unionByName(finished(spark, sf_dir, 0.5).withColumn("mode", F.lit("filter")))


@query(_M + " select mode, qid, vec_id, rank from f")
def candidate_then_topk_modes(spark, sf_dir):
    return modes_of(spark, sf_dir).select("mode", "qid", "vec_id", "rank")


@query(
    _M
    + """, r as (select mode, qid, count(*) as n from f group by 1, 2), k as (select qid, count(*) as n from c group by 1)
select m.mode, avg(coalesce(k.n, 0)) as candidates, avg(coalesce(r.n, 0)) as results, count(*) filter (coalesce(k.n, 0) > 0 and coalesce(r.n, 0) = 0) as filtered_all
from m cross join q left join k on k.qid = q.qid left join r on r.qid = q.qid and r.mode = m.mode group by 1"""
)
def mode_counts(spark, sf_dir):
    """Candidates, results and questions without any left, by mode."""
    found = ranked(spark, sf_dir)
    every = found.withColumn("mode", F.lit("baseline")).unionByName(found.withColumn("mode", F.lit("filter")))
    return evaluate.mode_counts(every, modes_of(spark, sf_dir), vectors(spark, sf_dir)[1].select("qid"), ["mode"])


@query(_M + ", h as (select f.mode, f.qid, min(f.rank) as rank from f join q on q.qid = f.qid where f.label = (q.want + 1) % 10 group by 1, 2) select m.mode, round(avg((coalesce(h.rank, 99) <= 1)::int), 6) as hit_1, round(avg((coalesce(h.rank, 99) <= 5)::int), 6) as hit_5, round(avg(coalesce(1.0 / h.rank, 0)), 6) as mrr, count(*) filter (h.rank is null) as no_results from m cross join q left join h on h.mode = m.mode and h.qid = q.qid group by 1")
def mode_grid(spark, sf_dir):
    """Figures of every mode."""
    rows, questions = vectors(spark, sf_dir)[0], label_questions(spark, sf_dir)
    found = modes_of(spark, sf_dir).join(rows.select("vec_id", F.col("label").cast("string").alias("section"), F.lit("x").alias("source")), "vec_id")
    m = evaluate.metrics(evaluate.ranks(found, questions, ["mode"]), ["mode"])
    return m.select("mode", *(F.round(c, 6).alias(c) for c in ("hit_1", "hit_5", "mrr")), "no_results")


def label_questions(spark, sf_dir) -> DataFrame:
    rows = vectors(spark, sf_dir)[0]
    return rows.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), F.array(((F.col("label") + 1) % 10).cast("string")).alias("expected"), F.lit(None).cast("string").alias("source"))


def label_ranks(spark, sf_dir) -> DataFrame:
    rows = vectors(spark, sf_dir)[0]
    found = ranked(spark, sf_dir).join(rows.select("vec_id", F.col("label").cast("string").alias("section"), F.lit("x").alias("source")), "vec_id")
    return evaluate.ranks(found, label_questions(spark, sf_dir), [])


_R = _V + ", r as (select q.qid, min(c.rank) as rank from q left join c on q.qid = c.qid and c.label = (q.want + 1) % 10 group by q.qid)"


@query(_R + " select qid, rank from r")
def rank_first_hit(spark, sf_dir):
    return label_ranks(spark, sf_dir)


@query(_R + " select round(avg((coalesce(rank, 99) <= 1)::int), 6) as hit_1, round(avg((coalesce(rank, 99) <= 5)::int), 6) as hit_5, round(avg(coalesce(1.0 / rank, 0)), 6) as mrr, count(*) filter (rank is null) as no_results from r")
def hit_mrr(spark, sf_dir):
    m = evaluate.metrics(label_ranks(spark, sf_dir), [])
    return m.select(*(F.round(c, 6).alias(c) for c in ("hit_1", "hit_5", "mrr")), "no_results")


@query("select item_id from benchmark b where not exists (select 1 from documents d where d.source = 'src' || (b.item_id % 30)::varchar)")
def unreachable_anti(spark, sf_dir):
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array(F.concat(F.lit("src"), F.col("item_id") % 30)).alias("expected"), F.lit(None).cast("string").alias("source"))
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("section"), F.lit("x").alias("source"))
    return evaluate.unreachable(questions, chunks).select(F.col("qid").alias("item_id"))


@query('select lang, min(length(text)) as "min", quantile_disc(length(text), 0.5)::bigint as median, quantile_disc(length(text), 0.95)::bigint as p95, max(length(text)) as "max" from documents group by lang')
def length_stats(spark, sf_dir):
    return evaluate.length_stats(table(spark, sf_dir, "documents"), F.length("text"), ["lang"])


@query("with s as (select source as strategy, round(avg(quality), 9) as mrr, round(avg(toxic), 9) as hit_5, count(*) as n from documents join labels using (doc_id) group by source) select strategy, (select max(mrr) - min(mrr) < 1e-9 and max(hit_5) - min(hit_5) < 1e-9 from s) as tie from s order by mrr desc, hit_5 desc, n, strategy desc limit 1")
def best_strategy(spark, sf_dir):
    """A strategy for each source, with shares of labels for its figures."""
    s = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("source").alias("strategy")).agg(F.round(F.avg("quality"), 9).alias("mrr"), F.round(F.avg("toxic"), 9).alias("hit_5"), F.count("*").alias("chunks"))
    return spark.createDataFrame([evaluate.best([r.asDict() for r in s.orderBy("strategy").collect()])], "strategy string, tie boolean")  # a row a strategy


PHRASES = 'вопрос «of the» и „die der“ и «one»'


@query("with h as (select doc_id % 20 as qid, doc_id, (doc_id * 7919 % 1000) / 1000.0::double as score, contains(lower(coalesce(text, '')), 'of the')::int + contains(lower(coalesce(text, '')), 'die der')::int as hits from documents) select qid, doc_id, hits as phrase_hits, row_number() over (partition by qid order by hits desc, score desc, doc_id) as rank from h where score >= 0.2 qualify rank <= 10")
def phrase_rerank(spark, sf_dir):
    """Documents as candidates of twenty queries with made-up scores, in order of the phrases that they hold."""
    found = search.phrases(PHRASES)
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("qid"), "doc_id", (F.col("doc_id") * 7919 % 1000 / 1000).alias("score"), F.coalesce("text", F.lit("")).alias("text"), F.array(*map(F.lit, found)).alias("phrases"))
    return search.finish(rows, ["doc_id"], 10, 0.2).select("qid", "doc_id", "phrase_hits", "rank")


_stores: dict[tuple[str, str], str] = {}


def built(spark: SparkSession, sf_dir: str) -> Store:
    """A store under the warehouse with two strategies, the documents of even and odd ids, the second replaced by those in English; made once a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _stores:
        root = f"{re.sub('^file:/*', '/', spark.conf.get('spark.sql.warehouse.dir'))}/_stores/{uuid.uuid4().hex}"
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        store, docs = Store(spark, root), table(spark, sf_dir, "documents")
        for strategy, rows in (("even", docs.where("doc_id % 2 = 0")), ("odd", docs.where("doc_id % 2 = 1")), ("odd", docs.where("doc_id % 2 = 1 and lang = 'en'"))):
            text, stem = F.coalesce("text", F.lit("")), F.format_string("doc%d", F.col("doc_id"))
            chunks = rows.select(
                chunk_id(F.lit(strategy), stem, F.lit(0)).alias("chunk_id"), F.lit(strategy).alias("strategy"), F.concat(stem, F.lit(".docx")).alias("source"), stem.alias("title"), F.col("lang").alias("section"), F.lit(0).cast("long").alias("ordinal"),
                F.lit(0).cast("long").alias("char_start"), F.length(text).cast("long").alias("char_end"), text.alias("text"), F.lit(False).alias("crosses_section"), F.lit(False).alias("cut_mid_sentence"),
            )
            given = chunks.select("chunk_id", F.lit("counts").alias("model"), F.lit(2).alias("dim"), F.array(F.col("char_end").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
            size = rows.agg(F.count("*").alias("files"), F.sum(F.length(text)).alias("chars")).first()
            store.replace({"strategy": strategy, "model": "counts", "dim": 2, "files": size.files, "chars": size.chars or 0, "chunks": size.files, "embed_ms": 0, "params": chunking.Fixed().params()}, chunks, given)
        _stores[key] = root
    return Store(spark, _stores[key])


_B = "with s as (select case when doc_id % 2 = 0 then 'even' else 'odd' end as strategy, doc_id, coalesce(text, '') as text, lang from documents where doc_id % 2 = 0 or lang = 'en')"


@query(_B + " select strategy, count(*) as chunks from s group by 1")
def chunks_per_strategy(spark, sf_dir):
    return built(spark, sf_dir).chunks_per_strategy()


@query("select 0::bigint as orphans")
def orphan_chunks(spark, sf_dir):
    """None in a store that only replaces whole strategies."""
    return built(spark, sf_dir).orphans().agg(F.count("*").alias("orphans"))


@query("select 'counts' as model, 2 as dim")
def distinct_models(spark, sf_dir):
    return built(spark, sf_dir).models()


@query(_B + " select printf('%s:doc%d:%04d', strategy, doc_id, 0) as chunk_id, 'doc' || doc_id || '.docx' as source, 'counts' as model, length(text)::double as first from s where strategy = 'odd'")
def load_join(spark, sf_dir):
    return built(spark, sf_dir).load("odd").select("chunk_id", "source", "model", F.col("vector")[0].cast("double").alias("first"))


@query(_B + " select printf('%s:doc%d:%04d', strategy, doc_id, 0) as chunk_id, strategy, lang as section, text from s")
def replace_strategy(spark, sf_dir):
    """All chunks after one strategy has been replaced."""
    return built(spark, sf_dir).chunks().select("chunk_id", "strategy", "section", "text")


@query(_B + " select strategy, count(*) as chunks, sum(length(text))::bigint as chars, 'counts' as model from s group by 1")
def build_upsert(spark, sf_dir):
    """The list of builds after that."""
    return spark.createDataFrame([(b["strategy"], b["chunks"], b["chars"], b["model"]) for b in built(spark, sf_dir).builds()], "strategy string, chunks long, chars long, model string")


@query(_B + " select strategy, count(*) as files, 1200::bigint as chunk_size, 'chars' as unit, true as dated from s group by 1")
def status_json(spark, sf_dir):
    """The status tool's answer, with its parameters parsed."""
    status = plain(Engine(spark, str(built(spark, sf_dir).root), HashingProvider(2)).status())
    rows = [(b["strategy"], b["files"], b["params"]["chunk_size"], b["params"]["unit"], len(b["built_at"]) == 19) for b in status["builds"]]
    return spark.createDataFrame(rows, "strategy string, files long, chunk_size long, unit string, dated boolean")


@query("select source as stem, count(*) as n from documents group by source having count(*) > 1")
def duplicate_stems(spark, sf_dir):
    return clashes(table(spark, sf_dir, "documents").select(F.col("source").alias("stem")))


@query(_P + "select count(distinct doc) as files, (sum(length(text) + 1) - count(distinct doc))::bigint as chars from p")
def corpus_size(spark, sf_dir):
    docs = packed_lines(spark, sf_dir)
    return spark.createDataFrame([(docs.count(), check_corpus(docs, 1))], "files long, chars long")


@query("with q as (select item_id, case when item_id % 2 = 0 then '[\"a\",\"' || item_id || '\"]' else 's' || item_id end as raw from benchmark) select item_id, case when raw like '[%' then array_to_string(cast(raw as json)::varchar[], '|') else raw end as expected from q")
def questions_union_type(spark, sf_dir):
    raw = F.when(F.col("item_id") % 2 == 0, F.format_string('["a","%d"]', F.col("item_id"))).otherwise(F.concat(F.lit("s"), F.col("item_id")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(expected_list(raw), "|").alias("expected"))


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as heading from pages")
def html_title_headings(spark, sf_dir):
    pick = lambda tag: F.regexp_extract("html", f"<{tag}>([^<]*)</{tag}>", 1)
    return table(spark, sf_dir, "pages").select("page_id", pick("title").alias("title"), pick("h1").alias("heading"))


@query("select doc_id, regexp_extract('/corpus/' || source || '/doc.' || doc_id || '.docx', '([^/]+)$', 1) as name, 'doc.' || doc_id as stem from documents")
def file_names(spark, sf_dir):
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/doc."), "doc_id", F.lit(".docx"))
    return table(spark, sf_dir, "documents").select("doc_id", paragraphs.file_name(path).alias("name"), paragraphs.file_stem(path).alias("stem"))


@query(_P + "select doc as doc_id, count(*) as paragraphs, sum(length(text))::bigint as chars from p group by doc")
def docx_round_trip(spark, sf_dir):
    """Each document written as a .docx package of its lines and read back."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    def packed(batches):
        for part in batches:
            out = []
            for text in part["text"].fillna(""):
                body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in text.split("\n"))
                blob = io.BytesIO()
                with zipfile.ZipFile(blob, "w") as z:
                    z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>')
                out.append(blob.getvalue())
            yield part.assign(content=out)[["path", "content"]]

    rows = table(spark, sf_dir, "documents").select(F.format_string("/c/%d.docx", "doc_id").alias("path"), "text")
    docs = parse_column(rows.mapInPandas(packed, "path string, content binary"))
    n = F.aggregate("paragraphs", F.lit(0), lambda a, p: a + F.length(p["text"]))
    return docs.where(F.size("paragraphs") > 0).select(F.col("stem").cast("long").alias("doc_id"), F.size("paragraphs").cast("long").alias("paragraphs"), n.cast("long").alias("chars"))


@query(_P + "select doc as doc_id, idx, case when heading is null and idx % 5 = 1 then text || ' | x' else text end as text, heading::int as heading from p")
def docx_levels(spark, sf_dir):
    """Documents written with styles by name, by outline level and by inheritance, and some lines as rows of tables, and read back."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    names = '<w:style w:type="paragraph" w:styleId="a"><w:name w:val="heading 1"/></w:style><w:style w:type="paragraph" w:styleId="b0"><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style>'
    names += '<w:style w:type="paragraph" w:styleId="b"><w:basedOn w:val="b0"/></w:style><w:style w:type="paragraph" w:styleId="c"><w:name w:val="Heading 3"/><w:basedOn w:val="b"/></w:style>'

    def written(i: int, text: str, heading) -> str:
        run = f"<w:r><w:t>{escape(text)}</w:t></w:r>"
        if heading and heading > 0:
            return f'<w:p><w:pPr><w:pStyle w:val="{" abc"[int(heading)]}"/></w:pPr>{run}</w:p>'
        return f"<w:tbl><w:tr><w:tc><w:p>{run}</w:p></w:tc><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl>" if i % 5 == 1 else f"<w:p>{run}</w:p>"

    def packed(batches):
        for part in batches:
            out = []
            for rows in part["paragraphs"]:
                blob = io.BytesIO()
                with zipfile.ZipFile(blob, "w") as z:
                    z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{"".join(written(i, r["text"], r["heading"]) for i, r in enumerate(rows))}</w:body></w:document>')
                    z.writestr("word/styles.xml", f'<w:styles xmlns:w="w">{names}</w:styles>')
                out.append(blob.getvalue())
            yield part.assign(content=out)[["path", "content"]]

    docs = parse_column(packed_lines(spark, sf_dir).select(F.col("source").alias("path"), "paragraphs").mapInPandas(packed, "path string, content binary"))
    return docs.select(F.expr("cast(substring(stem, 4) as long)").alias("doc_id"), F.posexplode("paragraphs").alias("idx", "x")).select("doc_id", "idx", "x.text", F.col("x.heading").cast("int").alias("heading"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
