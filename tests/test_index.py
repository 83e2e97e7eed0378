import io
import json
import zipfile

import duckdb
import numpy as np
import pytest

from inkfathom.functions.embed import ContextOverflow, HashingProvider, HttpProvider, decode_vector, embed_texts, encode_vector, normalise
from inkfathom.functions.units import Measure, WordPiece, check_budget
from inkfathom.operators import search
from inkfathom.operators.chunking import Document, Fixed, Structure, chunk_rows, register, select
from inkfathom.operators.evaluate import best, length_stats, metrics, ranks, unreachable
from inkfathom.plans import queries
from inkfathom.service import Engine, call, main, serve
from inkfathom.sources.docx import DocxError, collect, parse_styles, read_docx
from inkfathom.sources.models import ModelServer
from inkfathom.sources.questions import load_questions
from inkfathom.sources.store import Store

BODY = "A river runs past the mill and on to the sea. "
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body: str, styles: str = "", title: str | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}" xmlns:mc="mc"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}">{styles}</w:styles>')
        z.writestr("word/footnotes.xml", "<x>not this</x>")
        if title is not None:
            z.writestr("docProps/core.xml", f'<c:p xmlns:c="c" xmlns:dc="dc"><dc:title>{title}</dc:title></c:p>')
    return out.getvalue()


def p(text: str, style: str = "") -> str:
    props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{props}<w:r><w:t>{text}</w:t></w:r></w:p>"


STYLES = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="heading {i}"/></w:style>' for i in (1, 2, 3))


def test_docx_headings_tables_and_skipped_parts():
    body = p("One", "1") + p(" a  b ") + "<w:tbl><w:tr><w:tc>" + p("x") + "</w:tc><w:tc>" + p("y &amp; z") + "</w:tc></w:tr><w:tr><w:tc>" + p("") + "</w:tc></w:tr></w:tbl>"
    body += '<w:p><w:r><w:t>kept</w:t><w:tab/><w:noBreakHyphen/></w:r><w:moveFrom><w:r><w:t>moved</w:t></w:r></w:moveFrom><mc:Fallback><w:t>old</w:t></mc:Fallback></w:p>'
    title, got = read_docx(docx(body, STYLES, "  The  Title "))
    assert title == "The Title"
    assert got == [("One", 1), ("a b", None), ("x | y & z", None), ("kept -", None)]
    assert read_docx(docx(p("x"), title=" "))[0] is None
    with pytest.raises(DocxError, match="bad.docx"):
        read_docx(b"no package", "bad.docx")


def test_style_levels_inherit():
    s = '<w:style w:type="paragraph" w:styleId="a"><w:pPr><w:outlineLvl w:val="2"/></w:pPr></w:style><w:style w:type="paragraph" w:styleId="b"><w:basedOn w:val="a"/></w:style>'
    s += '<w:style w:type="paragraph" w:styleId="c"><w:name w:val="Заголовок 2"/></w:style><w:style w:type="character" w:styleId="d"><w:name w:val="heading 1"/></w:style><w:style w:type="paragraph" w:styleId="e"><w:basedOn w:val="e"/></w:style>'
    assert parse_styles(f'<w:styles xmlns:w="{W}">{s}</w:styles>') == {"a": 3, "b": 3, "c": 2}


def test_collect_leaves_out_hidden_and_lock_files(tmp_path):
    for name in ("b.docx", "A.DOCX", "~$b.docx", ".h.docx", "x.txt", ".d/c.docx", "s/_u.docx"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    assert [x[len(str(tmp_path)) + 1 :] for x in collect(tmp_path)] == ["A.DOCX", "b.docx", "s/_u.docx"]
    with pytest.raises(NotADirectoryError):
        collect(tmp_path / "none")


def test_boundaries():
    doc = Document([("First one here. Second one follows on. End", None), ("Next", None)])
    assert doc.find_break(40, 40) is None
    doc = Document([("A", 1), ("text", None), ("B", 2), ("more", None), ("C", 1), ("last", None)])
    assert [x.section for x in doc.paragraphs] == ["A", "A", "A > B", "A > B", "C", "C"]
    assert not doc.crosses_section(0, 12) and doc.crosses_section(8, doc.n) and doc.section_at(3) == "A"
    doc = Document([("Ab. Cd e", None), ("F", None)])
    assert [doc.cut_mid_sentence(0, e) for e in (5, 3, 8, doc.n)] == [True, False, False, False]


def test_fixed_chunks_cover_and_overlap():
    doc = Document([("One", 1), ((BODY * 30).strip(), None), ("Two", 2), ((BODY * 30).strip(), None)])
    got = Fixed(300, 50).chunk(doc)
    assert len(got) > 5 and all(c.end - c.start <= 300 for c in got) and got[0].start == 0 and got[-1].end == doc.n
    assert all(b.start < a.end for a, b in zip(got, got[1:])) and not any(doc.cut_mid_sentence(c.start, c.end) for c in got)
    words = Document([(" ".join(["word"] * 100), None)])
    assert all(set(c.text.split()) == {"word"} for c in Fixed(100, 20).chunk(words))
    for size, overlap in ((1200, 600), (7, 1)):
        with pytest.raises(ValueError):
            Fixed(size, overlap)


def test_structure_chunks():
    body = (BODY * 6).strip()
    assert [c.section for c in Structure(3000, 200).chunk(Document([("A", 1), (body, None), ("B", 1), (body, None)]))] == ["A", "B"]
    assert [c.section for c in Structure(3000, 200).chunk(Document([("A", 1), (body, None), ("B", 2), (body, None)]))] == ["A"]
    long = Structure(1000, 200).chunk(Document([("A", 1), *[(body, None)] * 8]))
    assert len(long) >= 3 and all(len(c.text) <= 1000 and c.text.startswith("A\n") for c in long)
    big = (BODY * 40).strip()
    assert [c.section for c in Structure(3000, 200).chunk(Document([("A", 1), ("tiny", None), ("B", 2), (big, None), ("C", 2), (big, None)]))] == ["A > B", "A > C"]
    cut = Structure(1000, 200).chunk(Document([("A", 1), ((BODY * 100).strip(), None)]))
    assert len(cut) >= 4 and all(c.text.endswith(".") for c in cut)
    assert Structure(600, 100).chunk(Document([(body, None), ("A", 1), (big, None)]))[0].section == ""
    assert Structure().chunk(Document([])) == [] and Fixed().chunk(Document([])) == []
    with pytest.raises(ValueError):
        select("other")


def test_units():
    m = Measure([0, 1, 1, 1, 2, 2, 3])
    assert (m.length(0, 6), m.advance(0, 1), m.advance(0, 2), m.advance(0, 10), m.advance(4, 0), m.retreat(6, 1), m.retreat(6, 2), m.retreat(6, 10)) == (3, 3, 5, 6, 5, 4, 1, 0)
    w = WordPiece(["▁hel", "lo", "▁wor", "ld", "▁,", "▁.", "▁cafe"])
    assert (w.count("Hello, world."), w.count("café"), w.count("zzz"), w.count("helzz"), w.measure("Hello, world.").length(0, 6)) == (6, 1, 1, 1, 3)
    b = WordPiece(["[UNK]", "head", "##tail"])
    assert (b.count("headtail"), b.count("tail")) == (2, 1)
    with pytest.raises(ValueError):
        WordPiece([])
    with pytest.raises(ValueError):
        check_budget(b, [2047], "", 2048)


def test_embedding():
    one = HashingProvider(64)
    a, b = embed_texts(one, ["river mill sea", "river mill town"], batch=1)
    assert abs(np.linalg.norm(a) - 1) < 1e-12 and a @ b > 0.5
    assert np.allclose(normalise([3, 4]), [0.6, 0.8]) and encode_vector([1.0]) == b"\x00\x00\x80\x3f" and decode_vector(b"\x00\x00\x80\x3f")[0] == 1
    for bad in (lambda: normalise([0, 0]), lambda: decode_vector(b"abc"), lambda: embed_texts(one, ["x"], batch=0)):
        with pytest.raises(ValueError):
            bad()
    sent = []

    def opener(request, timeout):
        sent.append(json.loads(request.data))
        texts = sent[-1]["input"]
        if any("long" in t for t in texts):
            import urllib.error

            raise urllib.error.HTTPError("u", 400, "bad", {}, io.BytesIO(b'{"error":"input exceeds the context length"}'))
        return io.BytesIO(json.dumps({"embeddings": [[3, 4]] * len(texts)}).encode())

    http = HttpProvider(dim=2, opener=opener)
    assert len(embed_texts(http, list("abcde"), 2, "p: ")) == 5 and [len(s["input"]) for s in sent] == [2, 2, 1] and sent[0]["input"][0] == "p: a"
    with pytest.raises(ContextOverflow) as e:
        embed_texts(http, ["a", "b", "c", "long"], 2)
    assert e.value.index == 3
    with pytest.raises(ValueError):
        embed_texts(HttpProvider(dim=3, opener=opener), ["a"])


def test_search(spark):
    chunks = spark.createDataFrame([("a", 0, [0.0, 1.0], "x"), ("a", 1, [0.9, 0.1], "of the sea"), ("a", 2, [0.9, 0.1], "y"), ("a", 3, [1.0, 0.0], "z")], "source string, ordinal int, vector array<double>, text string")
    asked = spark.createDataFrame([(0, [1.0, 0.0], ["of the"])], "qid int, query_vector array<double>, phrases array<string>")
    for method in ("expr", "matmul"):
        plain = search.retrieve(asked.drop("phrases"), chunks, top_k=2, threshold=0.5, method=method).orderBy("rank").collect()
        assert [r.ordinal for r in plain] == [3, 1]
        assert [r.ordinal for r in search.retrieve(asked, chunks, top_k=2, method=method).orderBy("rank").collect()] == [1, 3]
    assert search.retrieve(asked, chunks, threshold=1.0, rerank=False).count() == 1
    assert search.phrases("«of the» and „one“ and \"a b\"") == ["of the"] and search.phrases('"a b"', straight_quotes=True) == ["a b"]
    for bad in ((0, 1, None), (1, 0, None), (1, 1, 2)):
        with pytest.raises(ValueError):
            search.validate(*bad)
    assert search.clean_rewrite("\n`Запрос:Запрос: river mill`\nmore") == "river mill" and search.clean_rewrite("Query: x") == "Query: x"
    assert search.rewritten("q", lambda q: " ")[0] == "q"


def test_evaluation(spark):
    questions = spark.createDataFrame([(0, ["A"], None), (1, ["B", "C"], "f.docx"), (2, ["Z"], None)], "qid int, expected array<string>, source string")
    found = spark.createDataFrame([("s", 0, 1, "A", "/f.docx"), ("s", 1, 1, "A", "/f.docx"), ("s", 1, 2, "C", "/d/f.docx"), ("s", 2, 1, "A", "/f.docx")], "strategy string, qid int, rank int, section string, source string")
    got = ranks(found, questions, ["strategy"])
    assert {r.qid: r["rank"] for r in got.collect()} == {0: 1, 1: 2, 2: None}
    m = metrics(got, ["strategy"]).first()
    assert (round(m.hit_1, 4), round(m.hit_5, 4), m.mrr, m.no_results) == (0.3333, 0.6667, 0.5, 1)
    assert [r.qid for r in unreachable(questions, found).collect()] == [2]
    stats = length_stats(spark.range(1, 101), __import__("pyspark").sql.functions.col("id")).first()
    assert tuple(stats) == (1, 50, 95, 100) and tuple(length_stats(spark.range(0), __import__("pyspark").sql.functions.col("id")).first()) == (0, 0, 0, 0)
    assert best([{"strategy": "a", "mrr": 1.0, "hit_5": 1.0, "chunks": 2}, {"strategy": "b", "mrr": 1.0, "hit_5": 1.0, "chunks": 2}]) == ("b", True)


def test_build_search_compare(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, words in (("one", ("river", "mill")), ("two", ("tower", "harbour"))):
        body = "".join(p(w.title(), "1") + p(f"The {w} stands near the old {w} road. " * 40) for w in words)
        (tmp_path / "in" / f"{name}.docx").write_bytes(docx(body, STYLES))
    ask = tmp_path / "q.json"
    ask.write_text(json.dumps([{"question": "where is the river", "expected_section": "River"}, {"question": "old harbour road", "expected_section": ["Harbour", "Port"], "source": "two.docx"}]))
    engine = Engine(spark, str(tmp_path / "db"), HashingProvider(256))
    assert engine.status() == {"exists": False, "builds": []} and not (tmp_path / "db").exists()
    assert call(engine, "index_search", {"query": "river"})["is_error"]
    with pytest.raises(ValueError, match="characters"):
        engine.build(str(tmp_path / "in"))
    engine.build(str(tmp_path / "in"), chunk_size=600, overlap=100, min_chars=1000)
    ids = {r.chunk_id for r in engine.store.chunks().collect()}
    engine.build(str(tmp_path / "in"), "fixed", chunk_size=600, overlap=100, min_chars=1000)
    assert ids == {r.chunk_id for r in engine.store.chunks().collect()} and engine.store.orphans().count() == 0
    assert [b["strategy"] for b in engine.status()["builds"]] == ["fixed", "structure"]
    hits = engine.search("the river", "structure", top_k=2)["hits"]
    assert hits[0]["section"] == "River"
    with pytest.raises(ValueError, match="several"):
        engine.search("river")
    with pytest.raises(ValueError, match="built with"):
        Engine(spark, engine.root, HashingProvider(256, "other")).search("river", "fixed")
    out = engine.compare(str(ask), str(tmp_path / "r" / "report.md"))
    assert all(t["mrr"] == 1.0 and t["unreachable"] == 0 for t in out["table"]) and len(out["modes"]) == 8 and (tmp_path / "r" / "report.md").read_text().startswith("# ")
    twice = engine.store.chunks("fixed").union(engine.store.chunks("fixed"))
    with pytest.raises(ValueError):
        engine.store.replace({"strategy": "fixed"}, twice, engine.store.embeddings("fixed").drop("strategy"))
    assert ids == {r.chunk_id for r in engine.store.chunks().collect()}
    answers = io.StringIO()
    serve(engine, ['{"jsonrpc":"2.0","id":1,"method":"initialize"}', '{"id":2,"method":"tools/list"}', '{"id":3,"method":"tools/call","params":{"name":"index_status"}}', '{"id":4,"method":"x"}'], answers)
    lines = [json.loads(x) for x in answers.getvalue().splitlines()]
    assert len(lines[1]["result"]["tools"]) == 5 and not lines[2]["result"]["isError"] and "error" in lines[3]


def test_questions(spark, tmp_path):
    for text in ("[]", "{", '[{"question": "x"}]'):
        (tmp_path / "q.json").write_text(text)
        with pytest.raises(ValueError):
            load_questions(spark, tmp_path / "q.json")


def test_chunks_hold_over_documents(spark):
    from inkfathom.plans.queries import packed_lines

    docs = packed_lines(spark, "/root/testdata/sf0.001")
    for chunker in (Fixed(), Structure()):
        rows = chunk_rows(docs, chunker).toPandas()
        assert rows.chunk_id.is_unique and (rows.text.str.len() > 0).all() and (rows.char_start < rows.char_end).all()
        assert (rows.groupby("source").ordinal.max() + 1 == rows.groupby("source").size()).all()


@pytest.mark.parametrize("gone", ["inkfathom.llm", "corpus_pipeline", "tiktoken"])
def test_entry_without_training_operators(gone):
    """Without that subpackage, the pipeline or a package that it needs, the other queries are there."""
    import subprocess
    import sys

    code = f"import sys; sys.path.insert(0, '.'); sys.modules[{gone!r}] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_many_queries_and_odd_vectors(spark, monkeypatch):
    """Blocks of queries in one pass, vectors of unequal length, without a value or with one that is not a number: as the other form says."""
    rng = np.random.default_rng(5)
    vector = lambda i: None if i % 11 == 0 else [float("nan")] * 3 if i % 13 == 0 else rng.normal(size=3 if i % 3 else 2).tolist()
    chunks = spark.createDataFrame([(i, vector(i)) for i in range(60)], "at int, vector array<double>")
    asked = spark.createDataFrame([(i, vector(i + 1)) for i in range(25)], "qid int, query_vector array<double>")
    rows = lambda how: sorted((r.qid, r.at, r["rank"], str(round(r.score, 9))) for r in search.candidates(asked, chunks, 4, ["at"], how).collect())
    plain = rows("expr")
    monkeypatch.setattr(search, "BLOCK", 7)
    assert rows("matmul") == plain == rows("expr") and len(plain) == 4 * 23
    assert search.candidates(asked.limit(0), chunks, 4, ["at"]).count() == 0


def test_model_server_and_tools(spark, tmp_path):
    """Catalogue, dimension, vocabulary, chat and errors of a model server, and tools called by their argument names."""
    import urllib.error

    shown = {"a": {"capabilities": ["embedding"], "model_info": {"x.embedding_length": 3, "x.context_length": 9, "tokenizer.ggml.model": "bert", "tokenizer.ggml.tokens": ["[UNK]", "hi", "##gh"]}}, "b": {"capabilities": ["completion"]}, "c": None, "d": {"capabilities": ["embedding"]}}
    chats, seen = iter([{"message": {"content": "Запрос: one"}}, {"response": "two"}, {}]), []

    def opener(request, timeout):
        body = json.loads(request.data) if request.data else None
        seen.append((request.full_url.rsplit("/api/", 1)[1], body))
        what = seen[-1][0]
        if what == "show" and shown[body["model"]] is None:
            raise urllib.error.HTTPError("u", 404, "none", {}, io.BytesIO(b"no model"))
        answer = {"tags": lambda: {"models": [{"name": n, "size": 7} for n in "dcba"]}, "show": lambda: shown[body["model"]], "chat": lambda: next(chats), "embed": lambda: {"embeddings": [[1.0, 2.0, 2.0, 0.0][: 3 if body["model"] == "a" else 4] for _ in body["input"]]}}[what]()
        return io.BytesIO(json.dumps(answer).encode())

    server = ModelServer("http://h:1/", opener)
    assert [tuple(r) for r in server.embedding_models(spark).collect()] == [("a", 3, 9, 7), ("d", None, None, 7)]
    assert server.dim("a", None) == 3 and server.dim("d", lambda text: [0] * 4) == 4 and server.word_pieces("a").count("high") == 2
    assert (server.rewrite("m", "i", "q"), server.rewrite("m", "i", "q")) == ("Запрос: one", "two") and search.clean_rewrite("Запрос: one") == "one"
    with pytest.raises(ValueError, match="no text"):
        server.rewrite("m", "i", "q")
    with pytest.raises(ValueError, match="404"):
        server.show("c")
    with pytest.raises(ValueError, match="kind None"):
        server.word_pieces("d")
    engine = Engine(spark, str(tmp_path / "db"), HttpProvider("http://h:1", "a", 3, opener=opener), server)
    assert engine.provider_for("d").dim == 4 and engine.provider_for("d", 8).dim == 8 and engine.provider_for() is engine.provider and [m["name"] for m in engine.models()] == ["a", "d"]
    answers = io.StringIO()
    ask = lambda tool, **arguments: json.dumps({"id": 1, "method": "tools/call", "params": {"name": tool, "arguments": arguments}})
    serve(engine, ["{broken", "[1]", ask("index_search", query="x", similarity_threshold=0.5, top_k=99), ask("index_build", input=str(tmp_path / "none"), model="d", batch=2, num_ctx=64), ask("index_compare", questions="q", out="o", rewrite_model="m"), json.dumps({"id": 2, "method": "tools/list"})], answers)
    lines = [json.loads(x) for x in answers.getvalue().splitlines()]
    assert [x.get("error", {}).get("code") for x in lines[:2]] == [-32700, -32700] and all(x["result"]["isError"] for x in lines[2:5])
    assert [x["result"]["content"][0]["text"].split()[0] for x in lines[2:5]] == ["top_k", lines[3]["result"]["content"][0]["text"].split()[0], "the"]
    tools = {t["name"]: t["inputSchema"] for t in lines[5]["result"]["tools"]}
    assert tools["index_build"]["required"] == ["input"] and {"model", "dim", "num_ctx", "batch", "unit"} <= set(tools["index_build"]["properties"]) and "rewrite_model" in tools["index_compare"]["properties"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "_one.docx").write_bytes(docx(p("River", "1") + p("The river stands near the old road. " * 40), STYLES))
    (tmp_path / "in" / "two.docx").write_bytes(docx(p("Mill", "1") + p("The mill is by the harbour. " * 40), STYLES))
    common = ["--db", str(tmp_path / "db"), "--offline", "--dim", "64"]
    main(["build", str(tmp_path / "in"), "--min-chars", "100", "--batch", "4", *common])
    (tmp_path / "q.json").write_text(json.dumps([{"question": "old river road", "expected_section": "River", "source": "_one.docx"}]))
    main(["compare", str(tmp_path / "q.json"), "--top-k", "3", "--similarity-threshold", "0.1", *common])
    said = capsys.readouterr().out
    assert "fixed: 2 files" in said and "structure: 2 files" in said and "# " in said
    store = Store(spark, tmp_path / "db")
    assert [b["built_at"][4] for b in store.builds()] == ["-", "-"] and {tuple(r) for r in store.models().collect()} == {("hashing-bow", 64)}
    with pytest.raises(ValueError, match="built with"):
        Engine(spark, str(tmp_path / "db"), HashingProvider(64, "x")).compare(str(tmp_path / "q.json"))


def test_table_functions(spark):
    register(spark)
    text = "\n".join(["First line here. It goes on.", "  ", "Second line of some length, with words."] * 3)
    lines = [" ".join(x.split()) for x in text.split("\n") if x.strip()]
    doc = Document([(x, None) for x in lines])
    for sql, chunker in (("fixed_chunks(text, 40, 8)", Fixed(40, 8)), ("structure_chunks(text, 60, 10)", Structure(60, 10))):
        got = spark.createDataFrame([(text,)], "text string").createOrReplaceTempView("one") or spark.sql(f"select c.* from one, lateral {sql} c order by ordinal").collect()
        assert [(r.char_start, r.char_end, r.chunk) for r in got] == [(c.start, c.end, c.text) for c in chunker.chunk(doc)] and len(got) > 2


def test_units_over_odd_text():
    """Against the rule said character by character."""
    import unicodedata

    w = WordPiece(["▁a", "b", "▁é", "▁e", "c", "▁漢", "▁!", "▁i"])

    def plain(text):
        words, now = [], ""
        for char in text:
            for c in unicodedata.normalize("NFD", char):
                if c in "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" or 0x2000 <= ord(c) <= 0x200A:
                    words, now = [*words, now], ""
                elif unicodedata.category(c)[0] == "M" or unicodedata.category(c) == "Cc" or c == "\ufffd":
                    continue
                elif c in "!«»-" or 0x4E00 <= ord(c) <= 0x9FFF:
                    words, now = [*words, now, c], ""
                else:
                    now += c.lower()
        return [x for x in [*words, now] if x]

    import random

    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["a", "B", "é", "e\u0301", "\u0301", " ", "\u2003", "\x1c", "\x85", "漢", "!", "«", "İ", "ß", "\ufffd", "\x00", "c", "Σ"]) for _ in range(rng.randint(0, 14)))
        assert [x for _, x in w.words(text)] == plain(text) and w.count(text) == sum(map(w.word_tokens, plain(text))) == w.measure(text).length(0, len(text))


def test_normalised_vectors_equal_the_sql_to_the_bit(spark, tmp_path):
    """Small negative numbers round to a zero that keeps its sign."""
    rng = np.random.default_rng(4)
    wide = rng.normal(size=(300, 8)) * 10.0 ** rng.integers(-9, 1, (300, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*wide, [1, -1e-8, 1e-8, -0.0, 0.0, 0.0078125, -0.0078125, -4e-7]])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: np.array(r.vector).tobytes() for r in queries.QUERIES["l2_normalize"](spark, str(tmp_path)).collect()}
    sql = queries.SQL["l2_normalize"].replace("from embeddings", f"from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {i: np.array(v).tobytes() for i, v in duckdb.sql(sql).fetchall()}
    assert got == want and len(got) == len(rows)
