"""Reading .docx: a scan of binary files and a parser of the package's XML, one file a row."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.operators.paragraphs import file_stem
from inkfathom.schemas import DEFAULTS, WHITE

#: Style names that mean a heading, in lower case, followed by its level.
HEADING_NAMES = ("heading ", "заголовок ")
W = "w:"
_SPACES = re.compile(f"[{WHITE}]+")


class DocxError(ValueError):
    pass


def squeezed(text: str) -> str:
    return _SPACES.sub(" ", text).strip(" ")


def level_of_name(name: str) -> int | None:
    low = name.lower()
    for prefix in HEADING_NAMES:
        if low.startswith(prefix) and re.fullmatch(r"\+?\d+", rest := low[len(prefix) :].strip()) and 1 <= int(rest) <= 9:
            return int(rest)
    return None


def level_of_outline(value: str | None) -> int | None:
    return int(value) + 1 if value and re.fullmatch(r"\+?\d{1,3}", value) and int(value) < 9 else None


def _walk(xml: str, start, end=lambda name: None, text=lambda data: None) -> None:
    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, text
    p.Parse(xml, True)


def parse_styles(xml: str) -> dict[str, int]:
    """Heading level by style id: of its name, else its outline level, else of the style it is based on (32 steps at most)."""
    styles: dict[str, dict] = {}
    now: list[dict | None] = [None]

    def start(name, attr):
        if name == "w:style":
            now[0] = None
            if attr.get("w:type") == "paragraph" and attr.get("w:styleId"):
                now[0] = styles.setdefault(attr["w:styleId"], {})
        elif now[0] is not None and name in ("w:name", "w:basedOn", "w:outlineLvl"):
            now[0][name] = attr.get("w:val", "")

    def end(name):
        if name == "w:style":
            now[0] = None

    _walk(xml, start, end)
    out = {}
    for ident in styles:
        at, hops = ident, 0
        while at in styles and hops < 32:
            level = level_of_name(styles[at].get("w:name", "")) or level_of_outline(styles[at].get("w:outlineLvl"))
            if level:
                out[ident] = level
                break
            at, hops = styles[at].get("w:basedOn"), hops + 1
    return out


def parse_title(xml: str) -> str | None:
    inside, parts = [0], []

    def start(name, _):
        inside[0] += name.rpartition(":")[2] == "title"

    def end(name):
        inside[0] -= name.rpartition(":")[2] == "title"

    _walk(xml, start, end, lambda d: parts.append(d) if inside[0] else None)
    return squeezed("".join(parts)) or None


class _Body:
    """Paragraphs of a body, with table rows as one each; skips fallback and moved-away content."""

    def __init__(self, styles: dict[str, int]):
        self.styles, self.out = styles, []
        self.skipped = self.tables = self.rows = self.deep = 0
        self.in_properties = self.in_text = False
        self.parts: list[str] = []
        self.style = self.outline = None
        self.cells: list[list[str]] = []

    def start(self, name, attr):
        if self.skipped or name in ("mc:Fallback", "w:moveFrom"):
            self.skipped += name in ("mc:Fallback", "w:moveFrom")
        elif name == "w:tbl":
            self.tables += 1
        elif name == "w:tr" and self.tables == 1:
            self.cells = []
        elif name == "w:tc" and self.tables == 1:
            self.cells.append([])
        elif name == "w:p":
            self.deep += 1
            if self.deep == 1:
                self.parts, self.style, self.outline = [], None, None
        elif name == "w:pPr":
            self.in_properties = True
        elif name == "w:t":
            self.in_text = True
        elif self.in_properties:
            if self.deep == 1 and name == "w:pStyle":
                self.style = self.styles.get(attr.get("w:val", ""))
            elif self.deep == 1 and name == "w:outlineLvl":
                self.outline = level_of_outline(attr.get("w:val"))
        elif self.deep and name in ("w:tab", "w:br", "w:cr"):
            self.parts.append(" ")
        elif self.deep and name == "w:noBreakHyphen":
            self.parts.append("-")

    def end(self, name):
        if self.skipped:
            self.skipped -= name in ("mc:Fallback", "w:moveFrom")
        elif name == "w:tbl":
            self.tables -= 1
        elif name == "w:tr" and self.tables == 1:
            cells = [squeezed(" ".join(c)) for c in self.cells]
            if any(cells):
                self.out.append((" | ".join(cells), None))
        elif name == "w:pPr":
            self.in_properties = False
        elif name == "w:t":
            self.in_text = False
        elif name == "w:p" and self.deep:
            self.deep -= 1
            if self.deep == 0:
                text = squeezed("".join(self.parts))
                if self.tables:
                    if self.cells and text:
                        self.cells[-1].append(text)
                elif text:
                    self.out.append((text, self.outline or self.style))

    def text(self, data):
        if self.in_text and self.deep and not self.skipped:
            self.parts.append(data)


def parse_body(xml: str, styles: dict[str, int]) -> list[tuple[str, int | None]]:
    body = _Body(styles)
    _walk(xml, body.start, body.end, body.text)
    return body.out


def _part(package: zipfile.ZipFile, name: str) -> str | None:
    try:
        return package.read(name).decode("utf-8")
    except KeyError:
        return None


def read_docx(content: bytes, name: str = "document") -> tuple[str | None, list[tuple[str, int | None]]]:
    """Title (none if there is none) and paragraphs of a package; DocxError names the file."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            body = _part(package, "word/document.xml")
            if body is None:
                raise DocxError(f"{name}: no word/document.xml")
            styles, core = _part(package, "word/styles.xml"), _part(package, "docProps/core.xml")
            return parse_title(core) if core else None, parse_body(body, parse_styles(styles) if styles else {})
    except (zipfile.BadZipFile, UnicodeDecodeError, expat.ExpatError) as e:
        raise DocxError(f"{name}: {e}") from e


def collect(root: str | Path) -> list[str]:
    """Paths of the .docx files below a folder, sorted; hidden entries and lock files are left out."""
    root = Path(root)
    if not root.is_dir():
        raise NotADirectoryError(f"{root} is not a folder")
    found = []
    for p in root.rglob("*"):
        inner = p.relative_to(root).parts
        if p.is_file() and not any(x.startswith(".") for x in inner) and p.name.lower().endswith(".docx") and not p.name.startswith("~$"):
            found.append(str(p))
    return sorted(found)


def parse_column(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """source, stem, title and paragraphs of each file."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [read_docx(c, p) for p, c in zip(batch["path"], batch["content"])]
            yield pd.DataFrame({"source": batch["path"], "title": [t for t, _ in done], "paragraphs": [[{"text": x, "heading": h} for x, h in p] for _, p in done]})

    made = files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(parse, "source string, title string, paragraphs array<struct<text:string,heading:tinyint>>")
    return made.select("source", file_stem(F.col("source")).alias("stem"), F.coalesce("title", file_stem(F.col("source"))).alias("title"), "paragraphs")


def read_folder(spark: SparkSession, root: str | Path, min_chars: int | None = DEFAULTS.min_chars) -> DataFrame:
    """The corpus of a folder: some file, and, but for min_chars None, unique stems and at least min_chars characters."""
    paths = collect(root)
    if not paths:
        raise ValueError(f"no .docx files in {root}")
    hidden, shown = [p for p in paths if "/_" in p], [p for p in paths if "/_" not in p]  # Spark's reader passes over names that begin so

    def opened(batches):
        for part in batches:
            yield pd.DataFrame({"path": part["path"], "content": [Path(p).read_bytes() for p in part["path"]]})

    files = spark.createDataFrame([(p,) for p in hidden], "path string").mapInPandas(opened, "path string, content binary")
    if shown:
        files = files.union(spark.read.format("binaryFile").load(shown).select(F.regexp_replace("path", "^file:/*", "/"), "content"))
    docs = parse_column(files)
    if min_chars is not None:
        check_corpus(docs, min_chars)
    return docs


def char_len(paragraphs):
    n = F.size(paragraphs)
    return F.aggregate(paragraphs, F.lit(0), lambda a, p: a + F.length(p["text"])) + F.greatest(n - 1, F.lit(0))


def clashes(docs: DataFrame) -> DataFrame:
    """stem and n of those that several files share."""
    return docs.groupBy("stem").agg(F.count("*").alias("n")).where("n > 1")


def check_corpus(docs: DataFrame, min_chars: int = DEFAULTS.min_chars) -> int:
    """Characters of the corpus; raises if stems clash or there are too few."""
    clash = clashes(docs).orderBy("stem").limit(5).collect()
    if clash:
        raise ValueError("files share a name: " + ", ".join(r.stem for r in clash))
    chars = docs.agg(F.sum(char_len(F.col("paragraphs")))).first()[0] or 0
    if chars < min_chars:
        raise ValueError(f"the corpus has {chars} characters; at least {min_chars} are needed")
    return chars
