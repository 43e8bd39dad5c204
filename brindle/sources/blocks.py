"""Documents as flat blocks, and Markdown from them.

A block is (ord, kind, level, text): kind is heading, paragraph, item, code, quote, rule, row, image or page_break; level
is a heading's or a list's depth.  Parsers take (path, content) rows as ``binaryFile`` gives them.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import data_uri, media_by_name, paragraphs

BLOCKS = "array<struct<ord:int,kind:string,level:int,text:string>>"
IMAGES = ("png", "jpg", "jpeg", "webp", "gif")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_SKIP = ("script", "style", "noscript", "template")
_BLOCK = ("p", "div", "section", "article", "header", "footer", "nav", "main", "table", "ul", "ol", "body", "aside", "figure", "form")


class _Html(HTMLParser):
    """Collects blocks; text outside of any block tag is a paragraph."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, str]] = []
        self.kind, self.level, self.text, self.skip, self.lists, self.cells = "paragraph", 0, [], 0, 0, None

    def flush(self) -> None:
        raw = "".join(self.text)
        text = raw.strip("\n") if self.kind == "code" else " ".join(raw.split())
        if text:
            self.blocks.append((self.kind, self.level, text))
        self.kind, self.level, self.text = "paragraph", 0, []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.kind, self.level = "heading", int(tag[1])
        elif tag == "li":
            self.flush()
            self.kind, self.level = "item", max(1, self.lists)
        elif tag in ("pre", "blockquote"):
            self.flush()
            self.kind = "code" if tag == "pre" else "quote"
        elif tag == "hr":
            self.flush()
            self.blocks.append(("rule", 0, ""))
        elif tag == "img":
            self.blocks.append(("image", 0, dict(attrs).get("alt") or dict(attrs).get("src") or ""))
        elif tag == "br":
            self.text.append("\n")
        elif tag == "tr":
            self.flush()
            self.cells = []
        elif tag in ("td", "th"):
            self.text = []
        elif tag in _BLOCK:
            self.flush()
            self.lists += tag in ("ul", "ol")

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append(" ".join("".join(self.text).split()))
            self.text = []
        elif tag == "tr" and self.cells is not None:
            if any(self.cells):
                self.blocks.append(("row", 0, " | ".join(c.replace("|", "\\|") for c in self.cells)))
            self.cells, self.text = None, []
        elif re.fullmatch("h[1-6]", tag) or tag in ("li", "pre", "blockquote") or tag in _BLOCK:
            self.flush()
            if tag in ("ul", "ol"):
                self.lists = max(0, self.lists - 1)

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def html_blocks(html: str | None) -> list[tuple[str, int, str]]:
    p = _Html()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.blocks


def docx_blocks(data: bytes) -> list[tuple[str, int, str]]:
    """Paragraphs by style, list items by numbering, tables by row, page breaks."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    out: list[tuple[str, int, str]] = []

    def text(e) -> str:
        return "".join(x.text or "" if x.tag == _W + "t" else "\t" if x.tag == _W + "tab" else "" for x in e.iter()).strip()

    for e in root.find(_W + "body") or []:
        if e.tag == _W + "tbl":
            out.extend(("row", 0, " | ".join(text(c).replace("|", "\\|") for c in row.findall(_W + "tc"))) for row in e.findall(_W + "tr"))
            continue
        if e.tag != _W + "p":
            continue
        if any(b.get(_W + "type") == "page" for b in e.iter(_W + "br")):
            out.append(("page_break", 0, ""))
        style, number, words = e.find(f"{_W}pPr/{_W}pStyle"), e.find(f"{_W}pPr/{_W}numPr"), text(e)
        name = style.get(_W + "val", "") if style is not None else ""
        head = re.fullmatch(r"[Hh]eading(\d)", name)
        if not words:
            continue
        if head or name == "Title":
            out.append(("heading", min(6, int(head[1])) if head else 1, words))
        elif number is not None:
            level = number.find(_W + "ilvl")
            out.append(("item", 1 + int(level.get(_W + "val", "0")) if level is not None else 1, words))
        else:
            out.append(("quote" if name == "Quote" else "paragraph", 0, words))
    return out


def pptx_blocks(data: bytes) -> list[tuple[str, int, str]]:
    """Slides in order, a page break between them."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out: list[tuple[str, int, str]] = []
    for i, n in enumerate(names):
        if i:
            out.append(("page_break", 0, ""))
        for p in ElementTree.fromstring(z.read(n)).iter(_A + "p"):
            words = "".join(t.text or "" for t in p.iter(_A + "t")).strip()
            if words:
                out.append(("paragraph", 0, words))
    return out


def xlsx_blocks(data: bytes) -> list[tuple[str, int, str]]:
    """Rows of every sheet, shared strings resolved."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(ns + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(ns + "si")]
    out: list[tuple[str, int, str]] = []
    for n in sorted(x for x in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)):
        for row in ElementTree.fromstring(z.read(n)).iter(ns + "row"):
            cells = []
            for c in row.findall(ns + "c"):
                v = c.find(ns + "v")
                raw = "".join(t.text or "" for t in c.iter(ns + "t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                cells.append(shared[int(raw)] if c.get("t") == "s" and raw else raw)
            if any(cells):
                out.append(("row", 0, " | ".join(c.replace("|", "\\|") for c in cells)))
    return out


_BINARY = {"docx": docx_blocks, "pptx": pptx_blocks, "xlsx": xlsx_blocks, "xlsm": xlsx_blocks}


def _numbered(blocks: list[tuple[str, int, str]]) -> list[dict]:
    return [{"ord": i, "kind": k, "level": n, "text": t} for i, (k, n, t) in enumerate(blocks)]


def parse_html(df: DataFrame, column: str = "html") -> DataFrame:
    """``df`` with ``blocks`` in place of the HTML column."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != column)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns=[column]).assign(blocks=[_numbered(html_blocks(h)) for h in pdf[column]])

    return df.mapInPandas(run, f"{schema}, blocks {BLOCKS}")


def text_blocks(text: Column) -> Column:
    """Plain text: a paragraph between blank lines."""
    return F.transform(paragraphs(text), lambda p, i: F.struct(i.alias("ord"), F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), p.alias("text")))


def _stub(name: Column, kind: str) -> Column:
    return F.array(F.struct(F.lit(0).alias("ord"), F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), F.concat(F.lit(f"[{kind}: "), name, F.lit("]")).alias("text")))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, media_type, blocks, error) of every file: text, HTML and office files by their parser, images as data
    URIs, all others as a stub.  PDF and the old binary spreadsheets need packages that are not here and are stubs too."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    end = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rows = files.select("path", "content", end.alias("ending"), media_by_name(F.col("path")).alias("media_type"))
    schema = f"path string, media_type string, blocks {BLOCKS}, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            blocks, errors = [], []
            for e, data in zip(pdf["ending"], pdf["content"], strict=True):
                try:
                    blocks.append(_numbered(html_blocks(bytes(data).decode("utf-8", "replace")) if e in ("html", "htm") else _BINARY[e](bytes(data))))
                    errors.append(None)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError) as x:
                    blocks.append([])
                    errors.append(f"{type(x).__name__}: {x}")
            yield pd.DataFrame({"path": pdf["path"], "media_type": pdf["media_type"], "blocks": blocks, "error": errors})

    parsed = rows.filter(F.col("ending").isin("html", "htm", *_BINARY)).select("path", "media_type", "ending", "content").mapInPandas(run, schema)
    none = F.lit(None).cast("string").alias("error")
    name = F.element_at(F.split("path", "/"), -1)
    plain = rows.filter(F.col("ending").isin("txt", "log", "md")).select("path", "media_type", text_blocks(F.decode("content", "UTF-8")).cast(BLOCKS).alias("blocks"), none)
    image = rows.filter(F.col("ending").isin(*IMAGES)).select(
        "path", "media_type", F.array(F.struct(F.lit(0).alias("ord"), F.lit("image").alias("kind"), F.lit(0).alias("level"), data_uri(F.col("media_type"), F.col("content")).alias("text"))).cast(BLOCKS).alias("blocks"), none)
    other = rows.filter(~F.col("ending").isin("html", "htm", "txt", "log", "md", *_BINARY, *IMAGES)).select("path", "media_type", _stub(name, "unsupported").cast(BLOCKS).alias("blocks"), none)
    return parsed.unionByName(plain).unionByName(image).unionByName(other)


def markdown(blocks: Column) -> Column:
    """Markdown of a block array, blocks in order with a blank line between them."""

    def one(b: Column) -> Column:
        k, n, t = b["kind"], b["level"], b["text"]
        return (
            F.when(k == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(n, F.lit(6)))), F.lit(" "), t))
            .when(k == "item", F.concat(F.repeat(F.lit("  "), F.greatest(n - 1, F.lit(0))), F.lit("- "), t)).when(k == "code", F.concat(F.lit("```\n"), t, F.lit("\n```")))
            .when(k == "quote", F.concat(F.lit("> "), F.replace(t, F.lit("\n"), F.lit("\n> ")))).when(k == "rule", "---").when(k == "page_break", "---")
            .when(k == "row", F.concat(F.lit("| "), t, F.lit(" |"))).when(k == "image", F.concat(F.lit("!["), t, F.lit("]()"))).otherwise(t)
        )

    return F.array_join(F.transform(F.array_sort(blocks), one), "\n\n")
