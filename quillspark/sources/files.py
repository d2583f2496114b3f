"""Document files: scan, namespaces, incremental manifests, plain-text, Markdown and HTML elements."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import decoded, non_empty, strip
from quillspark.tables import bounded_batches

# fixed values: the file kinds that are scanned
EXTENSIONS = ("pdf", "docx", "md", "txt", "html", "png", "jpg", "jpeg")

ELEMENT = "doc_id long, pos int, category string, depth int, text string"


def scan(spark: SparkSession, root: str, extensions=EXTENSIONS) -> DataFrame:
    """All files below ``root`` with these extensions (any case): path, content, modificationTime, sha256, source_name."""
    any_case = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    pattern = f"*.{{{','.join(map(any_case, extensions))}}}"  # other files are not even opened
    kept = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return kept.select("path", "content", "modificationTime", F.sha2("content", 256).alias("sha256"), F.element_at(F.split("path", "/"), -2).alias("source_name"))


def namespaces(files: DataFrame, root: str) -> DataFrame:
    """Sorted names of the folders directly below ``root``; hidden ones are left out."""
    below = F.regexp_extract("path", re.escape("/" + root.split(":")[-1].strip("/")) + "/([^/.][^/]*)/", 1)
    return files.select(below.alias("namespace")).where("namespace <> ''").distinct().orderBy("namespace")


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (path, sha256) the manifest of earlier runs lacks."""
    return files.join(manifest.select("path", "sha256"), ["path", "sha256"], "left_anti")


def write_manifest(files: DataFrame, path: str) -> None:
    """Record files as ingested; called after the ingestion succeeded."""
    files.select("path", "sha256", F.current_timestamp().alias("ingested_at")).write.mode("append").parquet(path)


def text_elements(docs: DataFrame) -> DataFrame:
    """Paragraphs of plain text ``docs`` (doc_id, text): rows (doc_id, pos, category, depth, text)."""
    parts = non_empty(F.split("text", "\n\n"))
    rows = docs.select("doc_id", F.posexplode(parts).alias("pos", "text"))
    return rows.select("doc_id", "pos", F.lit("NarrativeText").alias("category"), F.lit(None).cast("int").alias("depth"), "text")


def markdown_elements(docs: DataFrame) -> DataFrame:
    """Elements of Markdown ``docs`` (doc_id, text) by line: titles with depth, list items, table rows, text."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(strip(F.col("line")) != "")
    line = strip(F.col("line"))
    marks = F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1))
    category = F.when(marks > 0, "Title").when(line.rlike(r"^(?:[-*+]|\d+[.)])\s"), "ListItem").when(line.startswith("|"), "Table").otherwise("NarrativeText")
    text = F.regexp_replace(line, r"^(?:#{1,6}|[-*+]|\d+[.)])\s+", "")
    return lines.select("doc_id", "pos", category.alias("category"), F.when(marks > 0, marks).alias("depth"), F.when(category == "Table", line).otherwise(text).alias("text"))


class _Elements(HTMLParser):
    """Titles, paragraphs, list items and tables of a page; scripts, styles and navigation are left out.

    A head without end tag ends at the body or its first element or text; a table does at the next one or the page's
    end. ``unclosed``: places of elements that are never closed, which are not left out.
    """

    BLOCKS = {"p": "Text", "li": "ListItem", "td": "Cell", "th": "Cell", "div": "Text", "article": "Text", "blockquote": "Text"}
    SKIPPED = {"script", "style", "nav", "head", "noscript"}
    IN_HEAD = {"title", "meta", "link", "base", "template", "html"}

    def __init__(self, unclosed: frozenset[tuple[int, int]] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, int | None, str]] = []
        self.skip: list[tuple[str, tuple[int, int]]] = []
        self.unclosed, self.rows, self.open = unclosed, None, ("Text", None)
        self.held: list[str] = []

    def _flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if not text:
            return
        if self.rows is not None:
            self.rows[-1].append(text) if self.rows else self.rows.append([text])
        else:
            self.out.append((*self.open, text))

    def _end_table(self) -> None:
        self._flush()
        text = "\n".join("| " + " | ".join(r) + " |" for r in self.rows if r)
        self.rows = None
        if text:
            self.out.append(("Table", None, text))

    def _end_head(self) -> None:
        at = [t for t, _ in self.skip].index("head")
        del self.skip[at:]

    def close(self) -> None:
        super().close()
        self._flush()
        if self.rows is not None:
            self._end_table()

    def handle_starttag(self, tag: str, attrs) -> None:
        tags = [t for t, _ in self.skip]
        if "head" in tags and (tag == "body" or tags[-1] in ("head", "title") and tag not in (self.SKIPPED - {"nav"}) | self.IN_HEAD):
            self._end_head()
        if tag in self.SKIPPED or tag == "title" and self.skip and self.skip[-1][0] == "head":
            if self.getpos() not in self.unclosed:
                self.skip.append((tag, self.getpos()))
        elif tag == "table":
            if self.rows is not None:
                self._end_table()
            self._flush()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self._flush()
            self.rows.append([])
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self._flush()
            self.open = ("Title", int(tag[1]))
        elif tag in self.BLOCKS:
            self._flush()
            self.open = (self.BLOCKS[tag] if self.rows is None else "Text", None)
        elif tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag: str) -> None:
        tags = [t for t, _ in self.skip]
        if tag in tags:
            del self.skip[len(tags) - 1 - tags[::-1].index(tag) :]
        elif tag == "table" and self.rows is not None:
            self._end_table()
        elif tag in self.BLOCKS or (len(tag) == 2 and tag[0] == "h"):
            self._flush()
            self.open = ("Text", None)

    def handle_data(self, data: str) -> None:
        if self.skip and self.skip[-1][0] == "head" and data.strip():
            self._end_head()
        if not self.skip:
            self.held.append(data)


def page_elements(html: str) -> list[tuple[str, int | None, str]]:
    """Elements of a page; it is read again where a navigation or noscript is never closed, as content may follow."""
    unclosed: frozenset[tuple[int, int]] = frozenset()
    while True:
        parser = _Elements(unclosed)
        parser.feed(html)
        parser.close()
        more = {at for tag, at in parser.skip if tag in ("nav", "noscript")} - unclosed
        if not more:
            return parser.out
        unclosed |= more


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, html in zip(pdf["doc_id"], pdf["html"], strict=True):
            rows += [(key, i, *e) for i, e in enumerate(page_elements(html or ""))]
        frame = pd.DataFrame(rows, columns=["doc_id", "pos", "category", "depth", "text"])
        yield frame.astype({"depth": "Int32", "pos": "int32"})


def html_elements(pages: DataFrame) -> DataFrame:
    """Elements of ``pages`` (doc_id, html): rows (doc_id, pos, category, depth, text); parsing is the only Python step."""
    bounded_batches(pages.sparkSession)
    return pages.select("doc_id", "html").mapInPandas(_parse, ELEMENT)


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx_elements(content: bytes) -> list[tuple[str, int | None, str]]:
    """Headings, list items, paragraphs and tables of a DOCX file's body, in order; none of a file that is no DOCX."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORD}t")).strip()
    out = []
    for node in body if body is not None else ():
        if node.tag == f"{_WORD}tbl":
            rows = ["| " + " | ".join(text(c) for c in r.iter(f"{_WORD}tc")) + " |" for r in node.iter(f"{_WORD}tr")]
            out += [("Table", None, "\n".join(rows))] if rows else []
        elif node.tag == f"{_WORD}p" and (said := text(node)):
            style = node.find(f"{_WORD}pPr/{_WORD}pStyle")
            name = style.get(f"{_WORD}val", "") if style is not None else ""
            heading = re.fullmatch(r"Heading([1-6])", name)
            listed = node.find(f"{_WORD}pPr/{_WORD}numPr") is not None or name.startswith("List")
            out.append(("Title", int(heading[1]), said) if heading else ("Title", 1, said) if name == "Title" else ("ListItem" if listed else "NarrativeText", None, said))
    return out


def docx_elements(files: DataFrame) -> DataFrame:
    """Elements of DOCX ``files`` (path, content): rows (path, pos, category, depth, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(path, i, *e) for path, content in zip(pdf["path"], pdf["content"], strict=True) for i, e in enumerate(_docx_elements(content or b""))]
            yield pd.DataFrame(rows, columns=["path", "pos", "category", "depth", "text"]).astype({"depth": "Int32", "pos": "int32"})

    return files.select("path", "content").mapInPandas(run, ELEMENT.replace("doc_id long", "path string"))


def decoded_files(files: DataFrame) -> DataFrame:
    """Texts of scanned files: path, source_name, text."""
    return files.select("path", "source_name", decoded(F.col("content")).alias("text"))


def table_markdown(rows: DataFrame) -> DataFrame:
    """Markdown of tables given as ``rows`` (table_id, row_no, cells array): rows (table_id, text).

    The first row is the header; of a header cell its first line counts.
    """
    first = Window.partitionBy("table_id").orderBy("row_no")
    n = F.row_number().over(first)
    cells = F.when(n == 1, F.transform("cells", lambda c: F.substring_index(c, "\n", 1))).otherwise(F.transform("cells", lambda c: F.regexp_replace(c, "\n", " ")))
    line = F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.lit("---")), " | "), F.lit(" |"))
    lines = rows.select("table_id", "row_no", F.when(n == 1, F.concat(line, F.lit("\n"), rule)).otherwise(line).alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("table_id").agg(joined.alias("text"))
