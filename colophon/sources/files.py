"""File sources (S1-S7, S9-S12, S23-S25, S28, S37): binary and text files as DataFrames.

Parsers of binary formats run inside ``mapInPandas`` on the executors and need only the
standard library; readers that need others are plugged in.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("pdf", "docx", "epub", "md", "txt", "html")


def binary_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, modificationTime, length, content``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def classify_pages(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``doc, doc_type``: pdf_digital if at least .8 of the pages have 50 characters or more, else pdf_scanned."""
    enough = F.avg(F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) >= 50, 1.0).otherwise(0.0))
    return pages.groupBy(doc).agg(F.when(enough >= 0.8, "pdf_digital").otherwise("pdf_scanned").alias("doc_type"))


def scanned_by_head(pages: DataFrame, doc: str = "doc_id", n: int = 5) -> DataFrame:
    """S1's other rule: scanned if none of the first ``n`` pages has text."""
    return pages.where(F.col("page") <= n).groupBy(doc).agg((F.max(F.length(F.trim(F.coalesce("text", F.lit(""))))) == 0).alias("scanned"))


def validate_pages(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``doc, valid, errors, warnings`` from ``doc, page, text, width, height, n_bytes, locked, corrupt`` (one row per page; a null page for none)."""
    n = F.count("page")
    share = lambda c: F.avg(F.when(F.col("page").isNotNull(), F.when(c, 1.0).otherwise(0.0)))
    agg = pages.groupBy(doc).agg(
        n.alias("n"), F.max("n_bytes").alias("bytes"), F.max(F.coalesce("locked", F.lit(False))).alias("locked"), F.max(F.coalesce("corrupt", F.lit(False))).alias("corrupt"),
        share(F.col("width") > 1.2 * F.col("height")).alias("wide"), share(F.length(F.trim(F.coalesce("text", F.lit("")))) < 10).alias("bare"),
    )
    said = lambda *pairs: F.filter(F.array(*[F.when(c, t) for c, t in pairs]), lambda x: x.isNotNull())
    errors = said((F.col("corrupt"), "corrupt"), (~F.col("corrupt") & (F.col("n") == 0), "no pages"), (F.col("locked"), "locked"))
    warnings = said((F.col("n") > 2000, "more than 2000 pages"), (F.col("wide") > 0.5, "mostly landscape"), (F.col("bare") > 0.8, "mostly without text"), ((F.col("n") > 10) & (F.col("bytes") / F.col("n") < 500), "few bytes a page"))
    return agg.select(doc, (F.size(errors) == 0).alias("valid"), errors.alias("errors"), warnings.alias("warnings"))


def validate_files(files: DataFrame) -> DataFrame:
    """S3: ``path, valid, errors, warnings`` of EPUB and DOCX files (``path, content``); other types are valid here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                kind, errors, warnings = path.rsplit(".", 1)[-1].lower(), [], []
                try:
                    if kind == "epub" and not read_epub(bytes(content)):
                        errors.append("no content documents")
                    if kind == "docx" and not read_docx(bytes(content)):
                        warnings.append("no paragraphs")
                except Exception as e:  # noqa: BLE001 - a broken file is a row, not a failed job
                    errors.append(f"corrupt: {type(e).__name__}")
                rows.append((path, not errors, errors, warnings))
            yield pd.DataFrame(rows, columns=["path", "valid", "errors", "warnings"])

    return files.select("path", "content").mapInPandas(run, "path string, valid boolean, errors array<string>, warnings array<string>")


def ocr_markdown(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """``path, text`` of Markdown files, one row a file, without image links."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"!\[[^\]]*\]\([^)]*\)", "").alias("text"))


def join_pages(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``doc, text``: pages with text in order, parted by blank lines; a document's pages are one record."""
    p = pages.where(F.length(F.trim("text")) > 0)
    return p.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


class _Blocks(HTMLParser):
    """Block texts in order, marked as Markdown."""

    MARKS = {**{f"h{i}": "#" * i + " " for i in range(1, 7)}, "p": "", "li": "- ", "blockquote": "> ", "pre": ""}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[tuple[str, list[str]]] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in self.MARKS and not self.open:
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif self.open and self.open[-1][0] == tag:
            _, parts = self.open.pop()
            if text := re.sub(r"\s+", " ", "".join(parts)).strip():
                self.out.append(self.MARKS[tag] + text)

    def handle_data(self, data):
        if self.open and not self.hidden:
            self.open[-1][1].append(data)


def html_blocks(html: str) -> list[str]:
    """Headings, paragraphs, items, quotes and preformatted text of a page."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    return parser.out


# What a short chapter says that is no content.
FRONT_MATTER = ("copyright", "isbn", "table of contents", "all rights reserved", "cover image")


def front_matter(text: str) -> bool:
    """A chapter of under 200 characters with one of the fixed phrases."""
    return len(text) < 200 and any(x in text.lower() for x in FRONT_MATTER)


def read_epub(content: bytes) -> list[tuple[int, str]]:
    """``chapter, text``; chapters of front matter or without text do not count."""
    out, n = [], 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(x for x in z.namelist() if re.search(r"\.x?html?$", x, re.I)):
            text = "\n\n".join(html_blocks(z.read(name).decode("utf-8", "replace")))
            if text and not front_matter(text):
                n += 1
                out.append((n, text))
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_docx(content: bytes) -> list[tuple[int, str]]:
    """One segment without page: heading styles as ``#``, table rows with `` | `` after the text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    lines, tables = [], []
    for el in body if body is not None else ():
        if el.tag == f"{_W}p":
            text = "".join(t.text or "" for t in el.iter(f"{_W}t")).strip()
            style = next((s.get(f"{_W}val", "") for s in el.iter(f"{_W}pStyle")), "")
            level = re.match(r"(?i)heading\s*(\d)", style)
            if text:
                lines.append("#" * int(level[1]) + " " + text if level else text)
        elif el.tag == f"{_W}tbl":
            for row in el.iter(f"{_W}tr"):
                tables.append(" | ".join("".join(t.text or "" for t in cell.iter(f"{_W}t")).strip() for cell in row.iter(f"{_W}tc")))
    return [(0, "\n\n".join(lines + tables))] if lines or tables else []


def read_plain(content: bytes) -> list[tuple[int, str]]:
    return [(1, content.decode("utf-8", "replace"))]


def read_html(content: bytes) -> list[tuple[int, str]]:
    return [(1, "\n\n".join(html_blocks(content.decode("utf-8", "replace"))))]


READERS: dict[str, Callable[[bytes], list[tuple[int, str]]]] = {"epub": read_epub, "docx": read_docx, "md": read_plain, "txt": read_plain, "html": read_html}


def extract_pages(files: DataFrame, readers: dict[str, Callable[[bytes], list[tuple[int, str]]]] | None = None) -> DataFrame:
    """``path, page, text, error`` of files (``path, content``); a file that cannot be read gives one row with its error.

    A PDF reader is plugged in under ``pdf``.
    """
    known = READERS | (readers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                kind = path.rsplit(".", 1)[-1].lower()
                try:
                    if kind not in known:
                        raise ValueError(f"no reader for .{kind}")
                    rows += [(path, page, text, None) for page, text in known[kind](bytes(content)) if text.strip()]
                except Exception as e:  # noqa: BLE001 - a broken file is a row, not a failed job
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"]).astype({"page": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, page bigint, text string, error string")


def modal_tables(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``doc, page, table_no, kind, content, surrounding_text`` of the Markdown tables of pages (``doc, page, text``): two lines or more that begin with a bar.

    The context is the page's first 1,500 characters.  A PDF reader that is plugged in
    gives its tables as Markdown in the page's text.
    """
    found = F.regexp_extract_all("text", F.lit(r"(?:(?:\A|(?<=\n))[^\S\n]*\|[^\n]*(?:\n|\z)){2,}"), F.lit(0))
    rows = pages.select(doc, "page", F.substring("text", 1, 1500).alias("surrounding_text"), F.posexplode(found).alias("table_no", "content"))
    return rows.select(doc, "page", "table_no", F.lit("table").alias("kind"), F.trim(F.regexp_replace("content", r"\n\z", "")).alias("content"), "surrounding_text")


def gold_rows(spark: SparkSession, path: str) -> DataFrame:
    """``query, source, page, gold_quote`` of a JSON array or an object with questions, items, samples or data; rows without query drop out."""
    raw = spark.read.option("multiLine", "true").json(path)
    names = [c for c in ("questions", "items", "samples", "data") if c in raw.columns]
    if names:
        raw = raw.select(F.inline(F.coalesce(*[F.col(c) for c in names])))
    pick = lambda *cs: F.coalesce(*[F.col(c).cast("string") for c in cs if c in raw.columns], F.lit(None).cast("string"))
    out = raw.select(pick("query", "question").alias("query"), pick("source", "expected_source", "book").alias("source"), pick("pdf_page", "page", "page_start").cast("int").alias("page"), pick("ground_truth", "quote", "gold_quote", "answer").alias("gold_quote"))
    return out.where(F.length(F.trim("query")) > 0)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines file; lines that do not parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def yaml_gazetteer(spark: SparkSession, folder: str) -> DataFrame:
    """``canonical_id, label, type, aliases, load_order`` of all ``*.yml`` in order of name; entries without id are left out.

    The folder may be on any file system that Spark reads; a gazetteer's files are few and small.
    """
    import yaml

    rows = []
    found = spark.read.text(folder, wholetext=True, pathGlobFilter="*.yml").select(F.col("_metadata.file_name").alias("name"), "value")
    for _, content in sorted((r["name"], r["value"]) for r in found.collect()):
        for section in (yaml.safe_load(content) or {}).values():
            for e in section if isinstance(section, list) else []:
                if isinstance(e, dict) and e.get("canonical_id"):
                    rows.append((e["canonical_id"], e.get("label", e["canonical_id"]), e.get("type", "TERM"), list(e.get("aliases") or []), len(rows)))
    return spark.createDataFrame(rows, "canonical_id string, label string, type string, aliases array<string>, load_order int")


def prefix_key(source: Column, index: Column, text: Column, model: Column) -> Column:
    """The cache key of a context prefix."""
    return F.sha2(F.concat_ws("|", source, index.cast("string"), text, model), 256)
