"""Documents to chunks.

Splits that are a pure function of positions are array expressions.  Only the greedy
recursive split keeps state that columns cannot express; it runs in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Where a sentence ends, and what a Markdown heading is.
SENTENCE = r"(?<=[.!?])\s+"
HEADER = r"(?m)^(#{1,6})\s+(.+)$"


def words_of(text: Column) -> Column:
    """C1's default token counter: words between white space."""
    return F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda w: w != "")


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def sentences(text: Column) -> Column:
    """Split after ., ! or ? and white space."""
    return F.filter(F.transform(F.split(text, SENTENCE), lambda x: F.trim(x)), lambda s: s != "")


def trim_to_sentence(text: Column) -> Column:
    """C4: what follows the first sentence end, or the text where none does."""
    rest = F.regexp_extract(text, r"(?s)^.*?(?<=[.!?])\s+(.*)$", 1)
    return F.trim(F.when(F.trim(rest) != "", rest).otherwise(text))


def split_by_headers(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, section_no, heading, text, offset`` of Markdown sections.

    The offset is that of the stripped section; a text without header is one section.
    """
    heads = F.regexp_extract_all(F.col("t"), F.lit(HEADER), F.lit(0))
    bodies = F.split(F.col("t"), HEADER)
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("t")).withColumn("h", heads).withColumn("b", bodies)
    starts = F.aggregate(F.zip_with("b", "h", lambda b, h: F.length(b) + F.coalesce(F.length(h), F.lit(0))), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    rows = rows.withColumn("at", starts).select("doc_id", "t", "h", F.size("b").alias("n"), F.posexplode(F.zip_with("b", "at", lambda b, a: F.struct(b.alias("b"), a.alias("a")))).alias("i", "s"))
    rows = rows.where("s.b is not null")
    lead = F.length(F.col("s.b")) - F.length(F.regexp_replace(F.col("s.b"), r"(?U)^\s+", ""))
    heading = F.when(F.col("i") == 0, "").otherwise(F.trim(F.regexp_extract(F.get("h", F.col("i") - 1), HEADER, 2)))
    body = F.regexp_replace(F.col("s.b"), r"(?U)^\s+|\s+$", "")
    out = rows.select("doc_id", "i", "n", "t", heading.alias("heading"), body.alias("text"), (F.col("s.a") + lead).alias("offset"))
    kept = out.where(F.length("text") > 0)
    whole = out.where("n = 1 and length(text) = 0").select("doc_id", "i", F.lit("").alias("heading"), F.col("t").alias("text"), F.lit(0).alias("offset"))
    order = Window.partitionBy("doc_id").orderBy("i")
    return kept.select("doc_id", "i", "heading", "text", "offset").unionByName(whole).withColumn("section_no", F.row_number().over(order) - 1).drop("i")


def breakpoints(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``doc_id, page, offset`` of each page in the text joined by blank lines."""
    before = Window.partitionBy(doc).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.select(doc, "page", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).alias("offset"))


def page_spans(pieces: DataFrame, points: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pieces (``doc_id, piece_no, start, length``) with ``page_start, page_end``: the last page that begins no later; unknown 0.

    One sort per document interleaves pieces and page starts; the last page seen is
    carried over, so no piece meets every page.
    """
    at = pieces.select(doc, "piece_no", F.col("start").alias("pos"), F.lit(0).alias("end"), F.lit(None).cast("int").alias("page"))
    to = pieces.select(doc, "piece_no", (F.col("start") + F.col("length")).alias("pos"), F.lit(1).alias("end"), F.lit(None).cast("int").alias("page"))
    marks = points.select(doc, F.lit(None).cast("int").alias("piece_no"), F.col("offset").alias("pos"), F.lit(-1).alias("end"), F.col("page").cast("int"))
    order = Window.partitionBy(doc).orderBy("pos", "end").rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy(doc)
    seen = at.withColumn("piece_no", F.col("piece_no").cast("int")).unionByName(to.withColumn("piece_no", F.col("piece_no").cast("int"))).unionByName(marks)
    seen = seen.withColumn("p", F.coalesce(F.last("page", ignorenulls=True).over(order), F.min_by("page", F.when(F.col("end") == -1, F.col("pos"))).over(first), F.lit(0)))
    ends = seen.where("end >= 0").groupBy(doc, "piece_no").agg(F.max(F.when(F.col("end") == 0, F.col("p"))).alias("page_start"), F.max(F.when(F.col("end") == 1, F.col("p"))).alias("page_end"))
    return pieces.join(ends, [doc, "piece_no"])


def sliding_chunks(docs: DataFrame, size: int = 384, overlap: int = 96, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of ``size`` words every ``size - overlap``; ``chunk_index`` from 0; the last reaches the end."""
    stride = size - overlap
    w = docs.select(F.col(doc).alias("doc_id"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.ceil((F.size("w") - size) / stride).cast("int"), F.lit(0))
    return w.select("doc_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index")).select(
        "doc_id", "chunk_index", F.array_join(F.slice("w", F.col("chunk_index") * stride + 1, size), " ").alias("text"), F.least(F.lit(size), F.size("w") - F.col("chunk_index") * stride).alias("n_tokens")
    )


def sentence_windows(docs: DataFrame, span: int = 3, least: int = 15, most: int = 512, doc: str = "doc_id", text: str = "text", boundary: str = r"(?<=[.!?])\s+(?=[A-Z\"'])") -> DataFrame:
    """``doc_id, window_index, text`` of ``span`` neighbouring sentences over 20 characters, with 15 to 512 words."""
    s = F.filter(F.transform(F.split(F.col(text), boundary), strip), lambda x: F.length(x) > 20)
    rows = docs.select(F.col(doc).alias("doc_id"), s.alias("s")).where(F.size("s") >= span)
    rows = rows.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("s") - span + 1), lambda i: F.array_join(F.slice("s", i, span), " "))).alias("window_index", "text"))
    n = F.size(words_of(F.col("text")))
    return rows.where((n >= least) & (n <= most))


def neighbour_context(chunks: DataFrame, wanted: DataFrame, window: int = 1, source: str = "source", index: str = "chunk_index") -> DataFrame:
    """Chunks within ``window`` of the wanted ones in their source, as an equi-join on exploded positions."""
    near = wanted.select(source, F.col(index).alias("centre"), F.explode(F.sequence(F.col(index) - window, F.col(index) + window)).alias(index))
    return chunks.join(near, [source, index])


def contextual(text: Column, prefix: Column) -> Column:
    """Prefix, blank line, text; the text alone without prefix."""
    return F.when(F.length(prefix) > 0, F.concat_ws("\n\n", prefix, text)).otherwise(text)


def default_prefix(source: Column, heading: Column) -> Column:
    """C14: the model-free prefix, of at most 500 characters."""
    return F.substring(F.concat_ws(" — ", F.nullif(source, F.lit("")), F.nullif(heading, F.lit(""))), 1, 500)


def document_sample(chunks: DataFrame, n: int = 15, chars: int = 8000) -> DataFrame:
    """``source, sample``: the first ``n`` chunks of each source, at most ``chars`` characters."""
    first = chunks.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy("chunk_index"))).where(F.col("_r") <= n)
    return first.groupBy("source").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "text"))), lambda x: x["text"]), "\n\n"), 1, chars).alias("sample"))


def strip_headers_footers(pages: DataFrame, doc: str = "doc_id", share: float = 0.5) -> DataFrame:
    """Pages without first or last lines that at least half of a document's pages repeat.

    Documents of under four pages, and lines of 80 characters or more, stay.  Counting
    is a pre-aggregation per (document, line); only repeated lines join back.
    """
    lines = F.split("text", "\n")
    full = F.filter(F.transform(lines, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    p = pages.select("*", full.alias("_f"))
    ends = p.where(F.size("_f") > 0).select(doc, F.explode(F.array(F.struct(F.lit("first").alias("side"), F.element_at("_f", 1).alias("line")), F.struct(F.lit("last").alias("side"), F.element_at("_f", -1).alias("line")))).alias("e")).select(doc, "e.*")
    counts = ends.where(F.length("line") < 80).groupBy(doc, "side", "line").agg(F.count("*").alias("n"))
    size = pages.groupBy(doc).agg(F.count("*").alias("pages")).where("pages >= 4")
    repeated = counts.join(size, doc).where(F.col("n") >= F.floor(F.col("pages") * share)).groupBy(doc).agg(F.collect_set(F.when(F.col("side") == "first", F.col("line"))).alias("_first"), F.collect_set(F.when(F.col("side") == "last", F.col("line"))).alias("_last"))
    j = p.join(repeated, doc, "left").withColumn("_l", lines)
    bad = lambda x, side: (F.trim(x) != "") & F.coalesce(F.array_contains(side, F.lower(F.trim(x))), F.lit(False))
    lead = F.aggregate("_l", F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & bad(x, F.col("_first")), 1).otherwise(0)).alias("n"), (a["on"] & bad(x, F.col("_first"))).alias("on")))["n"]
    tail = F.aggregate(F.reverse("_l"), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & bad(x, F.col("_last")), 1).otherwise(0)).alias("n"), (a["on"] & bad(x, F.col("_last"))).alias("on")))["n"]
    j = j.withColumn("_a", lead).withColumn("_z", tail)
    kept = F.slice("_l", F.col("_a") + 1, F.greatest(F.size("_l") - F.col("_a") - F.col("_z"), F.lit(0)))
    return j.withColumn("text", F.array_join(kept, "\n")).drop("_f", "_first", "_last", "_l", "_a", "_z")


# --- the recursive split (C3, C10, C11) ------------------------------------------------


def _hard(text: str, most: int, overlap: int) -> list[tuple[str, int, int]]:
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    out, i = [], 0
    while i < len(spans):
        j = min(i + most, len(spans))
        a, b = spans[i][0], spans[j - 1][1]
        out.append((text[a:b], a, b - a))
        if j == len(spans):
            break
        i = j - overlap if 0 < overlap < j - i else j
    return out


def _pack(text: str, separator: str, most: int, count: Callable[[str], int]) -> list[tuple[int, int]]:
    """Greedy spans of neighbouring parts of at most ``most`` tokens."""
    cuts = [0, *(m.end() for m in re.finditer(separator, text)), len(text)]
    parts = [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
    spans: list[tuple[int, int]] = []
    for a, b in parts:
        if spans and count(text[spans[-1][0] : b]) <= most:
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
    return spans


def recursive_pieces(text: str, most: int, overlap: int, count: Callable[[str], int] = lambda s: len(s.split())) -> list[tuple[str, int, int]]:
    """``text, offset, new_length`` of pieces of at most ``most`` tokens.

    Paragraphs, lines, sentences, words in turn; neighbours pack greedily; a piece too
    long splits by the next finer separator.  Each later piece is led by the last
    ``overlap`` tokens of the one before, from a sentence start where there is one.
    """

    def cut(a: int, b: int, level: int) -> list[tuple[int, int]]:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a == b:
            return []
        if count(text[a:b]) <= most:
            return [(a, b)]
        for n, separator in enumerate((r"\n\n", r"\n", r"(?<=[.!?])\s+", r" ")[level:], level):
            spans = _pack(text[a:b], separator, most, count)
            if len(spans) > 1:
                return [x for s, e in spans for x in cut(a + s, a + e, n + 1)]
        return [(a + o, a + o + n) for _, o, n in _hard(text[a:b], most, 0)]

    spans = cut(0, len(text), 0)
    out = []
    for i, (a, b) in enumerate(spans):
        piece = text[a:b]
        if i and overlap:
            before = text[spans[i - 1][0] : spans[i - 1][1]].split()
            if len(before) > overlap:
                lead = " ".join(before[-overlap:])
                if (m := re.search(r"(?<=[.!?])\s+", lead)) and lead[m.end() :].strip():
                    lead = lead[m.end() :]
                piece = f"{lead} {piece}"
        out.append((piece, a, b - a))
    return out


def recursive_split(docs: DataFrame, most: int = 512, overlap: int = 64, doc: str = "doc_id", text: str = "text", token_counter: Callable[[str], int] | None = None) -> DataFrame:
    """``doc_id, piece_no, text, start, length``; null and blank texts give nothing."""
    count = token_counter or (lambda s: len(s.split()))
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, i, *piece) for d, t in zip(batch["doc_id"], batch["t"]) if t for i, piece in enumerate(recursive_pieces(t, most, overlap, count))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "text", "start", "length"])

    return docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("t")).mapInPandas(run, f"doc_id {kind}, piece_no int, text string, start int, length int")


def packed_pages(pages: DataFrame, most: int = 512, overlap: int = 64, doc: str = "doc_id") -> DataFrame:
    """Pieces of each page by whole sentences where they fit: ``doc, page, piece_no, text, start, length``."""
    keyed = pages.select(F.struct(doc, "page").alias("k"), F.regexp_replace("text", r"\s*\n\s*", " ").alias("text"))
    return recursive_split(keyed, most, overlap, "k", "text").select(f"doc_id.{doc}", "doc_id.page", "piece_no", "text", "start", "length")


def described(content: Column, description: Column) -> Column:
    """A table or equation behind its description; alone without one."""
    return contextual(content, description)


def chunk_documents(docs: DataFrame, pages: DataFrame | None = None, most: int = 512, overlap: int = 64, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Sections, pieces, page spans: ``doc_id, chunk_index, heading, text, start, length, page_start, page_end``."""
    sections = split_by_headers(docs, doc, text)
    keyed = sections.select(F.struct("doc_id", "section_no", "heading", "offset").alias("k"), "text")
    pieces = recursive_split(keyed, most, overlap, "k", "text").select("doc_id.*", "piece_no", "text", "start", "length")
    order = Window.partitionBy("doc_id").orderBy("section_no", "piece_no")
    chunks = pieces.select("doc_id", (F.row_number().over(order) - 1).alias("piece_no"), "heading", "text", (F.col("start") + F.col("offset")).alias("start"), "length")
    if pages is None:
        return chunks.withColumnRenamed("piece_no", "chunk_index").withColumn("page_start", F.lit(0)).withColumn("page_end", F.lit(0))
    return page_spans(chunks, breakpoints(pages)).withColumnRenamed("piece_no", "chunk_index")


def markdown_paragraphs(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, paragraph_no, heading, text``; a heading of at most 80 characters is carried to the paragraphs after it."""
    p = docs.select(F.col(doc).alias("doc_id"), F.posexplode(F.filter(F.transform(F.split(F.col(text), r"\n\s*\n"), strip), lambda x: x != "")).alias("paragraph_no", "text"))
    head = F.when(F.col("text").rlike(r"^#{1,6}\s") & (F.length("text") <= 80), F.trim(F.regexp_replace("text", r"^#{1,6}\s+", "")))
    order = Window.partitionBy("doc_id").orderBy("paragraph_no")
    return p.withColumn("_h", head).withColumn("heading", F.coalesce(F.last("_h", ignorenulls=True).over(order), F.lit(""))).where("_h is null").drop("_h")
