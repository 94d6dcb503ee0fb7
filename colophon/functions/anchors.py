"""Page, section and edition anchors in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six kinds of anchor and how they are written.
ANCHORS = (
    ("page", r"(?iU)\bpp?\.?\s*(\d+(?:\s*[-–—]\s*\d+)?)\b"),
    ("section", r"(?iU)(?:§|section)\s*(\d+(?:\.\d+)?)"),
    ("chapter", r"(?iU)\b(?:ch\.?|chapter)\s*(\d+)\b"),
    ("kant_ab", r"(?U)\b([AB]\s*\d{1,4}(?:\s*/\s*[AB]\s*\d{1,4})?)\b"),
    ("heidegger_sz", r"(?iU)\bSZ[:\s]+(\d{1,4})\b"),
    ("plateau", r"(?iU)\b(?:plateau|ATP)\s+(\d+)\b"),
)
#: ``[Source: title, p. 12]`` as answers carry it.
CITATION_TAG = r"(?i)\[Source:\s*([^\]]+?),\s*pp?\.\s*(\d+(?:\s*[-–—]\s*\d+)?)\s*(?:—[^\]]*)?\]"


def _of_kind(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def extract_anchors(text: Column) -> Column:
    """``ARRAY<STRUCT<kind, value>>`` without white space, each kind and value once, by kind then place."""
    found = []
    for kind, pattern in ANCHORS:
        values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: F.regexp_replace(v, r"(?U)\s+", ""))
        first = F.filter(values, lambda v, i: F.array_position(F.transform(values, F.lower), F.lower(v)) == i + 1)
        found.append(F.transform(first, _of_kind(kind)))
    return F.coalesce(F.concat(*found), F.array().cast("array<struct<kind:string,value:string>>"))


def page_in_range(value: Column, page_start: Column, page_end: Column) -> Column:
    """Whether a page anchor meets a page span; false for an unknown start."""
    numbers = F.transform(F.regexp_extract_all(value, F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("int"))
    low, high = F.get(numbers, F.lit(0)), F.element_at(numbers, -1)
    end = F.when(F.coalesce(page_end, F.lit(0)) == 0, page_start).otherwise(page_end)
    return F.when((F.coalesce(page_start, F.lit(0)) == 0) | (F.size(numbers) == 0), False).otherwise(~((high < page_start) | (low > end)))


def citation_tags(text: Column) -> Column:
    """``ARRAY<STRUCT<tag, title, page>>`` in order."""
    tags = F.regexp_extract_all(text, F.lit(CITATION_TAG), F.lit(0))
    return F.transform(tags, lambda t: F.struct(t.alias("tag"), F.trim(F.regexp_extract(t, CITATION_TAG, 1)).alias("title"), F.regexp_extract(t, CITATION_TAG, 2).alias("page")))


def cited_pages(text: Column) -> Column:
    """Page numbers after ``p.`` or ``pp.``, distinct and sorted."""
    pages = F.regexp_extract_all(text, F.lit(r"p{1,2}\.\s*(\d+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(pages, lambda p: p.cast("int"))))


def cited_page_ranges(text: Column) -> Column:
    """The same with ranges of at most 1,000 pages spelt out."""
    spans = F.regexp_extract_all(text, F.lit(r"p{1,2}\.\s*(\d+(?:\s*[-–]\s*\d+)?)"), F.lit(1))

    def pages(span: Column) -> Column:
        n = F.transform(F.regexp_extract_all(span, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
        a, b = F.get(n, F.lit(0)), F.element_at(n, -1)
        return F.when((b >= a) & (b - a <= 1000), F.sequence(a, b)).otherwise(F.array(a))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(spans, pages))))


def nearest_quote(before: Column) -> Column:
    """V7: the quoted span of 15 characters or more that ends last in a text, or null."""
    straight = F.regexp_extract(before, r'(?s).*"([^"]{15,})"', 1)
    curly = F.regexp_extract(before, "(?s).*“([^”]{15,})”", 1)
    end_s = F.when(straight != "", F.length(F.regexp_extract(before, r'(?s)(.*"[^"]{15,}")', 1))).otherwise(0)
    end_c = F.when(curly != "", F.length(F.regexp_extract(before, "(?s)(.*“[^”]{15,}”)", 1))).otherwise(0)
    return F.when((end_s == 0) & (end_c == 0), None).when(end_c > end_s, curly).otherwise(straight)
