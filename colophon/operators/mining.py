"""Gold sets and page metadata by mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.functions.text import normalize_for_matching


def document_frequency(spans: DataFrame, least: int = 2, n: int | None = None) -> DataFrame:
    """A5, K3: ``span, df`` of spans in at least ``least`` chunks, most frequent first."""
    df = spans.distinct().groupBy("span").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    return df if n is None else df.orderBy(F.desc("df"), "span").limit(n)


def level_mix(nodes: DataFrame) -> DataFrame:
    """Leaves and summaries counted."""
    return nodes.groupBy(F.when(F.coalesce("level", F.lit(0)) == 0, "L0").otherwise("L1+").alias("level_class")).agg(F.count("*").alias("n"))


def sample_by_hash(rows: DataFrame, key: str, n: int = 50, seed: int = 42) -> DataFrame:
    """``n`` rows, the same for the same seed; all if there are fewer."""
    return rows.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key).limit(n)


# Patterns and names by which a title page is read.
ISBN = r"\bISBN[\s:]*([\d][\d\s\-Xx]{8,})"
COPYRIGHT_YEAR = r"©\s*(?:[^\d\n]*?)(\d{4})"
BARE_YEAR = r"\b(19[5-9]\d|20[0-2]\d)\b"
TRANSLATED = r"[Tt]ranslated\s+(?:from\s+the\s+\w+\s+)?(?:and\s+edited\s+)?by\s+([A-Z][\w.\-]*(?:\s+(?:[A-Z][\w.\-]*|and|&|,))*\s*[A-Z][\w.\-]*)"
PUBLISHERS = (
    "Columbia University Press", "University of Minnesota Press", "Presses Universitaires de France", "Zone Books", "The Athlone Press",
    "Athlone Press", "Continuum", "City Lights Books", "Les Editions de Minuit",
)
NO_TITLE = ("translated", "edited", "press", "by ", "copyright", "deleuze", "guattari")
AUTHORS = ((("Deleuze", "Guattari"), "Gilles Deleuze and Felix Guattari"), (("Deleuze", "Parnet"), "Gilles Deleuze and Claire Parnet"), (("Deleuze",), "Gilles Deleuze"))


def page_metadata(text: Column) -> Column:
    """``STRUCT<isbn, year, publisher, translator, author, title>`` of a title page by patterns; null where none fits.

    A copyright year goes before a bare one; the title is the first of the longest lines
    of 4 to 80 characters without figures or words of an imprint in the first 600.
    """
    found = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    low = F.lower(text)
    publisher, author = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in reversed(PUBLISHERS):
        publisher = F.when(low.contains(name.lower()), name).otherwise(publisher)
    for names, whole in reversed(AUTHORS):
        held = F.lit(True)
        for n in names:
            held = held & text.contains(n)
        author = F.when(held, whole).otherwise(author)
    lines = F.transform(F.split(F.substring(text, 1, 600), "\n"), lambda x: F.trim(x))
    fits = lambda x: (F.length(x) >= 4) & (F.length(x) <= 80) & ~x.rlike(r"\d") & ~F.lower(x).rlike("|".join(NO_TITLE))
    title = F.aggregate(F.filter(lines, fits), F.lit(None).cast("string"), lambda b, x: F.when(b.isNull() | (F.length(x) > F.length(b)), x).otherwise(b))
    return F.struct(
        F.trim(found(ISBN)).alias("isbn"), F.coalesce(found(COPYRIGHT_YEAR), found(BARE_YEAR)).alias("year"), publisher.alias("publisher"),
        F.regexp_replace(F.trim(F.regexp_replace(found(TRANSLATED), r"\s+", " ")), ",+$", "").alias("translator"), author.alias("author"), title.alias("title"),
    )


def enumerate_golds(spread: DataFrame, pairs: int = 4) -> DataFrame:
    """Per concept up to ``pairs`` pairs of works and one triple in order of year, and a rotating template.

    ``spread``: ``concept, source, year`` (unknown years last).
    """
    s = spread.withColumn("y", F.when(F.coalesce("year", F.lit(0)) == 0, 9999).otherwise(F.col("year")))
    s = s.withColumn("n", F.row_number().over(Window.partitionBy("concept").orderBy("y", "source"))).where(F.col("n") <= pairs + 2)
    a, b = s.select("concept", F.col("source").alias("a"), F.col("n").alias("i")), s.select("concept", F.col("source").alias("b"), F.col("n").alias("j"))
    two = a.join(b, "concept").where("i < j").withColumn("r", F.row_number().over(Window.partitionBy("concept").orderBy("i", "j"))).where(F.col("r") <= pairs).select("concept", F.array("a", "b").alias("works"), "r")
    three = s.where("n <= 3").groupBy("concept").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "source"))), lambda x: x["source"]).alias("works")).where(F.size("works") == 3).select("concept", "works", F.lit(pairs + 1).alias("r"))
    all_ = two.union(three)
    return all_.withColumn("template", F.pmod(F.col("r") - 1, F.when(F.size("works") == 2, 3).otherwise(2)) + 1)


def best_passage(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, passage``: the longest paragraph of 20 words or more that is no heading or list, cut after 80 words at a sentence end past its half."""
    p = pages.select(key, F.explode(F.transform(F.split("text", r"\n\s*\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))).alias("p"))
    p = p.where((F.size(F.split("p", " ")) >= 20) & ~F.col("p").rlike(r"^(?:#|\[|\*\*|\d+\.)"))
    best = p.groupBy(key).agg(F.max(F.struct(F.length("p").alias("l"), "p")).alias("b")).select(key, F.col("b.p").alias("p"))
    cut = F.array_join(F.slice(F.split("p", " "), 1, 80), " ")
    stop = F.regexp_extract(cut, r"(?s)^(.*[.!?])(?:\s|\z)", 1)
    return best.select(key, F.when(F.size(F.split("p", " ")) <= 80, F.col("p")).when(F.length(stop) > F.length(cut) / 2, stop).otherwise(cut).alias("passage"))


def stratified_pick(rows: DataFrame, stratum: str, score: str, key: str, per: int = 5, total: int = 20) -> DataFrame:
    """Up to ``per`` of each stratum, then the best of the rest, ``total`` in all."""
    r = rows.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(F.desc(score), key)))
    return r.orderBy(F.col("_r") > per, F.desc(score), key).limit(total).drop("_r")


def verify_golds(golds: DataFrame, pages: DataFrame) -> DataFrame:
    """``item_id, found``: whether the gold's page holds it, normalised; the first 50 characters where it moved."""
    g = golds.select("item_id", "source", F.col("pdf_page").alias("page"), normalize_for_matching(F.col("ground_truth")).alias("g"))
    p = pages.select("source", "page", normalize_for_matching(F.col("text")).alias("t"))
    hit = g.join(p, ["source", "page"]).groupBy("item_id").agg(F.max(F.col("t").contains(F.col("g"))).alias("whole"), F.max(F.col("t").contains(F.substring("g", 1, 50))).alias("head"))
    return g.select("item_id").join(hit, "item_id", "left").select("item_id", F.when(F.col("whole"), "whole").when(F.col("head"), "head").otherwise("missing").alias("found"))


def mined_entities(tags: DataFrame, least: int = 2) -> DataFrame:
    """``query_id, entities``: ids in at least ``least`` of a question's chunks, the most frequent first, then by id.

    ``tags``: ``query_id, chunk, canonical_id``; the gazetteer bounds a question's list.
    """
    n = tags.select("query_id", "chunk", "canonical_id").distinct().groupBy("query_id", "canonical_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "canonical_id"))), lambda x: x["canonical_id"]).alias("entities"))


def mined_spans(spans: DataFrame, most: int = 5, least: int = 2) -> DataFrame:
    """``query_id, spans``: the ``most`` best spans of a question's chunks by number of chunks, then length, then name; in ``least`` chunks at least.

    ``spans``: ``query_id, chunk, span``.
    """
    n = spans.where(F.length("span") > 0).select("query_id", "chunk", "span").distinct().groupBy("query_id", "span").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), F.desc(F.length("span")), "span")
    top = n.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    return top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "span"))), lambda x: x["span"]).alias("spans"))


def mined_edges(entities: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """``query_id, src, dst``: edges of the graph with both ends in a question, for questions of ``least`` entities or more.

    ``entities``: ``query_id, canonical_id``; ``edges``: ``src, dst`` with src < dst.
    """
    e = entities.select("query_id", "canonical_id").distinct()
    many = e.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("query_id")
    e = e.join(many, "query_id", "left_semi")
    half = e.join(edges.select(F.col("src").alias("canonical_id"), "dst"), "canonical_id").select("query_id", F.col("canonical_id").alias("src"), "dst")
    return half.join(e.select("query_id", F.col("canonical_id").alias("dst")), ["query_id", "dst"]).select("query_id", "src", "dst")


def refresh_golds(golds: DataFrame, pages: DataFrame, head: int = 50) -> DataFrame:
    """``item_id, page, pdf_page``: where a gold's first characters stand now in its source: its page, else the nearest page that has them, else null."""
    g = golds.select("item_id", "source", F.col("pdf_page").alias("page"), F.substring(normalize_for_matching(F.col("ground_truth")), 1, head).alias("g")).where(F.length("g") > 0)
    p = pages.select("source", F.col("page").alias("at"), normalize_for_matching(F.col("text")).alias("t"))
    hit = g.join(p, "source").where(F.col("t").contains(F.col("g"))).groupBy("item_id").agg(F.min(F.struct(F.coalesce(F.abs(F.col("at") - F.col("page")), F.lit(1 << 30)).alias("far"), "at"))["at"].alias("pdf_page"))
    return golds.select("item_id", F.col("pdf_page").alias("page")).join(hit, "item_id", "left")


def spans_of(text: Column, most: int = 5) -> Column:
    """The longest runs of two to five words of four letters or more in a gold, up to ``most``, longest first: the spans an answer must hold."""
    runs = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{4,}(?: \p{L}{4,}){1,4}"), F.lit(0)))
    return F.transform(F.slice(F.array_sort(F.transform(runs, lambda r: F.struct((-F.length(r)).alias("l"), r.alias("r")))), 1, most), lambda x: x["r"])


def passage_around(text: Column, marker: Column, before: int = 100, after: int = 400) -> Column:
    """The text from ``before`` characters ahead of a marker's first occurrence to ``after`` behind it, null without one."""
    at = F.position(marker, text)
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, text.substr(start, at + after - start))


def merge_golds(existing: DataFrame, candidates: DataFrame, handmade: DataFrame, total: int) -> DataFrame:
    """Existing, then new candidates, then handmade ones not seen, cut to ``total``."""
    both = existing.select("query", F.lit(0).alias("part")).union(candidates.select("query", F.lit(1))).union(handmade.select("query", F.lit(2)))
    first = both.groupBy("query").agg(F.min("part").alias("part"))
    return first.orderBy("part", "query").limit(total)
