"""Quotes checked against their sources (V1-V18, V28, M23; of V2 not the lemma tier).

Exact checks come first and are joins: a quote meets a chunk through its rarest word
n-gram, and the substring test runs on those pairs only.  Quotes left over meet, through single rare words, the
chunks most like them for the fuzzy tier.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colophon.functions.anchors import CITATION_TAG, citation_tags, nearest_quote
from colophon.functions.text import normalize_for_matching, strip_for_comparison
from colophon.operators.contain import contained
from colophon.storage import written

MIN_QUOTE, FUZZY, SHINGLE = 20, 0.85, 3


def extract_quotes(text: Column) -> Column:
    """V1: straight, then curly quotes of ten characters or more, then blockquotes; each once, in this order."""
    straight = F.regexp_extract_all(text, F.lit('"([^"]{10,})"'), F.lit(1))
    curly = F.regexp_extract_all(text, F.lit("“([^”]{10,})”"), F.lit(1))
    runs = F.regexp_extract_all(text, F.lit(r"(?:(?:\A|(?<=\n))[^\S\n]*>[^\n]*(?:\n|\z))+"), F.lit(0))
    block = F.transform(
        runs,
        lambda run: F.array_join(F.transform(F.split(F.regexp_replace(run, r"\n\z", ""), "\n"), lambda line: F.trim(F.regexp_replace(F.trim(line), r"\A[> ]+", ""))), " "),
    )
    return F.array_distinct(F.concat(straight, curly, F.filter(block, lambda b: F.length(b) >= 10)))


def match_key(text: Column) -> Column:
    """T10 with markdown, then T11: the form in which quotes and chunks are compared."""
    return strip_for_comparison(normalize_for_matching(text, markdown=True))


def words_in(text: Column) -> Column:
    """Words of a text in any script."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))


def shingles(words: Column, n: int = SHINGLE) -> Column:
    """Distinct word n-grams of a column of words; fewer words are one of their own.

    ``words`` must be a column of its own: an expression would run again for every n-gram.
    """
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(grams)).otherwise(F.filter(F.array(F.array_join(words, " ")), lambda w: w != ""))


def containment_pairs(needles: DataFrame, hay: DataFrame, needle_key: str, hay_key: str) -> DataFrame:
    """``needle_key, hay_key`` where a needle's ``k`` is a substring of a hay's ``k``.

    Of the whole-word shingles inside a needle (its first and last word may be cut) the
    one in fewest hays leads to its candidates, so a common turn of phrase leads
    nowhere.  Needles of fewer than five words are sought by one automaton.
    """
    # Keys get names of their own, so that a key may be called anything.
    needles, hay = needles.select(F.col(needle_key).alias("_a"), F.col("k").alias("_nk")), hay.select(F.col(hay_key).alias("_b"), F.col("k").alias("_hk"))
    w = written(needles.withColumn("_w", words_in(F.col("_nk"))), "needles")
    big, small = w.where(F.size("_w") >= SHINGLE + 2), w.where(F.size("_w") < SHINGLE + 2)
    inner = big.select("_a", F.slice("_w", F.lit(2), F.size("_w") - 2).alias("_w")).select("_a", F.explode(shingles(F.col("_w"))).alias("_gram"))
    # Keys move with the shingles, texts only to the candidates left.
    grams = hay.select("_b", words_in(F.col("_hk")).alias("_w")).select("_b", F.explode(shingles(F.col("_w"))).alias("_gram")).join(inner.select("_gram").distinct(), "_gram", "left_semi")
    grams = written(grams, "shingles")
    counts = grams.groupBy("_gram").agg(F.count("*").alias("_n"))
    # A needle with a shingle that no hay has is contained in none.
    rarest = inner.join(counts, "_gram", "left").groupBy("_a").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_r")).where("_r.n > 0").select("_a", F.col("_r.gram").alias("_gram"))
    near = grams.join(rarest, "_gram").join(big.select("_a", "_nk"), "_a").select("_a", "_nk", "_b")
    found = near.join(hay, "_b").where(F.col("_hk").contains(F.col("_nk"))).select("_a", "_b")
    short = contained(hay, small, "_b", "_hk", "_nk").join(small.select("_a", "_nk"), "_nk").select("_a", "_b")
    return found.union(short).distinct().select(F.col("_a").alias(needle_key), F.col("_b").alias(hay_key))


@F.pandas_udf(returnType=T.DoubleType())
def window_ratio(quote: pd.Series, text: pd.Series) -> pd.Series:
    """V4: best similarity of a quote with windows of its length; stops at the first above the threshold.

    The standard library's matcher; scores differ from other fuzzy matchers.
    """
    out = []
    for q, t in zip(quote, text):
        if not q or not t:
            out.append(0.0)
        elif len(q) >= len(t):
            out.append(SequenceMatcher(None, q, t).ratio())
        else:
            best = 0.0
            letters = Counter(q)
            for start in range(0, len(t) - len(q) + 1, max(1, len(q) // 4)):
                window = t[start : start + len(q)]
                # Shared letters bound the ratio from above: most windows end here.
                if (letters & Counter(window)).total() / len(q) <= best:
                    continue
                best = max(best, SequenceMatcher(None, q, window).ratio())
                if best >= FUZZY:
                    break
            out.append(best)
    return pd.Series(out)


def verify_quotes(quotes: DataFrame, chunks: DataFrame, fuzzy: bool = True, candidates: int | None = 5) -> DataFrame:
    """V2, V3: ``quote_id, status, source, page, similarity``.

    ``quotes``: ``quote_id, quote``; ``chunks``: ``chunk_ord, text, source, page_start``.
    Under 20 characters: too_short.  Else the first chunk in order that contains the
    quote (normalised, or also stripped) verifies it.  The rest go to the fuzzy tier
    against the ``candidates`` chunks that share most of their word pairs (None: all that
    share any): approximate from .85, unverified below.
    """
    marked = quotes.select("quote_id", "quote", match_key(F.col("quote")).alias("k"))
    long_enough = marked.where(F.length("quote") >= MIN_QUOTE)
    short = marked.where(F.length("quote") < MIN_QUOTE).select("quote_id", F.lit("too_short").alias("status"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("page"), F.lit(0.0).alias("similarity"))
    hay = chunks.select("chunk_ord", match_key(F.col("text")).alias("k"))
    info = chunks.select("chunk_ord", "source", F.col("page_start").cast("int").alias("page"))
    pairs = containment_pairs(long_enough.select("quote_id", "k"), hay, "quote_id", "chunk_ord")
    exact = pairs.groupBy("quote_id").agg(F.min("chunk_ord").alias("chunk_ord")).join(info, "chunk_ord").select("quote_id", F.lit("verified").alias("status"), "source", "page", F.lit(1.0).alias("similarity"))
    left = long_enough.join(exact.select("quote_id"), "quote_id", "left_anti")
    none = left.select("quote_id", F.lit("unverified").alias("status"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("page"), F.lit(0.0).alias("similarity"))
    if not fuzzy:
        return exact.unionByName(short).unionByName(none)
    near = (
        left.select("quote_id", words_in(F.col("k")).alias("w")).select("quote_id", F.explode(shingles(F.col("w"), 2)).alias("g"))
        .join(hay.select("chunk_ord", words_in(F.col("k")).alias("w")).select("chunk_ord", F.explode(shingles(F.col("w"), 2)).alias("g")), "g")
        .groupBy("quote_id", "chunk_ord")
        .agg(F.count("*").alias("n"))
    )
    if candidates is not None:
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("quote_id").orderBy(F.desc("n"), "chunk_ord"))).where(F.col("r") <= candidates)
    paired = near.join(left.select("quote_id", F.col("k").alias("q")), "quote_id").join(hay.select("chunk_ord", F.col("k").alias("t")), "chunk_ord")
    # Few bytes but much work a pair: all cores take part whatever the size.
    cores = max(paired.sparkSession.sparkContext.defaultParallelism, int(paired.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    scored = paired.repartition(cores, "quote_id", "chunk_ord").withColumn("s", window_ratio("q", "t"))
    best = scored.groupBy("quote_id").agg(F.max(F.struct("s", (-F.col("chunk_ord")).alias("o"))).alias("b")).select("quote_id", F.col("b.s").alias("s"), (-F.col("b.o")).alias("chunk_ord"))
    graded = best.join(info, "chunk_ord").select("quote_id", F.when(F.col("s") >= FUZZY, "approximate").otherwise("unverified").alias("status"), F.when(F.col("s") >= FUZZY, F.col("source")).alias("source"), F.when(F.col("s") >= FUZZY, F.col("page")).alias("page"), F.round("s", 4).alias("similarity"))
    missing = none.join(graded.select("quote_id"), "quote_id", "left_anti")
    return exact.unionByName(short).unionByName(graded).unionByName(missing)


def cross_check_pages(results: DataFrame, pages: DataFrame) -> DataFrame:
    """``source_verified`` true or false by the quote's first 60 characters on the page or its neighbours, null without page text.

    ``results``: ``quote_id, quote, status, source, page``; ``pages``: ``source, page, text``.
    """
    asked = results.where("status in ('verified', 'approximate') and source is not null and page > 0")
    near = asked.select("quote_id", "source", F.substring(normalize_for_matching(F.col("quote"), True), 1, 60).alias("k"), F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)).alias("page"))
    seen = near.join(pages.select("source", "page", normalize_for_matching(F.col("text"), True).alias("t")), ["source", "page"]).groupBy("quote_id").agg(F.max(F.col("t").contains(F.col("k"))).alias("source_verified"))
    return results.join(seen, "quote_id", "left")


def find_file(names: DataFrame, files: DataFrame) -> DataFrame:
    """V6: ``source, file``: the first PDF, by name, that contains the source's title or name."""
    low = F.lower(F.regexp_replace("file", "[_-]", " "))
    f = files.select("file", low.alias("f")).where(F.lower("file").endswith(".pdf"))
    s = names.select("source", F.trim(F.regexp_replace(F.lower("source"), r"^\d{4}\s+", "")).alias("t"), F.lower("source").alias("l"))
    f = f.withColumn("w", F.explode(F.array_distinct(F.regexp_extract_all("f", F.lit(r"(?U)\w+"), F.lit(0)))))
    s = s.withColumn("w", F.try_element_at(F.regexp_extract_all("t", F.lit(r"(?U)\w{3,}"), F.lit(0)), F.lit(1)))
    hit = s.join(f, "w").where((F.length("t") > 0) & (F.col("f").contains(F.col("t")) | F.col("f").contains(F.col("l"))))
    return hit.groupBy("source").agg(F.min("file").alias("file"))


def repair_citations(answers: DataFrame, chunks: DataFrame, fuzzy: bool = False) -> DataFrame:
    """V8: ``answer_id, repaired, corrections`` with each tag's page and title from the chunk that holds the quote before it.

    A tag without a quote of 15 characters in the 400 before it, or whose quote no chunk
    holds, becomes ``[unverified]``.  ``answers``: ``answer_id, text``.
    """
    parts = answers.select("answer_id", "text", F.split("text", CITATION_TAG).alias("between"), citation_tags(F.col("text")).alias("tags"))
    tags = parts.where(F.size("tags") > 0).select("answer_id", "between", "tags", F.posexplode("tags").alias("i", "tag"))
    before = F.aggregate(F.slice(F.zip_with("between", "tags", lambda b, t: F.concat(b, F.coalesce(t["tag"], F.lit("")))), 1, F.col("i") + 1), F.lit(""), lambda a, b: F.concat(a, b))
    before = F.substring(before, 1, F.length(before) - F.length("tag.tag"))
    quoted = tags.select("answer_id", "i", F.col("tag.tag").alias("tag"), F.col("tag.title").alias("title"), nearest_quote(F.substring(before, -400, 400)).alias("quote")).withColumn("quote_id", F.concat_ws("#", F.col("answer_id").cast("string"), F.col("i").cast("string")))
    checked = verify_quotes(quoted.where("quote is not null").select("quote_id", "quote"), chunks, fuzzy)
    fixed = quoted.join(checked, "quote_id", "left").select(
        "answer_id", "i", "tag", "quote",
        F.when(F.col("status").isin("verified", "approximate") & (F.coalesce("page", F.lit(0)) > 0), F.concat(F.lit("[Source: "), F.coalesce("source", "title"), F.lit(", p. "), F.col("page").cast("string"), F.lit("]"))).otherwise(F.lit("[unverified]")).alias("new"),
    )
    grouped = fixed.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("i", "tag", "quote", "new"))).alias("fixes"))
    joined = parts.join(grouped, "answer_id", "left")
    rebuilt = F.aggregate(F.zip_with("between", "fixes", lambda b, f: F.concat(b, F.coalesce(f["new"], F.lit("")))), F.lit(""), lambda a, b: F.concat(a, b))
    preview = lambda q: F.when(F.length(q) > 60, F.concat(F.substring(q, 1, 60), F.lit("…"))).otherwise(F.coalesce(q, F.lit("")))
    changes = F.transform(F.filter("fixes", lambda f: f["new"] != f["tag"]), lambda f: F.struct(f["tag"].alias("original"), f["new"].alias("corrected"), preview(f["quote"]).alias("quote")))
    return joined.select("answer_id", F.when(F.col("fixes").isNull(), F.col("text")).otherwise(rebuilt).alias("repaired"), F.coalesce(changes, F.array().cast("array<struct<original:string,corrected:string,quote:string>>")).alias("corrections"))


def verification_footer(results: DataFrame) -> DataFrame:
    """``answer_id, footer`` from ``answer_id, seq, quote, status, similarity, source_verified``; empty without a quote long enough.  The phrases are fixed values."""
    shown = F.when(F.length("quote") > 80, F.concat(F.substring("quote", 1, 80), F.lit("..."))).otherwise(F.col("quote"))
    fits = results.where("status <> 'too_short'")
    missed = (F.col("status") == "verified") & (F.coalesce("source_verified", F.lit(True)) == F.lit(False))
    line = F.when(missed, F.concat(F.lit('- ⚠ "'), shown, F.lit('" — verified in chunk but NOT found on cited page'))).when(
        F.col("status") != "verified",
        F.concat(F.lit("- "), F.when(F.col("status") == "approximate", "≈").otherwise("✗"), F.lit(' "'), shown, F.lit('" — '), F.col("status"), F.lit(" (similarity: "), F.format_string("%.0f%%", F.col("similarity") * 100), F.lit(")")),
    )
    n = lambda s: F.count_if(F.col("status") == s)
    agg = fits.withColumn("line", line).groupBy("answer_id").agg(
        F.count("*").alias("total"), n("verified").alias("v"), n("approximate").alias("a"), n("unverified").alias("u"), F.count("source_verified").alias("c"), F.count_if("source_verified").alias("ok"),
        F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("seq", "line")))).alias("lines"),
    )
    head = F.concat(
        F.format_string("\n---\n**Citation verification:** %d/%d verified", "v", "total"),
        F.when(F.col("a") > 0, F.format_string(", %d approximate", "a")).otherwise(""),
        F.when(F.col("u") > 0, F.format_string(", %d unverified", "u")).otherwise(""),
        F.when(F.col("c") > 0, F.format_string(" | %d/%d source-confirmed", "ok", "c")).otherwise(""),
    )
    return agg.select("answer_id", F.array_join(F.concat(F.array(head), F.transform("lines", lambda x: x["line"])), "\n").alias("footer"))


def corrections_footer(corrections: Column) -> Column:
    """The first ten corrections and how many more; empty without any."""
    n = F.size(corrections)
    lines = F.transform(F.slice(corrections, 1, 10), lambda c: F.concat(F.lit("- "), c["original"], F.lit(" → "), c["corrected"]))
    more = F.when(n > 10, F.concat(F.lit("\n- … and "), (n - 10).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(n > 0, F.concat(F.lit("\n\n**Citation corrections:**\n"), F.array_join(lines, "\n"), more)).otherwise("")


def find_quote_page(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """``quote_id, page``: the first page that holds the quote or one of its prefixes, each four fifths of the last, ten characters at least."""
    text = F.trim(F.regexp_replace("quote", r"(?U)\s+", " "))
    sizes = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.array(F.length(text)), lambda acc, _: F.when(F.floor(F.element_at(acc, -1) * 0.8) >= 10, F.concat(acc, F.array(F.floor(F.element_at(acc, -1) * 0.8).cast("int")))).otherwise(acc))
    q = quotes.select("quote_id", "source", text.alias("t"), sizes.alias("sizes")).withColumn("shortest", F.lower(F.expr("substring(t, 1, element_at(sizes, -1))")))
    p = pages.select("source", "page", F.lower(F.regexp_replace("text", r"(?U)\s+", " ")).alias("p"))
    # A page that holds any prefix holds the shortest.
    return q.join(p, "source").where(F.col("p").contains(F.col("shortest"))).groupBy("quote_id").agg(F.min("page").alias("page"))


def prefix_tier(quote: Column, text: Column, sizes: tuple[int, ...] = (80, 50, 40, 30)) -> Column:
    """The longest of the given prefixes of a quote that a text holds, 0 if none."""
    q, t = normalize_for_matching(quote), normalize_for_matching(text)
    out = F.lit(0)
    for n in sorted(sizes):
        out = F.when((F.length(q) >= F.least(F.lit(n), F.length(q))) & (F.length(q) > 0) & t.contains(F.substring(q, 1, n)), F.lit(n)).otherwise(out)
    return out


@F.pandas_udf(returnType=T.DoubleType())
def page_ratio(quote: pd.Series, page: pd.Series) -> pd.Series:
    """How much of a quote a page has: 1 if it contains it, else the best ratio of windows of its length, every sixth of it; stops at .98."""
    out = []
    for q, t in zip(quote, page):
        if not q or not t:
            out.append(0.0)
        elif q in t:
            out.append(1.0)
        else:
            best = 0.0
            for start in range(0, max(1, len(t) - len(q) + 1), max(1, len(q) // 6)):
                window = t[start : start + len(q)]
                if _most(q, window) <= best:
                    continue
                best = max(best, SequenceMatcher(None, q, window).ratio())
                if best >= 0.98:
                    break
            out.append(best)
    return pd.Series(out)


def _most(a: str, b: str) -> float:
    """A bound of the matcher's ratio: the letters shared."""
    return 2.0 * (Counter(a) & Counter(b)).total() / max(1, len(a) + len(b))


def quote_in_text(quote: Column, text: Column, sizes: tuple[int, ...], least: float) -> Column:
    """Whether a text holds one of a quote's prefixes or, failing that, a passage at least ``least`` alike."""
    return (prefix_tier(quote, text, sizes) > 0) | (window_ratio(normalize_for_matching(quote), normalize_for_matching(text)) >= least)


def quote_citation_pairs(text: Column) -> Column:
    """``ARRAY<STRUCT<quote, page>>``: quotes of 15 characters or more with a page within 300 characters after."""
    both = r'(?s)["“]([^"”]{15,})["”](?:(?!["“]).){0,300}?\bpp?\.\s*(\d+)'
    found = F.regexp_extract_all(text, F.lit(both), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, both, 1).alias("quote"), F.regexp_extract(m, both, 2).cast("int").alias("page")))


def drop_unverified(quotes: DataFrame, results: DataFrame) -> DataFrame:
    """The quotes that a chunk confirms."""
    return quotes.join(results.where("status in ('verified', 'approximate')").select("quote_id"), "quote_id", "left_semi")


def response_report(answers: DataFrame, chunks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``answer_id, repaired, corrections, footer``: repair, extract, verify, page check, footers."""
    fixed = repair_citations(answers, chunks)
    quotes = fixed.select("answer_id", F.posexplode(extract_quotes(F.col("repaired"))).alias("seq", "quote")).withColumn("quote_id", F.concat_ws("#", F.col("answer_id").cast("string"), F.col("seq").cast("string")))
    results = verify_quotes(quotes.select("quote_id", "quote"), chunks, fuzzy=False).join(quotes, "quote_id")
    results = cross_check_pages(results, pages) if pages is not None else results.withColumn("source_verified", F.lit(None).cast("boolean"))
    return fixed.join(verification_footer(results), "answer_id", "left").select("answer_id", "repaired", "corrections", F.concat(F.coalesce("footer", F.lit("")), corrections_footer(F.col("corrections"))).alias("footer"))
