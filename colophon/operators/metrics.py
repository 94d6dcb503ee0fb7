"""Retrieval and answer metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.functions.text import normalize_for_comparison, normalize_for_matching


def judge(results: DataFrame, golds: DataFrame) -> DataFrame:
    """M1, M5: ``query_id, rank, source_hit, term_share, page_hit, relevant``.

    ``results``: ``query_id, rank, text, source, page_start, page_end``; ``golds``:
    ``query_id, expected_source, expected_terms, first_page, last_page``.  Relevant:
    right source and more than .3 of the terms.
    """
    low = F.lower("text")
    terms = F.coalesce("expected_terms", F.array().cast("array<string>"))
    share = F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: low.contains(F.lower(t)))) / F.size(terms)).otherwise(F.lit(1.0))
    source = F.when(F.coalesce("expected_source", F.lit("")) == "", True).otherwise(F.coalesce(F.lower("source").contains(F.lower("expected_source")), F.lit(False)))
    page = F.when(F.coalesce("first_page", F.lit(0)) > 0, (F.coalesce("page_start", F.lit(0)) >= F.col("first_page")) & (F.coalesce("page_end", F.lit(0)) > 0) & (F.col("page_end") <= F.col("last_page")))
    j = results.join(golds, "query_id").select("query_id", "rank", source.alias("source_hit"), share.alias("term_share"), page.alias("page_hit"))
    return j.withColumn("relevant", F.when(F.col("source_hit") & (F.col("term_share") > 0.3), 1.0).otherwise(0.0))


def ranking_metrics(judged: DataFrame, k: int = 10, relevance: str = "relevant") -> DataFrame:
    """M2-M4: ``query_id, precision, mrr, ndcg``: precision over the rows returned, the ideal from them too."""
    r = F.col(relevance)
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(relevance), "rank"))
    rows = judged.withColumn("_i", ideal)
    top = F.col("rank") < k
    return rows.groupBy("query_id").agg(
        F.round(F.sum(F.when(top & (r > 0), 1).otherwise(0)) / F.count_if(top), 6).alias("precision"),
        F.round(F.coalesce(1 / (F.min(F.when(r > 0, F.col("rank"))) + 1), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.sum(F.when(top, r / F.log2(F.col("rank") + F.lit(2.0)))) / F.nullif(F.sum(F.when(F.col("_i") <= k, r / F.log2(F.col("_i") + F.lit(1.0)))), F.lit(0.0)), F.lit(0.0)), 6).alias("ndcg"),
    )


def _core(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"^\d{4}\s+|\.pdf$", ""))


def source_match(found: Column, wanted: Column, n: int = 20) -> Column:
    """Heads of ``n`` characters contain one another, year and extension aside."""
    a, b = _core(found), _core(wanted)
    return F.coalesce((F.length(found) > 0) & (F.length(wanted) > 0) & (a.contains(F.substring(b, 1, n)) | b.contains(F.substring(a, 1, n))), F.lit(False))


def page_match(page_start: Column, page_end: Column, gold: Column) -> Column:
    """The gold page within one page of the span."""
    a = F.coalesce(page_start, F.lit(0))
    b = F.when(F.coalesce(page_end, F.lit(0)) == 0, a).otherwise(page_end)
    return (a > 0) & (F.coalesce(gold, F.lit(0)) > 0) & (gold - 1 <= b) & (gold + 1 >= a)


def quote_match(text: Column, quote: Column) -> Column:
    """M6: the quote's first 40 characters, case and spaces aside, in the text."""
    key = F.trim(F.regexp_replace(F.substring(F.lower(quote), 1, 40), r"(?U)\s+", " "))
    return F.coalesce((F.length(key) > 0) & F.regexp_replace(F.lower(text), r"(?U)\s+", " ").contains(key), F.lit(False))


def sample_scores(results: DataFrame) -> DataFrame:
    """M6: hit@1, 5, 10 and reciprocal rank per query, from ``query_id, rank, source, text, page_start, page_end, gold_source, gold_page, gold_quote``."""
    src, page, quote = source_match(F.col("source"), F.col("gold_source")), page_match(F.col("page_start"), F.col("page_end"), F.col("gold_page")), quote_match(F.col("text"), F.col("gold_quote"))
    at = lambda hit, k: F.max(F.when(hit & (F.col("rank") < k), 1.0).otherwise(0.0))
    return results.groupBy("query_id").agg(
        *[at(src, k).alias(f"source_p_{k}") for k in (1, 5, 10)],
        *[at(page, k).alias(f"page_hit_{k}") for k in (1, 5, 10)],
        *[at(quote, k).alias(f"quote_hit_{k}") for k in (5, 10)],
        F.coalesce(F.round(1 / (F.min(F.when(page, F.col("rank"))) + 1), 6), F.lit(0.0)).alias("mrr"),
    )


def means(scores: DataFrame, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """The mean of every number column, rounded."""
    names = [f.name for f in scores.schema if f.dataType.typeName() in ("double", "float", "integer", "long") and f.name not in (by or []) and f.name != "query_id"]
    return scores.groupBy(*(by or [])).agg(*[F.round(F.avg(c), digits).alias(c) for c in names])


def deltas(scores: DataFrame, arm: str, a: str, b: str, digits: int = 4) -> DataFrame:
    """``metric, a, b, delta`` of two arms of a table of means."""
    names = [c for c in scores.columns if c != arm]
    long = scores.select(arm, F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.col(c).cast("double") for c in names]))).alias("metric", "value"))
    wide = long.groupBy("metric").agg(F.max(F.when(F.col(arm) == a, F.col("value"))).alias("a"), F.max(F.when(F.col(arm) == b, F.col("value"))).alias("b"))
    return wide.withColumn("delta", F.round(F.col("b") - F.col("a"), digits))


def recall(found: Column, wanted: Column, digits: int = 4) -> Column:
    """M8: share of the wanted set that was found; 0 for an empty wanted set."""
    return F.when(F.size(wanted) > 0, F.round(F.size(F.array_intersect(found, F.array_distinct(wanted))) / F.size(F.array_distinct(wanted)), digits)).otherwise(F.lit(0.0))


def edge_recall(sets: Column, edges: Column, digits: int = 4) -> Column:
    """Share of pairs that some one set of ids holds whole."""
    pairs = F.filter(edges, lambda e: F.size(e) == 2)
    held = F.filter(pairs, lambda e: F.exists(sets, lambda s: F.array_contains(s, F.get(e, F.lit(0))) & F.array_contains(s, F.get(e, F.lit(1)))))
    return F.when(F.size(pairs) > 0, F.round(F.size(held) / F.size(pairs), digits)).otherwise(F.lit(0.0))


def span_rate(text: Column, spans: Column, digits: int = 4) -> Column:
    """Share of spans that the normalised text contains."""
    t = normalize_for_matching(text)
    kept = F.filter(spans, lambda s: s != "")
    return F.when(F.size(kept) > 0, F.round(F.size(F.filter(kept, lambda s: t.contains(normalize_for_matching(s)))) / F.size(kept), digits)).otherwise(F.lit(0.0))


def composite(works: Column, spans: Column, entities: Column, entailment: Column) -> Column:
    """.35, .35, .20, .10."""
    return F.round(0.35 * works + 0.35 * spans + 0.20 * entities + 0.10 * entailment, 4)


def citation_quality(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row ``n_sentences, n_citations, recall, precision``.

    ``pairs``: ``sentence_id, citation_id, entailment`` (the best of the chunks cited, 0
    without one).  A sentence counts as recalled if one of its citations entails it.
    """
    by = pairs.groupBy("sentence_id").agg(F.max("entailment").alias("best"), F.count("*").alias("n"), F.count_if(F.col("entailment") >= threshold).alias("ok"))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    total = by.agg(F.count("*").alias("n_sentences"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_citations"), F.count_if(F.col("best") >= threshold).alias("r"), F.coalesce(F.sum("ok"), F.lit(0)).alias("p"))
    return total.select("n_sentences", "n_citations", F.round(share(F.col("r"), F.col("n_sentences")), 6).alias("recall"), F.round(share(F.col("p"), F.col("n_citations")), 6).alias("precision"))


def overlap_entailment(premise: Column, sentence: Column) -> Column:
    """M11's model-free default: the share of a sentence's longer words that the premise has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\W+"), lambda w: F.length(w) > 3))
    return F.when(F.size(words(sentence)) > 0, F.size(F.array_intersect(words(premise), words(sentence))) / F.size(words(sentence))).otherwise(F.lit(0.0))


#: Parts of a group's range of values; ranks are sought inside one part only.
PARTS = 4096


def nearest_rank(values: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles ``sorted[int(n * p)]``, with min, max, mean and n.

    Few groups may hold very many rows, so no window runs over a group: a pre-aggregated
    histogram of ``PARTS`` parts tells which part holds the rank, and only the distinct
    values of that part are put in order.  Groups may be null; null values do not count.
    """
    v = values.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    total = v.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.avg("_v").alias("_mean"))
    null_safe = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    t = total.alias("t")
    spread = F.greatest(F.col("t._hi") - F.col("t._lo"), F.lit(1e-300))
    part = F.least(F.floor((F.col("v._v") - F.col("t._lo")) / spread * PARTS), F.lit(PARTS - 1)).cast("int")
    rows = v.alias("v").join(t, null_safe("v", "t")).select(*[F.col(f"v.{c}").alias(c) for c in by], "_v", part.alias("_p"))
    rows = rows.groupBy(*by, "_p", "_v").agg(F.count("*").alias("_c"))  # distinct values, counted before they move
    order = Window.partitionBy(*by).orderBy("_p")
    hist = rows.groupBy(*by, "_p").agg(F.sum("_c").alias("_c")).withColumn("_upto", F.sum("_c").over(order))
    picks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("t.n") * p), F.col("t.n") - 1).alias("r")) for name, p in shares.items()])).alias("pick")
    wanted = t.select(*[F.col(f"t.{c}").alias(c) for c in by], picks).select(*by, "pick.*").alias("w")
    found = hist.alias("h").join(wanted, null_safe("h", "w")).where("h._upto - h._c <= w.r and w.r < h._upto")
    found = found.select(*[F.col(f"h.{c}").alias(c) for c in by], F.col("h._p").alias("_p"), "name", (F.col("r") - F.col("_upto") + F.col("_c")).alias("r")).alias("f")
    inside = rows.alias("x").join(found, [*null_safe("x", "f"), F.col("x._p") == F.col("f._p")]).select(*[F.col(f"x.{c}").alias(c) for c in by], "_v", "_c", "name", "r")
    upto = F.sum("_c").over(Window.partitionBy(*by, "name").orderBy("_v"))
    hit = inside.withColumn("_upto", upto).where("_upto - _c <= r and r < _upto")
    wide = hit.groupBy(*by).agg(*[F.round(F.max(F.when(F.col("name") == name, F.col("_v"))), 2).alias(name) for name in shares]).alias("p")
    out = total.alias("t").join(wide, null_safe("t", "p"))
    return out.select(*[F.col(f"t.{c}").alias(c) for c in by], F.col("t.n"), F.round("t._lo", 2).alias("min"), F.round("t._hi", 2).alias("max"), F.round("t._mean", 2).alias("mean"), *[F.col(f"p.{name}") for name in shares])


def term_report(quotes: DataFrame, expected: DataFrame) -> DataFrame:
    """``query_id, n_quotes, verify_rate, source_coverage, enough`` of exhaustive answers.

    ``quotes``: ``query_id, status, source``; ``expected``: ``query_id, expected_sources, min_citations``.
    """
    by = quotes.groupBy("query_id").agg(F.count("*").alias("n_quotes"), F.count_if(F.col("status") == "verified").alias("ok"), F.collect_set("source").alias("found"))
    j = expected.join(by, "query_id", "left")
    n = F.coalesce("n_quotes", F.lit(0))
    hit = F.size(F.filter("expected_sources", lambda w: F.exists(F.coalesce("found", F.array().cast("array<string>")), lambda s: source_match(s, w))))
    return j.select("query_id", n.alias("n_quotes"), F.round(F.coalesce(F.col("ok") / F.nullif(n, F.lit(0)), F.lit(0.0)), 4).alias("verify_rate"), F.round(F.coalesce(hit / F.nullif(F.size("expected_sources"), F.lit(0)), F.lit(0.0)), 4).alias("source_coverage"), (n >= F.col("min_citations")).alias("enough"))


def page_accuracy(pages: Column, expected: Column, slack: int = 0) -> Column:
    """Share of cited pages that are expected, or within ``slack`` of one; 0 without a cited page."""
    near = F.filter(pages, lambda p: F.exists(expected, lambda e: F.abs(p - e) <= slack))
    return F.when(F.size(pages) > 0, F.round(F.size(near) / F.size(pages), 4)).otherwise(F.lit(0.0))


def named_share(text: Column, names: Column) -> Column:
    """Share of names, concepts or stages that a text mentions, case aside."""
    low = F.lower(text)
    return F.when(F.size(names) > 0, F.round(F.size(F.filter(names, lambda n: low.contains(F.lower(n)))) / F.size(names), 4)).otherwise(F.lit(0.0))


def citation_outcome(n_quotes: Column, text: Column) -> Column:
    """QUOTED with quotes, ABSTAINED for a stated refusal, else NO_QUOTES."""
    return F.when(n_quotes > 0, "QUOTED").when(F.lower(text).contains("could not find"), "ABSTAINED").otherwise("NO_QUOTES")


def work_fragment(source: Column) -> Column:
    """What an answer must name of a work: up to the first `` - `` and a fixed word, 20 characters at most, in lower case."""
    return F.substring(F.lower(F.trim(F.substring_index(F.substring_index(source, " - ", 1), "Capitalism", 1))), 1, 20)


def _named_works(text: Column, works: Column) -> Column:
    low = F.lower(text)
    return F.size(F.filter(works, lambda w: low.contains(work_fragment(w))))


def _quote_counts(quotes: DataFrame) -> DataFrame:
    return quotes.groupBy("query_id").agg(F.count("*").alias("_n"), F.count_if("verified").alias("_ok"))


def exhaustive_scores(answers: DataFrame, quotes: DataFrame, expected: DataFrame) -> DataFrame:
    """``query_id, quotes, raw_quotes, hallucinated, verify_rate, source_coverage, term_coverage, meets_minimum``.

    ``answers``: ``query_id, text``; ``quotes``: ``query_id, verified`` of each quote found;
    ``expected``: ``query_id, expected_sources, expected_terms, min_citations``.  Quotes that
    no chunk confirms are set aside first, so the rest are all verified.
    """
    j = answers.join(expected, "query_id").join(_quote_counts(quotes), "query_id", "left").na.fill(0, ["_n", "_ok"])
    low = F.lower("text")
    terms = F.coalesce("expected_terms", F.array().cast("array<string>"))
    works = F.coalesce("expected_sources", F.array().cast("array<string>"))
    share = lambda a, b: F.round(a / F.greatest(F.size(b), F.lit(1)), 3)
    return j.select(
        "query_id", F.col("_ok").alias("quotes"), F.col("_n").alias("raw_quotes"), (F.col("_n") - F.col("_ok")).alias("hallucinated"),
        F.when(F.col("_ok") > 0, 1.0).otherwise(0.0).alias("verify_rate"), share(_named_works(F.col("text"), works), works).alias("source_coverage"),
        share(F.size(F.filter(terms, lambda t: low.contains(F.lower(t)))), terms).alias("term_coverage"), (F.col("_ok") >= F.coalesce("min_citations", F.lit(3))).alias("meets_minimum"),
    )


def precis_scores(answers: DataFrame, quotes: DataFrame, expected: DataFrame) -> DataFrame:
    """``query_id, quotes, verified, verify_rate, works_cited, meets_works, has_drift, stage_coverage, meets_quotes``.

    ``expected``: ``query_id, works_required, expected_stages, min_works_cited, min_quotes``.
    """
    j = answers.join(expected, "query_id").join(_quote_counts(quotes), "query_id", "left").na.fill(0, ["_n", "_ok"])
    text = F.col("text")
    works = F.size(F.array_distinct(F.filter(F.coalesce("works_required", F.array().cast("array<string>")), lambda w: F.lower(text).contains(work_fragment(w)))))
    return j.select(
        "query_id", F.col("_n").alias("quotes"), F.col("_ok").alias("verified"), F.round(F.col("_ok") / F.greatest("_n", F.lit(1)), 3).alias("verify_rate"), works.alias("works_cited"),
        (works >= F.coalesce("min_works_cited", F.lit(2))).alias("meets_works"), (drift_markers(text) >= 2).alias("has_drift"), stage_coverage(text, F.coalesce("expected_stages", F.array().cast("array<string>"))).alias("stage_coverage"),
        (F.col("_n") >= F.coalesce("min_quotes", F.lit(3))).alias("meets_quotes"),
    )


def general_scores(answers: DataFrame, quotes: DataFrame, expected: DataFrame, context: DataFrame) -> DataFrame:
    """``query_id, quote_count, verified_quotes, verification_rate, page_accuracy, concept_coverage, expected_quote_coverage``.

    ``answers``: ``query_id, text, cited_pages``; ``expected``: ``query_id,
    expected_pages, expected_concepts, expected_quotes``; ``context``: ``query_id, text``,
    the chunks retrieved for the question.  An expected quote counts by its first 30
    normalised characters.
    """
    wanted = expected.select("query_id", F.explode("expected_quotes").alias("q")).select("query_id", F.substring(normalize_for_comparison(F.col("q")), 1, 30).alias("q"))
    seen = wanted.join(context.select("query_id", normalize_for_comparison(F.col("text")).alias("t")), "query_id").groupBy("query_id", "q").agg(F.max(F.col("t").contains(F.col("q"))).alias("hit")).groupBy("query_id").agg(F.count_if("hit").alias("_hits"))
    j = answers.join(expected, "query_id").join(_quote_counts(quotes), "query_id", "left").join(seen, "query_id", "left").na.fill(0, ["_n", "_ok", "_hits"])
    share = lambda a, b: F.when(F.size(b) > 0, F.round(a / F.size(b), 3)).otherwise(F.lit(0.0))
    low, pages = F.lower("text"), F.col("expected_pages")
    right = F.size(F.filter("cited_pages", lambda p: F.array_contains(pages, p)))
    return j.select(
        "query_id", F.col("_n").alias("quote_count"), F.col("_ok").alias("verified_quotes"), F.coalesce(F.col("_ok") / F.nullif(F.col("_n"), F.lit(0)), F.lit(0.0)).alias("verification_rate"),
        F.when(F.size(pages) > 0, share(right, F.col("cited_pages"))).otherwise(F.lit(0.0)).alias("page_accuracy"),
        share(F.size(F.filter("expected_concepts", lambda c: low.contains(F.lower(c)))), F.col("expected_concepts")).alias("concept_coverage"), share(F.col("_hits"), F.col("expected_quotes")).alias("expected_quote_coverage"),
    )


def citation_scores(answers: DataFrame, quotes: DataFrame) -> DataFrame:
    """``query_id, status, num_quotes, grounded_cited, grounded_expected, grounded_pdf, ground_truth, page_exact, page_near``.

    ``answers``: ``query_id, text, expected_page``; ``quotes``: ``query_id, cited_page,
    on_cited, on_expected, in_source, like_gold``, each quote's ratios (:func:`verify.page_ratio`).
    The best of each counts; answers without quotes have nulls.
    """
    best = lambda c: F.round(F.max(c), 3)
    j = quotes.join(answers.select("query_id", "expected_page"), "query_id")
    near = F.coalesce(F.max((F.col("cited_page") > 0) & (F.abs(F.col("cited_page") - F.col("expected_page")) <= 1)), F.lit(False))
    per = j.groupBy("query_id").agg(F.count("*").alias("num_quotes"), best("on_cited").alias("grounded_cited"), best("on_expected").alias("grounded_expected"), best("in_source").alias("grounded_pdf"), best("like_gold").alias("ground_truth"), F.coalesce(F.max(F.col("cited_page") == F.col("expected_page")), F.lit(False)).alias("page_exact"), near.alias("page_near"))
    out = answers.join(per, "query_id", "left")
    n = F.coalesce("num_quotes", F.lit(0))
    return out.select("query_id", citation_outcome(n, F.col("text")).alias("status"), n.alias("num_quotes"), "grounded_cited", "grounded_expected", "grounded_pdf", "ground_truth", "page_exact", "page_near")


# Words that mark a change from work to work.
DRIFT = ("shift", "contrast", "earlier", "later", "transform", "develop", "evolve", "change", "building on", "unlike", "whereas", "moved from", "marks a", "depart", "extend", "expand", "narrow", "different")


def drift_markers(text: Column) -> Column:
    """How many of the fixed words of change a text contains; two or more make a drift."""
    low = F.lower(text)
    return sum((low.contains(w).cast("int") for w in DRIFT), F.lit(0))


def stage_coverage(text: Column, stages: Column) -> Column:
    """Share of stages of which at least half of the comma-separated terms of over three characters, one at least, stand in a text."""
    low = F.lower(text)

    def met(stage: Column) -> Column:
        terms = F.filter(F.transform(F.split(stage, ","), lambda t: F.lower(F.trim(t))), lambda t: F.length(t) > 3)
        held = F.size(F.filter(terms, lambda t: low.contains(t)))
        return (F.size(terms) > 0) & (held >= F.greatest(F.lit(1), F.floor(F.size(terms) / 2)))

    return F.round(F.size(F.filter(stages, met)) / F.greatest(F.size(stages), F.lit(1)), 3)
