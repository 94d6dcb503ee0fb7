"""Structured answers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colophon.functions.text import estimate_tokens, normalize_for_matching, short_title
from colophon.operators.verify import window_ratio

ANSWER_SCHEMA = "synthesis string, per_work array<struct<work:string,quote:string,page:string,gloss:string>>"


def _object(text: str | None) -> str | None:
    """The first balanced JSON object of a text, fences removed; null if there is none."""
    if not text:
        return None
    if fence := re.match(r"^\s*```(?:json)?\s*(.+?)\s*```\s*$", text, re.S):
        text = fence[1]
    start = text.find("{")
    if start < 0:
        return None
    try:
        found, _ = json.JSONDecoder().raw_decode(text[start:])
    except ValueError:
        return None
    return json.dumps(found, ensure_ascii=False)


@F.pandas_udf(returnType=T.StringType())
def loose_json(text: pd.Series) -> pd.Series:
    """The JSON object in a model's reply, fences and trailing text tolerated; null without one."""
    return text.map(_object)


def parse_answer(reply: Column) -> Column:
    """The reply as a structured answer, null if it holds no object."""
    return F.from_json(loose_json(reply), ANSWER_SCHEMA)


def fits_schema(answer: Column, n_required: Column) -> Column:
    """A synthesis and at least one entry per required work."""
    return F.coalesce((F.length(answer["synthesis"]) > 0) & (F.size(answer["per_work"]) >= n_required), F.lit(False))


def name_match(a: Column, b: Column) -> Column:
    """Short titles contain one another."""
    x, y = short_title(a), short_title(b)
    return F.coalesce((x != "") & (y != "") & (x.contains(y) | y.contains(x)), F.lit(False))


def chunks_per_work(chunks: DataFrame, works: DataFrame) -> DataFrame:
    """``query_id, work, n_chunks``; a chunk counts for the first work (``work_no``) its source matches; works without chunks have 0.

    Sources are matched once each, not chunk by chunk.
    """
    counts = chunks.where(F.length("source") > 0).groupBy("query_id", "source").agg(F.count("*").alias("c"))
    pairs = counts.join(works, "query_id").where(name_match(F.col("source"), F.col("work")))
    first = pairs.groupBy("query_id", "source").agg(F.min(F.struct("work_no", "work", "c")).alias("m"))
    per = first.groupBy("query_id", F.col("m.work").alias("work")).agg(F.sum("m.c").alias("n"))
    return works.join(per, ["query_id", "work"], "left").select("query_id", "work_no", "work", F.coalesce("n", F.lit(0)).cast("long").alias("n_chunks"))


def evidence_line(work: Column, quote: Column, page: Column, gloss: Column, no_chunks: Column) -> Column:
    """One bullet; empty without a work.  The phrases are fixed values."""
    w, q, p, g = (F.trim(F.coalesce(c, F.lit(""))) for c in (work, quote, page, gloss))
    q = F.regexp_replace(q, '^["“”]+|["“”]+$', "")
    start = F.concat(F.lit("- **"), w, F.lit(":** "))
    body = (
        F.when(no_chunks, "_no chunk for this work was retrieved — the corpus may not contain a passage answering this query._")
        .when((q != "") & (p != ""), F.concat(F.lit('"'), q, F.lit('" [Source: '), w, F.lit(", p. "), p, F.lit("]")))
        .when(q != "", F.concat(F.lit('"'), q, F.lit('"')))
        .otherwise("_no verbatim passage found in retrieved context._")
    )
    return F.when(w == "", "").otherwise(F.concat(start, body, F.when(g != "", F.concat(F.lit(" — "), g)).otherwise("")))


def render_answers(answers: DataFrame) -> DataFrame:
    """``query_id, markdown`` from ``query_id, answer, missing_works ARRAY<STRING>``."""
    missing = F.coalesce("missing_works", F.array().cast("array<string>"))
    entries = F.coalesce(F.col("answer.per_work"), F.array().cast("array<struct<work:string,quote:string,page:string,gloss:string>>"))
    lines = F.transform(entries, lambda e: evidence_line(e["work"], e["quote"], e["page"], e["gloss"], F.exists(missing, lambda w: name_match(e["work"], w))))
    gaps = F.filter(missing, lambda w: ~F.exists(entries, lambda e: name_match(e["work"], w)))
    gap_lines = F.transform(gaps, lambda w: evidence_line(F.initcap(F.coalesce(F.nullif(short_title(w), F.lit("")), w)), F.lit(""), F.lit(""), F.lit(""), F.lit(True)))
    evidence = F.filter(F.concat(lines, gap_lines), lambda x: x != "")
    synthesis = F.trim(F.coalesce(F.col("answer.synthesis"), F.lit("")))
    head = F.when((F.size(entries) > 0) | (F.size(missing) > 0), F.concat(F.array(F.lit("### Evidence"), F.lit("")), evidence)).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(F.when(synthesis != "", F.array(synthesis, F.lit(""))).otherwise(F.array().cast("array<string>")), head), "\n")
    return answers.select("query_id", F.regexp_replace(text, r"\s+$", "").alias("markdown"))


def coverage(answers: DataFrame) -> DataFrame:
    """Shares of required works in the entries and in the synthesis, and which lack.

    ``answers``: ``query_id, answer, required ARRAY<STRING>``; 1.0 without required works.
    """
    req = F.coalesce("required", F.array().cast("array<string>"))
    entries = F.coalesce(F.col("answer.per_work"), F.array().cast("array<struct<work:string,quote:string,page:string,gloss:string>>"))
    syn = F.lower(F.coalesce(F.col("answer.synthesis"), F.lit("")))
    has = F.filter(req, lambda w: F.exists(entries, lambda e: name_match(e["work"], w)))
    named = F.filter(req, lambda w: (short_title(w) != "") & syn.contains(short_title(w)))
    share = lambda x: F.when(F.size(req) > 0, F.round(F.size(x) / F.size(req), 4)).otherwise(F.lit(1.0))
    return answers.select("query_id", F.size(req).alias("n_required"), share(has).alias("per_work_coverage"), share(named).alias("synthesis_coverage"), F.array_except(req, has).alias("missing_in_per_work"), F.array_except(req, named).alias("missing_in_synthesis"))


def enforce_verbatim(entries: DataFrame, chunks: DataFrame, least: float = 0.85) -> DataFrame:
    """Quotes of 12 characters or more that no chunk of the query has, nor anything at least ``least`` alike, lose quote and page.

    ``entries``: ``query_id, work_no, quote, page``; ``chunks``: ``query_id, text``, the
    few retrieved for it.  Case and outer spaces aside.  A query without chunks keeps
    all.  Adds ``dropped``.  Equal texts and quotes are compared once.
    """
    key = F.lower(F.trim("quote"))
    asked = entries.where(F.length(key) >= 12).select("query_id", "work_no", key.alias("q"))
    texts = chunks.where(F.length("text") > 0).select("query_id", F.lower("text").alias("t")).distinct()
    pairs = asked.join(texts, "query_id").select("query_id", "work_no", "q", "t", F.col("t").contains(F.col("q")).alias("held"))
    whole = pairs.groupBy("query_id", "work_no").agg(F.max("held").alias("held"))
    left = pairs.join(whole.where("not held").select("query_id", "work_no"), ["query_id", "work_no"], "left_semi").withColumn("s", window_ratio("q", "t"))
    alike = left.groupBy("query_id", "work_no").agg(F.max("s").alias("s"))
    bad = alike.where(F.col("s") < least).select("query_id", "work_no", F.lit(True).alias("_bad")).distinct()
    j = entries.join(bad, ["query_id", "work_no"], "left").withColumn("dropped", F.coalesce("_bad", F.lit(False)))
    drop = F.col("dropped") & (F.length(key) >= 12)
    return j.withColumn("dropped", F.coalesce(drop, F.lit(False))).withColumn("quote", F.when(F.col("dropped"), "").otherwise(F.col("quote"))).withColumn("page", F.when(F.col("dropped"), "").otherwise(F.col("page"))).drop("_bad")


def answer_structured(answers: DataFrame, chunks: DataFrame, enforce: bool = True, least: float = 0.85) -> DataFrame:
    """``query_id, markdown, n_dropped, per_work_coverage, synthesis_coverage, missing_works`` of replies to structured questions.

    ``answers``: ``query_id, reply, required ARRAY<STRING>``; ``chunks``: ``query_id,
    source, text``.  Parse, count the chunks of each required work, keep verbatim quotes,
    render with the works that had no chunk, report coverage.
    """
    parsed = answers.select("query_id", parse_answer(F.col("reply")).alias("answer"), F.coalesce("required", F.array().cast("array<string>")).alias("required"))
    works = parsed.select("query_id", F.posexplode("required").alias("work_no", "work"))
    missing = chunks_per_work(chunks, works).where("n_chunks = 0").groupBy("query_id").agg(F.array_sort(F.collect_set("work")).alias("missing_works"))
    entries = parsed.select("query_id", F.posexplode("answer.per_work").alias("work_no", "e")).select("query_id", "work_no", "e.*")
    kept = enforce_verbatim(entries, chunks, least) if enforce else entries.withColumn("dropped", F.lit(False))
    again = kept.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("work_no", "work", "quote", "page", "gloss"))), lambda x: F.struct(x["work"].alias("work"), x["quote"].alias("quote"), x["page"].alias("page"), x["gloss"].alias("gloss"))).alias("per_work"), F.count_if("dropped").alias("n_dropped"))
    whole = parsed.join(again, "query_id", "left").join(missing, "query_id", "left")
    empty = F.array().cast("array<struct<work:string,quote:string,page:string,gloss:string>>")
    whole = whole.select("query_id", F.struct(F.col("answer.synthesis").alias("synthesis"), F.coalesce("per_work", empty).alias("per_work")).alias("answer"), "required", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), F.coalesce("missing_works", F.array().cast("array<string>")).alias("missing_works"))
    shares = coverage(whole).select("query_id", "per_work_coverage", "synthesis_coverage")
    return render_answers(whole).join(whole.select("query_id", "n_dropped", "missing_works"), "query_id").join(shares, "query_id").select("query_id", "markdown", "n_dropped", "per_work_coverage", "synthesis_coverage", "missing_works")


def coverage_block(missing: Column, n_dropped: Column) -> Column:
    """A warning that names up to three missing works and the quotes removed; empty without either."""
    names = F.array_join(F.slice(missing, 1, 3), ", ")
    more = F.when(F.size(missing) > 3, F.concat(F.lit(" and "), (F.size(missing) - 3).cast("string"), F.lit(" more"))).otherwise("")
    lines = F.concat(
        F.when(F.size(missing) > 0, F.array(F.concat(F.lit("- No evidence for: "), names, more))).otherwise(F.array().cast("array<string>")),
        F.when(n_dropped > 0, F.array(F.concat(F.lit("- Quotes removed as not verbatim: "), n_dropped.cast("string")))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(F.size(lines) > 0, F.concat(F.lit("\n\n> **Coverage**\n"), F.array_join(lines, "\n"))).otherwise("")


def required_block(works: Column) -> Column:
    """The list of required works of a prompt; empty without any."""
    return F.when(F.size(works) > 0, F.concat(F.lit("## Required works\n\n"), F.array_join(F.transform(works, lambda w: F.concat(F.lit("- "), w)), "\n"))).otherwise("")


def mode_prompt(mode: Column, query: Column, context: Column, style: Column) -> Column:
    """The instruction of a mode, the style, the context, the question."""
    task = (
        F.when(mode == "exact", "Quote the passage asked for word for word, with its source and page.")
        .when(mode == "exhaustive", "List every passage on the term, each word for word, with its source and page.")
        .when(mode == "precis", "Trace how the concept changes from work to work, with a quoted passage of each.")
        .otherwise("Answer from the context only, with quoted passages and their sources.")
    )
    return F.concat(task, F.lit("\nCitation style: "), F.coalesce(style, F.lit("chicago")), F.lit("\n\n## Context\n\n"), context, F.lit("\n\n## Question\n\n"), query)


def history_budget(messages: DataFrame, budget: int = 2048) -> DataFrame:
    """Per conversation the newest messages whose token estimates add up to the budget at most, always the newest.

    ``messages``: ``conversation_id, turn_no, content``.
    """
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("turn_no"))
    m = messages.withColumn("_n", F.row_number().over(newest)).withColumn("running", F.sum(F.coalesce(estimate_tokens(F.col("content")), F.lit(0))).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return m.where((F.col("running") <= budget) | (F.col("_n") == 1)).drop("_n")


def term_sentences(chunks: DataFrame, terms: DataFrame, doc: str = "chunk_id") -> DataFrame:
    """``term, chunk, sentence`` of at least 20 characters that contain a term, case aside.

    Terms meet sentences on the term's first word, so no nested loop runs.
    """
    t = terms.select("term", F.lower("term").alias("low")).withColumn("word", F.try_element_at(F.regexp_extract_all("low", F.lit(r"\w+"), F.lit(0)), F.lit(1))).where("word is not null")
    s = chunks.select(F.col(doc).alias("chunk"), F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("sentence")).where("length(sentence) >= 20")
    w = s.select("chunk", "sentence", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("sentence"), F.lit(r"\w+"), F.lit(0)))).alias("found"))
    return w.join(t, F.col("found").startswith(F.col("word")) & (F.col("found") == F.col("word"))).where(F.lower("sentence").contains(F.col("low"))).select("term", "chunk", "sentence").distinct()


def quota_by_source(scored: DataFrame, k: int) -> DataFrame:
    """At most k rows a query: max(3, k // sources) best of each source, then the best of the rest; in order of source and page."""
    n = F.size(F.collect_set("source").over(Window.partitionBy("query_id")))
    quota = F.coalesce(F.greatest(F.lit(3), F.floor(k / F.nullif(n, F.lit(0)))), F.lit(k))
    r = scored.withColumn("_q", quota).withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "doc_id")))
    r = r.withColumn("_g", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("_r") > F.col("_q"), F.desc("score"), "doc_id")))
    return r.where(F.col("_g") <= k).drop("_q", "_r", "_g")


def consensus(quotes: DataFrame, n_runs: int) -> DataFrame:
    """``query_id, key, n_runs`` of verified quotes whose first 50 normalised characters occur in most of the runs."""
    key = F.substring(normalize_for_matching(F.col("quote")), 1, 50)
    return quotes.where("verified").groupBy("query_id", key.alias("key")).agg(F.countDistinct("run").alias("n_runs")).where(F.col("n_runs") >= max(2, n_runs // 2 + 1))


def config_matrix(spark, flags: dict[str, object]) -> DataFrame:
    """``config, flags MAP<STRING, STRING>``: baseline, one flag each, all flags."""
    rows = [("baseline", {})] + [(f"only_{k}", {k: str(v)}) for k, v in sorted(flags.items())] + [("all", {k: str(v) for k, v in sorted(flags.items())})]
    return spark.createDataFrame(rows, "config string, flags map<string,string>")
