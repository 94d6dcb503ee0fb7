"""The whole retrieval plan (R45): every stage for all queries in one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colophon.functions.text import clean_query
from colophon.operators import entities, index, rerank, retrieve


@dataclass(frozen=True)
class Settings:
    """Flags of a run; a sweep passes one value after the other."""

    candidates: int = 200
    top_k: int = 10
    phrase_hits: int = 10
    leaves_only: bool = False
    strict_source: bool = False
    adaptive: bool = True
    per_work: bool = True
    per_work_fetch: int = 15
    per_work_most: int = 4
    window_weight: float = 0.7
    third_weight: float = 0.4
    gate: bool = False
    gate_candidates: int = 30
    widen: int = 40
    widen_weight: float = 0.5


def several_works(mentions: DataFrame, least: int = 2) -> DataFrame:
    """``query_id, work, work_no`` of queries that name ``least`` works or more, in order of name.

    ``mentions``: ``query_id, source, n_sources`` (:func:`retrieve.source_mentions`).
    """
    order = Window.partitionBy("query_id").orderBy("source")
    return mentions.where(F.col("n_sources") >= least).select("query_id", F.col("source").alias("work"), (F.row_number().over(order) - 1).alias("work_no"))


def one_work(mentions: DataFrame) -> DataFrame:
    """``query_id, source_prefix``: the first work that a query names, where it names one only."""
    return mentions.where("n_sources = 1").groupBy("query_id").agg(F.min("source").alias("source_prefix"))


def with_work_fetch(ranked: DataFrame, deeper: DataFrame, works: DataFrame, source: DataFrame, most: int) -> DataFrame:
    """A ranked list and, behind it, rows of each named work that only a deeper list has.

    ``ranked``, ``deeper``: ``query_id, doc_id, rank``; ``source``: ``doc_id, source``.
    """
    named = works.where(F.col("work_no") < most)
    more = deeper.join(named, "query_id").join(source, "doc_id").where(F.col("source").startswith(F.col("work")))
    new = more.groupBy("query_id", "doc_id").agg(F.min(F.struct("work_no", "rank")).alias("at")).join(ranked.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    both = ranked.select("query_id", "doc_id", F.struct(F.lit(-1).alias("work_no"), "rank").alias("at")).unionByName(new.select("query_id", "doc_id", "at"))
    return both.select("query_id", "doc_id", (F.row_number().over(Window.partitionBy("query_id").orderBy("at")) - 1).alias("rank"))


def by_turns(ranked: DataFrame, works: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of the works a query names in turn, the others behind; lists of other queries stay.

    A row belongs to the first work that its source begins with.
    """
    held = ranked.join(source, "doc_id", "left").join(works, "query_id", "left")
    mine = F.when(F.col("source").startswith(F.col("work")), F.col("work_no"))
    placed = held.groupBy("query_id", "doc_id", "rank").agg(F.min(mine).alias("work_no"))
    turn = F.when(F.col("work_no").isNotNull(), F.row_number().over(Window.partitionBy("query_id", "work_no").orderBy("rank")))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("turn"), F.asc_nulls_last("work_no"), "rank")
    return placed.withColumn("turn", turn).select("query_id", "doc_id", (F.row_number().over(order) - 1).alias("rank"))


def of_source(ranked: DataFrame, prefixes: DataFrame, source: DataFrame, strict: bool) -> DataFrame:
    """The rows of a query's source; all of them where it asks for none, or where none fits and ``strict`` is off."""
    held = ranked.join(prefixes, "query_id", "left").join(source, "doc_id", "left")
    free = held.where("source_prefix is null")
    bound = retrieve.filter_by_source(held.where("source_prefix is not null"), F.col("source_prefix"), strict=strict)
    kept = free.unionByName(bound).select("query_id", "doc_id", "rank")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1)


def search(
    chunks: DataFrame,
    queries: DataFrame,
    query_vectors: DataFrame | None = None,
    settings: Settings = Settings(),
    scorer=None,
    works: DataFrame | None = None,
    windows: DataFrame | None = None,
    third: DataFrame | None = None,
    aliases: DataFrame | None = None,
    embed=None,
) -> DataFrame:
    """``query_id, doc_id, rank, rerank_score, source, text, ...`` of every query's best chunks.

    ``chunks``: ``doc_id, text, source, embedding, level, page_start, page_end, heading``
    (all but the first two may be missing); ``queries``: ``query_id, query`` and, if
    wanted, ``source_prefix``; ``query_vectors``: ``query_id, vector``; ``works``:
    ``query_id, work, work_no`` of queries that name several works; ``windows``:
    ``doc_id, embedding`` of sentence windows, ids of their own; ``third``: a further
    ranked list; ``aliases``: ``query_id, aliases`` for the confidence gate.

    In order: dense and lexical lists; rows of named works fetched, and works by turns;
    the source filter; reciprocal rank fusion by the query's class; windows fused in at
    .7, a third list at .4; quoted phrases first; where the best passage is not
    confident, a wider search with the query's aliases fused in at half weight; leaves
    only; rerank.  Texts join only to the rows left at the end.
    """
    s = settings
    kind = retrieve.query_class(F.col("query")) if s.adaptive else F.lit("static")
    weights = queries.select("query_id", retrieve.channel_weights(kind).alias("w"))
    source = chunks.select("doc_id", F.col("source") if "source" in chunks.columns else F.lit(None).cast("string").alias("source"))
    deep = max(s.candidates, s.per_work_fetch)
    prefixes = queries.select("query_id", "source_prefix") if "source_prefix" in queries.columns else None

    def lists(asked: DataFrame, vectors: DataFrame | None, k: int) -> list[DataFrame]:
        lexical = index.bm25_topk(chunks, asked, k)
        has = vectors is not None and "embedding" in chunks.columns
        return [*([retrieve.dense_topk(chunks, vectors, k, "doc_id")] if has else []), lexical]

    def shaped(full: DataFrame, of: DataFrame, fetch: bool = True) -> DataFrame:
        ranked = full.where(F.col("rank") < s.candidates).select("query_id", "doc_id", "rank")
        if works is not None and s.per_work:
            if fetch:
                ranked = with_work_fetch(ranked, full.where(F.col("rank") < s.per_work_fetch), works, of, s.per_work_most)
            ranked = by_turns(ranked, works, of)
        if prefixes is not None:
            free = prefixes if works is None else prefixes.join(works.select("query_id").distinct(), "query_id", "left_anti")
            ranked = of_source(ranked, free.where("source_prefix is not null"), of, s.strict_source)
        return ranked

    channels = [shaped(x, source) for x in lists(queries, query_vectors, deep)]
    names = ["w.dense", "w.sparse"][-len(channels) :]
    fused = retrieve.fuse([(x.join(weights, "query_id"), F.col(n)) for x, n in zip(channels, names)])
    if windows is not None and query_vectors is not None:
        of = windows.select("doc_id", F.col("source") if "source" in windows.columns else F.lit(None).cast("string").alias("source"))
        near = shaped(retrieve.dense_topk(windows, query_vectors, s.candidates, "doc_id"), of, fetch=False)
        fused = retrieve.fuse([(fused, 1.0), (near, s.window_weight)])
    if third is not None:
        fused = retrieve.fuse([(fused, 1.0), (third, s.third_weight)])
    quoting = queries.where(retrieve.quoted_phrase(F.col("query")).isNotNull())
    phrases = retrieve.phrase_search(chunks, quoting, s.phrase_hits)
    if prefixes is not None:
        phrases = of_source(phrases.select("query_id", "doc_id", "rank"), prefixes.where("source_prefix is not null"), source, s.strict_source)
    ranked = retrieve.inject_front(fused, phrases)
    if s.gate and aliases is not None:
        ranked = _widened(ranked, chunks, queries, aliases, s, lists, embed)
    info = chunks.select([c for c in ("doc_id", "text", "source", "page_start", "page_end", "heading", "level") if c in chunks.columns])
    if windows is not None:
        info = info.unionByName(windows.select([c for c in info.columns if c in windows.columns]), allowMissingColumns=True)
    if s.leaves_only and "level" in chunks.columns:
        leaf = retrieve.leaves_only(info).select("doc_id")
        ranked = ranked.join(leaf, "doc_id", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1)
    few = ranked.where(F.col("rank") < s.candidates)
    ordered = few.join(info, "doc_id").join(queries.select("query_id", "query"), "query_id")
    return rerank.rerank(ordered, s.top_k, "pair" if scorer else "none", scorer).drop("query")


def _widened(ranked: DataFrame, chunks: DataFrame, queries: DataFrame, aliases: DataFrame, s: Settings, lists, embed) -> DataFrame:
    """The gate: queries whose best passage scores under .6 of 100 are asked again with their aliases."""
    probe = ranked.where(F.col("rank") < s.gate_candidates).join(chunks.select("doc_id", "text"), "doc_id").join(queries.select("query_id", "query"), "query_id")
    best = retrieve.with_passage_score(probe).groupBy("query_id").agg(F.max("passage_score").alias("passage_score"))
    wider = queries.join(aliases, "query_id").select("query_id", "query", entities.rewrite_query(F.col("query"), F.col("aliases")).alias("wide")).where("wide <> query").select("query_id", clean_query(F.col("wide")).alias("query"))
    unsure = best.where(retrieve.confidence(F.least(F.col("passage_score") / 100, F.lit(1.0))) != "confident").select("query_id")
    asked = wider.join(unsure, "query_id", "left_semi")
    vectors = None
    if "embedding" in chunks.columns and embed is not None:
        vectors = asked.select("query_id", embed(F.col("query")).alias("vector"))
    extra = lists(asked, vectors, s.widen)
    extra = retrieve.fuse([(x, w) for x, w in zip(extra, (0.6, 0.4)[-len(extra) :])])
    return retrieve.fuse([(ranked, 1.0), (extra, s.widen_weight)])
