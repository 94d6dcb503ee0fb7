"""The reference's endpoints and tools as functions over tables (§2.16, R38, S32, S35, S38, K5, Q12, V25, M22, X10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colophon.functions.text import clean_query, unsafe_path
from colophon.operators import catalog, chunking, embed, telemetry, verify
from colophon.operators.retrieve import quoted_phrase
from colophon.plans.search import Settings, search
from colophon.sources import collections


#: Most sources that a question may ask to cover.
MOST_SOURCES = 10_000


def search_corpus(spark: SparkSession, store: str, collection: str, queries: DataFrame, source: str | None = None, top_k: int = 10, settings: Settings | None = None) -> DataFrame:
    """Search a collection; ``source`` filters afterwards, case aside (J6), as the reference does: fewer than k rows may remain."""
    chunks = collections.read(spark, store, collection).withColumnRenamed("id", "doc_id")
    vectors = embed.embed_queries(queries) if "embedding" in chunks.columns else None
    found = search(chunks, queries, vectors, settings or Settings(top_k=top_k))
    return found if source is None else found.where(F.lower("source").contains(source.lower()))


def verify_quote(quotes: DataFrame, chunks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Quotes against chunks and, where pages are given, against the page itself."""
    results = verify.verify_quotes(quotes, chunks).join(quotes, "quote_id")
    return results if pages is None else verify.cross_check_pages(results, pages)


def get_page_text(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """``source, page, text`` for ``source, page``; null text for a miss, unsafe names drop out."""
    safe = wanted.where(~unsafe_path(F.col("source")))
    return safe.join(pages.select("source", "page", "text"), ["source", "page"], "left")


def list_documents(chunks: DataFrame) -> DataFrame:
    """A2: sources with their number of chunks."""
    return chunks.where("source is not null").groupBy("source").agg(F.count("*").alias("n_chunks")).orderBy("source")


def list_corpora(corpora: DataFrame, documents: DataFrame) -> DataFrame:
    """Q1, Q10: corpora by name with their documents and chunks."""
    return catalog.corpus_listing(corpora, documents).orderBy("name")


def get_chunk_context(chunks: DataFrame, wanted: DataFrame, window: int = 1) -> DataFrame:
    """Neighbours of chunks."""
    return chunking.neighbour_context(chunks, wanted, window)


def page_of(rows: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """K5: one page of rows in a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def reindex(spark: SparkSession, store: str, collection: str, path: str) -> None:
    """The index of a collection built anew."""
    collections.save_index(collections.read(spark, store, collection).withColumnRenamed("id", "doc_id"), path)


def weekly_report(events: DataFrame, days: int = 7) -> DataFrame:
    """The roll-up of the last days before the newest event."""
    newest = events.agg(F.max("ts").alias("_now"))
    recent = events.crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.col("_now") - F.make_dt_interval(F.lit(days)))  # one row
    return telemetry.roll_up(recent)


def prune(rows: DataFrame, at: str, days: int, now) -> DataFrame:
    """Rows younger than ``days``."""
    return telemetry.since(rows, at, now, days)


def cover_sources(find: Callable[[DataFrame, int], DataFrame], queries: DataFrame, sources: DataFrame, rounds: int = 3, key: str = "doc_id") -> DataFrame:
    """Up to ``rounds`` searches, each for the sources not yet covered; a passage counts once.

    ``find(queries_with_source, round)`` returns ``query_id, doc_id, source, ...``.
    """
    found = None
    named = sources.select("source").distinct()
    if named.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources to cover")
    left = queries.crossJoin(F.broadcast(named))  # the few works a question names
    for i in range(rounds):
        got = find(left, i)
        new = got if found is None else got.join(found.select("query_id", key), ["query_id", key], "left_anti")
        new = collections.written(new, f"round{i}")
        found = new if found is None else found.unionByName(new)
        left = left.join(found.select("query_id", "source").distinct(), ["query_id", "source"], "left_anti")
        if left.isEmpty():
            break
    return found


def golden_diff(rendered: DataFrame, golden: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, got, want`` where a rendering differs from its golden form or either is missing."""
    a, b = rendered.select(*keys, F.col(value).alias("got")), golden.select(*keys, F.col(value).alias("want"))
    return a.join(b, keys, "full").where(~F.col("got").eqNullSafe(F.col("want")))


def sweep(run: Callable[[Settings], DataFrame], configs: dict[str, Settings]) -> DataFrame:
    """One plan per configuration, their rows marked with its name."""
    out = None
    for name, settings in configs.items():
        part = run(settings).withColumn("config", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def rename_conversations(conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """Q12: titles replaced for conversations that exist; unknown ids change nothing."""
    known = changes.join(conversations.select("id"), "id", "left_semi")
    return catalog.merge(conversations, known, ["id"])


def create_conversations(conversations: DataFrame, corpora: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q12: ``(conversations, refused)``: new rows (``id, corpus_id, title``) whose corpus exists are added; others, and ids that are taken, are refused."""
    fits = new.join(corpora.select(F.col("id").alias("corpus_id")), "corpus_id", "left_semi").join(conversations.select("id"), "id", "left_anti").dropDuplicates(["id"])
    refused = new.join(fits.select("id"), "id", "left_anti")
    return conversations.unionByName(fits.select(*[c for c in conversations.columns if c in fits.columns]), allowMissingColumns=True), refused


def delete_conversations(conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q12, Q9: ``(conversations, messages, unknown)`` after deletion by ``id``; messages go with their conversation."""
    unknown = gone.join(conversations.select("id"), "id", "left_anti")
    kept = catalog.cascade_delete(messages, gone, "conversation_id")
    return conversations.join(gone.select("id"), "id", "left_anti"), kept, unknown


def reingest(documents: DataFrame, jobs: DataFrame, corpora: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Q13: ``(documents, jobs)``: the documents of the given corpora (``id``) are pending again, and each corpus gets a new pending job."""
    hit = documents.join(corpora.select(F.col("id").alias("corpus_id")), "corpus_id", "left_semi").select("id", F.lit("pending").alias("status"))
    counts = documents.join(corpora.select(F.col("id").alias("corpus_id")), "corpus_id", "left_semi").groupBy("corpus_id").agg(F.count("*").alias("total_files"))
    new = corpora.select(F.col("id").alias("corpus_id")).distinct().join(counts, "corpus_id", "left").select(
        collections.stable_id("corpus_id", now.cast("string")).alias("id"), "corpus_id", F.lit("pending").alias("status"), F.coalesce("total_files", F.lit(0)).alias("total_files"), F.lit(0).cast("long").alias("completed_files"), now.alias("created_at")
    )
    return catalog.merge(documents, hit, ["id"]), jobs.unionByName(new)


def resume_job(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """The job to take up with ``completed_files`` as the log of finished files (``corpus_id, path``) has it."""
    done = log.groupBy("corpus_id").agg(F.countDistinct("path").alias("_done"))
    return catalog.claim_oldest(jobs).join(done, "corpus_id", "left").withColumn("completed_files", F.coalesce("_done", F.lit(0))).withColumn("status", F.lit("running")).drop("_done")


def cached_answers(queries: DataFrame, cache: DataFrame, now, seconds: int = 3600) -> tuple[DataFrame, DataFrame]:
    """``(answered, left)``: queries with the stored result of the same cleaned query, not older than ``seconds``; quoted phrases are always asked anew.

    ``queries``: ``query_id, query``; ``cache``: ``key, result, at``; the newest entry of a key counts.
    """
    key = clean_query(F.col("query"))
    fresh = cache.where(F.unix_timestamp(now) - F.unix_timestamp("at") <= seconds)
    fresh = fresh.groupBy("key").agg(F.max(F.struct("at", "result"))["result"].alias("result"))
    keyed = queries.withColumn("key", F.when(quoted_phrase(F.col("query")).isNull(), key))
    return keyed.join(fresh, "key").select("query_id", "query", "result"), keyed.join(fresh.select("key"), "key", "left_anti").select("query_id", "query")


def filter_by_metadata(rows: DataFrame, needle: DataFrame, column: str = "source") -> DataFrame:
    """Rows whose column contains its query's string, case aside; all rows of a query where none does.

    ``rows``: ``query_id, ...``; ``needle``: ``query_id, wanted``.
    """
    held = rows.join(needle, "query_id", "left").withColumn("_hit", F.coalesce(F.lower(column).contains(F.lower("wanted")), F.lit(False)))
    any_hit = F.max("_hit").over(Window.partitionBy("query_id"))
    return held.withColumn("_any", any_hit).where("_hit or not _any").drop("_hit", "_any", "wanted")


def newest_jobs(jobs: DataFrame) -> DataFrame:
    """Q6: each corpus' latest job."""
    order = Window.partitionBy("corpus_id").orderBy(F.desc("created_at"), F.desc("id"))
    return jobs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
