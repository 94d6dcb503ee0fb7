"""File-arrival ingestion and telemetry windows.

The file source and its checkpoint give each file once; the batch body is idempotent
(content ids, anti-joins), so a batch that runs again after a crash adds nothing twice.
Files that cannot be read go to a dead-letter table with their error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colophon.functions.text import clean_for_ingestion
from colophon.operators.chunking import chunk_documents
from colophon.sources import collections, files


def ingest_batch(batch: DataFrame, root: str, collection: str, readers: dict | None = None, embed: Callable[[Column], Column] | None = None, most: int = 512, overlap: int = 64) -> None:
    """One batch of files (``path, content``): dedup, extract, clean, chunk, embed, store, record.

    Tables under ``root``: ``chunks``, ``log`` (path, sha256, chunks), ``failed``.
    """
    spark = batch.sparkSession
    try:
        log = spark.read.parquet(f"{root}/log")
    except Exception as e:  # noqa: BLE001 - the first batch finds no log
        if "PATH_NOT_FOUND" not in str(e):
            raise
        log = spark.createDataFrame([], "path string, sha256 string, chunks bigint")
    new = collections.written(collections.unseen(batch.select("path", "content"), log), "arrived")
    if new.isEmpty():
        return
    pages = collections.written(files.extract_pages(new, readers), "pages")
    good = pages.where("error is null").select(F.col("path").alias("doc_id"), F.coalesce("page", F.lit(0)).cast("int").alias("page"), clean_for_ingestion(F.col("text")).alias("text"))
    chunks = chunk_documents(files.join_pages(good), good, most, overlap)
    source = F.regexp_extract("doc_id", r"([^/]+)$", 1)
    rows = chunks.select(
        collections.stable_id("doc_id", F.col("chunk_index").cast("string"), "text").alias("id"), "text", source.alias("source"), "heading", F.col("chunk_index").cast("int").alias("chunk_index"),
        F.col("page_start").cast("int").alias("page_start"), F.col("page_end").cast("int").alias("page_end"), F.lit(0).alias("level"), (embed(F.col("text")) if embed else F.lit(None).cast("array<float>")).alias("embedding"), F.col("doc_id").alias("path"),
    )
    rows = collections.written(rows, "rows")
    collections.append(rows.drop("path"), f"{root}/chunks", collection)
    counts = rows.groupBy("path").agg(F.count("*").alias("chunks"))
    pages.where("error is not null").select("path", "error").write.mode("append").parquet(f"{root}/failed")
    # Recorded last: a batch that died before this runs again, and adds no chunk twice.
    new.select("path", "sha256").join(counts, "path", "left").select("path", "sha256", F.coalesce("chunks", F.lit(0)).alias("chunks")).write.mode("append").parquet(f"{root}/log")


def watch(spark: SparkSession, inbox: str, root: str, collection: str, files_per_batch: int = 100, once: bool = False, **options) -> StreamingQuery:
    """Files that arrive in ``inbox``; ``once`` takes what is there and stops."""
    arrived = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length long, content binary").load(inbox)
    writer = arrived.writeStream.option("checkpointLocation", f"{root}/_checkpoint").foreachBatch(lambda batch, _: ingest_batch(batch, root, collection, **options))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def dedup_stream(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, by: list[str], value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and mean per window and group; rows later than the watermark are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"))


def progress(query: StreamingQuery) -> list[dict]:
    """Batch number, rows and seconds of the last batches."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "seconds": p["durationMs"].get("triggerExecution", 0) / 1000} for p in query.recentProgress]


def visible_answer(tokens: DataFrame, doc: str = "conversation_id", order: str = "seq", token: str = "token") -> DataFrame:
    """The answer that a stream of tokens shows, think passages hidden wherever their tags were cut.

    A conversation's tokens are one answer, bounded by the model's output limit.
    """
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, token))), lambda x: x[token]), "")
    return tokens.groupBy(doc).agg(whole.alias("raw")).select(doc, F.regexp_replace("raw", r"(?s)<think>.*?(?:</think>\s*|\z)", "").alias("answer"))
