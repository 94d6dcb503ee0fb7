"""Collections of chunks as partitioned Parquet.

A collection is a partition.  Updates and deletes rewrite only the partition they
touch: the new content is written beside, then swapped in by a dynamic partition
overwrite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.operators import index
from colophon.storage import written


def stable_id(*columns):
    """An id from content, so that a retry writes the same rows."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *columns), 256), 1, 32)


def append(chunks: DataFrame, path: str, collection: str) -> None:
    """Chunks of a collection whose id it lacks are added."""
    new = chunks.withColumn("collection", F.lit(collection))
    try:
        have = read(chunks.sparkSession, path, collection).select("id")
        new = new.join(have, "id", "left_anti").select(new.columns)
    except Exception as e:  # noqa: BLE001 - the first write finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.dropDuplicates(["id"]).write.mode("append").partitionBy("collection").parquet(path)


def read(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """All chunks, or those of one collection (a partition filter)."""
    df = spark.read.parquet(path)
    return df if collection is None else df.where(F.col("collection") == collection)


def _replace(df: DataFrame, path: str) -> None:
    safe = written(df, "replace")  # never overwrite what is being read
    safe.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def update(spark: SparkSession, path: str, collection: str, changes: DataFrame) -> None:
    """Columns of rows with the same id replaced where the change is not null."""
    now = read(spark, path, collection)
    cols = [c for c in changes.columns if c != "id"]
    j = now.join(changes.select("id", *[F.col(c).alias(f"_{c}") for c in cols]), "id", "left")
    _replace(j.select(*[F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in now.columns]), path)


def delete_source(spark: SparkSession, path: str, collection: str, source: str) -> None:
    """The chunks of one source removed; a null source stays."""
    now = read(spark, path, collection)
    kept = now.where(F.coalesce(F.col("source") != source, F.lit(True)))
    if kept.isEmpty():
        drop(spark, path, collection)
    else:
        _replace(kept, path)


def drop(spark: SparkSession, path: str, collection: str) -> None:
    """The collection's partition removed."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/collection={collection}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clone(spark: SparkSession, path: str, source: str, target: str, without: tuple[str, ...] = ("context_prefix",)) -> None:
    """A copy without some columns' content; a target that holds rows is refused."""
    if not read(spark, path, target).isEmpty():
        raise ValueError(f"collection {target} is not empty")
    copy = read(spark, path, source)
    copy = copy.select(*[F.lit(None).cast(copy.schema[c].dataType).alias(c) if c in without else F.col(c) for c in copy.columns if c != "collection"])
    written(copy.withColumn("collection", F.lit(target)), "clone").write.mode("append").partitionBy("collection").parquet(path)


def unseen(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files (``path, content``) whose SHA-256 the log (``sha256``) lacks, each content once (the least path)."""
    marked = files.withColumn("sha256", F.sha2("content", 256))
    new = marked.join(log.select("sha256"), "sha256", "left_anti")
    return new.groupBy("sha256").agg(F.min_by(F.struct(*files.columns), "path").alias("f")).select("f.*", "sha256")


def with_cached(rows: DataFrame, cache: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows with the cached ``embedding`` of their text, and those that lack one."""
    keyed = rows.withColumn("cache_key", F.substring(F.sha2(text, 256), 1, 16)).join(cache.select("cache_key", "embedding"), "cache_key", "left")
    return keyed.where("embedding is not null"), keyed.where("embedding is null").drop("embedding")


def save_index(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> None:
    """Postings by term range, lengths and term statistics, stamped with the time of building."""
    index.postings(docs, doc, text).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.doc_lengths(docs, doc, text).write.mode("overwrite").parquet(f"{path}/doc_lengths")
    index.term_stats(docs, doc, text).withColumn("built_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/term_stats")


def index_is_fresh(spark: SparkSession, path: str, seconds: int = 3600) -> bool:
    """Whether the index is younger than ``seconds``."""
    built = spark.read.parquet(f"{path}/term_stats").agg(F.max("built_at").alias("t")).select((F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("t")).alias("age")).first()
    return built["age"] is not None and built["age"] < seconds


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """BM25 over a saved index; only the queries' terms are read from the sorted postings."""
    wanted = queries.select("query_id", F.explode(index.tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    posts, lengths, stats = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "doc_lengths", "term_stats"))
    average = lengths.agg(F.avg("dl").alias("avgdl"))
    j = wanted.join(stats.select("term", "idf"), "term").join(posts, "term").join(lengths, "doc_id").crossJoin(F.broadcast(average))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (index.K1 + 1) / (F.col("tf") + index.K1 * (1 - index.B + index.B * F.col("dl") / F.col("avgdl")))
    return index.top_per_query(j.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0"), k)


def manifest_diff(saved: DataFrame, live: DataFrame) -> DataFrame:
    """``flag, saved, live`` where two flag maps (one row each, column ``flags``) differ."""
    a, b = saved.select(F.explode("flags").alias("flag", "saved")), live.select(F.explode("flags").alias("flag", "live"))
    return a.join(b, "flag", "full").where(~F.col("saved").eqNullSafe(F.col("live")))


def routes(setting: str) -> dict[str, str]:
    """``slug:collection,...`` as a map; parts without a colon are left out."""
    pairs = (x.split(":", 1) for x in setting.split(",") if ":" in x)
    return {a.strip(): b.strip() for a, b in pairs if a.strip() and b.strip()}
