"""Relational catalog: corpora, documents, conversations, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def corpus_listing(corpora: DataFrame, documents: DataFrame) -> DataFrame:
    """Every corpus with its number of done documents and their chunks; documents are pre-aggregated, then joined."""
    done = documents.where("status = 'done'").groupBy("corpus_id").agg(F.count("*").alias("n_documents"), F.sum("chunks").alias("n_chunks"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return corpora.join(done, corpora["id"] == done["corpus_id"], "left").select(corpora["id"], corpora["name"], corpora["created_at"], zero("n_documents"), zero("n_chunks"))


def corpus_detail(corpora: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents with their corpus, ``position`` by creation time."""
    order = Window.partitionBy("corpus_id").orderBy("created_at", "id")
    d = documents.withColumn("position", F.row_number().over(order))
    return d.join(corpora.select(F.col("id").alias("corpus_id"), F.col("name").alias("corpus_name")), "corpus_id").select("corpus_id", "corpus_name", F.col("id").alias("document_id"), "filename", "status", "chunks", "position")


def count_by_parent(parents: DataFrame, children: DataFrame, key: str, parent: str) -> DataFrame:
    """Every parent with its number of children, 0 included."""
    counts = children.groupBy(F.col(parent).alias(key)).agg(F.count("*").alias("n"))
    return parents.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def newest_first(rows: DataFrame, by: list[str], at: str, key: str) -> DataFrame:
    """Q4, K4: ``position`` within a group, newest first."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(at).desc_nulls_last(), key)))


def latest(rows: DataFrame, by: list[str], at: str, key: str) -> DataFrame:
    """The newest row of each group; a partial aggregate, no sort."""
    names = rows.columns
    return rows.groupBy(*by).agg(F.max(F.struct(F.col(at).alias("_at"), F.col(key).alias("_key"), *[F.col(c).alias(f"c_{c}") for c in names])).alias("_r")).select(*[F.col(f"_r.c_{c}").alias(c) for c in names])


def conversation_detail(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Q5: conversations with ``n_messages`` and first and last time of their messages."""
    m = messages.groupBy("conversation_id").agg(F.count("*").alias("n_messages"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return conversations.join(m, conversations["id"] == m["conversation_id"], "left").select(conversations["id"], "title", F.coalesce("n_messages", F.lit(0)).alias("n_messages"), "first_at", "last_at")


def conversation_messages(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Q5: each conversation's messages in order of time, then id: ``id, title, position, message_id, role, content, at``.

    ``messages``: ``id, conversation_id, role, content, at``.  Conversations without
    messages give no row here (see :func:`conversation_detail`).
    """
    order = Window.partitionBy("conversation_id").orderBy(F.asc_nulls_first("at"), "message_id")
    m = messages.select(F.col("id").alias("message_id"), "conversation_id", "role", "content", "at").withColumn("position", F.row_number().over(order))
    return m.join(conversations.select(F.col("id").alias("conversation_id"), "title"), "conversation_id").select(F.col("conversation_id").alias("id"), "title", "position", "message_id", "role", "content", "at")


def default_title(text: Column) -> Column:
    """Q7: the first 80 characters, with ``...`` if there are more."""
    return F.when(F.length(text) > 80, F.concat(F.substring(text, 1, 80), F.lit("..."))).otherwise(text)


def merge(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows updated by key where a change is not null, new keys added."""
    cols = [c for c in current.columns if c not in keys]
    got = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in changes.columns if c not in keys])
    pick = [F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in got.columns else F.col(c) for c in cols]
    return current.join(got, keys, "full").select(*keys, *pick)


def cascade_delete(children: DataFrame, removed: DataFrame, parent: str, key: str = "id") -> DataFrame:
    """Children whose parent was not removed."""
    return children.join(removed.select(F.col(key).alias(parent)), parent, "left_anti").select(children.columns)


def orphans(children: DataFrame, parents: DataFrame, parent: str, key: str = "id") -> DataFrame:
    """Children whose parent does not exist; a null parent is an orphan."""
    return children.join(parents.select(F.col(key).alias(parent)), parent, "left_anti").select(children.columns)


def lookup(keys: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value``, null where the table has none."""
    return keys.join(table.select(key, value), key, "left")


def migrate(rows: DataFrame, id_map: DataFrame, column: str) -> DataFrame:
    """Ids replaced through ``old_id, new_id``; rows without a new id drop out."""
    return rows.join(id_map.select(F.col("old_id").alias(column), "new_id"), column).drop(column).withColumnRenamed("new_id", column)


def register_sources(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """``source, n_chunks`` of sources that the catalog lacks."""
    return chunks.where("source is not null").groupBy("source").agg(F.count("*").alias("n_chunks")).join(known.select(F.col("filename").alias("source")), "source", "left_anti")


def claim_oldest(jobs: DataFrame) -> DataFrame:
    """The oldest pending job, or the oldest running one to resume."""
    order = F.when(F.col("status") == "running", 0).otherwise(1)
    return jobs.where("status in ('pending', 'running')").orderBy(order, "created_at", "id").limit(1)
