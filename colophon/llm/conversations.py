"""Ordered conversations out of single message rows.

Rows shrink to fingerprints before anything is shuffled.  Rows without an identifier
get one from the connected component over reply and quote links.  Ordering never holds
a whole conversation in one task: rows are range-partitioned by (conversation, time),
window functions run inside one range, and what crosses a range border (the last row,
the number of rows so far) is carried by one summary row per conversation and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.components import connected_components
from colophon.llm.unify import unify_text
from colophon.storage import written

# Spellings of the three speakers, compared trimmed and in lower case.
SPEAKERS = {
    "user": ("user", "human", "usr", "prompter"),
    "assistant": ("assistant", "ai", "bot", "model", "gpt"),
    "system": ("system", "sys", "developer"),
}
#: Keys of ``metadata_json`` that name the message answered or quoted.
REPLY_KEYS = ("reply_to", "in_reply_to", "parent_id")
QUOTE_KEYS = ("quote_of", "quoted_id")
_TIME = r"^\s*(\d{4}-\d{2}-\d{2})[Tt ]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)\s*([Zz]|[+-]\d{2}:?\d{2})?\s*$"


def speaker(role: Column) -> Column:
    """user, assistant, system, or null where the role says nothing."""
    key = F.lower(F.trim(F.regexp_replace(role, r"(?U)[\s\p{Cf}]+", " ")))
    out = F.lit(None).cast("string")
    for name, spelled in SPEAKERS.items():
        out = F.when(key.isin(*spelled), F.lit(name)).otherwise(out)
    return out


def instant(text: Column) -> Column:
    """Microseconds since 1970 UTC of a written time; null if unreadable.

    Dates with a time, with or without offset (then UTC), and seconds or milliseconds
    since 1970 in digits.
    """
    zone = F.regexp_extract(text, _TIME, 3)
    zone = F.when((zone == "") | (F.lower(zone) == "z"), "+00:00").otherwise(F.regexp_replace(zone, r"^([+-]\d{2})(\d{2})$", "$1:$2"))
    written_out = F.concat(F.regexp_extract(text, _TIME, 1), F.lit(" "), F.regexp_extract(text, _TIME, 2), zone)
    digits = F.regexp_extract(text, r"^\s*(\d{9,14})(?:\.\d+)?\s*$", 1)
    number = digits.try_cast("bigint")
    return F.when(text.rlike(_TIME), F.unix_micros(written_out.try_cast("timestamp"))).when(
        digits != "", F.when(F.length(digits) >= 12, number * 1000).otherwise(number * 1000000)
    )


def visible(content: Column) -> Column:
    """Whether a text in canonical form has a letter or digit outside think tags."""
    open_text = F.regexp_replace(content, r"(?is)<\s*think\s*>.*?(?:<\s*/\s*think\s*>|\z)", " ")
    return F.coalesce(open_text.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def _links(messages: DataFrame) -> DataFrame:
    """``src, dst``: message ids tied by a reply key, a quote key or a quoted passage.

    A quoted passage ties only where it was said in one place, not after the quoting row.
    """
    meta = F.col("metadata_json")
    named = messages.where(meta.isNotNull() & meta.rlike("|".join(REPLY_KEYS + QUOTE_KEYS))).select(
        F.col("id").alias("src"), F.explode(F.array(*[F.get_json_object(meta, f"$.{k}") for k in REPLY_KEYS + QUOTE_KEYS])).alias("dst")
    )
    named = named.where("dst is not null").join(messages.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    strip = lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    body = strip(F.col("content"))
    quoting = messages.where(F.col("content").startswith(">")).select(
        F.col("id").alias("src"),
        instant(F.col("created_at")).alias("at"),
        F.xxhash64(strip(F.regexp_replace(F.regexp_extract("content", r"\A((?:>[^\n]*(?:\n|\z))+)", 1), r"(?m)^>[^\S\n]?", ""))).alias("print"),
    )
    # Where a text was said: its conversation, or the row itself where that has none.  One row a text, so a
    # text said a million times gives one link, and none if it was said in several places.
    place = F.coalesce("conversation_id", F.concat(F.lit("\0"), "id"))
    at = instant(F.col("created_at"))
    quoted = messages.where(body != "").select("id", place.alias("place"), F.xxhash64(body).alias("print"), at.alias("at"))
    quoted = quoted.groupBy("print").agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.min("at").alias("said"), F.min("id").alias("dst")).where("lo = hi")
    earlier = F.coalesce(F.col("said") <= F.col("at"), F.lit(True))
    return named.select("src", "dst").union(quoting.join(quoted, "print").where(earlier).select("src", "dst"))


def with_conversation_ids(messages: DataFrame) -> DataFrame:
    """``conversation_id`` filled for rows that lack one.

    Rows without an identifier are components over their reply and quote links to one
    another.  A component takes the identifier of the rows with one that it links to, or
    else ``linked:`` and its least message id.  A row stays null without links, or where
    its component links to several identifiers.
    """
    lost = messages.where("conversation_id is null and id is not null").select("id").distinct()
    known = messages.where("conversation_id is not null and id is not null").groupBy("id").agg(F.min("conversation_id").alias("known"))
    links = _links(messages)
    both = links.union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).join(lost.select(F.col("id").alias("src")), "src", "left_semi")
    nodes = connected_components(both.join(lost.select(F.col("id").alias("dst")), "dst", "left_semi"))
    told = both.join(known.select(F.col("id").alias("dst"), "known"), "dst").select(F.col("src").alias("node"), "known")
    at = told.join(nodes, "node", "left").withColumn("component", F.coalesce("component", "node")).groupBy("component").agg(F.min("known").alias("known"), F.max("known").alias("other"))
    alone = told.select("node", F.col("node").alias("component")).join(nodes.select("node"), "node", "left_anti").distinct()
    given = nodes.select("node", "component").union(alone).join(at, "component", "left").where("known is null or known = other")
    given = given.select(F.col("node").alias("id"), F.coalesce("known", F.concat(F.lit("linked:"), "component")).alias("_given"))
    found = messages.where("conversation_id is null").join(given, "id", "left").withColumn("conversation_id", F.col("_given")).drop("_given")
    return messages.where("conversation_id is not null").unionByName(found.select(messages.columns))


def rebuild_conversations(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conversation_id, turn_no, message_id, role, created_micros`` of kept conversations.

    ``messages``: ``id, conversation_id, role, content, metadata_json, created_at``;
    ``conversations``: ``id``.  An id counts once (of unlike rows with one id, the least
    by conversation, role, time).  Order: time, then system, user, assistant, then id.
    Rows that directly repeat the speaker and stored content of the row before count
    once.  Kept: conversations that stand in ``conversations``, all of whose rows have
    a speaker and a time, and that alternate user, assistant, ..., assistant, each with
    visible words.  Rows without id are a broken row of their conversation.  Empty
    tables give an empty result.
    """
    whole = with_conversation_ids(messages.select("id", "conversation_id", "role", "content", "metadata_json", "created_at"))
    slim = unify_text(whole, "content").select(
        "id",
        "conversation_id",
        speaker(F.col("role")).alias("role"),
        instant(F.col("created_at")).alias("at"),
        visible(F.col("canonical")).alias("visible"),
        F.xxhash64(F.coalesce("content", F.lit("\0null")), F.length("content")).alias("print"),
    )
    rows = slim.where("conversation_id is not null").groupBy(F.coalesce("id", F.concat(F.lit("\0"), "conversation_id")).alias("k")).agg(F.min(F.struct("conversation_id", "role", "at", "visible", "print", "id")).alias("r")).select("r.*")
    rows = rows.withColumn("ok", F.col("id").isNotNull() & F.col("role").isNotNull() & F.col("at").isNotNull())
    rows = written(rows, "messages")
    sound = rows.groupBy("conversation_id").agg(F.min("ok").alias("ok")).where("ok").select("conversation_id")
    standing = conversations.select(F.col("id").alias("conversation_id")).where("conversation_id is not null").distinct()
    rows = rows.join(sound.join(standing, "conversation_id", "left_semi"), "conversation_id", "left_semi")

    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    rows = rows.withColumn("rank", rank)
    order = ["at", "rank", "id"]
    ranged = rows.repartitionByRange("conversation_id", *order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "ranges").select("conversation_id", "part", "at", "rank", "id", "role", "visible", "print")
    inside = Window.partitionBy("conversation_id", "part").orderBy(*order)
    across = Window.partitionBy("conversation_id").orderBy("part")

    edge = ranged.groupBy("conversation_id", "part").agg(F.max_by(F.struct("role", "print"), F.struct(*order)).alias("last"))
    edge = edge.select("conversation_id", "part", F.lag("last").over(across).alias("carried"))
    marked = ranged.withColumn("before", F.lag(F.struct("role", "print")).over(inside)).join(edge, ["conversation_id", "part"])
    before = F.coalesce("before", "carried")
    kept = marked.where(before.isNull() | (before["role"] != F.col("role")) | (before["print"] != F.col("print"))).where("role <> 'system'")
    numbered = kept.withColumn("n", F.row_number().over(inside))
    sums = kept.groupBy("conversation_id", "part").agg(F.count("*").alias("n"))
    start = sums.select("conversation_id", "part", F.coalesce(F.sum("n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    turns = numbered.join(start, ["conversation_id", "part"]).withColumn("turn_no", (F.col("n") + F.col("start")).cast("int"))
    turns = written(turns.select("conversation_id", "turn_no", F.col("id").alias("message_id"), "role", F.col("at").alias("created_micros"), "visible"), "turns")
    fits = F.col("visible") & (F.col("role") == F.when(F.col("turn_no") % 2 == 1, "user").otherwise("assistant"))
    good = turns.groupBy("conversation_id").agg(F.min(fits).alias("fits"), F.count("*").alias("n")).where("fits and n % 2 = 0").select("conversation_id")
    return turns.join(good, "conversation_id", "left_semi").drop("visible")
