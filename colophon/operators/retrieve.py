"""Ranking, fusion and filtering of retrieved rows."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.functions.text import normalize_for_matching
from colophon.operators.contain import contained
from colophon.storage import written

RRF_K = 60
#: Vectors of queries that an executor may hold: 64 MB of float32 components.
MAX_QUERY_FLOATS = 16_000_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision; null if a length differs or is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact cosine top k of a set of query vectors over all rows.

    ``queries``: ``query_id, vector``.  Queries go to the executors in slices whose size
    is bounded; each Arrow batch of rows is scored against a slice in one matrix product
    and sends on its own top k only.  Rows of another length or length 0 are no hits.
    """
    asked = queries.select("query_id", "vector").where(F.size("vector") > 0)
    first = asked.select(F.size("vector")).first()
    if first is None:
        kind = queries.schema["query_id"].dataType.simpleString()
        return vectors.select(F.lit(None).cast(kind).alias("query_id"), F.col(key).alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    dim = first[0]
    width = max(1, MAX_QUERY_FLOATS // dim)

    def slices() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and unit vectors of at most ``width`` queries; the driver holds one slice at a time."""
        rows = asked.orderBy("query_id").toLocalIterator()
        while held := list(itertools.islice(rows, width)):
            matrix = np.array([r["vector"] for r in held], np.float64)
            yield np.array([r["query_id"] for r in held]), matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    key_type = vectors.schema[key].dataType.simpleString()
    id_type = queries.schema["query_id"].dataType.simpleString()
    slim = vectors.select(F.col(key).alias("doc_id"), F.col(vector).alias("v")).where(F.size("v") == dim)
    parts = None
    for part in slices():
        held = vectors.sparkSession.sparkContext.broadcast(part)

        def score(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            names, q = held.value
            for batch in batches:
                if batch.empty:
                    continue
                x = np.array(batch["v"].tolist(), np.float64)
                norm = np.linalg.norm(x, axis=1)
                keep = np.isfinite(norm) & (norm > 0)
                x, docs = x[keep] / norm[keep, None], batch["doc_id"].to_numpy()[keep]
                for a in range(0, len(q), 512):
                    s = np.round(q[a : a + 512] @ x.T, 6)
                    m = min(k, s.shape[1])
                    if not m:
                        continue
                    # Ties at the border must go by id: order by id first, then stably by score.
                    by_id = np.argsort(docs, kind="stable")
                    top = by_id[np.argsort(-s[:, by_id], axis=1, kind="stable")[:, :m]]
                    yield pd.DataFrame({"query_id": np.repeat(names[a : a + 512], m), "doc_id": docs[top.ravel()], "score": np.take_along_axis(s, top, 1).ravel()})

        part = slim.mapInPandas(score, f"query_id {id_type}, doc_id {key_type}, score double")
        parts = part if parts is None else parts.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return parts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def query_class(query: Column) -> Column:
    """Lexical for a quoted phrase, a page reference or two capitalised words, else semantic."""
    lexical = query.rlike('"[^"]{5,}"') | query.rlike("“[^”]{5,}”") | query.rlike(r"(?i)p\.?\s*\d+") | query.rlike(r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b")
    return F.when(lexical, "lexical").otherwise("semantic")


def channel_weights(kind: Column) -> Column:
    """``STRUCT<dense, sparse>`` of a query class; any other class gets the static pair."""
    pair = lambda d, s: F.struct(F.lit(d).alias("dense"), F.lit(s).alias("sparse"))
    return F.when(kind == "lexical", pair(0.35, 0.65)).when(kind == "semantic", pair(0.70, 0.30)).otherwise(pair(0.6, 0.4))


def fuse(channels: list[tuple[DataFrame, Column | float]], k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists (``query_id, doc_id, rank``).

    Score: the sum of weight / (k + rank + 1).  Ties keep the order of first insertion:
    the earlier channel, then its rank.  Returns ``query_id, doc_id, rrf_score, rank``.
    """
    lists = [df.select("query_id", "doc_id", F.lit(i).alias("channel"), F.col("rank"), ((weight if isinstance(weight, Column) else F.lit(float(weight))) / (k + F.col("rank") + 1)).alias("part")) for i, (df, weight) in enumerate(channels)]
    merged = lists[0]
    for other in lists[1:]:
        merged = merged.unionByName(other)
    fused = merged.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 8).alias("rrf_score"), F.min(F.struct("channel", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "first.channel", "first.rank", "doc_id")
    return fused.withColumn("rank", F.row_number().over(order) - 1).select("query_id", "doc_id", "rrf_score", "rank")


def quoted_phrase(query: Column) -> Column:
    """The first straight-quoted phrase of ten characters or more, else the first curly one, else null."""
    straight = F.regexp_extract(query, '"([^"]{10,})"', 1)
    curly = F.regexp_extract(query, "“([^”]{10,})”", 1)
    return F.coalesce(F.nullif(straight, F.lit("")), F.nullif(curly, F.lit("")))


def with_passage_score(df: DataFrame, query: str = "query", text: str = "text", entities: str | None = None, query_ids: str | None = None, chunk_ids: str | None = None, neighbour_ids: str | None = None, out: str = "passage_score") -> DataFrame:
    """``df`` with the token-level score of a passage for a query.

    A phrase's prefix, or its longest part from the first start that has one; two per
    shared word; five per shared bigram; times boosts for entities and gazetteer ids.
    Normal forms are columns of their own, so no element of an array computes them again.
    """
    long_words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) > 2))
    kept = df.columns
    staged = df.select("*", normalize_for_matching(F.col(query)).alias("_q"), normalize_for_matching(F.col(text)).alias("_t"), normalize_for_matching(quoted_phrase(F.col(query))).alias("_p"))
    staged = staged.select("*", F.split("_q", " ").alias("_qw"), F.split("_p", " ").alias("_pw"))
    pairs = F.when(F.size("_qw") > 1, F.transform(F.sequence(F.lit(1), F.size("_qw") - 1), lambda i: F.array_join(F.slice("_qw", i, 2), " "))).otherwise(F.array().cast("array<string>"))
    staged = staged.select("*", F.array_distinct(F.filter(pairs, lambda b: F.length(b) > 5)).alias("_b"))
    t, phrase, n = F.col("_t"), F.col("_p"), F.size("_pw")

    def longest_from(start: Column) -> Column:
        ends = F.sequence(F.greatest(n - start + 1, F.lit(1)), F.lit(1))
        parts = F.transform(ends, lambda size: F.array_join(F.slice("_pw", start, size), " "))
        hit = F.filter(parts, lambda p: (F.length(p) > 10) & t.contains(p))
        return F.when(F.size(hit) > 0, F.least(F.lit(40.0), F.length(F.element_at(hit, 1)) * 0.5)).otherwise(F.lit(0.0))

    partial = F.coalesce(F.get(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), longest_from), lambda s: s > 0), F.lit(0)), F.lit(0.0))
    phrase_part = (
        F.when(phrase.isNull(), 0.0)
        .when(t.contains(F.substring(phrase, 1, 50)), 100.0)
        .when(t.contains(F.substring(phrase, 1, 30)), 80.0)
        .when(t.contains(F.substring(phrase, 1, 20)), 50.0)
        .otherwise(partial)
    )
    score = phrase_part + 2.0 * F.size(F.array_intersect(long_words(F.col("_q")), long_words(t)))
    score = score + 5.0 * F.size(F.filter("_b", lambda b: t.contains(b)))
    if entities is not None:
        hits = F.size(F.filter(entities, lambda e: t.contains(normalize_for_matching(e))))
        score = score * (1.0 + 0.2 * F.least(hits, F.lit(3)))
    if query_ids is not None and chunk_ids is not None:
        shared = F.size(F.array_intersect(query_ids, chunk_ids))
        boost = F.when(shared > 0, 1.0 + 0.15 * F.least(shared, F.lit(3)))
        if neighbour_ids is not None:
            near = F.size(F.array_intersect(neighbour_ids, chunk_ids))
            boost = boost.when(near > 0, 1.0 + 0.10 * F.least(near, F.lit(3)))
        score = score * F.coalesce(boost, F.lit(1.0))
    return staged.select(*[F.col(f"`{c}`") for c in kept if c != out], F.coalesce(score, F.lit(0.0)).alias(out))


def phrase_terms(words: Column) -> Column:
    """Search terms of a phrase's words in order: trigrams by length, bigrams by length, the longest word of more than three."""
    n = F.size(words)

    def grams(size: int) -> Column:
        made = F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.struct((-F.length(F.array_join(F.slice(words, i, size), " "))).alias("l"), i.alias("i"), F.array_join(F.slice(words, i, size), " ").alias("g"))))
        return F.coalesce(F.transform(F.array_sort(made), lambda s: s["g"]), F.array().cast("array<string>"))

    longest = F.aggregate(F.filter(words, lambda w: F.length(w) > 3), F.lit(None).cast("string"), lambda best, w: F.when(best.isNull() | (F.length(w) > F.length(best)), w).otherwise(best))
    tail = F.when(longest.isNotNull(), F.array(longest)).otherwise(F.array().cast("array<string>"))
    return F.when(n >= 2, F.concat(grams(3), grams(2), tail)).otherwise(F.array().cast("array<string>"))


def phrase_search(docs: DataFrame, queries: DataFrame, k: int = 10, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that contain the first of a phrase's terms that any document contains.

    Terms are found by an equi-join on word n-grams of the documents, the check on
    whole normalised text follows.  ``queries``: ``query_id, query``; score 100.
    """
    split = queries.select("query_id", F.split(normalize_for_matching(quoted_phrase(F.col("query"))), " ").alias("w"))
    terms = split.select("query_id", F.posexplode(phrase_terms(F.col("w"))).alias("priority", "term")).where("length(term) > 0")
    wanted = terms.select("term").distinct().withColumn("size", F.size(F.split("term", " ")))
    norm = docs.select(F.col(doc).alias("doc_id"), F.split(normalize_for_matching(F.col(text)), " ").alias("w"))
    grams = norm.select("doc_id", F.explode(F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda s: F.when(F.size("w") >= s, F.transform(F.sequence(F.lit(1), F.size("w") - s + 1), lambda i: F.array_join(F.slice("w", i, s), " "))).otherwise(F.array().cast("array<string>"))))).alias("term"))
    hits = grams.join(wanted.select("term"), "term", "left_semi").distinct()
    first = terms.join(hits, "term")
    best = first.groupBy("query_id").agg(F.min("priority").alias("priority"))
    order = Window.partitionBy("query_id").orderBy("doc_id")
    return first.join(best, ["query_id", "priority"]).select("query_id", "doc_id").distinct().withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).withColumn("score", F.lit(100.0))


def inject_front(ranked: DataFrame, found: DataFrame) -> DataFrame:
    """New hits go before the list one by one, so the last found stands first."""
    new = found.join(ranked.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    both = new.select("query_id", "doc_id", F.lit(0).alias("part"), (-F.col("rank")).alias("pos")).unionByName(ranked.select("query_id", "doc_id", F.lit(1).alias("part"), F.col("rank").alias("pos")))
    return both.select("query_id", "doc_id", (F.row_number().over(Window.partitionBy("query_id").orderBy("part", "pos")) - 1).alias("rank"))


def source_mentions(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """``query_id, source, n_sources``: sources a query names.

    ``in Title`` anywhere, the whole title of six characters or more, or the longest
    leading part of the title (five characters or more, without leading stop words)
    that no other source's title contains or is contained in.  Titles and their parts
    meet queries, and parts each other, by :func:`contained`.
    """
    words = lambda text: F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0))
    stop = r"^(?:(?:the|a|an|what|who|when|where|why|how|which|is|are|was|were|do|does|did) )+"
    title = F.trim(F.regexp_replace(F.lower("source"), r"^\d{4}\s+", ""))
    s = sources.select("source").where("source is not null").distinct().withColumn("title", title)
    short = F.trim(F.get(F.split(F.replace(F.col("title"), F.lit(".pdf"), F.lit("")), " - "), F.lit(0)))
    s = s.withColumn("words", F.split(F.regexp_replace(F.concat(short, F.lit(" ")), stop, ""), r"\s+"))
    s = s.withColumn("words", F.filter("words", lambda w: w != ""))
    parts = s.select("source", F.explode(F.when(F.size("words") > 0, F.transform(F.sequence(F.lit(1), F.size("words")), lambda n: F.array_join(F.slice("words", 1, n), " ")))).alias("part")).where("length(part) >= 5")
    parts = parts.withColumn("word", F.try_element_at(words(F.col("part")), F.lit(1)))
    pattern = F.concat(F.lit(r"(?i)\bin\s+"), F.regexp_replace(F.regexp_replace(F.regexp_replace("title", r"([\\.\[\]{}()*+?^$|])", r"\\$1"), "-", r"[-\\s]?"), r"\s+", r"\\s+"), F.lit(r"\b"))
    # What the pattern leaves open are spaces and hyphens: without them, "in" and the title stand in the query.
    closed = lambda text: F.regexp_replace(text, r"[-\s]+", "")
    named = s.select("source", "title", pattern.alias("pattern"), F.concat(F.lit("in"), closed(F.col("title"))).alias("closed"), F.try_element_at(words(F.col("title")), F.lit(1)).alias("word")).where("word is not null")
    asked = queries.select("query").where("query is not null").distinct().withColumn("low", F.lower("query")).withColumn("closed", closed(F.col("low"))).withColumn("words", words(F.col("low")))
    strings = named.where("length(title) >= 6").select(F.col("title").alias("string")).union(parts.where("word is not null").select("part"))
    held = written(contained(asked, strings, "query", "low", "string").join(asked.select("query", "words"), "query"), "mentioned")
    has_word = F.array_contains("words", F.col("word"))
    whole = held.join(named, F.col("string") == F.col("title")).where(has_word & (F.length("title") >= 6)).select("query", "source")
    inside = contained(asked, named, "query", "closed", "closed").withColumnRenamed("closed", "key").join(asked.select("query", "words"), "query").join(named, F.col("key") == F.col("closed"))
    inside = inside.where(has_word & F.rlike(F.col("query"), F.col("pattern"))).select("query", "source")
    # Only parts that stand in a query need to be alone; one that two sources have is not.
    owned = parts.groupBy("part").agg(F.min("source").alias("source"), F.max("source").alias("last"), F.first("word").alias("word"))
    alone = held.join(owned, F.col("string") == F.col("part")).where(has_word & (F.col("source") == F.col("last")))
    some = written(alone.select("query", "source", "part"), "parts")
    wanted = some.select("source", "part").distinct()
    # A part that holds another source's part, or is held by one: then by that source's longest.
    longest = parts.groupBy("source").agg(F.max_by("part", F.length("part")).alias("part")).groupBy("part").agg(F.min("source").alias("source"), F.max("source").alias("last"))
    holds = contained(wanted.select(F.col("part").alias("mine")), parts, "mine", "mine", "part").join(owned.drop("word"), "part")
    held_by = contained(longest.select(F.col("part").alias("long")), wanted, "long", "long", "part").select(F.col("part").alias("mine"), F.col("long").alias("part")).join(longest, "part")
    near = holds.select("mine", "part", "source", "last").union(held_by.select("mine", "part", "source", "last")).where(F.arrays_overlap(F.split("mine", " "), F.split("part", " ")))
    clash = near.alias("n").join(wanted.alias("w"), (F.col("n.mine") == F.col("w.part")) & ((F.col("n.source") != F.col("w.source")) | (F.col("n.last") != F.col("w.source"))))
    unique = some.join(clash.select(F.col("w.part").alias("part")).distinct(), "part", "left_anti")
    found = whole.union(inside).union(unique.select("query", "source")).distinct()
    found = queries.select("query_id", "query").join(found, "query").select("query_id", "source").distinct()
    return found.withColumn("n_sources", F.count("*").over(Window.partitionBy("query_id")))


def filter_by_source(ranked: DataFrame, prefix: Column, source: str = "source", strict: bool = False) -> DataFrame:
    """Rows whose source starts with ``prefix``; where a query has none, all its rows unless ``strict``."""
    match = F.coalesce(F.col(source).startswith(prefix), F.lit(False))
    marked = ranked.withColumn("_m", match)
    if strict:
        return marked.where("_m").drop("_m")
    return marked.withColumn("_any", F.max("_m").over(Window.partitionBy("query_id"))).where("_m or not _any").drop("_m", "_any")


def balance_works(ranked: DataFrame, work: str = "work") -> DataFrame:
    """Works interleaved by position inside each; rows of no work last.

    Adds ``balanced_rank`` from 0.  Works take turns in the order of their best rank.
    """
    inside = Window.partitionBy("query_id", work)
    lead = F.when(F.col(work).isNotNull(), F.min("rank").over(inside))
    turn = F.when(F.col(work).isNotNull(), F.row_number().over(inside.orderBy("rank")))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("_turn"), F.asc_nulls_last("_lead"), "rank")
    return ranked.withColumn("_turn", turn).withColumn("_lead", lead).withColumn("balanced_rank", F.row_number().over(order) - 1).drop("_turn", "_lead")


def keep_first(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first row of each key by ``seq``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(seq))).where("_n = 1").drop("_n")


def leaves_only(rows: DataFrame, level: str = "level") -> DataFrame:
    """Rows of level 0; a level that cannot be read is a leaf."""
    return rows.where(F.coalesce(F.col(level).try_cast("int"), F.lit(0)) == 0)


def confidence(score: Column) -> Column:
    """Confident from .6, ambiguous from .25, else irrelevant."""
    return F.when(score >= 0.6, "confident").when(score >= 0.25, "ambiguous").otherwise("irrelevant")


def widen_if_unsure(main: DataFrame, extra: DataFrame, top: DataFrame) -> DataFrame:
    """Where a query's best passage score / 100 is not confident, fuse the extra list in at half weight.

    ``top``: ``query_id, passage_score`` of each query's best passage.
    """
    unsure = top.where(confidence(F.col("passage_score") / 100) != "confident").select("query_id")
    return fuse([(main, 1.0), (extra.join(unsure, "query_id", "left_semi"), 0.5)])


def context_label(n: Column, source: Column, page_start: Column, page_end: Column, heading: Column) -> Column:
    """``[Source n: source, p. a - heading]``, pages as a range where they differ."""
    a, b = F.coalesce(page_start, F.lit(0)), F.coalesce(page_end, F.lit(0))
    pages = F.when((a != 0) & (b != 0), F.when(a == b, F.concat(F.lit(", p. "), a.cast("string"))).otherwise(F.concat(F.lit(", pp. "), a.cast("string"), F.lit("-"), b.cast("string")))).otherwise("")
    head = F.when(F.length(heading) > 0, F.concat(F.lit(" — "), heading)).otherwise("")
    return F.concat(F.lit("[Source "), n.cast("string"), F.lit(": "), F.coalesce(source, F.lit("unknown")), pages, head, F.lit("]"))


def prompt_context(ranked: DataFrame) -> DataFrame:
    """``query_id, context``: labelled passages in rank order, parted by rules.

    ``ranked``: ``query_id, rank, source, page_start, page_end, heading, text``; callers
    pass a top k, so a query's list is bounded.
    """
    label = context_label(F.col("rank") + 1, F.col("source"), F.col("page_start").cast("int"), F.col("page_end").cast("int"), F.col("heading"))
    block = F.struct("rank", F.concat(label, F.lit("\n"), F.col("text")).alias("b"))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n\n---\n\n").alias("context"))
