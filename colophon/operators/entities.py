"""Gazetteer tags and the co-occurrence graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # the join form needs no library
    ahocorasick = None

#: Aliases that an executor may hold, about 200 bytes each.
MAX_ALIASES = 500_000


def alias_map(entries: DataFrame) -> DataFrame:
    """``alias, canonical_id, load_order`` from ``canonical_id, label, type, aliases, load_order``; the last writer of an alias wins."""
    names = entries.select("canonical_id", "load_order", F.explode(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("label"))).alias("alias"))
    names = names.select(F.lower(F.trim("alias")).alias("alias"), "canonical_id", "load_order").where("length(alias) > 0")
    return names.groupBy("alias").agg(F.max_by("canonical_id", "load_order").alias("canonical_id"), F.max("load_order").alias("load_order"))


def label_map(entries: DataFrame) -> DataFrame:
    """``canonical_id, label``."""
    return entries.groupBy("canonical_id").agg(F.max_by("label", "load_order").alias("label"))


def ruler_patterns(entries: DataFrame) -> DataFrame:
    """``label, pattern, canonical_id``: lower-case token patterns for a rule matcher."""
    e = entries.select("canonical_id", F.concat(F.lit("CANONICAL_"), F.coalesce("type", F.lit("TERM"))).alias("label"), F.explode("aliases").alias("alias"))
    return e.select("label", F.filter(F.split(F.lower("alias"), r"\s+"), lambda w: w != "").alias("pattern"), "canonical_id").where(F.size("pattern") > 0)


def resolve(docs: DataFrame, aliases: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, canonical_id, pos`` of gazetteer entries in texts, plain substrings of three characters or more.

    Up to ``MAX_ALIASES`` aliases go to the executors as one automaton, and a text is
    read once.  More meet the texts on character trigrams (each alias by its first) in
    an equi-join.  ``pos`` orders a document's entries by longest alias, load order.
    """
    some = aliases.where("length(alias) >= 3").limit(MAX_ALIASES + 1)
    if ahocorasick is not None and some.count() <= MAX_ALIASES:
        return _resolve_small(docs, some, doc, text)
    a = aliases.where("length(alias) >= 3").withColumn("gram", F.substring("alias", 1, 3))
    heads = a.select("gram").distinct()
    low = docs.select(F.col(doc).alias("doc_id"), F.lower(F.col(text)).alias("t")).where("length(t) >= 3")
    grams = low.select("doc_id", "t", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.substring(F.col("t"), i, F.lit(3))))).alias("gram"))
    hits = grams.join(heads, "gram", "left_semi").join(a, "gram").where(F.col("t").contains(F.col("alias")))
    best = hits.groupBy("doc_id", "canonical_id").agg(F.min(F.struct((-F.length("alias")).alias("l"), "load_order", "alias")).alias("b"))
    order = Window.partitionBy("doc_id").orderBy("b.l", "b.load_order", "b.alias")
    return best.select("doc_id", "canonical_id", (F.row_number().over(order) - 1).alias("pos"))


def _resolve_small(docs: DataFrame, aliases: DataFrame, doc: str, text: str) -> DataFrame:
    rows = [(r["alias"], r["canonical_id"], (-len(r["alias"]), r["load_order"], r["alias"])) for r in aliases.collect()]
    held = docs.sparkSession.sparkContext.broadcast(rows)
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = ahocorasick.Automaton()
        for alias, entity, order in held.value:
            machine.add_word(alias, (entity, order))
        machine.make_automaton()
        for batch in batches:
            out = []
            for key, value in zip(batch["doc_id"], batch["t"]):
                best: dict = {}
                for _, (entity, order) in machine.iter(value) if rows_held(held) and value else ():
                    if entity not in best or order < best[entity]:
                        best[entity] = order
                out += [(key, entity, i) for i, entity in enumerate(sorted(best, key=best.get))]
            yield pd.DataFrame(out, columns=["doc_id", "canonical_id", "pos"])

    return docs.select(F.col(doc).alias("doc_id"), F.lower(F.col(text)).alias("t")).mapInPandas(run, f"doc_id {kind}, canonical_id string, pos int")


def rows_held(held) -> bool:
    """An automaton without words cannot be searched."""
    return bool(held.value)


def tag(docs: DataFrame, aliases: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """E5: documents with ``canonical_ids`` in order; empty without any. The gazetteer bounds the list."""
    ids = resolve(docs, aliases, doc, text).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "canonical_id"))), lambda x: x["canonical_id"]).alias("canonical_ids"))
    return docs.join(ids.withColumnRenamed("doc_id", doc), doc, "left").withColumn("canonical_ids", F.coalesce("canonical_ids", F.array().cast("array<string>")))


def cooccurrence(tags: DataFrame, doc: str = "doc_id", entity: str = "canonical_id") -> DataFrame:
    """``src, dst, weight`` with src < dst: in how many documents both occur.

    Pairs are made inside a document's row from its set of entities, which the
    gazetteer bounds; only pre-aggregated counts move.
    """
    sets = tags.groupBy(doc).agg(F.array_sort(F.collect_set(entity)).alias("s"))
    pairs = sets.select(F.explode(F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.greatest(F.size("s") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("src"), y.alias("dst")))))).alias("p"))
    return pairs.groupBy("p.src", "p.dst").agg(F.count("*").alias("weight")).select("src", "dst", "weight")


def neighbours(edges: DataFrame, of: DataFrame) -> DataFrame:
    """``canonical_id, neighbour``, distinct, both directions."""
    both = edges.select(F.col("src").alias("canonical_id"), F.col("dst").alias("neighbour")).union(edges.select("dst", "src"))
    return both.join(of.select("canonical_id").distinct(), "canonical_id", "left_semi").distinct()


def expand(edges: DataFrame, of: DataFrame) -> DataFrame:
    """The given ids and their neighbours, distinct."""
    return of.select("canonical_id").union(neighbours(edges, of).select("neighbour")).distinct()


def query_entities(query: Column) -> Column:
    """Capitalised runs in lower case, longer than one character: the model-free default."""
    runs = F.regexp_extract_all(query, F.lit(r"(?U)\b\p{Lu}[\w'’-]*(?:\s+\p{Lu}[\w'’-]*)*"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(runs, F.lower), lambda r: F.length(r) > 1))


def expand_query(query: Column, entities: Column, aliases: Column) -> Column:
    """The query, each entity three times, every alias."""
    return F.concat_ws(" ", query, F.array_join(F.flatten(F.transform(entities, lambda e: F.array_repeat(e, 3))), " "), F.array_join(aliases, " "))


def rewrite_query(query: Column, aliases: Column) -> Column:
    """Aliases appended; unchanged without any."""
    return F.when(F.size(aliases) > 0, F.concat_ws(" ", query, F.array_join(aliases, " "))).otherwise(query)


def lemmas(text: Column) -> Column:
    """Letters-only words of two or more in lower case: the model-free default."""
    return F.filter(F.split(F.lower(text), r"(?U)[^\w'’-]+"), lambda w: w.rlike(r"^\p{L}{2,}$"))


def concept_source_counts(tags: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """``canonical_id, source, n`` over leaf chunks, without the ids to skip."""
    kept = tags.where(~F.col("canonical_id").isin(skip)) if skip else tags
    return kept.groupBy("canonical_id", "source").agg(F.count("*").alias("n"))
