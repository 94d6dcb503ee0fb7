"""Rerank strategies (R28-R32, R44, R47): models are plugged in; the defaults need none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.operators.index import top_per_query
from colophon.operators.retrieve import with_passage_score

#: How many fused rows each strategy sees.
CANDIDATES = {"late": 30, "pair": 30, "none": 200}


def max_similarity(query_tokens: Column, doc_tokens: Column) -> Column:
    """Per query token vector the greatest dot product with a document's, summed."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(F.transform(query_tokens, lambda q: F.array_max(F.transform(doc_tokens, lambda d: dot(q, d)))), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


#: Most queries of one late-interaction search; their token vectors go to every executor.
MOST_QUERIES = 1_000


def late_topk(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, doc_id, score, rank``: the best ``k`` of each query by late interaction over all rows.

    ``rows``: ``doc_id, tokens``; ``queries``: ``query_id, tokens`` (arrays of token
    vectors).  Each row is scored against the whole, bounded set of queries; more than
    ``MOST_QUERIES`` raise.  Rows or queries without tokens are in no result.
    """
    asked = queries.where(F.size("tokens") > 0).select("query_id", F.col("tokens").alias("_q"))
    if asked.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries")
    held = rows.where(F.size("tokens") > 0).select("doc_id", F.col("tokens").alias("_t")).crossJoin(F.broadcast(asked))
    return top_per_query(held.select("query_id", "doc_id", F.round(max_similarity(F.col("_q"), F.col("_t")), 6).alias("score")), k)


def hypothetical(query: Column, reply: Column) -> Column:
    """What is embedded for a question: a model's hypothetical passage, the question itself without one."""
    text = F.regexp_replace(reply, r"(?U)\A\s+|\s+\z", "")
    return F.when(F.length(text) > 0, text).otherwise(query)


def pair_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]):
    """A column function of (query, text) from a loader that runs once per worker."""
    from pyspark.sql import types as T

    @F.pandas_udf(returnType=T.DoubleType())
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in parts:
            yield pd.Series(model(q.tolist(), t.tolist()), dtype="float64")

    return score


def rerank(ranked: DataFrame, k: int = 10, strategy: str = "none", scorer=None) -> DataFrame:
    """The first 30 or 200 rows of each query rescored, the best ``k`` kept.

    ``ranked``: ``query_id, doc_id, rank, query, text``.  The cut comes before the scorer,
    so a model never sees more.  Without a scorer the passage score stands in.
    """
    few = ranked.where(F.col("rank") < CANDIDATES[strategy])
    s = few.withColumn("rerank_score", scorer(F.col("query"), F.col("text"))) if scorer else with_passage_score(few, out="rerank_score")
    s = s.withColumn("rerank_score", F.round("rerank_score", 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return s.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def expand_sparse(query: Column, weights: Column | None = None, k: int = 30) -> Column:
    """The ``k`` heaviest terms of a learned expansion (a map of weights) as the query; the query without one."""
    if weights is None:
        return query
    best = F.slice(F.array_sort(F.transform(F.map_entries(weights), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("t")))), 1, k)
    return F.when(F.size(best) > 0, F.array_join(F.transform(best, lambda s: s["t"]), " ")).otherwise(query)


def sub_queries(query: Column, reply: Column) -> Column:
    """The query first, then a reply's lines of more than ten characters, four in all."""
    lines = F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))), lambda x: F.length(x) > 10)
    return F.slice(F.array_distinct(F.concat(F.array(query), lines)), 1, 4)


def listed_scores(reply: Column) -> Column:
    """The numbers of a JSON array in a reply; null without one."""
    return F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)(\[[^\[\]]*\])", 1), F.lit("")), "array<double>")
