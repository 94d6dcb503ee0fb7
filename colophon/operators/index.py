"""Inverted index and lexical search.

The index is three tables: postings (term, doc, tf), document lengths, and term
statistics.  Queries are a table too: all of them run in one plan, as an equi-join on
terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from colophon.operators.contain import contained
from colophon.storage import written

#: Bounds of what an executor holds of a set of queries, and of a block of documents.
MAX_CELLS, MAX_TERMS, ROW_CELLS = 20_000_000, 200_000, 4_000_000
K1, B, NEGATIVE_SHARE = 1.5, 0.75, 0.25


def tokenize(text: Column) -> Column:
    """Lower-case words of two letters or more; dashes separate. No lemmas, weight 1 each."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), "[-–—]", " "), F.lit(r"\p{L}{2,}"), F.lit(0))


def spaced_words(text: Column) -> Column:
    """The evaluation's tokens: lower case, between white space."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


#: How a text becomes tokens.
Tokens = Callable[[Column], Column]


def searchable_text(text: Column, prefix: Column | None = None) -> Column:
    """The text a chunk is indexed by: its context prefix, if any, before it."""
    return text if prefix is None else F.when(F.length(prefix) > 0, F.concat_ws("\n\n", prefix, text)).otherwise(text)


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``term, doc_id, tf``."""
    return docs.select(F.col(doc).alias("doc_id"), F.explode(tokenize(F.col(text))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame, doc: str = "doc_id", text: str = "text", tokens: Tokens = tokenize) -> DataFrame:
    """``doc_id, dl``: tokens of every document; no shuffle."""
    return docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.size(tokens(F.col(text))), F.lit(0)).alias("dl"))


def _counts(docs: DataFrame, doc: str, text: str, tokens: Tokens = tokenize) -> DataFrame:
    """``term, df, total``: documents of each term; under the empty term all documents and all tokens.

    One pass: distinct terms of a document are taken inside its row, its length rides
    along, and only partial counts move.
    """
    w = docs.select(tokens(F.col(text)).alias("w"))
    whole = F.array(F.struct(F.lit("").alias("term"), F.coalesce(F.size("w"), F.lit(0)).alias("n")))
    rows = w.select(F.explode(F.concat(whole, F.coalesce(F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"))), F.array().cast("array<struct<term:string,n:int>>")))).alias("x"))
    return rows.groupBy("x.term").agg(F.count("*").alias("df"), F.sum("x.n").alias("total"))


def _idf(counts: DataFrame) -> DataFrame:
    n = counts.where("term = ''").select(F.col("df").alias("n"))
    raw = counts.where("term <> ''").select("term", "df").crossJoin(F.broadcast(n)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, NEGATIVE_SHARE * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def term_stats(docs: DataFrame, doc: str = "doc_id", text: str = "text", tokens: Tokens = tokenize) -> DataFrame:
    """``term, df, idf``: the negative idf of a term in most documents becomes a quarter of the mean."""
    return _idf(written(_counts(docs, doc, text, tokens), "terms"))


def bm25_scores(docs: DataFrame, queries: DataFrame, doc: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "query", tokens: Tokens = tokenize) -> DataFrame:
    """``query_id, doc_id, score`` of every document that shares a term with a query; repeated query words count."""
    wanted = queries.select(F.col(query).alias("query_id"), F.explode(tokens(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    weighted = wanted.join(term_stats(docs, doc, text, tokens), "term")
    terms = wanted.select("term").distinct()
    # Only the queries' terms become postings; the rest never reaches a shuffle.
    # The length is taken below the explode, once a document, not above it once a token.
    cut = docs.select(F.col(doc).alias("doc_id"), tokens(F.col(text)).alias("w")).select("doc_id", F.size("w").alias("dl"), "w")
    used = (
        cut.select("doc_id", "dl", F.explode("w").alias("term"))
        .join(terms, "term", "left_semi")
        .groupBy("doc_id", "term", "dl")
        .agg(F.count("*").alias("tf"))
    )
    average = doc_lengths(docs, doc, text, tokens).agg(F.avg("dl").alias("avgdl"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return weighted.join(used, "term").crossJoin(F.broadcast(average)).groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")


def top_per_query(scores: DataFrame, k: int, by: str = "score", doc: str = "doc_id") -> DataFrame:
    """K1: the best ``k`` of each query with ``rank`` from 0; ties by document."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), F.asc(doc))
    return scores.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10, doc: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "query", tokens: Tokens = tokenize) -> DataFrame:
    """``query_id, doc_id, score, rank``: BM25 top k of every query; ties by document.

    A set of queries whose terms fit in memory (``MAX_CELLS``) goes to the executors as
    a terms x queries matrix of weights; each Arrow batch of documents becomes a
    documents x terms matrix, one product scores all pairs, and only the batch's own
    top k of each query is shuffled.  A larger set of queries takes the join of
    :func:`bm25_scores`.  Rows without a document id are no hits.
    """
    wanted = queries.select(F.col(query).alias("query_id"), F.explode(tokens(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    size = wanted.agg(F.countDistinct("query_id").alias("q"), F.countDistinct("term").alias("t")).first()
    if size["q"] * size["t"] > MAX_CELLS or size["t"] > MAX_TERMS or not size["q"]:
        return top_per_query(bm25_scores(docs, queries, doc, text, query, query_text, tokens), k)
    counts = written(_counts(docs, doc, text, tokens), "terms")
    stats = wanted.join(_idf(counts), "term").select("query_id", "term", "qtf", "idf").toPandas()
    average = (counts.where("term = ''").select(F.col("total") / F.col("df")).first() or (None,))[0] or 1.0
    terms = sorted(set(stats["term"]))
    asked = sorted(set(stats["query_id"]))
    weights = np.zeros((len(terms), len(asked)))
    at_t, at_q = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(asked)}
    for q, t, n, idf in stats.itertuples(index=False):
        weights[at_t[t], at_q[q]] = n * idf * (K1 + 1)
    held = docs.sparkSession.sparkContext.broadcast((terms, np.array(asked), weights, float(average)))
    kind = docs.schema[doc].dataType.simpleString()
    id_kind = queries.schema[query].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        terms, asked, weights, average = held.value
        values = pa.array(terms, pa.string())
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            by_id = np.argsort(ids, kind="stable")
            lists = batch.column(1).take(pa.array(by_id))
            ids = ids[by_id]
            length = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            found = pc.fill_null(pc.index_in(lists.flatten(), value_set=values), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(ids)), length)
            row, found = row[found >= 0], found[found >= 0]
            step = max(1, ROW_CELLS // max(len(terms), len(asked)))
            tops = []
            for i in range(0, len(ids), step):
                lo, hi = np.searchsorted(row, [i, min(i + step, len(ids))])
                n = min(step, len(ids) - i)
                tf = np.bincount((row[lo:hi] - i) * len(terms) + found[lo:hi], minlength=n * len(terms)).reshape(n, len(terms)).astype(np.float64)
                norm = K1 * (1 - B + B * length[i : i + n] / average)
                s = np.round((tf / (tf + norm[:, None])) @ weights, 6)
                m = min(k, n)
                top = np.argsort(-s, axis=0, kind="stable")[:m]  # rows are in order of id: ties go to the lesser
                best = np.take_along_axis(s, top, 0)
                r, c = np.nonzero(best > 0)
                tops.append(pd.DataFrame({"query_id": asked[c], "doc_id": ids[i + top[r, c]], "score": best[r, c]}))
            if tops:
                out = pd.concat(tops).sort_values(["query_id", "score", "doc_id"], ascending=[True, False, True], kind="stable")
                yield pa.RecordBatch.from_pandas(out.groupby("query_id", sort=False).head(k), schema=shape, preserve_index=False)

    spec = f"query_id {id_kind}, doc_id {kind}, score double"
    shape = to_arrow_schema(_parse_datatype_string(spec))
    rows = docs.select(F.col(doc).alias("doc_id"), tokens(F.col(text)).alias("w")).where("doc_id is not null and w is not null")
    return top_per_query(rows.mapInArrow(score, spec), k)


def longest_word(query: Column) -> Column:
    """The first of the longest words of more than three characters, or null."""
    words = F.filter(F.split(F.trim(query), r"\s+"), lambda w: F.length(w) > 3)
    return F.aggregate(words, F.lit(None).cast("string"), lambda best, w: F.when(best.isNull() | (F.length(w) > F.length(best)), w).otherwise(best))


def keyword_fallback(docs: DataFrame, queries: DataFrame, k: int = 10, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that contain the query's longest word, case kept, score 1.

    The words are grouped first, so a word asked by many queries is looked up once, and
    of a word in very many documents each task sends on its first ``k``.
    """
    asked = queries.select("query_id", longest_word(F.col("query")).alias("word")).where("word is not null")
    hits = contained(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("_t")), asked, "doc_id", "_t", "word", first=k)
    order = Window.partitionBy("word").orderBy("doc_id")
    first = hits.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
    return asked.join(first, "word").select("query_id", "doc_id", F.lit(1.0).alias("score"), "rank")
