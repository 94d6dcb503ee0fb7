"""k-means and the summary tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.storage import written

#: Floats of centroids that an executor may hold.
MAX_FLOATS = 16_000_000
#: Nodes of a source that one task clusters, and directions whose signs cut larger sources.
CELL, BITS = 4096, 24


def assign_centroids(vectors: DataFrame, centroids: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """``key, cluster, distance``: squared Euclidean distance, ties to the lower cluster.

    ``centroids``: ``cluster, centroid``; their number times dimension is checked against
    ``MAX_FLOATS`` before they go to the executors.
    """
    c = centroids.orderBy("cluster").toPandas()
    m = np.array(c["centroid"].tolist(), np.float64)
    if m.size > MAX_FLOATS:
        raise ValueError(f"{m.size} centroid components exceed {MAX_FLOATS}")
    held = vectors.sparkSession.sparkContext.broadcast((c["cluster"].to_numpy(), m))
    kind = vectors.schema[key].dataType.simpleString()
    dim = m.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, m = held.value
        for batch in batches:
            if batch.empty:
                continue
            x = np.array(batch["v"].tolist(), np.float64)
            d = (x * x).sum(1)[:, None] - 2 * x @ m.T + (m * m).sum(1)[None, :]
            best = np.argmin(np.round(d, 9), axis=1)
            yield pd.DataFrame({"k": batch["k"], "cluster": names[best], "distance": np.maximum(d[np.arange(len(x)), best], 0)})

    slim = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).where(F.size("v") == dim)
    return slim.mapInPandas(run, f"k {kind}, cluster int, distance double").withColumnRenamed("k", key)


def centroid_means(vectors: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """``by, centroid``: the mean per component; partial sums per component move, not vectors."""
    parts = vectors.select(*by, F.posexplode(vector).alias("i", "x")).groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def kmeans(vectors: DataFrame, k: int, key: str = "id", vector: str = "embedding", rounds: int = 20, seed: int = 42) -> DataFrame:
    """``key, cluster`` after at most ``rounds`` rounds; an empty cluster keeps its centroid.

    Starts from the k rows that a seeded hash of the key puts first; each round's state
    is k centroids.
    """
    v = vectors.where(F.size(vector) > 0)
    first = v.select(key, vector, F.xxhash64(F.lit(seed), key).alias("h")).orderBy("h", key).limit(k).toPandas()
    spark = v.sparkSession
    now = [(i, [float(x) for x in row]) for i, row in enumerate(first[vector])]
    schema = "cluster int, centroid array<double>"
    for _ in range(rounds):
        labelled = assign_centroids(v, spark.createDataFrame(now, schema), key, vector)
        moved = {r[0]: r[1] for r in centroid_means(v.join(labelled.select(key, "cluster"), key), ["cluster"], vector).collect()}
        new = [(i, [float(x) for x in moved.get(i, c)]) for i, c in now]
        if all(np.allclose(a[1], b[1], atol=1e-9) for a, b in zip(now, new)):
            break
        now = new
    return assign_centroids(v, spark.createDataFrame(now, schema), key, vector).select(key, "cluster")


def first_sentences(texts: Column) -> Column:
    """R48's model-free summary: the first sentence of every child, at most 6,000 characters."""
    return F.substring(F.array_join(F.transform(texts, lambda t: F.regexp_extract(t, r"(?s)^(.*?(?:[.!?](?=\s|\z)|\z))", 1)), " "), 1, 6000)


def summary_level(nodes: DataFrame, clusters: DataFrame, level: int, summarize: Callable[[Column], Column] = first_sentences) -> DataFrame:
    """Parent nodes of one level: ``id, source, level, text, children_ids, page_start, page_end, embedding``.

    ``clusters``: ``id, cluster`` of nodes; clusters are small by construction (about five).
    """
    j = nodes.join(clusters, "id")
    nonzero = lambda c: F.when(F.col(c) > 0, F.col(c))
    info = j.groupBy("source", "cluster").agg(
        F.array_sort(F.collect_list(F.struct("id", "text"))).alias("kids"), F.coalesce(F.min(nonzero("page_start")), F.lit(0)).alias("page_start"), F.coalesce(F.max(nonzero("page_end")), F.lit(0)).alias("page_end")
    )
    mean = centroid_means(j, ["source", "cluster"]).withColumnRenamed("centroid", "embedding")
    ids = F.transform("kids", lambda x: x["id"])
    text = summarize(F.transform("kids", lambda x: x["text"]))
    return info.join(mean, ["source", "cluster"]).select(F.concat(F.lit(f"L{level}-"), F.substring(F.sha2(F.concat_ws("|", "source", F.array_join(ids, ",")), 256), 1, 16)).alias("id"), "source", F.lit(level).alias("level"), text.alias("text"), ids.alias("children_ids"), "page_start", "page_end", "embedding").where("length(text) > 0")


def _lloyd(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Cluster numbers of rows; an empty cluster keeps its centroid, ties go to the lower one."""
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    label = np.full(len(x), -1)
    for _ in range(rounds):
        d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]
        now = np.argmin(np.round(d, 9), axis=1)
        if (now == label).all():
            break
        label = now
        n = np.bincount(label, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, label, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return label


def clusters_within(nodes: DataFrame, size: int = 5, rounds: int = 20, seed: int = 42, cell: int = CELL) -> DataFrame:
    """R40 inside each source: ``id, cluster`` with about ``size`` nodes a cluster.

    ``nodes``: ``id, source, embedding``.  A source of more than ``cell`` nodes is cut by
    the signs of fixed random directions into cells of near vectors, and a cell that
    stays larger (near-equal vectors) by a hash of the id, so no task holds more than
    about two cells and work grows with the number of nodes, not its square.  Nodes
    without an embedding are in no cluster.
    """
    v = nodes.where(F.size("embedding") > 0).select("id", "source", F.col("embedding").cast("array<double>").alias("e"))
    kind = v.schema["id"].dataType.simpleString()

    def signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            code = np.zeros(len(batch), np.int64)
            for i, e in enumerate(batch["e"]):
                if len(e) not in planes:
                    planes[len(e)] = np.random.default_rng([seed, len(e)]).normal(size=(len(e), BITS))
                code[i] = int("".join("1" if b else "0" for b in np.asarray(e) @ planes[len(e)] > 0), 2)
            yield batch.assign(code=code)

    marked = written(v.mapInPandas(signs, f"id {kind}, source string, e array<double>, code bigint"), "cells")
    bits = F.least(F.lit(BITS), F.ceil(F.log2(F.ceil(F.count("*") / cell))).cast("int"))
    per = marked.groupBy("source").agg(bits.alias("bits"))
    celled = marked.join(per, "source").withColumn("cell", F.expr(f"shiftright(code, {BITS} - bits)"))
    parts = celled.groupBy("source", "cell").agg(F.ceil(F.count("*") / (2 * cell)).alias("parts"))
    ready = celled.join(parts, ["source", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable").reset_index(drop=True)
        dims = rows["e"].map(len)
        out = []
        for dim, same in rows.groupby(dims, sort=True):
            x = np.array(same["e"].tolist(), np.float64)
            k = max(1, -(-len(x) // size)) if len(x) <= size else max(2, -(-len(x) // size))
            label = _lloyd(x, k, rounds, np.random.default_rng(seed))
            out.append(pd.DataFrame({"id": same["id"], "cluster": [f"{key[1]}.{key[2]}.{dim}.{j}" for j in label]}))
        return pd.concat(out)

    return ready.groupBy("source", "cell", "part").applyInPandas(run, f"id {kind}, cluster string")


def summary_tree(leaves: DataFrame, levels: int = 3, least: int = 5) -> DataFrame:
    """Leaves and up to three levels of parents, a tree for each source; a source stops at ``least`` nodes."""
    now, out = leaves, leaves.withColumn("level", F.lit(0)).withColumn("children_ids", F.array().cast("array<string>"))
    cols = ["id", "source", "level", "text", "children_ids", "page_start", "page_end", "embedding"]
    out = out.select(*cols[:-1], F.col("embedding").cast("array<double>").alias("embedding"))
    for level in range(1, levels + 1):
        large = now.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") > least).select("source")
        going = now.join(large, "source", "left_semi")
        if going.isEmpty():
            break
        now = written(summary_level(going, clusters_within(going), level), f"tree{level}")
        out = out.unionByName(now.select(cols))
    return out


def sources_for_trees(leaves: DataFrame, least: int = 20) -> DataFrame:
    """Sources with at least ``least`` leaves."""
    return leaves.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") >= least)
