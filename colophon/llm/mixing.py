"""Mixing sources to target shares of tokens by balanced (cube) sampling.

Each source's expected number of repeats follows from its share of the largest total
that no cap forbids.  Its whole part is given to every document; the fraction is an
inclusion probability.  The cube method's flight phase moves these probabilities along
the null space of the two balancing constraints (tokens and documents) until they are
0 or 1.  It runs in blocks of bounded size; the two probabilities at most that a block
leaves open meet again in the next round, until one block a source is left, whose last
two are landed on the outcome with the least error.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.storage import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern that belongs to these ranks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most documents of a block, and most rows of the target table.
BLOCK, MAX_SOURCES = 2000, 100_000


@functools.lru_cache(maxsize=2)
def _encoding(content: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}
    return tiktoken.Encoding("shares", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, out: str = "n_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` without ``text``, with its number of tokens; null texts have 0."""
    with open(tokenizer, "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())  # about 1 MB
    kept = [c for c in df.columns if c not in (text, out)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(content.value).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(n, pa.int64())], [*kept, out])

    from pyspark.sql import types as T

    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.LongType())])
    return df.select(*kept, text).mapInArrow(count, schema)


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cube flight phase for the sums of 1 and of ``x``; at most two entries stay between 0 and 1.

    Every step moves three open entries along the vector orthogonal to both
    constraints, to whichever bound is met first, on either side with the probability
    that keeps each expectation.
    """
    p = p.astype(float).tolist()
    x = x.astype(float).tolist()
    eps = 1e-9
    todo = [i for i, v in enumerate(p) if eps < v < 1 - eps][::-1]
    draws = iter(rng.random(2 * len(todo) + 8).tolist())
    active: list[int] = []
    while True:
        while len(active) < 3 and todo:
            active.append(todo.pop())
        if len(active) < 3:
            break
        i, j, k = active
        u = (x[j] - x[k], x[k] - x[i], x[i] - x[j])
        if u[0] == u[1] == u[2] == 0:
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for n, d in zip(active, u):
            if d > 0:
                up, down = min(up, (1 - p[n]) / d), min(down, p[n] / d)
            elif d < 0:
                up, down = min(up, -p[n] / d), min(down, -(1 - p[n]) / d)
        step = up if next(draws) * (up + down) < down else -down
        for n, d in zip(active, u):
            p[n] = min(1.0, max(0.0, p[n] + step * d))
        left = [n for n in active if eps < p[n] < 1 - eps]
        if len(left) == 3:  # rounding: close the nearest
            n = min(active, key=lambda m: min(p[m], 1 - p[m]))
            p[n] = round(p[n])
            left.remove(n)
        active = left
    return np.array([0.0 if v <= eps else 1.0 if v >= 1 - eps else v for v in p])


def landing(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The open entries (two at most) set to 0 or 1 with the least error in tokens, then in number."""
    rest = np.flatnonzero((p > 0) & (p < 1))
    if not len(rest):
        return p
    best = min(
        (tuple((m >> b) & 1 for b in range(len(rest))) for m in range(1 << len(rest))),
        key=lambda s: (abs(float(((np.array(s) - p[rest]) * x[rest]).sum())), abs(float((np.array(s) - p[rest]).sum()))),
    )
    p = p.copy()
    p[rest] = best
    return p


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    total_tokens: float | None = None,
    tokenizer: str = TOKENIZER,
    seed: int = 17,
    block: int = BLOCK,
) -> DataFrame:
    """``doc_id, source, n_tokens, repeats`` of the selected documents.

    ``targets``: ``source, target_share, max_repeats``; several rows of a source add
    their shares and take the greatest cap.  Shares are taken over the sources that
    have documents with tokens.  The total is the largest at which no source needs
    more than its cap, or ``total_tokens`` if that is less.  Documents without tokens,
    without source, or of no target source are not selected; repeated rows are records
    of their own.  An empty table gives an empty result.
    """
    spark = documents.sparkSession
    rows = (
        targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").cast("long").alias("cap")).limit(MAX_SOURCES + 1).collect()
    )
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    names = [r["source"] for r in rows]
    slim = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    slim = slim.join(F.broadcast(spark.createDataFrame([(n,) for n in names], "source string")), "source", "left_semi").select("doc_id", "source", "text")  # at most MAX_SOURCES names
    counted = written(count_tokens(slim, "text", tokenizer=tokenizer).where("n_tokens > 0"), "tokens")
    sums = {r["source"]: (r["t"], r["n"]) for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    present = [r for r in rows if r["source"] in sums]
    id_type = counted.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, source string, n_tokens bigint, repeats bigint"
    if not present:
        return spark.createDataFrame([], schema)
    whole = sum(r["share"] for r in present)
    total = min(r["cap"] * sums[r["source"]][0] * whole / r["share"] for r in present)
    if total_tokens is not None:
        total = min(total, total_tokens)
    plan = [(r["source"], float(min(r["cap"], r["share"] / whole * total / sums[r["source"]][0])), sums[r["source"]][1]) for r in present]
    plan_df = spark.createDataFrame([(s, int(x + 1e-9), max(0.0, x - int(x + 1e-9)), -(-n // block)) for s, x, n in plan], "source string, base bigint, p double, blocks bigint")

    columns = ["doc_id", "source", "n_tokens", "base", "p", "h"]

    def fly(last: bool):
        def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("h", kind="stable").reset_index(drop=True)
            rng = np.random.default_rng([seed, abs(hash_text(str(key[0]))), int(key[1])])
            x = part["n_tokens"].to_numpy(float)
            p = flight(part["p"].to_numpy(), x, rng)
            part["p"] = landing(p, x) if last else p
            return part[columns]

        return run

    state = "doc_id " + id_type + ", source string, n_tokens bigint, base bigint, p double, h bigint"
    start = counted.join(plan_df, "source").withColumn("h", F.xxhash64("doc_id", "n_tokens", F.lit(seed)))
    now, done, size, turn = start.withColumn("block", F.pmod("h", "blocks")).select(*columns, "block"), [], max(n for _, _, n in plan), 0
    while True:
        last = size <= block
        flown = now.groupBy("source", "block").applyInPandas(fly(last), state)
        if last:
            done.append(flown)
            break
        flown = written(flown, f"flight{turn}")
        done.append(flown.where("p <= 0 or p >= 1"))
        size, turn = 2 * -(-size // (block // 2)), turn + 1  # two of each block stay open; blocks vary in size
        blocks = 1 if size <= block else -(-size // block)
        now = flown.where("p > 0 and p < 1").withColumn("block", F.pmod(F.xxhash64("h", F.lit(turn)), F.lit(blocks))).select(*columns, "block")
    out = functools.reduce(DataFrame.unionByName, [d.select(*columns) for d in done])
    return out.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("p").cast("bigint")).alias("repeats")).where("repeats > 0")


def hash_text(text: str) -> int:
    """A number of a text that is the same in every process."""
    import zlib

    return zlib.crc32(text.encode("utf-8"))


def share_report(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, n_documents, n_records, tokens, actual_share, most_repeats``; sources without selection have 0."""
    per = selection.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("repeats").alias("n_records"), F.sum(F.col("repeats") * F.col("n_tokens")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    total = per.agg(F.sum("tokens").alias("total"))
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        wanted.join(per, "source", "left")
        .crossJoin(total)  # one row
        .select("source", "target_share", "max_repeats", zero("n_documents"), zero("n_records"), zero("tokens"), F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"), zero("most_repeats"))
    )
