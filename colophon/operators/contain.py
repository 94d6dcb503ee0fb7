"""Which of many strings a text contains, without a nested loop."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # the join form needs no library
    ahocorasick = None

#: Strings that an executor may hold, and their characters.
MAX_STRINGS, MAX_CHARACTERS = 500_000, 50_000_000


def contained(texts: DataFrame, needles: DataFrame, key: str, text: str, needle: str, first: int | None = None) -> DataFrame:
    """``key, needle``: each distinct string of ``needles`` that a text contains, as stored, once a row.

    A set of strings within ``MAX_STRINGS`` and ``MAX_CHARACTERS`` goes to the executors
    as one automaton, and a text is read once.  More meet the texts on their first three
    characters in an equi-join.  Strings of under three characters are only found by the
    automaton; a larger set of them raises.  ``first`` lets a batch send on only the
    ``first`` least keys of each string, where a caller keeps no more.  Null texts and
    null or empty strings match nothing.
    """
    wanted = needles.select(F.col(needle).alias("needle")).where("length(needle) > 0").distinct()
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("needle")), F.lit(0)).alias("c"), F.min(F.length("needle")).alias("least")).first()
    kind = texts.schema[key].dataType.simpleString()
    slim = texts.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    if ahocorasick is not None and size["n"] <= MAX_STRINGS and size["c"] <= MAX_CHARACTERS:
        held = texts.sparkSession.sparkContext.broadcast([r[0] for r in wanted.toLocalIterator()])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            machine = ahocorasick.Automaton()
            for w in held.value:
                machine.add_word(w, w)
            machine.make_automaton()
            for batch in batches:
                rows = [(k, w) for k, t in zip(batch["k"], batch["t"]) for w in ({w for _, w in machine.iter(t)} if held.value and t else ())]
                out = pd.DataFrame(rows, columns=["k", "needle"])
                if first is not None and len(out) > first:
                    out = out.sort_values("k", kind="stable").groupby("needle", sort=False).head(first)
                yield out

        return slim.mapInPandas(run, f"k {kind}, needle string").select(F.col("k").alias(key), F.col("needle").alias(needle))
    if size["least"] is not None and size["least"] < 3:
        raise ValueError(f"strings of under three characters among {size['n']}")
    heads = wanted.withColumn("gram", F.substring("needle", 1, 3))
    grams = slim.where("length(t) >= 3").select("k", "t", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.substring(F.col("t"), i, F.lit(3))))).alias("gram"))
    hits = grams.join(heads.select("gram").distinct(), "gram", "left_semi").join(heads, "gram").where(F.col("t").contains(F.col("needle")))
    return hits.select(F.col("k").alias(key), F.col("needle").alias(needle)).distinct()
