"""Splitting oversized texts at natural boundaries, with overlap.

One bounded-quantifier regular expression cuts the text: its alternatives are tried
from the strongest boundary (end of text, paragraph) to the weakest (any character),
and each consumes as much as the limit allows.  The pieces it extracts concatenate to
the text; every later piece is then widened to the left by a lookback of at most
``overlap`` characters that starts at a sentence or word.  All of it is SQL array
functions inside one projection: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 2400
OVERLAP = 240


def boundary_pattern(limit: int) -> str:
    """Alternatives in order of boundary strength; each takes 1..limit code points.

    Paragraphs and sentences must fill a third of the limit, else pieces get tiny.
    No piece ends before a combining mark unless a run of marks exceeds the limit.
    """
    least = max(1, limit // 3)
    return (
        "(?s)"
        rf".{{1,{limit}}}\z"
        rf"|.{{{least},{limit}}}(?<=\n\n)(?!\n)"
        rf"|.{{{least},{limit}}}(?<=[.!?…][\"'”’»)\]]{{0,2}}\s)(?!\s)"
        rf"|.{{{least},{limit}}}(?<=\n)"
        rf"|.{{{least},{limit}}}(?<=[;:,]\s)(?!\s)"
        rf"|.{{1,{limit}}}(?<=\s)(?!\s)"
        rf"|.{{1,{limit}}}(?!\p{{M}})"
        rf"|.{{1,{limit}}}"
    )


#: What a lookback sheds so that it starts at a sentence or, failing that, at a word.
_SHED = r"(?s)\A(?:.*?[.!?…][\"'”’»)\]]{0,2}\s+(?=\S)|\S*\s+(?=\S))"


def _bodies(text: Column, max_chars: int, overlap: int) -> Column:
    """The pieces without their overlap; they concatenate to the text."""
    cut = F.regexp_extract_all(text, F.lit(boundary_pattern(max_chars - overlap)), F.lit(0))
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(cut)


#: Lengths added up at once where the bodies before a piece are measured.
_RUN = 128


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _runs(lengths: Column) -> Column:
    """Total length before each run of ``_RUN`` bodies."""
    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _RUN).cast("int")), lambda r: _sum(F.slice(lengths, r * _RUN + 1, F.lit(_RUN))))
    return F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _pieces(bodies: Column, lengths: Column, runs: Column, overlap: int) -> Column:
    """``STRUCT<begin, tail, body>`` a piece: where its body starts, the end of the body before, its body.

    A piece takes along no more than itself, so cost grows with the text's length alone.
    """

    def piece(body: Column, i: Column) -> Column:
        run = F.floor(i / _RUN).cast("int")
        # The array is named twice, else the optimizer would move what computes it into this function.
        begin = F.when(run < F.size(runs), F.get(runs, run)) + _sum(F.slice(lengths, run * _RUN + 1, i - run * _RUN))
        tail = F.when(i > 0, F.substring(F.get(bodies, i - 1), -overlap, overlap)).otherwise("") if overlap else F.lit("")
        return F.struct(begin.alias("begin"), tail.alias("tail"), body.alias("body"))

    return F.transform(bodies, piece)


def split_oversized(
    df: DataFrame,
    text: str = "text",
    page_start: str = "page_start",
    page_end: str = "page_end",
    max_chars: int = MAX_CHARS,
    overlap: int = OVERLAP,
) -> DataFrame:
    """One row per piece: the columns but ``text``, ``piece_no`` from 1, ``piece_text``, ``piece_offset``, ``piece_body_offset``, ``piece_page_start``, ``piece_page_end``.

    A null text gives no row; an empty one gives one empty piece.  Pages are spread
    evenly over the characters (an estimate: the text has no page breaks); a swapped pair is put in order, a null end equals the
    start, and a null or 0 start means unknown and gives 0.  Repeated rows stay
    repeated.  Columns of ``df`` that carry an output name are replaced.
    """
    out = ["piece_no", "piece_text", "piece_offset", "piece_body_offset", "piece_page_start", "piece_page_end"]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (*out, text)]
    if not 0 <= overlap < max_chars:
        raise ValueError("overlap must be at least 0 and below max_chars")
    n = F.length(F.col(text))
    a, b = F.coalesce(F.col(page_start).cast("int"), F.lit(0)), F.coalesce(F.col(page_end).cast("int"), F.lit(0))
    b = F.when(b == 0, a).otherwise(b)
    lo, hi = F.least(a, b), F.greatest(a, b)
    # One projection each: inside one expression the pieces would be cut again for every use.
    rows = df.where(F.col(text).isNotNull()).select(*kept, n.alias("_n"), a.alias("_a"), lo.alias("_lo"), hi.alias("_hi"), _bodies(F.col(text), max_chars, overlap).alias("_b"))
    rows = rows.withColumn("_l", F.transform("_b", F.length)).withColumn("_r", _runs(F.col("_l")))
    rows = rows.withColumn("_p", _pieces(F.col("_b"), F.col("_l"), F.col("_r"), overlap)).drop("_b", "_l", "_r")
    # No array is empty here; the outer form keeps the optimizer from cutting the text once more to test that.
    rows = rows.select("*", F.posexplode_outer("_p").alias("_i", "_q")).drop("_p")
    rows = rows.withColumn("_o", F.regexp_replace("_q.tail", _SHED, "")).withColumn("_s", (F.col("_q.begin") - F.length("_o")).cast("int"))

    def page(offset: Column) -> Column:
        at = F.col("_lo") + F.floor(offset.cast("bigint") * (F.col("_hi") - F.col("_lo") + 1) / F.greatest(F.col("_n"), F.lit(1))).cast("int")
        return F.when(F.col("_a") == 0, F.lit(0)).otherwise(F.least(at, F.col("_hi")))

    return rows.select(
        *kept,
        (F.col("_i") + 1).alias("piece_no"),
        F.concat("_o", "_q.body").alias("piece_text"),
        F.col("_s").alias("piece_offset"),
        F.col("_q.begin").alias("piece_body_offset"),
        page(F.col("_s")).alias("piece_page_start"),
        page(F.greatest(F.col("_q.begin") + F.length("_q.body") - 1, F.lit(0))).alias("piece_page_end"),
    )
