"""Keyword-stuffed and link-list pages, by mean pointwise mutual information of neighbours.

Pass one counts, exactly, in how many documents each word and each pair of neighbouring
words stands, copies once (so copies of a page do not vouch for it).  Pass two scores
each document.  The PMI of two neighbours compares how often the corpus joins them with
how often chance would, given how frequent each word is; a word's frequency is the
corpus's, or its share of the page's other text where that is more.  Prose has a high mean:
its words belong together.  Word salad has a low one because the corpus does not join
its words; a collocation repeated beyond what the corpus bears has a low one because the
page's own repetition makes chance account for it.  A page is flagged when stretches
of low mean PMI hold more than half of its text.

Counts are taken within reach of a page's language: what is frequent is measured against
the number of documents that hold the commonest word known beside the page's words, so
a language with a hundredth of the corpus is judged like one with all of it.

The most frequent counts, of a bounded number, are broadcast; every other count comes by
a join on the words and pairs that a text needs, so no count is estimated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm.words import DIGIT, JOINT, LETTER, STOP, code_points, mix, once, pair_numbers, run_numbers, slices
from colophon.storage import written

#: Most words and pairs whose counts executors hold (24 and 16 bytes each); the rest is joined.
HELD_WORDS, HELD_PAIRS = 1 << 20, 1 << 22
#: Pairs on either side of a token that decide whether its stretch is stuffed, by their mean PMI (bits).
REACH, STUFFED = 12, -4.4
#: Documents counted for a pair that no other document holds.
UNSEEN = 0.5
#: Share of the text in such stretches from which a page is flagged.
FLAG = 0.5
#: Distinct counts a task holds before it sends them on.
HOLD = 2_000_000

URL, TAG = np.uint64(1), np.uint64(2)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, lengths and text numbers of the words, links and tags of ``texts``, in order.

    Words are runs of letters in lower case, numbered by a 64-bit hash; links and tags
    have one number each; figures and signs are passed over.  No call is made per token.
    """
    points, k, begin = code_points(texts)
    letter = k == LETTER
    spans = []
    # Links run to the next space, quote or bracket.
    stops = np.flatnonzero(k == STOP)
    colon = np.flatnonzero(points == ord(":"))
    colon = colon[(colon >= 4) & (colon + 2 < len(points))]
    colon = colon[(points[colon + 1] == ord("/")) & (points[colon + 2] == ord("/"))]
    starts = []
    for word in ("http", "https"):
        at = colon[colon >= len(word)]
        for i, c in enumerate(reversed(word)):
            at = at[points[at - 1 - i] == ord(c)]
        starts.append(at - len(word))
    dot = np.flatnonzero(points == ord("."))
    dot = dot[dot >= 3]
    for i in range(3):
        dot = dot[points[dot - 1 - i] == ord("w")]
    starts.append(dot - 3)
    start = np.unique(np.concatenate(starts))
    if len(start):
        end, first = np.unique(stops[np.searchsorted(stops, start)], return_index=True)
        spans.append((start[first], end, URL))
    tag = np.flatnonzero(points[:-1] == ord("#"))
    tag = tag[np.isin(k[tag + 1], (LETTER, DIGIT, JOINT))]
    if len(tag):
        apart = np.flatnonzero((k != LETTER) & (k != DIGIT) & (k != JOINT))
        end, first = np.unique(apart[np.searchsorted(apart, tag + 1)], return_index=True)
        spans.append((tag[first], end, TAG))
    if spans:
        inside = np.zeros(len(points) + 1, np.int32)
        for start, end, _ in spans:
            np.add.at(inside, start, 1)
            np.add.at(inside, end, -1)
        letter &= np.cumsum(inside)[:-1] == 0
    spot, length, numbers = run_numbers(points, letter)
    if spans:
        links = [(start, end, code) for start, end, code in spans]
        if len(links) == 2:  # a tag inside a link is part of it
            (a, b, _), (s, e, code) = links
            held = np.searchsorted(a, s, side="right") - 1
            free = (held < 0) | (s >= b[np.maximum(held, 0)])
            links[1] = (s[free], e[free], code)
        spot = np.concatenate([spot, *(s for s, _, _ in links)])
        length = np.concatenate([length, *(e - s for s, e, _ in links)])
        numbers = np.concatenate([numbers, *(np.full(len(s), code) for s, _, code in links)])
        order = np.argsort(spot, kind="stable")
        spot, length, numbers = spot[order], length[order], numbers[order]
    return numbers, length, np.searchsorted(begin, spot, side="right") - 1


def neighbours(numbers: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a token has a next one in its text, and the number of the pair."""
    at = np.flatnonzero(docs[1:] == docs[:-1]) if len(docs) > 1 else np.zeros(0, np.int64)
    return at, pair_numbers(numbers[at], numbers[at + 1])


# --- counts ---------------------------------------------------------------------


def distinct_texts(texts: DataFrame, text: str) -> DataFrame:
    """One row of each class of copies: texts that agree but for case, spaces, figures and punctuation.

    Classes are told by 128 bits and stand for their least text.  Each task keeps one text
    of a class before texts move, so a class of very many rows costs no more than one of few.
    """
    letters = F.regexp_replace(F.lower(text), r"[^\p{L}#]+", " ")
    # Texts without a letter are copies only if equal.
    key = F.unhex(F.md5(F.when(F.length(F.trim(letters)) > 0, letters).otherwise(F.col(text))))
    return texts.select(text, key.alias("copy")).groupBy("copy").agg(F.min(text).alias(text)).select(text)


def corpus_counts(texts: DataFrame, text: str) -> DataFrame:
    """``a, b, n``: the number of rows that hold word ``a`` (``b`` null) or the neighbours ``a b``; rows in all under two nulls.

    Each task adds up its own counts before they move.
    """

    def rows(a, b, n, word: bool) -> pa.RecordBatch:
        second = pa.nulls(len(a), pa.int64()) if word else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), second, pa.array(n)], ["a", "b", "n"])

    def added(parts: list) -> tuple:
        key, a, b, n = (np.concatenate(x) for x in zip(*parts))
        _, first, group = np.unique(key, return_index=True, return_inverse=True)
        return key[first], a[first], b[first], np.bincount(group, weights=n).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}
        total = 0

        def grown() -> Iterator[pa.RecordBatch]:
            for word, parts in held.items():
                if sum(len(p[0]) for p in parts) > HOLD:
                    parts[:] = [added(parts)]
                    if len(parts[0][0]) > HOLD // 2:
                        _, a, b, n = parts.pop()
                        yield rows(a, b, n, word)

        for batch in batches:
            total += batch.num_rows
            for _, part in slices(batch.column(0).to_pylist()):
                numbers, _, docs = tokens(part)
                one = once(numbers, docs)
                held[True].append((numbers[one], numbers[one], numbers[one], np.ones(len(one), np.int64)))
                at, pair = neighbours(numbers, docs)
                one = once(pair, docs[at])
                held[False].append((pair[one], numbers[at[one]], numbers[at[one] + 1], np.ones(len(one), np.int64)))
                yield from grown()
        for word, parts in held.items():
            if parts:
                _, a, b, n = added(parts)
                yield rows(a, b, n, word)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([total], pa.int64())], ["a", "b", "n"])

    return texts.select(text).mapInArrow(count, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


class Counts:
    """Counts that executors hold: of words with the reach of each, of pairs, and the totals."""

    def __init__(self, words, reach_n, reach, pairs, pair_n, texts: int, all_words: int, all_pairs: int) -> None:
        self.words, self.word_n, self.reach = words, reach_n, reach
        self.pairs, self.pair_n = pairs, pair_n
        self.texts, self.all_words, self.all_pairs = texts, max(1, all_words), max(1, all_pairs)

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def missing(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Text numbers and numbers of the words and pairs of which no count is held."""
        numbers, _, docs = tokens(texts)
        at, pair = neighbours(numbers, docs)
        out = []
        for table, keys, where in ((self.words, numbers, docs), (self.pairs, pair, docs[at])):
            lost = ~self._find(table, keys)[1]
            keys, where = keys[lost], where[lost]
            one = once(keys, where)
            out.append((where[one], keys[one]))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def with_more(self, keys: np.ndarray, n: np.ndarray, reach: np.ndarray) -> Counts:
        """These counts and some of the others; reach is -1 for pairs."""
        word = reach >= 0

        def merged(a, b, *columns):
            k = np.concatenate([a, b])
            k, one = np.unique(k, return_index=True)
            return k, *(np.concatenate(c)[one] for c in columns)

        w, wn, wr = merged(self.words, keys[word], (self.word_n, n[word]), (self.reach, reach[word]))
        p, pn = merged(self.pairs, keys[~word], (self.pair_n, n[~word]))
        return Counts(w, wn, wr, p, pn, self.texts, self.all_words, self.all_pairs)


def held_counts(counts: DataFrame, most_words: int = HELD_WORDS, most_pairs: int = HELD_PAIRS) -> tuple[Counts, DataFrame | None]:
    """The counts of the most frequent words and pairs, and ``key, n, reach`` of all others above one (None if none)."""
    words = counts.where("a is not null and b is null").select(F.col("a").alias("key"), "n")
    pairs = counts.where("b is not null")
    # The commonest word beside a word tells how many documents could hold it.
    beside = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    reach = beside.join(words.select(F.col("key").alias("b"), F.col("n").alias("m")), "b").groupBy("a").agg(F.max("m").alias("m"))
    words = words.join(reach.withColumnRenamed("a", "key"), "key", "left").select("key", "n", F.greatest("n", F.coalesce("m", F.lit(0))).alias("reach"))
    words = written(words, "word-counts")

    def pair_number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.asarray(batch.column(i)).view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(pair_numbers(a, b).view(np.int64)), batch.column(2)], ["key", "n"])

    pairs = pairs.where("n > 1").select("a", "b", "n").mapInArrow(pair_number, "key bigint, n bigint")

    def floor(df: DataFrame, most: int) -> int:
        """The least count from which on at most ``most`` rows have it."""
        step = F.when(F.col("n") <= 64, F.col("n")).otherwise(F.floor(F.pow(F.lit(2.0), F.floor(8 * F.log2("n")) / 8)))
        hist = sorted(((r[0], r[1]) for r in df.groupBy(step.alias("s")).count().collect()), reverse=True)  # a few hundred rows
        total, least = 0, None
        for s, c in hist:
            if total + c > most:
                break
            total, least = total + c, int(s)
        return least if least is not None else (1 << 62)

    low_word, low_pair = floor(words, most_words), floor(pairs, most_pairs)
    w = words.where(F.col("n") >= low_word).toPandas()
    p = pairs.where(F.col("n") >= low_pair).toPandas()
    total = {(r["w"], r["p"]): r["n"] for r in counts.groupBy(F.col("a").isNull().alias("w"), F.col("b").isNull().alias("p")).agg(F.sum("n").alias("n")).collect()}
    w_key, p_key = w["key"].to_numpy(np.int64).view(np.uint64), p["key"].to_numpy(np.int64).view(np.uint64)
    wo, po = np.argsort(w_key), np.argsort(p_key)
    found = Counts(
        w_key[wo], w["n"].to_numpy(np.int64)[wo], w["reach"].to_numpy(np.int64)[wo], p_key[po], p["n"].to_numpy(np.int64)[po],
        total.get((True, True), 0), total.get((False, True), 0), total.get((False, False), 0),
    )
    more = words.where((F.col("n") < low_word) & (F.col("n") > 1)).union(pairs.where(F.col("n") < low_pair).select("key", "n", F.lit(-1).cast("bigint")))
    return found, None if more.isEmpty() else more


# --- scores ---------------------------------------------------------------------


def score(texts: list[str], counts: Counts, reach: int = REACH, stuffed: float = STUFFED) -> tuple[np.ndarray, np.ndarray]:
    """Mean PMI (NaN without neighbours) and share of the text in stretches of low mean PMI, of each text."""
    size = len(texts)
    numbers, lengths, docs = tokens(texts)
    at, pair = neighbours(numbers, docs)
    if not len(at):
        return np.full(size, np.nan), np.zeros(size)
    spot, known = counts._find(counts.words, numbers)
    n = np.where(known, counts.word_n[spot], 1) if len(counts.words) else np.ones(len(numbers), np.int64)
    near = np.where(known, counts.reach[spot], 1) if len(counts.words) else np.ones(len(numbers), np.int64)
    start = np.searchsorted(docs, np.arange(size), side="left")
    stop = np.searchsorted(docs, np.arange(size), side="right")
    held = stop > start
    widest = np.ones(size)
    widest[held] = np.maximum.reduceat(np.maximum(near, 1), start[held])
    scale = counts.texts / widest
    weight = lengths + 1.0
    _, group = np.unique(mix(numbers) + mix(docs.astype(np.uint64)), return_inverse=True)
    # How frequent a word is: in the corpus, or in the page's text without this word if more.
    in_corpus = np.maximum(n - 1, 1) / counts.all_words * scale[docs]
    whole = np.bincount(docs, weights=weight, minlength=size)
    on_page = (np.bincount(group, weights=weight)[group] - weight) / np.maximum(whole[docs] - weight, 1)
    rate = np.log2(np.maximum(in_corpus, on_page))
    spot, known = counts._find(counts.pairs, pair)
    joined = (np.where(known, counts.pair_n[spot], 1) if len(counts.pairs) else np.ones(len(pair))) - 1.0
    pmi = np.log2((np.maximum(joined, 0.0) + UNSEEN) / counts.all_pairs * scale[docs[at]]) - rate[at] - rate[at + 1]
    sums, over = np.zeros(len(numbers) + 1), np.zeros(len(numbers) + 1)
    both = weight[at] + weight[at + 1]
    sums[at + 1], over[at + 1] = pmi * both, both
    sums, over = np.cumsum(sums), np.cumsum(over)
    here = np.arange(len(numbers))
    lo = np.maximum(here - reach, start[docs])
    hi = np.maximum(np.minimum(here + reach, stop[docs] - 1), lo)
    low = (sums[hi] - sums[lo]) < stuffed * (over[hi] - over[lo])
    share = np.bincount(docs, weights=weight * low, minlength=size) / np.maximum(whole, 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        pairs_of = np.bincount(docs[at], minlength=size)
        mean = np.bincount(docs[at], weights=pmi, minlength=size) / np.where(pairs_of > 0, pairs_of, np.nan)
    return mean, share


def score_pages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", most_words: int = HELD_WORDS, most_pairs: int = HELD_PAIRS) -> DataFrame:
    """``doc_id, mean_pmi, stuffed``, one row per row of ``documents``.

    Copies count once in the corpus and are all scored.  ``stuffed`` is the share of the
    text (words, links and tags, by length) in stretches of low mean PMI.  Null, empty
    and one-word texts score 0 and have no mean.  ``most_words`` and ``most_pairs`` bound
    what executors hold and do not change the result.
    """
    spark = documents.sparkSession
    slim = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counts = written(corpus_counts(distinct_texts(slim, "text"), "text"), "counts")
    found, more = held_counts(counts, most_words, most_pairs)
    held = spark.sparkContext.broadcast(found)  # at most 24 * most_words + 16 * most_pairs bytes
    shape = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, mean_pmi double, stuffed double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            extra = batch.column(2) if batch.num_columns > 2 else None
            for start, part in slices(batch.column(1).to_pylist()):
                use = known
                if extra is not None:
                    own = pa.array(extra.slice(start, len(part))).flatten()
                    if len(own):
                        key, n, reach = (np.asarray(own.field(i)) for i in range(3))
                        use = known.with_more(key.view(np.uint64), n, reach)
                mean, share = score(part, use)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(mean, pa.float64(), from_pandas=True), pa.array(share, pa.float64())], ["doc_id", "mean_pmi", "stuffed"])

    if more is None:
        return slim.mapInArrow(scan, shape)

    def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in slices(batch.column(1).to_pylist()):
                docs, keys = held.value.missing(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs + start)), pa.array(keys.view(np.int64))], ["print", "key"])

    # What the executors do not hold comes by a join, once per text: a list no longer than its text.
    marked = slim.withColumn("print", F.unhex(F.md5("text")))
    wanted = marked.where("print is not null").select("print", "text").mapInArrow(lacking, "print binary, key bigint").distinct()
    lists = wanted.join(more, "key").groupBy("print").agg(F.collect_list(F.struct("key", "n", "reach")).alias("extra"))
    return marked.join(lists, "print", "left").select("doc_id", "text", "extra").mapInArrow(scan, shape)


def stuffed_pages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", flag: float = FLAG) -> DataFrame:
    """The scores of pages of which more than ``flag`` is stuffed."""
    return score_pages(documents, doc_id, text).where(F.col("stuffed") > flag)
