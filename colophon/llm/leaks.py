"""Evaluation passages inside a training corpus.

The test items' word n-grams form a hash set that every executor holds; its size is
bounded.  One pass over the documents maps words to the vocabulary of the test items
(any other word is a gap), hashes token windows in numpy and keeps windows that hit the
set.  Hits of one item that lie close together are verified by aligning the passage
with that place of the document, and only verified places count.  The same pass can
cut the places out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from colophon.llm.unify import canonical_array
from colophon.llm.words import DIGIT, LETTER, code_points, run_numbers, slices

#: Words a window; the share of a passage, and of its content words, that must reappear.
#: Where six of ten words stay, a fifth of all neighbours do, so windows of two words miss no such place.
GRAM, SHARE, CONTENT_SHARE = 2, 0.6, 0.6
#: A word in more than this share of the passages is a turn of style, not content.
COMMON = 0.15
#: Share of a passage that intact windows near one diagonal must cover before it is aligned.
SEED = 0.2
#: Most n-grams of test items held by an executor (about 100 bytes each).
MAX_GRAMS = 4_000_000
_BROKEN = r"(\pL)[-\x{2010}\x{AD}\x{AC}][^\S\n]*\n\s*"
#: What stands between spaces, and what a line-end hyphen joins to it.
_PART = re.compile(r"(?:[^\W\d_][-\u2010\u00ad\u00ac][^\S\n]*\n\s*|\S)+")


def word_arrays(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and text numbers of the words of all texts.

    Lower case; line-end hyphens joined; presentation forms, look-alikes and invisible
    characters undone.
    """
    held = pa.array(texts, pa.large_string())
    if any("\n" in t for t in texts):
        held = pc.replace_substring_regex(held, pattern=_BROKEN, replacement=r"\1")
    points, kind, begin = code_points(canonical_array(held).to_pylist())
    spot, _, numbers = run_numbers(points, (kind == LETTER) | (kind == DIGIT))
    return numbers, np.searchsorted(begin, spot, side="right") - 1


class TestSet:
    """Passages as token numbers, their n-gram index, and which of their words carry content."""

    __test__ = False

    def __init__(self, items: list[tuple[object, np.ndarray]], common: np.ndarray, gram: int = GRAM) -> None:
        self.gram = gram
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t for _, t in items)]))
        passages: dict[bytes, list] = defaultdict(list)
        for item, tokens in items:
            if len(tokens):
                passages[self.numbered(tokens).tobytes()].append(item)
        self.passages = [np.frombuffer(p, np.int64) for p in passages]
        self.items = list(passages.values())
        plain = self.numbered(common)
        self.content = [~np.isin(p, plain) for p in self.passages]
        self.masks, self.content_masks = [], []
        for p, content in zip(self.passages, self.content):
            both: tuple[dict, dict] = {}, {}
            for i, (w, c) in enumerate(zip(p.tolist(), content.tolist())):
                for masks in both[: 1 + c]:
                    masks[w] = masks.get(w, 0) | 1 << i
            self.masks.append(both[0])
            self.content_masks.append(both[1])
        lengths = np.array([len(p) for p in self.passages] or [0], np.int64)
        self.lengths = lengths
        self.contents = [int(c.sum()) for c in self.content]
        self.band = np.maximum(4, lengths // 5)
        self.need = np.maximum(gram, SEED * lengths)
        where: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, p in enumerate(self.passages):
            for i, h in enumerate(self.hashes(p)):
                if self.content[n][i : i + gram].any():  # turns of style alone lead nowhere
                    where[int(h)].append((n, i))
        self.keys = np.array(sorted(where), np.uint64)
        sizes = [len(where[int(k)]) for k in self.keys]
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flat = [x for k in self.keys for x in where[int(k)]]
        self.at = np.array(flat, np.int64).reshape(-1, 2)

    def numbered(self, words: np.ndarray) -> np.ndarray:
        """Places in the vocabulary from 1; 0 for words that no passage has."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0)

    def hashes(self, tokens: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each window of ``gram`` tokens."""
        n = len(tokens) - self.gram + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for j in range(self.gram):
            h = (h ^ tokens[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h


def common_length(masks: dict[int, int], n: int, place: list[int], least: float = 0) -> int:
    """Length of the longest common subsequence of a passage of ``n`` words and ``place``, in bits of one integer.

    ``masks`` has, for each word of the passage, a bit for each of its positions.  A
    length below ``least`` may come as any other bound below it.
    """
    hits = list(filter(None, map(masks.get, place)))
    if len(hits) < least:
        return len(hits)
    whole = (1 << n) - 1
    open_ = whole
    for m in hits:
        hit = open_ & m
        open_ = ((open_ + hit) | (open_ - hit)) & whole
    return n - open_.bit_count()


def aligned(passage: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where in ``place`` a longest common subsequence keeps each passage word; -1 for lost ones."""
    n, m = len(passage), len(place)
    table = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n):
        row = np.where(place == passage[i], table[i, :-1] + 1, table[i, 1:])
        np.maximum.accumulate(np.maximum(row, table[i, 1:]), out=table[i + 1, 1:])
    kept, i, j = np.full(n, -1), n, m
    while i and j:
        if passage[i - 1] == place[j - 1] and table[i, j] == table[i - 1, j - 1] + 1:
            kept[i - 1] = j - 1
            i, j = i - 1, j - 1
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return kept


def places(tokens: np.ndarray, docs: np.ndarray, t: TestSet, share: float, content_share: float, every: bool = False) -> Iterator[tuple[int, int, int, int, float]]:
    """``document, passage number, first token, last token, share`` of a verified place of each passage of each document, or of all its places.

    ``tokens`` are those of all documents in order, ``docs`` their documents; places count
    from the document's first token.
    """
    h = t.hashes(tokens)
    if not len(h) or not len(t.keys):
        return
    live = np.flatnonzero((tokens[: len(h)] > 0) & (docs[: len(h)] == docs[t.gram - 1 :]))
    if not len(live):
        return
    spot = np.minimum(np.searchsorted(t.keys, h[live]), len(t.keys) - 1)
    hit = t.keys[spot] == h[live]
    pos, spot = live[hit], spot[hit]
    if not len(pos):
        return
    count = t.starts[spot + 1] - t.starts[spot]
    back = np.repeat(np.arange(len(pos)), count)
    index = np.arange(len(back)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(t.starts[spot], count)
    number, offset, pos = t.at[index, 0], t.at[index, 1], pos[back]
    # Hits of one passage on nearly one diagonal, within a fifth of its length, form a candidate.
    group = docs[pos] * len(t.passages) + number
    key = (group << 32) + (pos - offset) + (1 << 20)
    order = np.argsort(key, kind="stable")
    key, group, number, offset = key[order], group[order], number[order], offset[order]
    reach = np.searchsorted(key, key + t.band[number], side="right")
    gain = reach - np.arange(len(key))
    # Of the starts on one diagonal the first has the hits of all the others and the same place.
    strong = np.flatnonzero((gain * t.gram >= t.need[number]) & np.r_[True, key[1:] != key[:-1]])
    if not len(strong):
        return
    begin = np.searchsorted(docs, np.arange(docs[-1] + 2))
    line = lambda at: (key[at] & 0xFFFFFFFF) - (1 << 20)
    doc = group[strong] // len(t.passages)
    first = np.maximum(begin[doc], line(strong) - 2)
    stop = np.minimum(begin[doc + 1], line(reach[strong] - 1) + t.lengths[number[strong]] + t.band[number[strong]])
    # Overlapping candidates of one passage lie in one span; what the span keeps bounds what each keeps.
    fresh = np.r_[True, (group[strong][1:] != group[strong][:-1]) | (first[1:] >= np.maximum.accumulate(stop)[:-1])]
    span = np.cumsum(fresh) - 1
    heads = np.flatnonzero(fresh)
    widest = np.maximum.reduceat(stop, heads)
    able = np.zeros(len(heads), bool)
    for i, (a, b, n) in enumerate(zip(first[heads].tolist(), widest.tolist(), number[strong[heads]].tolist())):
        length = len(t.passages[n])
        # The content words are fewer and rarer, so most spans end here.
        place = tokens[a:b].tolist()
        able[i] = common_length(t.content_masks[n], length, place, content_share * t.contents[n]) >= content_share * t.contents[n] and common_length(t.masks[n], length, place, share * length) >= share * length
    kept_starts = np.flatnonzero(able[span])
    cuts = np.flatnonzero(np.r_[True, group[strong[kept_starts]][1:] != group[strong[kept_starts]][:-1], True]) if len(kept_starts) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        mine = kept_starts[a:b]
        n, d = int(number[strong[mine[0]]]), int(doc[mine[0]])
        passage, content = t.passages[n], t.content[n]
        length, refused = len(passage), []
        for c in mine[np.argsort(-gain[strong[mine]], kind="stable")]:
            s, lo, hi = strong[c], int(first[c]), int(stop[c])
            # A part of a place keeps no more words than the place.
            if any(x <= lo and hi <= y for x, y in refused):
                continue
            covered = np.zeros(length + t.gram, bool)
            for j in range(t.gram):
                covered[offset[s : reach[s]] + j] = True
            if covered.sum() < t.need[n]:
                continue
            place = tokens[lo:hi].tolist()
            # The exact number of words kept, and a bound of the content words kept.
            if common_length(t.masks[n], length, place, share * length) < share * length or common_length(t.content_masks[n], length, place) < content_share * t.contents[n]:
                refused.append((lo, hi))
                continue
            where = aligned(passage, tokens[lo:hi])
            kept = where >= 0
            if not content.any() or kept[content].mean() >= content_share:
                at = lo - int(begin[d])
                yield d, n, at + int(where[kept].min()), at + int(where[kept].max()) + 1, float(kept.mean())
                if not every:
                    break
                refused.append((lo, hi))


def _test_sets(items: DataFrame, item_id: str, passage: str, gram: int, max_grams: int) -> Iterator[TestSet]:
    """Test sets of at most ``max_grams`` n-grams; the driver holds one at a time."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(passage).alias("text")).where("text is not null").distinct()

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch.column(0).to_pylist()):
                numbers, docs = word_arrays(part)
                pairs = np.unique(np.stack([docs.astype(np.uint64), numbers]), axis=1) if len(numbers) else np.zeros((2, 0), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64))], ["word"])

    total = rows.count()
    often = rows.select("text").mapInArrow(said, "word bigint").groupBy("word").count().where(F.col("count") > max(3, COMMON * total))
    # A passage has few words, so few words can be in this share of the passages.
    common = np.array([r["word"] for r in often.select("word").collect()], np.int64).view(np.uint64)
    now, size = [], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        tokens, _ = word_arrays([row["text"]])
        if now and size + len(tokens) > max_grams:
            yield TestSet(now, common, gram)
            now, size = [], 0
        now.append((row["item_id"], tokens))
        size += len(tokens)
    yield TestSet(now, common, gram)


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    passage: str = "ground_truth",
    share: float = SHARE,
    content_share: float = CONTENT_SHARE,
    gram: int = GRAM,
    max_grams: int = MAX_GRAMS,
    every: bool = False,
) -> DataFrame:
    """``doc_id, item_id, share, first_char, last_char``: documents that hold a passage, which, and where.

    A passage counts when at least ``share`` of its words, and ``content_share`` of the
    words that are not common to many passages, reappear in order in one place.  The
    place runs from ``first_char`` up to before ``last_char`` of the stored text (code
    points from 0); ``every`` gives all places of a passage in a document, not one.
    Equal passages of several items all count.  Null or empty texts and passages match
    nothing; passages shorter than a window cannot be found.  Repeated document rows
    give repeated rows.  More than ``max_grams`` n-grams are taken in slices, one pass
    over the documents each, so what an executor holds stays bounded.
    """
    spark = documents.sparkSession
    id_type = documents.schema[doc_id].dataType.simpleString()
    item_type = items.schema[item_id].dataType.simpleString()
    slim = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    spec = f"doc_id {id_type}, item_id {item_type}, share double, first_char int, last_char int"
    shape = to_arrow_schema(_parse_datatype_string(spec))
    out = None
    for test_set in _test_sets(items, item_id, passage, gram, max_grams):
        held = spark.sparkContext.broadcast(test_set)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            t = held.value
            for batch in batches:
                keys = batch.column(0).to_pylist()
                rows = []
                for begin, part in slices(batch.column(1).to_pylist()):
                    for i, found in _found(part, t, share, content_share, every):
                        span = _characters_of(part[i], found)
                        rows += [(keys[begin + i], item, got, *at) for (n, _, _, got), at in zip(found, span) for item in t.items[n]]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(shape)], schema=shape)

        hits = slim.mapInArrow(scan, spec)
        out = hits if out is None else out.union(hits)
    return out


def _found(texts: list[str], t: TestSet, share: float, content_share: float, every: bool) -> Iterator[tuple[int, list[tuple[int, int, int, float]]]]:
    """The number of each text that holds a passage, and its places."""
    words, docs = word_arrays(texts)
    found: dict[int, list] = {}
    for d, *place in places(t.numbered(words), docs, t, share, content_share, every):
        found.setdefault(d, []).append(tuple(place))
    yield from found.items()


def _characters_of(text: str, found: list[tuple[int, int, int, float]]) -> list[tuple[int, int]]:
    """Where places given in words stand in the stored text."""
    parts = [m.span() for m in _PART.finditer(text)]
    _, part = word_arrays([text[a:b] for a, b in parts])
    out = []
    for _, first, stop, _ in found:
        a, b = parts[part[min(first, len(part) - 1)]][0], parts[part[min(stop, len(part)) - 1]][1]
        out.append((a, b))
    return out


def cut_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = " ", **options) -> DataFrame:
    """``documents`` with every place that holds a passage cut out of ``text``, and ``cut_chars``, the number of characters cut.

    ``mark`` stands in for each cut.  Rows, also repeated ones and those without a place,
    stay, with all their columns; a column named ``cut_chars`` is replaced.  Options are
    those of ``find_leaks``.
    """
    spark = documents.sparkSession
    kept = [c for c in documents.columns if c != "cut_chars"]
    share, content_share = options.get("share", SHARE), options.get("content_share", CONTENT_SHARE)
    out = documents.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).alias("cut_chars"))
    shape = out.schema
    for test_set in _test_sets(items, options.get("item_id", "item_id"), options.get("passage", "ground_truth"), options.get("gram", GRAM), options.get("max_grams", MAX_GRAMS)):
        held = spark.sparkContext.broadcast(test_set)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index(text)
                stored = batch.column(at).to_pylist()
                new, lost = list(stored), batch.column(len(kept)).to_pylist()
                for begin, part in slices(stored):
                    for i, found in _found(part, held.value, share, content_share, True):
                        whole, done, pieces = part[i], 0, []
                        for a, b in sorted(_characters_of(whole, found)):
                            if a >= done:
                                pieces += [whole[done:a], mark]
                            lost[begin + i] += max(0, b - max(a, done))
                            done = max(done, b)
                        new[begin + i] = "".join(pieces) + whole[done:]
                columns = [*batch.columns]
                columns[at], columns[-1] = pa.array(new, batch.column(at).type), pa.array(lost, pa.int32())
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        out = out.mapInArrow(scan, shape)
    return out


def remove_leaks(documents: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents without those that hold a passage."""
    return documents.join(leaks.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")
