"""Variant spellings of the names of people, bodies and works.

1. Distinct stored strings are parsed to a form: characters unified, marks, case,
   titles, roles, editions, copies and subtitles set aside, reordered parts restored.
2. Pigeonhole segment join: a key of a form (a surname, each word of a body, a title's
   content words) is cut into k + 1 segments; an inverted index of segments is probed
   with the substrings that k edits can have shifted there.  A match within k edits
   must share a segment, so nothing within k edits is lost.
3. Candidates pass a banded edit distance in the JVM and then the rules of their kind
   (nicknames, initials, abbreviations, volumes, which words may be typos).
4. Links become entities as connected components.  Forms with initials only join the
   one entity they fit, none if they fit several.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.llm.components import connected_components
from colophon.llm.unify import canonical_text
from colophon.storage import written

#: Edits that a key may differ by from five letters on: the two that ``typo`` admits, a swap counted as two; the banded check of a pair's keys.
MAX_EDITS = 4
#: Parts over which the forms that share a hot word spread.
SALTS = 16
# Strings that name nobody, compared in lower case without punctuation.
PLACEHOLDERS = {"", "na", "n a", "anon", "anonymous", "unknown", "various", "none", "null", "unbekannt", "inconnu", "s n", "n n", "no author", "untitled", "diverse", "divers"}
ROLES = {"ed", "eds", "editor", "hrsg", "hg", "trans", "translator", "author", "übers", "ubers", "dir", "autor", "auteur"}
TITLES = {"prof", "dr", "mr", "mrs", "ms", "sir", "professor", "doctor", "rev", "hon", "herr", "frau"}
BODY_WORDS = {"academy", "institute", "society", "college", "foundation", "university", "department", "circle", "press", "association", "school", "centre", "center", "group", "museum", "library"}
SMALL_WORDS = {"the", "a", "an", "of", "and", "at", "for", "in", "on", "to", "und", "der", "die", "das", "et", "de", "la", "le", "les", "des", "du"}
#: Most pairs of a given name and a short form, given or learnt; more raise an error.
MOST_SHORT_NAMES = 100_000

_EDITION = re.compile(r"\[[^\]]*\]|\s--\s.*$|[,;(]?\s*\b(?:rev(?:ised)?\.?|\d+(?:st|nd|rd|th)|new)\s+ed(?:ition|n)?\b\.?\)?|\((?:copy|scan|duplicate)[^)]*\)", re.I)
_VOLUME = re.compile(r"[,;(]?\s*\b(?:vol(?:ume)?|band|bd|tome|part)\b\.?\s+(\d+|[ivxlcdm]+)\b\s*\)?", re.I)
_SUBTITLE = re.compile(r"(?::\s+|\s+[-–—]\s+|\.\s+)(?=\S).*$", re.S)


def number(text: str) -> int:
    """A number in figures or Roman numerals; 0 if it is neither."""
    if text.isdigit():
        return int(text)
    values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.get(c, 0) for c in text.lower()]
    return 0 if 0 in values else sum(-a if a < b else a for a, b in zip(values, [*values[1:], 0]))


def plain(text: str) -> str:
    """Unified characters, no marks, lower case."""
    if not text.isascii():
        text = unicodedata.normalize("NFD", canonical_text(text) or "").casefold()
        text = "".join(c for c in text if not unicodedata.combining(c)).replace("ø", "o").replace("ł", "l").replace("æ", "ae").replace("œ", "oe")
    return text.lower()


def parse_author(text: str) -> tuple[str, list[str], list[str], list[str], int]:
    """``kind, words, abbreviations, initials, 0`` of a person or body."""
    s = plain(text)
    s = re.sub(r"\(([^)]*)\)", lambda m: " " if m[1].strip(" .") in ROLES else f", {m[1]}", s)
    if re.sub(r"[^a-z0-9]+", " ", s).strip() in PLACEHOLDERS:
        return "none", [], [], [], 0
    found = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?|,", s)
    while found and found[0].rstrip(".") in TITLES and len(found) > 1:
        found.pop(0)
    words = [w for w in found if w != ","]
    bare = [w.rstrip(".") for w in words]
    if "of" in bare or len([w for w in bare if len(w) > 1 and w not in SMALL_WORDS]) > 3 or BODY_WORDS & set(bare):
        keep = [w for w in words if w.rstrip(".") not in SMALL_WORDS]
        return "body", sorted(w for w in keep if not w.endswith(".")), sorted(w.rstrip(".") for w in keep if w.endswith(".")), [], 0
    if "," in found and found[-1] != ",":
        cut = found.index(",")
        found = [*found[cut + 1 :], *found[:cut]]
    parts = [w.rstrip(".") for w in found if w != ","]
    return "person", [w for w in parts if len(w) > 1], [], [w for w in parts if len(w) == 1], 0


def parse_title(text: str) -> tuple[str, list[str], list[str], list[str], int]:
    """``kind, words, [], [], volume`` of a work; 0 without a volume."""
    s = plain(text).replace("_", " ").replace("&", " and ")
    s = re.sub(r"\s+", " ", s).strip()
    s = _EDITION.sub(" ", s)
    volume = 0
    if m := _VOLUME.search(s):
        volume = number(m[1])
        s = s[: m.start()] + " " + s[m.end() :]
    s = s.strip(" .,;")
    main = _SUBTITLE.sub("", s)
    if len(re.findall(r"[^\W\d_]{3,}", main)) >= 2:
        s = main
    if m := re.search(r",\s*(the|a|an|der|die|das|le|la|les)$", s.strip(" .,;")):
        s = f"{m[1]} {s[: m.start()]}"
    words = re.findall(r"\w+", s)
    if len(words) > 1 and words[0] in ("the", "a", "an", "der", "die", "das", "le", "la", "les"):
        words = words[1:]
    if " ".join(words) in PLACEHOLDERS:
        return "none", [], [], [], 0
    return "work", words, [], [], volume


def close(a: str, b: str, most: int) -> int:
    """Edits (a swap of neighbours is one) between two words within a band; ``most + 1`` if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        row = [most + 1] * (len(b) + 1)
        if i <= most:
            row[0] = i
        for j in range(lo, hi + 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != b[j - 1]))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, before[j - 2] + 1)
            row[j] = cost
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def typo(a: str, b: str, count: dict[str, int]) -> int:
    """Edits if one word can be a misspelling of the other, else 9.

    Two words that both occur in many names are two words, however close.  A negative
    count marks a given name.
    """
    if a == b:
        return 0
    if min(len(a), len(b)) < 4:
        return 1 if close(a, b, 1) == 1 and min(abs(count.get(a, 0)), abs(count.get(b, 0))) <= 2 and min(len(a), len(b)) > 2 else 9
    n = close(a, b, 2)
    if n > 2:
        return 9
    rare, common = sorted((abs(count.get(a, 0)), abs(count.get(b, 0))))
    return n if rare <= 2 or rare <= 0.1 * common else 9


class Nicknames:
    """Which given names a short form can stand for; both directions, plain spelling."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        self.full: dict[str, set[str]] = {}
        for name, short in pairs:
            self.full.setdefault(plain(short), set()).add(plain(name))

    def learn(self, pairs: list[tuple[str, str]]) -> None:
        for name, short in pairs:
            self.full.setdefault(short, set()).add(name)

    def names(self, word: str) -> set[str]:
        return {word} | self.full.get(word, set())

    def initials(self, word: str) -> set[str]:
        return {w[0] for w in self.names(word) if w}

    def same(self, a: str, b: str, count: dict[str, int]) -> int:
        """Edits between two given names, 0 for a known or clipped short form, 9 if they differ."""
        if self.names(a) & self.names(b):
            return 0
        short, long = sorted((a, b), key=len)
        if len(short) < len(long) and (long.startswith(short) and len(short) >= 2):
            return 0
        if 2 <= len(short) <= 6 and short[:2] == long[:2] and re.search(r"(?:ie|y|i)$", short) and long.startswith(re.sub(r"(.)\1?(?:ie|y|i)$", r"\1", short)[:2]) and len(long) > len(short):
            return 0
        return min(typo(x, y, count) for x in self.names(a) for y in self.names(b))


def same_person(a: dict, b: dict, nick: Nicknames, count: dict[str, int]) -> bool:
    """Surname alike, given names or initials compatible, middle initials not at odds."""
    aw, bw = list(a["words"]), list(b["words"])
    if not aw or not bw:
        return False
    for i, x in enumerate(aw):
        for j, y in enumerate(bw):
            if min(len(x), len(y)) < 4 or (count.get(x, 0) < 0 and count.get(y, 0) < 0):
                # Short surnames and those that are given names too: equal and last on both sides.
                if x != y or i < len(aw) - 1 or j < len(bw) - 1:
                    continue
            edits = typo(x, y, count)
            if edits > 2:
                continue
            ra, rb = aw[:i] + aw[i + 1 :], bw[:j] + bw[j + 1 :]
            ia, ib = list(a["initials"]), list(b["initials"])
            if ra and rb:
                first = nick.same(ra[0], rb[0], count)
                if first > 3 and edits == 0 and min(len(x), len(ra[0]), len(rb[0])) >= 6 and min(abs(count.get(ra[0], 0)), abs(count.get(rb[0], 0))) <= 2:
                    first = close(ra[0], rb[0], 3)
                if edits + first > 3 or (ra[1:] and rb[1:] and nick.same(ra[1], rb[1], count) > 1):
                    continue
                if ia and ib and set(ia).isdisjoint(ib):
                    continue
                return True
            if ra or rb:
                given, letters = (ra, ib) if ra else (rb, ia)
                own = ia if ra else ib
                if letters and letters[0] in nick.initials(given[0]) and (len(letters) < 2 or not own or own[0] == letters[1]):
                    return True
                continue
            if ia and ib and ia[0] == ib[0] and (len(ia) < 2 or len(ib) < 2 or ia[1] == ib[1]):
                return True
    return False


def same_body(a: dict, b: dict, count: dict[str, int]) -> bool:
    """Every word has its own partner: equal, misspelt, or abbreviated."""
    if len(a["words"]) + len(a["short"]) != len(b["words"]) + len(b["short"]):
        return False
    left, right = list(a["words"]), list(b["words"])
    for w in list(left):
        if w in right:
            left.remove(w)
            right.remove(w)
    edits = 0
    for w in list(left):
        best = min(((typo(w, v, count), v) for v in right), default=(9, ""))
        if best[0] <= 2:
            edits += best[0]
            left.remove(w)
            right.remove(best[1])
    for shorts, words in ((list(a["short"]), right), (list(b["short"]), left)):
        for s in shorts:
            for w in list(words):
                if w[0] == s[0] and _within(s, w):
                    words.remove(w)
                    break
            else:
                other = b["short"] if shorts == list(a["short"]) else a["short"]
                if s not in other:
                    return False
    return not left and not right and edits <= 3


def _within(short: str, word: str) -> bool:
    it = iter(word)
    return all(c in it for c in short)


def same_work(a: dict, b: dict, count: dict[str, int]) -> bool:
    """Word for word equal or misspelt, three edits at most, and the same volume."""
    if a["volume"] != b["volume"] or len(a["words"]) != len(b["words"]):
        return False
    edits = 0
    for x, y in zip(a["words"], b["words"]):
        edits += typo(x, y, count)
        if edits > 3:
            return False
    return True


def learned_short_names(forms: DataFrame, counts: DataFrame) -> DataFrame:
    """``given_name, short_name`` seen beside the same surnames, beyond the given table.

    A rarer given name that shares at least half of its surnames, two or more, with a
    commoner one stands for it.
    """
    two = forms.where("kind = 'person' and size(words) = 2").select(F.explode(F.array(F.struct(F.get("words", 0).alias("given"), F.get("words", 1).alias("surname")), F.struct(F.get("words", 1).alias("given"), F.get("words", 0).alias("surname"))))).select("col.*")
    given = counts.where("given").select(F.col("word").alias("given"))
    sure = two.join(given, "given").join(given.withColumnRenamed("given", "surname"), "surname", "left_anti").distinct()
    wide = sure.groupBy("given").agg(F.count("*").alias("n"))
    pair = sure.withColumnRenamed("given", "short").join(sure, "surname").where("short <> given").groupBy("short", "given").agg(F.count("*").alias("c")).where("c >= 2")
    pair = pair.join(wide.select(F.col("given").alias("short"), F.col("n").alias("ns")), "short").join(wide, "given")
    return pair.where("ns < n and 2 * c >= ns").select(F.col("given").alias("given_name"), F.col("short").alias("short_name"))


def _name_pairs(pairs: DataFrame) -> list[tuple[str, str]]:
    """The pairs of a table of names, whose number is bounded."""
    rows = pairs.limit(MOST_SHORT_NAMES + 1).collect()
    if len(rows) > MOST_SHORT_NAMES:
        raise ValueError(f"more than {MOST_SHORT_NAMES} pairs of given names and short forms")
    return sorted((r[0], r[1]) for r in rows)


def _budget(length: Column) -> Column:
    return F.when(length >= 5, MAX_EDITS).otherwise(0)


_FORM = "field string, value string, kind string, form string, words array<string>, short array<string>, initials array<string>, volume int"


def parsed(values: DataFrame) -> DataFrame:
    """Distinct stored strings (``field, value``) with their form; placeholders are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for field, value in zip(batch["field"], batch["value"]):
                kind, words, short, initials, volume = (parse_author if field == "author" else parse_title)(value)
                if kind != "none" and (words or short):
                    rows.append((field, value, kind, f"{kind}|{' '.join(words)}|{' '.join(short)}|{' '.join(initials)}|{volume}", words, short, initials, volume))
            yield pd.DataFrame(rows, columns=["field", "value", "kind", "form", "words", "short", "initials", "volume"])

    return values.mapInPandas(run, _FORM)


def _keys(forms: DataFrame, counts: DataFrame) -> DataFrame:
    """``form, key, also``: strings to match by segments; ``also`` must be equal too.

    A person's words other than given names, those of two words each beside the other, and the last word if it is short or a given
    name, with the initials of what stands beside;
    each of a body's words of four letters or more, with the number of words and
    abbreviations; a work's content words in one string, with the volume.
    """
    word = forms.where("kind <> 'work'").select("form", "kind", "words", "short", "firsts", F.explode("words").alias("word")).join(counts.where("field = 'author'"), "word")
    surname = "word = element_at(words, -1)"
    persons = word.where(f"kind = 'person' and ((not given and length(word) >= 4) or {surname})").select("form", F.col("word").alias("key"), F.explode("firsts").alias("also"))
    bodies = word.where("kind = 'body' and length(word) >= 4").select("form", F.col("word").alias("key"), F.concat(F.lit("body"), (F.size("words") + F.size("short")).cast("string")).alias("also"))
    small = F.array(*[F.lit(w) for w in sorted(SMALL_WORDS)])
    works = forms.where("kind = 'work'").select(
        "form",
        F.array_join(F.when(F.size(F.array_except("words", small)) > 0, F.filter("words", lambda w: ~F.array_contains(small, w))).otherwise(F.col("words")), " ").alias("key"),
        F.concat(F.lit("v"), F.col("volume").cast("string")).alias("also"),
    )
    # A given name misspelt from its first letter on: by its own segments, beside the same surname.
    two = forms.where("kind = 'person' and size(words) = 2")
    given = two.select("form", F.explode(F.array(*[F.struct(F.get("words", i).alias("key"), F.concat(F.lit("beside "), F.get("words", 1 - i)).alias("also")) for i in (0, 1)])).alias("k")).select("form", "k.key", "k.also")
    return persons.union(given.where("length(key) >= 5")).union(bodies).union(works).distinct()


def segment_join(keys: DataFrame) -> DataFrame:
    """``form_a, form_b`` of keys within their edit budget, by the pigeonhole principle.

    Distinct keys meet first; forms join to the pairs of keys left, spread over ``SALTS``.
    """
    k = keys.select("key", "also").distinct().withColumn("len", F.length("key")).withColumn("budget", _budget(F.col("len")))

    def start(length: Column, parts: Column, i: Column) -> Column:  # segment i of parts, from 0
        return F.floor(length * i / parts).cast("int")

    seg_of = lambda length, parts, i: F.struct(start(length, parts, i).alias("at"), (start(length, parts, i + 1) - start(length, parts, i)).alias("size"))
    index = k.select("key", "also", "len", "budget", F.explode(F.sequence(F.lit(0), F.col("budget"))).alias("i"))
    index = index.withColumn("s", seg_of(F.col("len"), F.col("budget") + 1, F.col("i")))
    index = index.select("key", "also", F.xxhash64("also", "len", "i", F.substring(F.col("key"), F.col("s.at") + 1, F.col("s.size"))).alias("cell"))

    probe = k.select("key", "also", "len", F.explode(F.sequence(F.greatest(F.lit(1), F.col("len") - MAX_EDITS), F.col("len"))).alias("other"))
    probe = probe.withColumn("budget", _budget(F.col("other"))).where("len - other <= budget")
    probe = probe.select("*", F.explode(F.sequence(F.lit(0), F.col("budget"))).alias("i")).withColumn("s", seg_of(F.col("other"), F.col("budget") + 1, F.col("i")))
    more = F.col("len") - F.col("other")
    low, high = -F.floor((F.col("budget") - more) / 2).cast("int"), F.floor((F.col("budget") + more) / 2).cast("int")
    probe = probe.select("*", F.explode(F.sequence(low, high)).alias("shift")).where("s.at + shift >= 0 and s.at + shift + s.size <= len")
    probe = probe.select("key", "also", F.xxhash64("also", "other", "i", F.substring(F.col("key"), F.col("s.at") + F.col("shift") + 1, F.col("s.size"))).alias("cell")).distinct()

    a, b = probe.select(F.col("key").alias("ka"), "also", "cell"), index.select(F.col("key").alias("kb"), "also", "cell")
    near = a.join(b, ["cell", "also"]).where(F.levenshtein("ka", "kb", MAX_EDITS + 1) >= 0).select("ka", "kb", "also").distinct()
    near = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = keys.select(F.col("form").alias("fa"), F.col("key").alias("ka"), "also")
    right = keys.select(F.col("form").alias("fb"), F.col("key").alias("kb"), "also", F.pmod(F.hash("form"), F.lit(SALTS)).alias("salt"))
    pairs = left.join(near, ["ka", "also"]).join(right, ["kb", "also", "salt"]).where("fa <> fb")
    return pairs.select(F.least("fa", "fb").alias("form_a"), F.greatest("fa", "fb").alias("form_b")).distinct()


def _may_pair(a: str, b: str) -> Column:
    """Whether each word of body ``a`` is in ``b``, near a word of it, or may be abbreviated there: needed for ``same_body``."""
    near = lambda w: F.exists(f"words_{b}", lambda v: F.levenshtein(w, v, 4) >= 0)  # noqa: E731  two edits or swaps, a swap being two
    cut = lambda w: F.exists(f"short_{b}", lambda s: F.substring(s, 1, 1) == F.substring(w, 1, 1))
    return F.forall(F.array_except(f"words_{a}", f"words_{b}"), lambda w: near(w) | cut(w))


def entities(values: DataFrame, short_names: DataFrame | None, field: str | None = None) -> DataFrame:
    """``field, value, entity`` of distinct strings (``field, value``; or ``value`` of one ``field``), all fields in one run.

    The kind of a string stands in its form, so strings of different fields never meet.
    """
    spark = values.sparkSession
    if field is not None:
        values = values.select(F.lit(field).alias("field"), "value")
    pairs = [] if short_names is None else _name_pairs(short_names.where("given_name is not null and short_name is not null").select("given_name", "short_name").distinct())
    nick = Nicknames(pairs)
    known = sorted({plain(x) for p in pairs for x in p})
    rows = written(parsed(values), "forms")
    forms = rows.groupBy("field", "form").agg(*[F.first(c).alias(c) for c in ("kind", "words", "short", "initials", "volume")])
    words = forms.select("field", "form", "kind", F.size("words").alias("size"), F.posexplode("words").alias("spot", "word"))
    counts = words.groupBy("field", "word").agg(F.countDistinct("form").alias("n"), F.sum(F.when((F.col("spot") == 0) & (F.col("size") > 1), 1).otherwise(0)).alias("first"))
    is_known = F.col("word").isin(known) if known else F.lit(False)
    counts = written(counts.select("field", "word", "n", (is_known | ((F.col("n") >= 3) & (F.col("first") >= 0.7 * F.col("n")))).alias("given")), "words")
    nick.learn(_name_pairs(learned_short_names(forms, counts.where("field = 'author'"))))

    def beside(kind: pd.Series, words: pd.Series, initials: pd.Series) -> pd.Series:
        out = []
        for k, w, i in zip(kind, words, initials):
            letters = set()
            if k == "person":
                if len(w) > 1:
                    for x in w:
                        letters |= nick.initials(x)
                else:
                    letters |= set(i[:1])
            out.append(sorted(letters))
        return pd.Series(out)

    beside_udf = F.pandas_udf(beside, "array<string>")
    with_firsts = forms.withColumn("firsts", beside_udf("kind", "words", "initials"))
    candidates = segment_join(_keys(with_firsts, counts))

    per_form = words.join(counts.select("field", "word", F.when(F.col("given"), -F.col("n")).otherwise(F.col("n")).alias("n")), ["field", "word"]).groupBy("form").agg(F.map_from_entries(F.collect_set(F.struct("word", "n"))).alias("n"))
    full = written(forms.join(per_form, "form", "left"), "counted")
    side = lambda s: full.select(*[F.col(c).alias(f"{c}_{s}") for c in ("form", "kind", "words", "short", "initials", "volume", "n")])
    both = candidates.join(side("a"), "form_a").join(side("b"), "form_b").where("kind_a = kind_b")
    both = both.where((F.col("kind_a") != "body") | (_may_pair("a", "b") & _may_pair("b", "a")))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                a = {c: r[f"{c}_a"] for c in ("words", "short", "initials", "volume")}
                b = {c: r[f"{c}_b"] for c in ("words", "short", "initials", "volume")}
                count = dict(r["n_a"] or {}) | dict(r["n_b"] or {})
                if r["kind_a"] == "person":
                    ok = same_person(a, b, nick, count)
                elif r["kind_a"] == "body":
                    ok = same_body(a, b, count)
                else:
                    ok = same_work(a, b, count)
                if ok:
                    letters = [r["kind_a"] == "person" and len(x["words"]) < 2 for x in (a, b)]
                    out.append((r["form_a"], r["form_b"], *letters))
            yield pd.DataFrame(out, columns=["form_a", "form_b", "only_a", "only_b"])

    links = written(both.mapInPandas(check, "form_a string, form_b string, only_a boolean, only_b boolean"), "links")
    sure = links.where("not only_a and not only_b").select("form_a", "form_b")
    # Initials only: to the one entity they fit, else to each other if they fit none.
    half = links.where("only_a <> only_b").select(F.when(F.col("only_a"), F.col("form_a")).otherwise(F.col("form_b")).alias("src"), F.when(F.col("only_a"), F.col("form_b")).otherwise(F.col("form_a")).alias("dst"))
    fitting = half.select("src").distinct()
    lone = links.where("only_a and only_b").join(fitting.select(F.col("src").alias("form_a")), "form_a", "left_anti").join(fitting.select(F.col("src").alias("form_b")), "form_b", "left_anti")
    names = connected_components(sure.union(lone.select("form_a", "form_b")), "form_a", "form_b")
    placed = half.join(names.withColumnRenamed("node", "dst"), "dst", "left").select("src", F.coalesce("component", "dst").alias("entity"))
    fit = placed.groupBy("src").agg(F.countDistinct("entity").alias("n"), F.min("entity").alias("entity")).where("n = 1").select(F.col("src").alias("node"), F.col("entity").alias("component"))
    named = names.union(fit).withColumnRenamed("node", "form")
    return rows.select("field", "value", "form").join(named, "form", "left").select("field", "value", F.coalesce("component", "form").alias("entity"))


def _values(df: DataFrame, field: str) -> DataFrame:
    return df.select(F.lit(field).alias("field"), F.col(field).cast("string").alias("value")).where("value is not null").distinct()


def spelling_entities(df: DataFrame, field: str | tuple[str, ...], short_names: DataFrame | None = None) -> DataFrame:
    """``field_name, value, entity``: each distinct stored string that names somebody, once, with its entity.

    ``field`` is ``author``, ``title`` or both; both cost about as much as one.  The
    entity is named by its least form.  No pairs: an entity of very many spellings costs
    one row each.  Nulls, blanks and placeholders name nobody.
    """
    fields = (field,) if isinstance(field, str) else field
    values = _values(df, fields[0])
    for f in fields[1:]:
        values = values.union(_values(df, f))
    return entities(values, short_names).select(F.col("field").alias("field_name"), "value", "entity")


def variant_pairs(df: DataFrame, field: str | tuple[str, ...], short_names: DataFrame | None = None) -> DataFrame:
    """``field_name, value_a, value_b`` (``value_a < value_b``): stored strings of one entity.

    ``field`` is ``author``, ``title`` or both.  Only distinct strings are compared, so how
    often a string is stored costs nothing.  Nulls, blanks and placeholders name
    nobody.  An empty table gives an empty result.
    """
    named = spelling_entities(df, field, short_names)
    a, b = named.select("field_name", F.col("value").alias("value_a"), "entity"), named.select("field_name", F.col("value").alias("value_b"), "entity")
    return a.join(b, ["field_name", "entity"]).where("value_a < value_b").select("field_name", "value_a", "value_b")
