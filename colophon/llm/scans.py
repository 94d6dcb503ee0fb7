"""Repair of text from scanned pages.

Running headers, footers and page numbers are found by position on the page (isolated
blocks, number near the chunk's pages, capitals, likeness to heading and title).  Cut
words are rejoined across line and page ends.  Misread words go to an averaged-
perceptron character editor that labels every character keep, replace, delete or insert,
and every line end inside a word join or hyphen.  It is trained here: confusions are
aligned from the corpus' own rare words; noised lexicon words and lexicon words cut at
random places, or at their own hyphens, give labelled characters.  The editor proposes;
its loss against counts over the whole corpus decides.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.spellings import close
from colophon.llm.unify import canonical_text
from colophon.storage import written

#: Words the executors hold (the most frequent of clean chunks), words and noised copies for training.
LEXICON, TRAIN_WORDS, NOISED = 200_000, 12_000, 4
#: Rare words that the editor's fit looks at, and lexicon words of like ends that it compares each with.
FIT_WORDS, FIT_NEAR = 8_000, 400
#: The editor's beam: readings of a part, of a word, labels tried a character, edits a reading.
PART_READINGS, WORD_READINGS, LABELS, EDITS = 24, 48, 6, 4
#: How many times as often a repair must occur as the stored word.
GAIN = 8.0
#: A word unknown to clean chunks counts as known from this many scanned occurrences.
SCAN_KNOWN = 20
#: Weight of a reading's log count against the editor's loss.
EVIDENCE = 0.1
#: Pages a printed number may lie from the chunk's pages.
PAGE_SLACK = 20
CUT = "\x01"
#: A longer run of letters and digits is no word (a key, an encoded file) and stays as stored.
LONGEST = 64
#: A longer line is no running header.
LONGEST_LINE = 200

_HARD = re.compile(r"[^\n]\n[^\n]")
_WORD = re.compile(r"(?:!(?=[^\W\d_]))?[^\W_]+(?:[-'’!\x01‐]+[^\W_]+)*!?")
_ODD = re.compile("[^\\x00-\\x7fÀ-ÖØ-öø-ÿŒœŸ‐‑–—‘’“”„…«»¬°§]")
_FIRST = re.compile(r"!?[^\W_]*[^\W\d_]")
_LATIN = re.compile("[A-Za-z\uff21-\uff3a\uff41-\uff5aÀ-ÿﬀ-ﬆ]")
_OTHER_SCRIPT = re.compile("[\u0370-\u052f\u1f00-\u1fff]")
_UNSEEN = re.compile("[\u00ad\u034f\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_SPACES = re.compile("[^\\S\n ]")
_ODD_WORD = re.compile("\\S*[^\\x00-\\x7fÀ-ÖØ-öø-ÿŒœŸ‐‑–—‘’“”„…«»¬°§\\s]\\S*")
_CUT_BREAK = re.compile(r"[-‐\u00ad¬][^\S\n]*\n\s*")
_LOWER = re.compile(r"(?<![^\W_])[a-zß-öø-ÿ][0-9a-zß-öø-ÿ]{3,}")
_NUMBER_LINE = re.compile(r"^\W*(?:p\.|pp\.|page|seite|s\.)?\W*(\d{1,4})\W*$", re.I)
_SIDE_NUMBER = re.compile(r"^\W*(\d{1,4})\s*[\s|/·•–—-]\s*(\D.*)$|^(.*\D)[\s|/·•–—-]\s*(\d{1,4})\W*$")
# Words that titles write small, in three languages.
_SMALL = {
    "of", "the", "and", "against", "on", "in", "a", "an", "to", "for", "with", "at", "by", "from", "into", "about", "without", "between",
    "de", "la", "le", "et", "des", "du", "avec", "contre", "sans", "entre", "pour", "dans", "sous", "vers",
    "der", "die", "das", "und", "von", "über", "gegen", "ohne", "zwischen", "nach", "eine", "einer",
}
_DIGIT_LETTER = str.maketrans("01568", "olsbb")


def is_scan(text: str) -> bool:
    """Lines broken inside paragraphs, as on a printed page."""
    return bool(_HARD.search(text))


def _bare(text: str | None) -> str:
    """Letters only, look-alike digits as letters, for comparing headers."""
    return re.sub(r"[\W_]+", "", (text or "").lower().translate(_DIGIT_LETTER))


@lru_cache(maxsize=100_000)
def _small(word: str) -> bool:
    """Whether a lower-case word is one that titles write small, perhaps misread in one place."""
    word = word.translate(_DIGIT_LETTER)
    return word in _SMALL or (len(word) > 5 and any(len(w) > 5 and close(word, w, 1) <= 1 for w in _SMALL))


def _body(line: str) -> bool:
    """Whether a line has a word that no title writes in lower case."""
    return any(not _small(w) for w in _LOWER.findall(line))


def _titled(text: str) -> bool:
    """Capitals where a running header has them: all, or every word but small ones."""
    words = re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", text)
    letters = [w for w in words if any(c.isalpha() for c in w)]
    if not letters or len(words) > 14:
        return False
    if sum(c.isupper() for c in text) > 0.6 * sum(c.isalpha() for c in text):
        return True
    large = [w for w in letters if len(w) > 3 and not _small(w.lower())]
    return bool(large) and all(w[0].isupper() or w[0].isdigit() for w in large) and (letters[0][0].isupper() or letters[0][0].isdigit())


def furniture(lines: list[str], first_page: int | None, last_page: int | None, heading: str | None, source: str | None) -> list[bool]:
    """Which lines are a running header, footer or page number.

    Scores a number near the chunk's pages, capitals, likeness to the heading or the
    title in the file name, and position: alone between blank lines, or beside a line
    that is furniture already.
    """
    n = len(lines)
    pages = sorted(p for p in (first_page, last_page) if p)
    lo, hi = (pages[0] - PAGE_SLACK, pages[-1] + PAGE_SLACK) if pages else (1, 9999)
    head, title = _bare(heading), _bare(source)
    scores = []
    for i, line in enumerate(lines):
        s = line.strip()
        if not s or len(s) > LONGEST_LINE or _body(s):
            scores.append(0)
            continue
        alone = (i == 0 or not lines[i - 1].strip()) and (i == n - 1 or not lines[i + 1].strip())
        if m := _NUMBER_LINE.match(s):
            near = lo <= int(m[1]) <= hi and not re.search(r"[.,;:?!]$", s)
            scores.append(3 if near else 1 if alone and not s.endswith(".") else 0)
            continue
        number, rest = None, s
        if m := _SIDE_NUMBER.match(s):
            number, rest = (int(m[1]), m[2]) if m[1] else (int(m[4]), m[3])
        bare = _bare(rest)
        stopped = ". " in rest or bool(re.search(r"[.!?;:,»”\"-]$|[‐¬]$", rest.rstrip(" |/·•–—") if number is not None else s))
        titled = _titled(rest) and not stopped
        score = 2 if titled and (number is not None or alone or len(rest.split()) > 1) else 1 if titled else 0
        score += number is not None and lo <= number <= hi
        score += 2 * (len(bare) >= 6 and (bare == head or (titled and bare in title)))
        score -= 2 * (stopped or s[:1].islower())
        scores.append(score)
    return [
        x >= 2 or (x == 1 and ((i and scores[i - 1] >= 3) or (i + 1 < n and scores[i + 1] >= 3)))
        for i, x in enumerate(scores)
    ]


def join_lines(lines: list[str | None]) -> str:
    """Paragraphs of lines, furniture given as None; a cut word carries ``CUT`` at the line end.

    A blank line beside furniture does not end a paragraph that runs on.
    """
    paragraphs: list[str] = []
    now = ""
    gap = False
    for line in lines:
        if line is None:
            continue
        s = line.strip()
        if not s:
            gap = bool(now)
            continue
        if now and now[-1] in "-‐\u00ad¬" and len(now) > 1 and now[-2].isalnum() and _FIRST.match(s) and (not s[0].isupper() or not gap):
            now = now[:-1] + CUT + s
        elif now and gap and s[0].isupper() and re.search(r"[.!?:;\"”»)\]…]$", now):
            paragraphs.append(now)
            now = s
        else:
            now = f"{now} {s}" if now else s
        gap = False
    if now:
        paragraphs.append(now)
    return "\n\n".join(paragraphs)


def tokens(text: str) -> list[str]:
    """Words with a letter, in lower case; hyphens, apostrophes and misread marks inside stay, a trailing ``!`` too."""
    return [w for w in _WORD.findall(text.lower()) if len(w) <= LONGEST and (not w[0].isdigit() or not w.isdigit())]


def _undone(match: re.Match) -> str:
    """A word with odd characters in plain ones; words of another script keep their letters."""
    word = match[0]
    if not _LATIN.search(word) and _OTHER_SCRIPT.search(word):
        return unicodedata.normalize("NFC", _UNSEEN.sub("", word))
    return canonical_text(word)


def readable(text: str) -> str:
    """Invisible characters and look-alikes undone where a text has any; line breaks stay."""
    if text.isascii() or not _ODD.search(text):
        return text
    text = _SPACES.sub(" ", text.replace("\u00ad\n", "-\n"))
    return _ODD_WORD.sub(_undone, text)


def spaced_words(text: str) -> tuple[bool, list[str]]:
    """Whether a chunk is scanned, and its words between spaces in lower case; a cut word carries ``CUT``."""
    text = readable(text)
    scan = is_scan(text)
    if scan:
        text = _CUT_BREAK.sub(CUT, text)
    return scan, text.lower().split()


def counted_words(spaced: Counter) -> Counter:
    """Counts of words from counts of what stands between spaces; cut ones do not count."""
    out: Counter = Counter()
    for w, n in spaced.items():
        if w.isalpha():
            if len(w) <= LONGEST:
                out[w] += n
        elif CUT not in w:
            for x in tokens(w):
                out[x.strip("!")] += n
    return out


def read_scan(text: str, first_page, last_page, heading: str | None, source: str | None) -> tuple[list[str], list[str], str]:
    """Words (cut ones carry ``CUT``), furniture lines as stored, and joined text of a scanned chunk."""
    stored = text.split("\n")
    lines = readable(text).split("\n")
    page = lambda p: int(p) if p is not None and p == p and p > 0 else None
    marks = furniture(lines, page(first_page), page(last_page), heading, source)
    joined = join_lines([None if m else x for m, x in zip(marks, lines)])
    return tokens(joined), [stored[i].strip() for i, m in enumerate(marks) if m], joined


# --- the editor -----------------------------------------------------------------


def align(wrong: str, right: str) -> list[str] | None:
    """What each character of ``wrong`` must become so that they join to ``right``; None beyond 3 edits."""
    n, m = len(wrong), len(right)
    if abs(n - m) > 3:
        return None
    cost = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == 0 or j == 0:
                cost[i][j] = i + j
            else:
                cost[i][j] = min(cost[i - 1][j - 1] + (wrong[i - 1] != right[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    if cost[n][m] > 3:
        return None
    labels = [""] * n
    i, j, pending = n, m, ""
    while i:
        if j and cost[i][j] == cost[i - 1][j - 1] + (wrong[i - 1] != right[j - 1]):
            labels[i - 1] = right[j - 1] + pending
            pending, i, j = "", i - 1, j - 1
        elif cost[i][j] == cost[i - 1][j] + 1:
            labels[i - 1] = pending
            pending, i = "", i - 1
        else:
            pending, j = right[j - 1] + pending, j - 1
    if j or pending:
        labels[0] = right[:j] + labels[0] if n else ""
    return labels


class Editor:
    """An averaged-perceptron tagger of characters; a label is what a character becomes.

    Keep is the character itself, delete the empty string, replace another one,
    insert several.
    """

    def __init__(self) -> None:
        self.weights: dict[str, dict[str, float]] = {}
        self.labels: dict[str, list[str]] = {}

    @staticmethod
    def features(word: str, i: int) -> list[str]:
        w = f"^^{word}$$"
        k = i + 2
        c = w[k]
        return [c, "l" + w[k - 1] + c, "r" + c + w[k + 1], "b" + w[k - 1 : k + 2], "L" + w[k - 2 : k + 1], "R" + w[k : k + 3], "w" + w[k - 2 : k + 3], "e" + w[max(0, k - 3) : k + 1], "f" + w[k : k + 4]]

    def scores(self, word: str, i: int) -> list[tuple[float, str]]:
        totals = dict.fromkeys(self.labels.get(word[i], [word[i]]), 0.0)
        for f in self.features(word, i):
            for label, v in self.weights.get(f, {}).items():
                if label in totals:
                    totals[label] += v
        return sorted(((v, k) for k, v in totals.items()), reverse=True)

    def train(self, pairs: list[tuple[str, list[str]]], rounds: int = 6, seed: int = 5) -> None:
        rng = random.Random(seed)
        seen: dict[str, Counter] = defaultdict(Counter)
        for word, labels in pairs:
            for c, label in zip(word, labels):
                seen[c][label] += 1
        self.labels = {c: sorted({c} | {k for k, n in found.items() if n >= 3}) for c, found in seen.items()}
        weights: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        sums: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        stamps: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        self.weights = weights
        t = 0
        for _ in range(rounds):
            rng.shuffle(pairs)
            for word, labels in pairs:
                for i, right in enumerate(labels):
                    options = self.labels.get(word[i])
                    if not options or len(options) == 1 or right not in options:
                        continue
                    t += 1
                    features = self.features(word, i)
                    totals = dict.fromkeys(options, 0.0)
                    for f in features:
                        for k, v in weights[f].items() if f in weights else ():
                            if k in totals:
                                totals[k] += v
                    guess = max(options, key=lambda k: (totals[k], k))
                    if guess == right:
                        continue
                    for f in features:
                        for k, d in ((right, 1.0), (guess, -1.0)):
                            sums[f][k] += (t - stamps[f][k]) * weights[f][k]
                            stamps[f][k] = t
                            weights[f][k] += d
        self.weights = {}
        for f, ws in weights.items():
            mean = {k: (sums[f][k] + (t - stamps[f][k]) * v) / max(t, 1) for k, v in ws.items()}
            if mean := {k: v for k, v in mean.items() if abs(v) > 1e-3}:
                self.weights[f] = mean

    def proposals(self, word: str, most: int = WORD_READINGS) -> list[tuple[str, float]]:
        """Readings of a word and how much less likely than the greedy one, best first."""
        options = [self.scores(word, i) for i in range(len(word))]
        beam: list[tuple[float, int, str]] = [(0.0, 0, "")]
        for i, scored in enumerate(options):
            top = scored[0][0]
            keep = next((v for v, k in scored if k == word[i]), top)
            grown = []
            for loss, edits, text in beam:
                for v, k in scored[:LABELS]:
                    changed = k != word[i]
                    if edits + changed > EDITS:
                        continue
                    grown.append((loss + top - v, edits + changed, text + k))
                if keep < scored[min(LABELS, len(scored)) - 1][0]:
                    grown.append((loss + top - keep, edits, text + word[i]))
            beam = sorted(grown)[:most]
        out: dict[str, float] = {}
        for loss, _, text in beam:
            if text != word:
                out.setdefault(text, loss)
        return list(out.items())


def confusions(rare: list[str], lexicon: dict[str, int], least: int = 3) -> tuple[list[tuple[str, str]], Counter]:
    """Aligned pairs (misread, word) and how often each string was read as another.

    A rare word is paired with the most frequent lexicon word that has the same ends or
    beginnings and differs in at most two adjacent places.
    """
    by: dict[tuple, list[str]] = defaultdict(list)
    for w in lexicon:
        if len(w) >= 4:
            for d in (-1, 0, 1):
                by[(len(w) + d, w[:2], "s")].append(w)
                by[(len(w) + d, w[-2:], "e")].append(w)
    pairs, counts = [], Counter()
    for word in rare:
        if len(word) < 4 or "-" in word:
            continue
        best, near = None, (9, 0)
        for key in ((len(word), word[:2], "s"), (len(word), word[-2:], "e")):
            for w in by.get(key, ())[:FIT_NEAR]:
                a = 0
                while a < min(len(w), len(word)) and w[a] == word[a]:
                    a += 1
                z = 0
                while z < min(len(w), len(word)) - a and w[-1 - z] == word[-1 - z]:
                    z += 1
                rank = (len(word) + len(w) - 2 * (a + z), -lexicon[w])
                if len(word) - a - z <= 2 and len(w) - a - z <= 2 and rank < near:
                    best, near = (w, word[a : len(word) - z], w[a : len(w) - z]), rank
        if best:
            pairs.append((word, best[0]))
            counts[(best[1], best[2])] += 1
    top: dict[str, int] = defaultdict(int)
    for (wrong, _), n in counts.items():
        top[wrong] = max(top[wrong], n)
    strong = {k for k, n in counts.items() if n >= least and n >= 0.3 * top[k[0]] and k[0] and k[1]}
    kept = []
    for word, w in pairs:
        a = 0
        while a < min(len(w), len(word)) and w[a] == word[a]:
            a += 1
        z = 0
        while z < min(len(w), len(word)) - a and w[-1 - z] == word[-1 - z]:
            z += 1
        if (word[a : len(word) - z], w[a : len(w) - z]) in strong:
            kept.append((word, w))
    return kept, Counter({k: counts[k] for k in strong})


def train_editor(rare: list[str], lexicon: dict[str, int], seed: int = 3) -> Editor:
    """An editor from a corpus' rare words of scanned chunks and its lexicon of clean words."""
    rng, cuts = random.Random(seed), random.Random(seed + 1)
    pairs, counts = confusions(rare, lexicon)
    labelled = [(a, labels) for a, b in pairs if (labels := align(a, b))]
    words = [w for w, _ in sorted(lexicon.items(), key=lambda x: (-x[1], x[0]))[:TRAIN_WORDS]]
    ops = [(wrong, right, n) for (wrong, right), n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    for w in words:
        labelled.append((w, list(w)))
        for _ in range(NOISED):
            possible = [(x, y, n) for x, y, n in ops if y in w]
            if not possible:
                break
            wrong, right, _ = rng.choices(possible, [n for _, _, n in possible])[0]
            spots = [m.start() for m in re.finditer(re.escape(right), w)]
            at = rng.choice(spots)
            noised = w[:at] + wrong + w[at + len(right) :]
            labels = list(w[:at]) + _spread(wrong, right) + list(w[at + len(right) :])
            labelled.append((noised, labels))
        labelled += _cut_words(w, cuts)
    # Compounds are rare among the frequent words, so all that the lexicon has take part.
    compounds = sorted((w for w in lexicon if "-" in w[2:-2]), key=lambda w: (-lexicon[w], w))[:TRAIN_WORDS]
    for w in compounds:
        labelled += _cut_words(w, cuts)
    editor = Editor()
    editor.train(labelled)
    return editor


def _cut_words(word: str, rng: random.Random) -> list[tuple[str, list[str]]]:
    """A word cut at a line end, labelled: join at a random place, hyphen at each hyphen of its own."""
    out = []
    for at in [i for i in range(2, len(word) - 2) if word[i] == "-"]:
        out.append((word[:at] + CUT + word[at + 1 :], list(word[:at]) + ["-"] + list(word[at + 1 :])))
    if len(word) >= 5 and "-" not in word:
        at = rng.randrange(2, len(word) - 1)
        out.append((word[:at] + CUT + word[at:], [*word[:at], "", *word[at:]]))
    return out


def _spread(wrong: str, right: str) -> list[str]:
    """Labels that turn ``wrong`` into ``right``, character for character, the rest on the last."""
    if len(wrong) >= len(right):
        return list(right) + [""] * (len(wrong) - len(right))
    return [*right[: len(wrong) - 1], right[len(wrong) - 1 :]]


# --- the operator ---------------------------------------------------------------


def vocabulary(chunks: DataFrame, text: str = "text") -> DataFrame:
    """``word, clean, scan``: how often each word occurs in clean and in scanned chunks.

    Each task counts its own words first, so a frequent word crosses the network once
    a task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaced = Counter(), Counter()  # clean, scanned

        def flush() -> pa.RecordBatch:
            clean, scan = counted_words(spaced[0]), counted_words(spaced[1])
            words = list(clean.keys() | scan.keys())
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([clean[w] for w in words], pa.int64()), pa.array([scan[w] for w in words], pa.int64())], ["word", "clean", "scan"])
            spaced[0].clear()
            spaced[1].clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    scanned, words = spaced_words(t)
                    spaced[scanned].update(words)
            if len(spaced[0]) + len(spaced[1]) > 500_000:
                yield flush()
        yield flush()

    found = chunks.select(F.col(text).alias("t")).where(F.length("t") > 0).mapInArrow(count, "word string, clean bigint, scan bigint")
    return found.where("word <> ''").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("scan").alias("scan"))


def joins(raw: str, editor: Editor) -> list[tuple[str, float]]:
    """The word with its line ends joined, and with hyphens there, each with the editor's loss; the word itself without one."""
    at = [i for i, c in enumerate(raw) if c == CUT]
    if not at:
        return [(raw, 0.0)]
    loss = {"": 0.0, "-": 0.0}
    for i in at:
        scored = {k: v for v, k in editor.scores(raw, i)}
        top = max(scored.get("", 0.0), scored.get("-", 0.0))
        for k in loss:
            loss[k] += top - scored.get(k, 0.0)
    return [(raw.replace(CUT, k), v) for k, v in loss.items()]


def readings(raw: str, editor: Editor, lexicon: dict[str, int]) -> list[tuple[str, float, bool]]:
    """``reading, loss, is_base`` of a stored word; the base readings are the word as stored or rejoined."""
    bases = joins(raw, editor)
    out: dict[str, tuple[float, bool]] = {}
    for base, cost in bases:
        out.setdefault(base.strip("!"), (cost, True))
        parts = re.split(r"([-'’])", base)
        options: list[list[tuple[str, float]]] = []
        for part in parts:
            if len(part) < 2 or part in lexicon:
                options.append([(part, 0.0)])
            else:
                options.append([(part, 0.0), *editor.proposals(part)[:PART_READINGS]])
        beam = [("", cost)]
        for option in options:
            beam = sorted(((text + o, loss + d) for text, loss in beam for o, d in option), key=lambda x: x[1])[:WORD_READINGS]
        for text, loss in beam:
            text = text.strip("!")
            if text and (text not in out or (loss < out[text][0] and not out[text][1])):
                out[text] = (loss, text in (base, base.strip("!")))
    return [(k, *v) for k, v in out.items()]


def repair_scans(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text", source: str = "source", heading: str = "heading", page_start: str = "page_start", page_end: str = "page_end") -> tuple[DataFrame, DataFrame]:
    """``(words, lines)``: ``chunk_id, raw, value`` of repaired words and ``chunk_id, line`` of furniture.

    Chunks without line breaks inside paragraphs are not scans and give no rows, nor do
    null and empty texts.  Rows that repeat a chunk give its rows once.  A word is
    repaired if a reading the editor proposes occurs ``GAIN`` times as often; a cut word
    always is, by the reading the corpus knows best; a word with a figure among its
    letters that no count can settle takes the editor's own reading.
    """
    spark = chunks.sparkSession
    counts = written(vocabulary(chunks, text), "vocabulary")
    top = counts.where("clean >= 2").orderBy(F.desc("clean"), "word").limit(LEXICON).select("word", "clean").toPandas()
    lexicon = dict(zip(top["word"], top["clean"]))
    rare = counts.where("clean < 2 and scan > 0").orderBy(F.desc("scan"), "word").limit(LEXICON // 10).select("word").toPandas()["word"].tolist()
    model = train_editor([w for w in rare if w not in lexicon][:FIT_WORDS], lexicon)
    held = spark.sparkContext.broadcast((lexicon, model))  # at most LEXICON words

    slim = chunks.select(F.col(chunk_id).cast("string").alias("chunk_id"), F.col(text).alias("t"), F.col(page_start).cast("int").alias("a"), F.col(page_end).cast("int").alias("b"), F.col(heading).alias("h"), F.col(source).alias("s"))
    scans = slim.where(F.col("t").rlike(r"[^\n]\n[^\n]"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = held.value[0]
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if not is_scan(readable(r.t)):
                    continue
                words, lines, _ = read_scan(r.t, r.a, r.b, r.h, r.s)
                for w in set(words):
                    if w not in known and (w[-1] != "!" or w[:-1] not in known):
                        rows.append((r.chunk_id, "word", w))
                rows += [(r.chunk_id, "line", x) for x in set(lines)]
            yield pd.DataFrame(rows, columns=["chunk_id", "kind", "raw"])

    found = written(scans.mapInPandas(read, "chunk_id string, kind string, raw string").distinct(), "scanned")
    raws = found.where("kind = 'word'").select("raw").distinct()

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, editor = held.value
        for batch in batches:
            rows = [(raw, reading, loss, base) for raw in batch["raw"] for reading, loss, base in readings(raw, editor, known)]
            yield pd.DataFrame(rows, columns=["raw", "word", "loss", "base"])

    # Few bytes but much work a word: one task a core whatever the size.
    raws = raws.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    options = raws.mapInPandas(propose, "raw string, word string, loss double, base boolean")
    counted = options.join(counts, "word", "left").na.fill(0, ["clean", "scan"]).withColumn("n", F.col("clean") + F.col("scan"))
    counted = counted.withColumn("known", (F.col("clean") >= 1) | (F.col("scan") >= SCAN_KNOWN))
    own = Window.partitionBy("raw")  # at most about a hundred readings
    cut = F.col("raw").contains(CUT)
    counted = counted.withColumn("own", F.max(F.when(F.col("base"), F.col("n")).otherwise(0)).over(own)).withColumn("own_clean", F.max(F.when(F.col("base"), F.col("clean")).otherwise(0)).over(own))
    counted = counted.withColumn("figures", F.col("raw").rlike(r"[\p{L}][0-9!][\p{L}]|[0-9!][\p{L}]{2}|[\p{L}]{2}[0-9]") & ~F.col("raw").rlike(r"^[0-9]+[\p{L}]{1,3}$"))
    sensible = F.when(cut, F.when(F.col("base"), True).otherwise(F.col("known") & (F.col("n") >= GAIN * F.col("own")))).otherwise(
        ~F.col("base") & (((F.col("own_clean") < 2) & F.col("known") & (F.col("n") >= GAIN * F.col("own"))) | (F.col("figures") & ~F.col("word").rlike("[0-9!]") & (F.col("own_clean") < 1)))
    )
    # Known readings first; among them the least loss against the evidence of the counts.
    unknown = F.when(F.col("known"), 0).otherwise(1)
    rank = F.struct(unknown.alias("u"), (F.col("loss") - EVIDENCE * F.log1p("n")).alias("s"), F.length("word").alias("l"), F.col("word").alias("word"))
    fixes = counted.where(sensible).groupBy("raw").agg(F.min(rank)["word"].alias("value"))
    fixes = fixes.where(F.col("value") != F.col("raw"))
    words = found.where("kind = 'word'").select("chunk_id", "raw").join(fixes, "raw").select("chunk_id", "raw", "value")
    return words, found.where("kind = 'line'").select("chunk_id", F.col("raw").alias("line"))


def found_repairs(chunks: DataFrame) -> DataFrame:
    """``chunk_id, kind, value``, distinct: repaired words and furniture lines."""
    words, lines = repair_scans(chunks)
    return words.select("chunk_id", F.lit("word").alias("kind"), "value").union(lines.select("chunk_id", F.lit("line").alias("kind"), F.col("line").alias("value"))).distinct()


def repaired_texts(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text", source: str = "source", heading: str = "heading", page_start: str = "page_start", page_end: str = "page_end") -> DataFrame:
    """``chunk_id, repaired``: each chunk's text in continuous paragraphs; one row per chunk id.

    Texts that are no scan come as stored; null stays null.
    """
    words, _ = repair_scans(chunks, chunk_id, text, source, heading, page_start, page_end)
    per = words.groupBy("chunk_id").agg(F.map_from_entries(F.collect_set(F.struct("raw", "value"))).alias("fix"))  # the words of one chunk
    slim = chunks.select(F.col(chunk_id).cast("string").alias("chunk_id"), F.col(text).alias("t"), F.col(page_start).cast("int").alias("a"), F.col(page_end).cast("int").alias("b"), F.col(heading).alias("h"), F.col(source).alias("s")).dropDuplicates(["chunk_id"])

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if not r.t or not is_scan(readable(r.t)):
                    out.append((r.chunk_id, r.t))
                    continue
                fix = dict(r.fix) if r.fix is not None else {}
                _, _, joined = read_scan(r.t, r.a, r.b, r.h, r.s)

                def put(m: re.Match, fix=fix) -> str:
                    w = m[0]
                    new = fix.get(w.lower())
                    if new is None:
                        return w.replace(CUT, "")
                    return new.upper() if w.isupper() and len(w) > 1 else new[:1].upper() + new[1:] if w[:1].isupper() else new

                out.append((r.chunk_id, _WORD.sub(put, joined).replace(CUT, "")))
            yield pd.DataFrame(out, columns=["chunk_id", "repaired"])

    return slim.join(per, "chunk_id", "left").mapInPandas(rewrite, "chunk_id string, repaired string")
