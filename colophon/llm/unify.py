"""One consistent form for text that looks alike but differs in its characters.

An Arrow batch's text is viewed as one array of code points.  A lookup table maps each
code point to its replacement (none, one or several code points); gathers with
expansion offsets apply it to the whole batch; combining marks are then put in order
and composed by sorted-key lookups.  No call is made per row.

The form: width and presentation variants and ligatures become plain letters, marks
are composed, look-alike Greek, Cyrillic, Armenian and Cherokee letters become Latin
ones, every line break becomes U+000A and every other space U+0020, invisible
characters vanish.  Case, digits
that a reader tells apart, superscripts, fractions, quotes, dashes and the number of
spaces stay, so texts that can be told apart by reading stay apart.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that are drawn like a Latin letter.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "І": "I", "Ј": "J", "Ѕ": "S", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Һ": "h",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "α": "a", "γ": "y", "ι": "i", "κ": "k", "ο": "o", "ν": "v", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
}
ARMENIAN = {"Լ": "L", "Օ": "O", "Ս": "U", "Տ": "S", "ց": "g", "հ": "h", "յ": "j", "ո": "n", "օ": "o", "զ": "q", "ս": "u"}
CHEROKEE = {
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S",
    "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
}
#: Others, among them the small capitals that are drawn like small letters.
OTHER = {"ı": "i", "ɑ": "a", "ɡ": "g", "ſ": "s", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s"}
#: Compatibility mappings that change only width, presentation or kind of space.
FORMS = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>")
#: Letters that one character writes joined: these <compat> ranges are ligatures and Roman numerals.
LIGATURES = ((0x0132, 0x0133), (0x01C7, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17))
#: Invisible though not of category Cf: joiners, fillers, variation selectors.
INVISIBLE = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))
KEPT_CONTROLS = (0x0A,)


def _within(cp: int, ranges) -> bool:
    return any(a <= cp <= b for a, b in ranges)


def _expand(ch: str, alike: dict[str, str]) -> str:
    """What a character becomes before composition: decomposed, in Latin look-alikes."""
    cp = ord(ch)
    kind = unicodedata.category(ch)
    if 0xD800 <= cp <= 0xDFFF:
        return ch
    if kind == "Cf" or _within(cp, INVISIBLE) or (kind == "Cc" and cp not in KEPT_CONTROLS and not ch.isspace()):
        return ""
    if cp == 13:
        return "\n"
    if kind in ("Zs", "Zl", "Zp") or (ch.isspace() and cp not in KEPT_CONTROLS):
        return "\n" if cp in (0x2028, 0x2029, 0x85) else " "
    found = unicodedata.decomposition(ch)
    if found:
        head, _, rest = found.partition(" ")
        if not head.startswith("<"):
            return "".join(_expand(c, alike) for c in unicodedata.normalize("NFD", ch) if c != ch) or ch
        if head in FORMS or (head == "<compat>" and _within(cp, LIGATURES)):
            return "".join(_expand(chr(int(x, 16)), alike) for x in rest.split())
    if 0xAC00 <= cp <= 0xD7A3:
        return unicodedata.normalize("NFD", ch)
    return alike.get(ch, ch)


class Tables:
    """The lookup tables, built once per process from the Unicode database."""

    def __init__(self) -> None:
        alike = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | OTHER
        size = sys.maxunicode + 1
        self.first = np.arange(size, dtype=np.int32)
        self.count = np.ones(size, dtype=np.uint8)
        self.mark = np.zeros(size, dtype=np.uint8)  # canonical combining class
        flat: list[int] = []
        pairs: dict[int, int] = {}
        for cp in range(0x80, size):
            if 0x3400 <= cp <= 0x9FFF or 0x20000 <= cp <= 0x2F7FF or 0x30000 <= cp <= 0xDFFFF or cp >= 0xF0000 or 0xE000 <= cp <= 0xF8FF:
                continue  # ideographs and private use: no mappings
            ch = chr(cp)
            self.mark[cp] = unicodedata.combining(ch)
            out = _expand(ch, alike)
            if out != ch:
                self.count[cp] = len(out)
                self.first[cp] = ord(out) if len(out) == 1 else len(flat)
                if len(out) > 1:
                    flat.extend(map(ord, out))
            found = unicodedata.decomposition(ch)
            if found and not found.startswith("<") and " " in found and unicodedata.normalize("NFC", ch) == ch:
                a, b = (int(x, 16) for x in found.split())
                a = ord(alike.get(chr(a), chr(a)))  # an accented look-alike composes to the accented Latin letter
                into = unicodedata.normalize("NFC", chr(a) + chr(b))
                pairs.setdefault((a << 21) | b, ord(into) if len(into) == 1 else cp)
        for cp in range(0x80):
            if cp not in KEPT_CONTROLS and (cp < 32 or cp == 127):
                self.count[cp] = 1 if chr(cp).isspace() else 0
                self.first[cp] = 10 if cp == 13 else 32 if chr(cp).isspace() else cp
        for lead in range(19):  # Hangul, by its arithmetic
            for vowel in range(21):
                lv = 0xAC00 + (lead * 21 + vowel) * 28
                pairs[((0x1100 + lead) << 21) | (0x1161 + vowel)] = lv
                for tail in range(1, 28):
                    pairs[(lv << 21) | (0x11A7 + tail)] = lv + tail
        self.flat = np.array(flat or [0], dtype=np.int32)
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.keys, self.into = keys, np.array([pairs[int(k)] for k in keys], dtype=np.int32)
        self.second = np.zeros(size, dtype=bool)  # can close a pair
        self.second[keys & 0x1FFFFF] = True
        self.plain = self.count == 1
        self.plain &= self.first == np.arange(size, dtype=np.int32)
        self.plain &= ~self.second & (self.mark == 0)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def canonical_points(points: np.ndarray, rows: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Canonical code points and their row numbers; both inputs have equal length."""
    pairs = (points[:-1] == 13) & (points[1:] == 10) & (rows[:-1] == rows[1:])  # two characters, one line break
    if pairs.any():
        kept = np.r_[~pairs, True]
        points, rows = points[kept], rows[kept]
    # Expansion: each source character is repeated as often as it has replacements.
    count = t.count[points].astype(np.int64)
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    source = np.repeat(np.arange(len(points)), count)
    within = np.arange(total) - np.repeat(ends - count, count)
    single = count[source] == 1
    first = t.first[points[source]].astype(np.int64)
    out = np.where(single, first, t.flat[np.minimum(np.where(single, 0, first + within), len(t.flat) - 1)]).astype(np.int64)
    rows = rows[source]
    # Canonical order: only runs of marks can be out of order.
    ccc = t.mark[out]
    if len(out) > 1 and np.any((ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & (rows[1:] == rows[:-1])):
        starter = np.cumsum((ccc == 0) | np.r_[True, rows[1:] != rows[:-1]])
        order = np.lexsort((np.arange(len(out)), ccc, starter))
        out, rows = out[order], rows[order]
    # Composition: join neighbours until none joins; three rounds cover letters with several marks.
    for _ in range(6):
        if len(out) < 2:
            break
        near = np.flatnonzero(t.second[out[1:]] & (rows[1:] == rows[:-1])) + 1
        if not len(near):
            break
        key = (out[near - 1] << 21) | out[near]
        at = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
        joins = t.keys[at] == key
        near, into = near[joins], t.into[at[joins]]
        if not len(near):
            break
        alone = np.r_[True, near[1:] != near[:-1] + 1]  # of a chain only the first joins this round
        near, into = near[alone], into[alone]
        out[near - 1] = into
        keep = np.ones(len(out), dtype=bool)
        keep[near] = False
        out, rows = out[keep], rows[keep]
    return out, rows


def canonical_array(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The canonical form of every string of an Arrow array; null stays null."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return pa.array([], pa.large_string())
    valid = np.asarray(texts.is_valid())
    filled = texts.fill_null("") if texts.null_count else texts
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + n + 1]
    data = filled.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    t = tables()
    # Rows of printable ASCII and line breaks are in the form already.
    odd = (raw >= 127) | ((raw < 32) & (raw != 10))
    sums = np.concatenate(([0], np.cumsum(odd)))
    touched = (sums[offsets[1:]] - sums[offsets[:-1]]) > 0
    if not touched.any():
        return texts
    length = np.diff(offsets)
    take = np.repeat(touched, length)
    part = raw[take]
    starts_char = (part & 0xC0) != 0x80
    points = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    rows = np.repeat(np.flatnonzero(touched), length[touched])[starts_char]
    out, rows = canonical_points(points, rows, t)
    done = out.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
    width = 1 + (out > 0x7F).astype(np.int64) + (out > 0x7FF) + (out > 0xFFFF)
    size = np.bincount(rows, weights=width, minlength=n).astype(np.int64)
    # Interleave the rows that changed with those that did not.
    new_len = np.where(touched, size, length)
    new_off = np.concatenate(([0], np.cumsum(new_len)))
    result = np.empty(int(new_off[-1]), dtype=np.uint8)
    into = np.repeat(touched, new_len)
    result[into] = np.frombuffer(done, dtype=np.uint8)
    result[~into] = raw[~take]
    validity = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), n, [validity, pa.py_buffer(new_off.astype(np.int64).tobytes()), pa.py_buffer(result.tobytes())])


def canonical_text(text: str | None) -> str | None:
    """The canonical form of one string."""
    return None if text is None else canonical_array(pa.array([text], pa.large_string()))[0].as_py()


def unify_text(df: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """``df`` with column ``out``: the canonical form of ``text``.

    Null stays null and an empty text empty.  A column already named ``out`` is
    replaced; all others pass through.  One map over Arrow batches, no shuffle.
    """
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.StringType())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = canonical_array(batch.column(batch.schema.get_field_index(text)))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept] + [column.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, out])

    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])]).mapInArrow(convert, schema)


def alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id, class_id, texts``: the rows whose form has several stored texts; class_id is the class's least id, texts their number.

    One row an id, no pairs: a class of a third of all rows costs what its rows cost.
    Null and blank texts and rows without an id take no part.
    """
    marked = _fingerprints(df, key, text)
    classes = marked.groupBy("form", "stored").agg(F.min("id").alias("least")).groupBy("form").agg(F.min("least").alias("class_id"), F.count("*").alias("texts"))
    return marked.join(classes.where("texts > 1"), "form").select("id", "class_id", "texts").distinct()


def _fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id, form, stored``, distinct: 128 bits of the form and 64 of the stored text."""
    return (
        unify_text(df.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull()), "text")
        .where(F.col("canonical").rlike(r"\S"))
        .select("id", F.unhex(F.md5("canonical")).alias("form"), F.xxhash64("text").alias("stored"))
        .dropDuplicates(["id", "form", "stored"])
    )


def alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id_a, id_b`` (``id_a < id_b``): ids whose texts share a form but differ as stored.

    Only fingerprints move: 128 bits of the form and 64 of the stored text.  Groups of
    one stored text drop out after a pre-aggregation, before anything is paired, so a
    passage copied a million times costs nothing.  Null and blank texts take no part;
    a row without an id is skipped; an id with repeated rows counts once.
    """
    marked = _fingerprints(df, key, text)
    mixed = marked.groupBy("form").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select("form")
    members = marked.join(mixed, "form")
    a, b = members.alias("a"), members.alias("b")
    return (
        a.join(b, (F.col("a.form") == F.col("b.form")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.stored") != F.col("b.stored")))
        .select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
        .distinct()
    )
