"""Text normalisation as column functions.

Every pattern that means letters or spaces of any script starts with ``(?U)``.  Only
compatibility normalisation leaves the JVM, and only for rows that are not ASCII.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Quotes that become ' and ".
SINGLE_QUOTES = "‘’‚‛‹›"
DOUBLE_QUOTES = "“”„‟«»"
INVISIBLE = "[​‌‍‎‏﻿­]"

# What follows a misread "rn" (m), "cl" (d) and "li" after t (h).
RN_FOLLOWERS = (
    "achine|ade|an|atter|eans|ent|ethod|ind|odern|ode|oment|oral|ore|ost|ove|uch|ulti|ust|yth",
    "ach|ake|ark|atch|aterial|ax|edic|eet|ember|emor|ental|erge|essage|etal|icro|iddl|ilieu|inor|irror|istak|ix|olecul|onar|onstr|ontag|oral|ov|urdoch|usic",
)
CL_FOLLOWERS = "eath|esire|esirous|elirium|espotic|estroy|etermin|evelop|iagram|ifferenc|irect|iscours|istinct|ivision|omin|omain|ouble"
LI_FOLLOWERS = r"e\b|at\b|is\b|ey\b|em\b|eir\b|ere\b|en\b|ings?\b|ink|ose|ough|ousand|rough|us"
BROKEN_WORDS = {
    "inter rupts": "interrupts",
    "con nections": "connections",
    "pro duction": "production",
    "ex periment": "experiment",
    "de siring": "desiring",
}
# Endings after which a line-end hyphen is the word's own.
WORD_ENDINGS = "ing|tion|sion|ment|ness|ous|ive|ful|less|able|ible|ated|ized|ling|ism|ist|ent|ant|ary|ory|ure|ite|ous|al|er|ed|ly|or|us"


@F.pandas_udf(returnType=T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_unicode(text: Column) -> Column:
    """Compatibility form, plain quotes, dashes as ``--``, ``...``, no invisible characters."""
    out = F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)
    out = F.translate(out, SINGLE_QUOTES + DOUBLE_QUOTES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))
    out = F.regexp_replace(out, "[—–]", "--")
    out = F.replace(F.replace(out, F.lit("…"), F.lit("...")), F.lit(" "), F.lit(" "))
    return F.regexp_replace(out, INVISIBLE, "")


def repair_ocr(text: Column) -> Column:
    """Common serif confusions, stray tildes, broken words."""
    out = text
    for followers in RN_FOLLOWERS:
        out = F.regexp_replace(out, rf"(?U)\brn(?={followers})", "m")
    out = F.regexp_replace(out, rf"(?U)\bcl(?={CL_FOLLOWERS})", "d")
    out = F.regexp_replace(out, rf"(?U)(?<=t)li(?={LI_FOLLOWERS})", "h")
    out = F.regexp_replace(out, r"(?U)(?<=\s)~(?=\s)", "")
    for broken, whole in BROKEN_WORDS.items():
        out = F.replace(out, F.lit(broken), F.lit(whole))
    return out


def repair_hyphenation(text: Column) -> Column:
    """Words rejoined across line ends; the hyphen stays after a complete word's ending."""
    own = rf"(?U)\b(\w*(?i:{WORD_ENDINGS}))(?<=\w{{4}})-\s*\n\s*([a-z])"
    return F.regexp_replace(F.regexp_replace(text, own, "$1-$2"), r"(?U)(\w+)-\s*\n\s*([a-z])", "$1$2")


def normalize_whitespace(text: Column) -> Column:
    """T4: form feeds as line breaks, at most one blank line, single spaces, no trailing space."""
    out = F.regexp_replace(text, r"[\f\x0B]", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, " {2,}", " ")
    return F.regexp_replace(out, r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")


def collapse_punctuation(text: Column) -> Column:
    """T5: runs of dots, dashes and underscores to three, of spaces to two."""
    out = F.regexp_replace(text, r"\.{3,}", "...")
    out = F.regexp_replace(out, "-{3,}", "---")
    out = F.regexp_replace(out, "_{3,}", "___")
    return F.regexp_replace(out, " {3,}", "  ")


def strip_markdown(text: Column) -> Column:
    """Bold and italic markers unwrapped; single underscores stay."""
    for pattern in (r"\*{3}([^*]+)\*{3}", "_{3}([^_]+)_{3}", r"\*{2}([^*]+)\*{2}", "_{2}([^_]+)_{2}", r"\*([^*]+)\*"):
        text = F.regexp_replace(text, pattern, "$1")
    return text


def clean_for_ingestion(text: Column) -> Column:
    """T1, T2, T3, T4, T5 in this order."""
    return collapse_punctuation(normalize_whitespace(repair_hyphenation(repair_ocr(normalize_unicode(text)))))


def squeeze(text: Column) -> Column:
    """Any white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_for_comparison(text: Column) -> Column:
    """T1, T2, lower case, single spaces."""
    return squeeze(F.lower(repair_ocr(normalize_unicode(text))))


def normalize_for_matching(text: Column, markdown: bool = False) -> Column:
    """The key for matching: lower case, one kind of dash, no quotes, single spaces."""
    out = F.lower(strip_markdown(text) if markdown else text)
    out = F.regexp_replace(out, "[–—―−]", "-")
    out = F.regexp_replace(out, "-{2,}", "-")
    out = F.regexp_replace(out, "[\"'“”‘’«»]", "")
    return squeeze(out)


def strip_for_comparison(text: Column) -> Column:
    """No spaces around punctuation, no inner hyphens, no trailing punctuation."""
    out = F.regexp_replace(squeeze(text), r"(?U)\s*([.!?,;:)(\[\]])\s*", "$1")
    out = F.regexp_replace(out, r"(?U)(\w)-(\w)", "$1$2")
    return F.regexp_replace(out, r"[., ;:!?]+\z", "")


def clean_query(text: Column) -> Column:
    """Trimmed, T5."""
    return collapse_punctuation(F.trim(text))


def source_stem(text: Column) -> Column:
    """Lower case without leading year and ``.pdf``."""
    return F.trim(F.replace(F.regexp_replace(F.lower(text), r"^\d{4}\s+", ""), F.lit(".pdf"), F.lit("")))


def short_title(text: Column) -> Column:
    """What stands before `` - ``, at most four words and 30 characters."""
    head = F.substring_index(source_stem(text), " - ", 1)
    words = F.array_join(F.slice(F.split(F.trim(head), r"\s+"), 1, 4), " ")
    return F.regexp_replace(F.substring(words, 1, 30), r"[,.;: ]+$", "")


def filename_parts(name: Column) -> Column:
    """``STRUCT<title, author, year>`` of ``YYYY Title - Author``; else the name, '', 0."""
    pattern = r"^(\d{4})\s+(.+?)\s+-\s+(.+)$"
    hit = name.rlike(pattern)
    return F.struct(
        F.when(hit, F.regexp_extract(name, pattern, 2)).otherwise(name).alias("title"),
        F.when(hit, F.regexp_extract(name, pattern, 3)).otherwise(F.lit("")).alias("author"),
        F.when(hit, F.regexp_extract(name, pattern, 1).cast("int")).otherwise(F.lit(0)).alias("year"),
    )


def slug(text: Column) -> Column:
    """Lower case, other characters as single dashes, at most 40."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)


def safe_name(text: Column) -> Column:
    """Trimmed, at most 100 characters, without path and markup characters."""
    return F.trim(F.regexp_replace(F.substring(F.trim(text), 1, 100), r"[/\\:<>]", ""))


def tag_list(text: Column) -> Column:
    """Comma-separated tags trimmed, blanks dropped, ten of 50 characters at most."""
    return F.slice(F.filter(F.transform(F.split(text, ","), lambda t: F.substring(F.trim(t), 1, 50)), lambda t: t != ""), 1, 10)


def normalize_citation(text: Column) -> Column:
    """One to three ``*`` or ``_`` unwrapped, lower case, single spaces."""
    return squeeze(F.lower(F.regexp_replace(text, r"[*_]{1,3}([^*_]+)[*_]{1,3}", "$1")))


def normalize_field(text: Column) -> Column:
    """Lower case, punctuation as spaces, no leading article."""
    out = squeeze(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "))
    return F.regexp_replace(out, "^(?:the|a|an) ", "")


def field_match(found: Column, wanted: Column) -> Column:
    """``exact``, ``normalized``, ``substring`` (five characters or more) or ``none``."""
    a, b = normalize_field(found), normalize_field(wanted)
    inside = (F.length(a) >= 5) & (F.length(b) >= 5) & (a.contains(b) | b.contains(a))
    return F.when(found.isNull() | wanted.isNull(), "none").when(F.trim(found) == F.trim(wanted), "exact").when(a == b, "normalized").when(inside, "substring").otherwise("none")


def drop_think(text: Column) -> Column:
    """Without ``<think>`` passages and the white space after them."""
    return F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", "")


def unsafe_path(text: Column) -> Column:
    """Whether a file name tries to leave its folder."""
    return text.rlike(r"(?i)[/\\\x00]|\.\.|%2f|%5c")


def garbled_ratio(text: Column) -> Column:
    """Share of words that mix digits into letters or lack a vowel, the model-free scan-quality signal."""
    words = F.filter(F.split(F.lower(text), r"(?U)[^\w]+"), lambda w: F.length(w) >= 4)
    bad = F.filter(words, lambda w: w.rlike(r"\p{L}\d|\d\p{L}") | ~w.rlike("[aeiouyäöüàâéèêëîïôùûœæ0-9]"))
    return F.when(F.size(words) > 0, F.size(bad) / F.size(words)).otherwise(F.lit(0.0))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(text) / 4).cast("int")


def escape_html(text: Column) -> Column:
    """Markup characters escaped."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def badge_citations(text: Column) -> Column:
    """``[Source: t, p. n]`` tags as HTML spans, the rest escaped."""
    return F.regexp_replace(escape_html(text), r"\[Source: ([^\]]+?), (pp?\. ?[0-9–-]+)\]", '<span class="citation" title="$1">$2</span>')
