import pytest
from pyspark.sql import functions as F

from colophon.functions import anchors, citations, text

PAIRS = [
    (text.normalize_unicode, "ＡＢＣ", "ABC"), (text.normalize_unicode, "ﬁnd", "find"), (text.normalize_unicode, "a​b﻿c", "abc"),
    (text.normalize_unicode, "word—word", "word--word"), (text.normalize_unicode, "«Hello» it’s…", '"Hello" it\'s...'), (text.normalize_unicode, "a b", "a b"),
    (text.repair_ocr, "the rnachine of clesire", "the machine of desire"), (text.repair_ocr, "a ~ b inter rupts", "a  b interrupts"), (text.repair_ocr, "tlie end", "the end"),
    (text.repair_hyphenation, "philoso-\nphy", "philosophy"), (text.repair_hyphenation, "Anti-\nOedipus", "Anti-\nOedipus"), (text.repair_hyphenation, "desiring-\nmachine", "desiring-machine"), (text.repair_hyphenation, "dé-\n  jà", "déjà"),
    (text.normalize_whitespace, "hello   \nworld  ", "hello\nworld"), (text.normalize_whitespace, "a\fb\n\n\n\nc", "a\nb\n\nc"),
    (text.collapse_punctuation, "____", "___"), (text.collapse_punctuation, "text------text", "text---text"), (text.collapse_punctuation, "e.g.", "e.g."), (text.collapse_punctuation, "a.....b     c", "a...b  c"),
    (text.strip_markdown, "***both***", "both"), (text.strip_markdown, "**b** _i_ *x*", "b _i_ x"),
    (text.clean_for_ingestion, "“philoso-\nphy” is the study… of every-\nthing.", '"philosophy" is the study... of everything.'),
    (text.normalize_for_matching, "“It’s” — a  Test", "its - a test"), (text.strip_for_comparison, "a . b ( line-strokes ) agent.", "a.b(linestrokes)agent"),
    (text.drop_think, "<think>a\nb</think>\n Yes", "Yes"), (text.short_title, "1972 Anti-Oedipus Capitalism and Schizophr - Deleuze.pdf", "anti-oedipus capitalism and sc"),
    (text.slug, "My  Corpus: 2!", "my-corpus-2"), (text.normalize_citation, "**Bold**  _It_", "bold it"), (text.normalize_field, "The Book: a Tale", "book a tale"),
]


def test_literal_pairs(spark):
    got = spark.range(1).select(*[f(F.lit(a)).alias(f"c{i}") for i, (f, a, _) in enumerate(PAIRS)]).first()
    bad = [(f.__name__, a, b, got[i]) for i, (f, a, b) in enumerate(PAIRS) if got[i] != b]
    assert not bad


def test_null_and_empty_stay(spark):
    for value in (None, ""):
        row = spark.createDataFrame([(value,)], "t string").select(*[f(F.col("t")).alias(f"{i}") for i, f in enumerate({p[0] for p in PAIRS})]).first()
        assert all(x == value or x == "" for x in row)


def test_file_names_and_fields(spark):
    rows = [("1968 Title - Author, A.pdf", ("Title", "Author, A.pdf", 1968)), ("scan.pdf", ("scan.pdf", "", 0))]
    df = spark.createDataFrame([(a,) for a, _ in rows], "n string")
    assert [tuple(r[0]) for r in df.select(text.filename_parts(F.col("n"))).collect()] == [b for _, b in rows]
    pairs = spark.createDataFrame([("A", "A"), ("the A!", "a"), ("Long title here", "title here"), ("x", "y"), (None, "y")], "a string, b string")
    assert [r[0] for r in pairs.select(text.field_match(F.col("a"), F.col("b"))).collect()] == ["exact", "normalized", "substring", "none", "none"]
    bad = spark.createDataFrame([("a/b",), ("..x",), ("a%2Fb",), ("fine.pdf",)], "n string")
    assert [r[0] for r in bad.select(text.unsafe_path(F.col("n"))).collect()] == [True, True, True, False]


def test_anchors(spark):
    df = spark.createDataFrame([("see pp. 45–67, § 3.2, chapter 4, A 51 / B 75, SZ 42, ATP 10, p. 9 and P. 9",), ("",), (None,)], "t string")
    got = [[tuple(x) for x in r[0]] for r in df.select(anchors.extract_anchors(F.col("t"))).collect()]
    assert got[0] == [("page", "45–67"), ("page", "9"), ("section", "3.2"), ("chapter", "4"), ("kant_ab", "A51/B75"), ("heidegger_sz", "42"), ("plateau", "10")]
    assert got[1:] == [[], []]
    spans = spark.createDataFrame([("47", 45, 50), ("47-49", 50, 60), ("47-52", 50, 60), ("47", 0, 0), ("x", 1, 2), ("47", 47, None)], "v string, a int, b int")
    assert [r[0] for r in spans.select(anchors.page_in_range(F.col("v"), F.col("a"), F.col("b"))).collect()] == [True, False, True, False, False, True]
    q = spark.createDataFrame([('x "first quoted span here" and “second quoted span here” then',), ("none",)], "t string")
    assert [r[0] for r in q.select(anchors.nearest_quote(F.col("t"))).collect()] == ["second quoted span here", None]
    c = spark.createDataFrame([("p. 3, pp. 10-12 and p. 3",)], "t string")
    assert c.select(anchors.cited_pages(F.col("t")), anchors.cited_page_ranges(F.col("t"))).first()[:] == ([3, 10], [3, 10, 11, 12])


GOLD = {
    "mla": ("(Deleuze 1)", "Deleuze, Gilles. *Difference and Repetition*. Columbia University Press, 1968.", "(Deleuze and Guattari 24)"),
    "apa": ("(Deleuze, 1968, p. 1)", "Deleuze, G. (1968). *Difference and Repetition*. Columbia University Press.", "(Deleuze & Guattari, 1980, p. 24)"),
    "chicago": ("Gilles Deleuze, *Difference and Repetition*, 1.", "Deleuze, Gilles. *Difference and Repetition*. New York: Columbia University Press, 1968.", "Gilles Deleuze and Felix Guattari, *A Thousand Plateaus*, 24."),
    "harvard": ("(Deleuze 1968, p. 1)", "Deleuze, G. (1968) *Difference and Repetition*. New York: Columbia University Press.", "(Deleuze & Guattari 1980, p. 24)"),
    "asa": ("(Deleuze 1968:1)", "Deleuze, G. 1968. *Difference and Repetition*. New York: Columbia University Press.", "(Deleuze and Guattari 1980:24)"),
    "sage": ("(Deleuze, 1968, p. 1)", "Deleuze, G. (1968). *Difference and Repetition*. Columbia University Press.", "(Deleuze and Guattari, 1980, p. 24)"),
}


@pytest.mark.parametrize("style", list(GOLD))
def test_citation_styles(spark, style):
    rows = [("Deleuze, Gilles", "Difference and Repetition", 1968, "1", "Columbia University Press", "New York"), ("Deleuze, Gilles and Felix Guattari", "A Thousand Plateaus", 1980, "24", "University of Minnesota Press", "Minneapolis"), ("", "T", 0, "3", "P", ""), ("A, B and C D and E F", "T", 1990, "ch. 3", "P", "")]
    df = spark.createDataFrame(rows, "author string, title string, year int, page string, publisher string, city string")
    c = F.col
    got = df.select(citations.inline(style, c("author"), c("title"), c("year"), c("page")).alias("i"), citations.bibliography(style, c("author"), c("title"), c("year"), c("publisher"), c("city")).alias("b")).collect()
    assert (got[0]["i"], got[0]["b"], got[1]["i"]) == GOLD[style]
    assert "et al." in got[3]["i"] and "ch. 3" in got[3]["i"]
    if style in ("apa", "harvard"):
        assert "Unknown" in got[2]["i"] and "n.d." in got[2]["i"]
