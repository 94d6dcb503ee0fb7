import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from colophon.llm.unify import alike_classes, alike_pairs, canonical_array, canonical_text, unify_text


def test_forms():
    same = [("ﬁnd", "find"), ("ＡＢＣ", "ABC"), ("t‌h­e", "the"), ("аpple", "apple"), ("a b", "a b"), ("é", "é"), ("с̧a", "ça"), ("각", "각"), ("ậ", "ậ"), ("ａ́", "á"), ("x　y", "x y"), ("foo\rbar", "foo\nbar"), ("a\r\nb", "a\nb"), ("a\r\n\r\nb", "a\n\nb"), ("Տսո", "Sun"), ("ᎪᏴ", "AB"), ("Ⅳ", "IV"), ("ικο", "iko"), ("ᴄᴏw", "cow")]
    for a, b in same:
        assert canonical_text(a) == canonical_text(b), (a, b)
    apart = [("é", "e"), ("A", "a"), ("x²", "x2"), ("½", "1/2"), ("l", "1"), ("a  b", "a b"), ("a\nb", "a b"), ("O", "0"), ("foo\rbar", "foobar"), ("a\r\rb", "a\rb")]
    for a, b in apart:
        assert canonical_text(a) != canonical_text(b), (a, b)
    assert canonical_text(None) is None and canonical_text("") == ""


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=8))
def test_stable_whatever_the_composition(texts):
    got = canonical_array(pa.array(texts, pa.string())).to_pylist()
    assert got == canonical_array(pa.array(got, pa.string())).to_pylist()
    for form in ("NFC", "NFD"):
        again = [None if t is None else unicodedata.normalize(form, t) for t in texts]
        assert canonical_array(pa.array(again, pa.string())).to_pylist() == got
    assert [canonical_text(t) for t in texts] == got  # a batch and its rows agree


def test_pairs(spark):
    rows = [("a", "same text"), ("b", "same text"), ("c", "sаme text"), ("d", "same text"), ("e", "other"), (None, "same text"), ("f", None), ("g", ""), ("h", "​"), ("a", "same text")]
    df = spark.createDataFrame(rows, "id string, text string").selectExpr("*", "'x' as canonical", "1 as form")
    got = {(r[0], r[1]) for r in alike_pairs(df, "id", "text").collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d")}
    assert alike_pairs(df.limit(0), "id", "text").count() == 0
    assert {tuple(r) for r in alike_classes(df, "id", "text").collect()} == {(x, "a", 3) for x in "abcd"}
    assert alike_classes(df.limit(0), "id", "text").count() == 0
    kept = unify_text(df, "text")
    assert kept.columns == ["id", "text", "form", "canonical"] and kept.count() == len(rows)


def test_copies_of_one_string_cost_no_pairs(spark):
    df = spark.range(3000).selectExpr("cast(id as string) as id", "'the same passage' as text")
    assert alike_pairs(df, "id", "text").count() == 0


def test_very_long_text(spark):
    long = "ａ" * 300_000
    df = spark.createDataFrame([("a", long), ("b", "a" * 300_000)], "id string, text string")
    assert alike_pairs(df, "id", "text").count() == 1
