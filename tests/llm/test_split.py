import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from colophon.llm.split import split_oversized

SCHEMA = "chunk_id string, text string, page_start int, page_end int, piece_no string"


def pieces(spark, rows, **kw):
    got = split_oversized(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    out = {}
    for r in got:
        out.setdefault(r["chunk_id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["piece_no"]) for k, v in out.items()}


def whole(rows):
    return "".join(r["piece_text"][r["piece_body_offset"] - r["piece_offset"] :] for r in rows)


def test_round_trip_limits_and_overlap(spark):
    prose = ("A sentence of some words. " * 40 + "\n\n") * 6
    rows = [("prose", prose, 3, 9, "x"), ("solid", "x" * 9001, 5, 5, None), ("short", "Hello.", 1, 1, None), ("empty", "", 0, 0, None), ("none", None, 1, 2, None), ("marks", "é" * 3000, None, None, None), ("astral", "𝔘 " * 3000, 9, 4, None)]
    got = pieces(spark, rows)
    assert set(got) == {"prose", "solid", "short", "empty", "marks", "astral"}  # a null text gives no row
    for name, text, *_ in rows:
        if text is None:
            continue
        assert whole(got[name]) == text
        assert all(len(r["piece_text"]) <= 2400 for r in got[name])
        for before, r in zip(got[name], got[name][1:]):
            again = r["piece_body_offset"] - r["piece_offset"]
            assert 0 <= again <= 240 and before["piece_text"].endswith(r["piece_text"][:again])
    assert len(got["short"]) == len(got["empty"]) == 1
    assert all(r["piece_text"].startswith(("A sentence", "\n")) for r in got["prose"])  # natural boundaries
    assert got["prose"][0]["piece_page_start"] == 3 and got["prose"][-1]["piece_page_end"] == 9
    assert got["solid"][0]["piece_page_start"] == got["solid"][-1]["piece_page_end"] == 5
    assert got["marks"][0]["piece_page_start"] == 0  # unknown
    assert [r["piece_page_start"] for r in got["astral"]] == sorted(r["piece_page_start"] for r in got["astral"])  # swapped pages in order
    assert not any(r["piece_text"].startswith("́") for r in got["marks"])


def test_repeated_rows_stay_and_empty_table(spark):
    got = split_oversized(spark.createDataFrame([("a", "x" * 5000, 1, 1, None)] * 2, SCHEMA))
    assert got.count() == 2 * 3
    assert split_oversized(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        split_oversized(spark.createDataFrame([], SCHEMA), overlap=2400)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .\ńé", max_size=400), min_size=1, max_size=6))
def test_any_text_comes_back(spark, texts):
    got = pieces(spark, [(str(i), t, 1, 2, None) for i, t in enumerate(texts)], max_chars=50, overlap=10)
    for i, t in enumerate(texts):
        assert whole(got[str(i)]) == t
        assert all(len(r["piece_text"]) <= 50 for r in got[str(i)])


def test_cost_grows_with_the_length(spark):
    """Eight times the text takes at most about eight times as long, in one row."""
    import time

    def seconds(n):
        df = spark.range(1).selectExpr("'a' as chunk_id", f"repeat('Some words of a sentence. ', {n}) as text", "1 as page_start", "9 as page_end")
        begin = time.time()
        total = split_oversized(df).selectExpr("sum(length(piece_text) - (piece_body_offset - piece_offset)) as n", "max(piece_page_end) as p").first()
        assert total["n"] == 26 * n and total["p"] == 9
        return time.time() - begin

    seconds(1_000)
    small, large = seconds(20_000), seconds(160_000)
    assert large < 8 * max(small, 0.5) * 1.6
