import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colophon.llm.mixing import TOKENIZER, count_tokens, flight, landing, mix_sources, share_report


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 500)), max_size=60), st.integers(0, 9))
def test_flight_keeps_both_sums(rows, seed):
    p, x = np.array([r[0] for r in rows]), np.array([float(r[1]) for r in rows])
    out = flight(p, x, np.random.default_rng(seed))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum(), abs=1e-5) and (out * x).sum() == pytest.approx((p * x).sum(), abs=1e-3)
    assert set(np.unique(landing(out, x))) <= {0.0, 1.0}


def test_flight_keeps_every_expectation():
    # The landing of the last two goes by least error and does not.
    p, x = np.full(9, 0.4), np.arange(1.0, 10.0)
    mean = np.mean([flight(p, x, np.random.default_rng(s)) for s in range(3000)], axis=0)
    assert abs(mean - 0.4).max() < 0.04


def corpus(spark, sizes):
    r = random.Random(4)
    rows = [(i, s, "word " * r.randrange(5, 60), "x") for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows += [(10_001, "a", None, "x"), (10_002, "a", "", "x"), (10_003, None, "text", "x"), (10_004, "elsewhere", "text", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, n_tokens string")


def test_shares_and_caps(spark):
    docs = corpus(spark, {"a": 3000, "b": 300, "c": 40})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 6), ("absent", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    for block in (2000, 100):
        chosen = mix_sources(docs, targets, block=block)
        report = {r["source"]: r for r in share_report(chosen, targets).collect()}
        whole = 1.0
        for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
            assert report[s]["actual_share"] == pytest.approx(share / whole, abs=0.01)
            assert report[s]["most_repeats"] <= report[s]["max_repeats"]
        assert report["absent"]["tokens"] == 0
        rows = chosen.collect()
        assert len({r["doc_id"] for r in rows}) == len(rows) and not {10_001, 10_002, 10_003, 10_004} & {r["doc_id"] for r in rows}


def test_total_can_be_given_and_empty_tables(spark):
    docs = corpus(spark, {"a": 400, "b": 400})
    targets = spark.createDataFrame([("a", 0.75, 2), ("b", 0.25, 2)], "source string, target_share double, max_repeats int")
    got = mix_sources(docs, targets, total_tokens=4000)
    tokens = sum(r["n_tokens"] * r["repeats"] for r in got.collect())
    assert abs(tokens - 4000) < 120
    assert mix_sources(docs.limit(0), targets).count() == 0 and mix_sources(docs, targets.limit(0)).count() == 0


def test_tokens_are_those_of_the_tokenizer(spark):
    df = spark.createDataFrame([(1, "Hello there, world!"), (2, None), (3, "")], "i int, text string")
    got = {r["i"]: r["n_tokens"] for r in count_tokens(df, "text", tokenizer=TOKENIZER).collect()}
    assert got == {1: 5, 2: 0, 3: 0}
