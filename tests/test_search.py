import pytest
from pyspark.sql import functions as F

from colophon import storage
from colophon.operators import answers, contain, metrics, verify
from colophon.plans import api
from colophon.plans.search import Settings, by_turns, of_source, one_work, search, several_works, with_work_fetch

LIST = "query_id int, doc_id string, rank int"


def listed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["doc_id"])
    return out


def test_contained_strings_by_either_way(spark, monkeypatch):
    rows = [("1", "The cat sat"), ("2", "a dog's den"), ("3", None), ("4", ""), ("1", "The cat sat")]
    texts = spark.createDataFrame(rows, "needle string, k string")
    needles = spark.createDataFrame([("cat",), ("The",), ("dog's",), ("cat",), (None,), ("",), ("none here",)], "w string")
    want = {("1", "cat"), ("1", "The"), ("2", "dog's")}
    assert {tuple(r) for r in contain.contained(texts, needles, "needle", "k", "w").collect()} == want
    monkeypatch.setattr(contain, "MAX_STRINGS", 1)
    assert {tuple(r) for r in contain.contained(texts, needles, "needle", "k", "w").collect()} == want
    with pytest.raises(ValueError):
        contain.contained(texts, spark.createDataFrame([("a",), ("bcd",)], "w string"), "needle", "k", "w")
    monkeypatch.undo()
    assert contain.contained(texts.limit(0), needles, "needle", "k", "w").count() == 0
    assert contain.contained(texts, needles.limit(0), "needle", "k", "w").count() == 0


def test_a_common_phrase_leads_to_few_candidates(spark):
    hay = spark.createDataFrame([(i, f"x of the same kind as number{i} before it y") for i in range(300)], "n int, k string")
    needles = spark.createDataFrame([(i, f"of the same kind as number{i} before it") for i in (3, 77)] + [(500, "of the same kind as nothing at all it"), (501, "kind as"), (502, "")], "w int, k string")
    got = {(r["w"], r["n"]) for r in verify.containment_pairs(needles, hay, "w", "n").collect()}
    assert got == {(3, 3), (77, 77)} | {(501, i) for i in range(300)}


def test_works_fetched_and_by_turns(spark):
    ranked = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "a", 0), (2, "c", 1)], LIST)
    deeper = spark.createDataFrame([(1, "a", 0), (1, "d", 5), (1, "e", 6), (2, "d", 3)], LIST)
    source = spark.createDataFrame([("a", "X one"), ("b", "X two"), ("c", "Y one"), ("d", "Y two"), ("e", None)], "doc_id string, source string")
    works = spark.createDataFrame([(1, "X", 0), (1, "Y", 1)], "query_id int, work string, work_no int")
    more = with_work_fetch(ranked, deeper, works, source, 4)
    assert listed(more) == {1: ["a", "b", "c", "d"], 2: ["a", "c"]}
    assert listed(by_turns(more, works, source)) == {1: ["a", "c", "b", "d"], 2: ["a", "c"]}
    assert listed(with_work_fetch(ranked, deeper, works, source, 1))[1] == ["a", "b", "c"]  # Y is beyond the first work
    prefixes = spark.createDataFrame([(1, "Y"), (2, "Z")], "query_id int, source_prefix string")
    assert listed(of_source(ranked, prefixes, source, False)) == {1: ["c"], 2: ["a", "c"]}
    assert listed(of_source(ranked, prefixes, source, True)) == {1: ["c"]}
    mentions = spark.createDataFrame([(1, "B", 2), (1, "A", 2), (2, "C", 1)], "query_id int, source string, n_sources int")
    assert {tuple(r) for r in several_works(mentions).collect()} == {(1, "A", 0), (1, "B", 1)}
    assert [tuple(r) for r in one_work(mentions).collect()] == [(2, "C")]


def test_whole_search_with_every_channel(spark):
    docs = spark.createDataFrame([(1, "quick brown foxes jump", "S1", [1.0, 0.0], 0), (2, "lazy dogs sleep", "S2", [0.0, 1.0], 0), (3, "foxes in summary", "S1", [1.0, 0.1], 1)], "doc_id int, text string, source string, embedding array<double>, level int")
    asked = spark.createDataFrame([(1, "quick foxes"), (2, 'where is "lazy dogs sleep"'), (3, "nothing known")], "query_id int, query string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, vector array<double>")
    windows = spark.createDataFrame([(101, "brown foxes", "S1", [1.0, 0.0])], "doc_id int, text string, source string, embedding array<double>")
    third = spark.createDataFrame([(3, 2, 0)], "query_id int, doc_id int, rank int")
    aliases = spark.createDataFrame([(3, ["dogs"]), (1, [])], "query_id int, aliases array<string>")
    got = search(docs, asked, vectors, Settings(top_k=3, leaves_only=True, gate=True), windows=windows, third=third, aliases=aliases)
    rows = {}
    for r in got.orderBy("query_id", "rank").collect():
        rows.setdefault(r["query_id"], []).append(r["doc_id"])
    assert rows[1][0] == 1 and 101 in rows[1] and 3 not in rows[1]  # a window counts, a summary does not
    assert rows[2][0] == 2 and rows[3][0] == 2  # the phrase; the third list and the wider question
    assert search(docs.limit(0), asked, settings=Settings()).count() == 0
    assert search(docs, asked.limit(0), settings=Settings()).count() == 0


def test_percentiles_of_hot_ties_and_nulls(spark):
    rows = [("a", 5.0)] * 900 + [("a", float(i)) for i in range(100)] + [(None, 1.0), (None, 3.0), ("b", None), ("c", 7.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in metrics.nearest_rank(df, "v", ["g"], {"p50": 0.5, "p99": 0.99}).collect()}
    whole = sorted(v for g, v in rows if g == "a")
    assert (got["a"]["p50"], got["a"]["p99"], got["a"]["n"]) == (whole[500], whole[990], 1000)
    assert (got[None]["p50"], got[None]["max"]) == (3.0, 3.0) and got["c"]["p99"] == 7.5 and "b" not in got


def test_verbatim_by_likeness(spark):
    entries = spark.createDataFrame([(1, 0, "The machine of desire works", "4"), (1, 1, "the machine of desires works", "5"), (1, 2, "an entirely different sentence", "6"), (1, 3, "short", "7"), (2, 0, "no chunk for this question", "8")], "query_id int, work_no int, quote string, page string")
    chunks = spark.createDataFrame([(1, "Here THE MACHINE OF DESIRE WORKS well"), (1, None)], "query_id int, text string")
    got = {(r["query_id"], r["work_no"]): (r["dropped"], r["quote"] != "") for r in answers.enforce_verbatim(entries, chunks).collect()}
    assert got == {(1, 0): (False, True), (1, 1): (False, True), (1, 2): (True, False), (1, 3): (False, True), (2, 0): (False, True)}


def test_quote_in_page(spark):
    df = spark.createDataFrame([("the long quote of a page", "before the long quote of a page after"), ("the long quote of a page", "before the lang quote of a page after"), ("the long quote of a page", "zzz"), ("", "x"), (None, "x")], "q string, t string")
    got = [round(r[0], 2) for r in df.select(verify.page_ratio("q", "t")).collect()]
    assert got[0] == 1.0 and 0.6 < got[1] < 1.0 and got[2:] == [0.0, 0.0, 0.0]
    near = df.limit(2).select(verify.quote_in_text(F.col("q"), F.col("t"), (80, 40), 0.7)).collect()
    assert [r[0] for r in near] == [True, True]


def test_catalog_changes(spark):
    c = spark.createDataFrame([("1", "k", "t")], "id string, corpus_id string, title string")
    new = spark.createDataFrame([("1", "k", "again"), ("2", "k", "two"), ("3", "gone", "three")], "id string, corpus_id string, title string")
    kept, refused = api.create_conversations(c, spark.createDataFrame([("k",)], "id string"), new)
    assert {r["id"] for r in kept.collect()} == {"1", "2"} and {r["id"] for r in refused.collect()} == {"1", "3"}
    left, messages, unknown = api.delete_conversations(kept, spark.createDataFrame([("m", "1"), ("n", "2")], "id string, conversation_id string"), spark.createDataFrame([("1",), ("9",)], "id string"))
    assert [r["id"] for r in left.collect()] == ["2"] and [r["id"] for r in messages.collect()] == ["n"] and [r["id"] for r in unknown.collect()] == ["9"]


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "none"

        def getConf(self):
            return {}

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class Empty:
                    @staticmethod
                    def getCheckpointDir():
                        class No:
                            @staticmethod
                            def isDefined():
                                return False

                        return No

                return Empty

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session)
