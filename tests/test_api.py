from pyspark.sql import functions as F

from colophon.operators import chunking, embed, metrics
from colophon.plans import api
from colophon.plans.search import Settings
from colophon.sources import collections


def test_store_search_and_tools(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = [("1", "The quick brown fox jumps", "1980 Foxes - A.pdf"), ("2", "A lazy dog sleeps", "1981 Dogs - B.pdf"), ("3", "Foxes and dogs in one text", "1981 Dogs - B.pdf")]
    df = spark.createDataFrame(rows, "id string, text string, source string").withColumn("embedding", embed.embedder()(F.col("text")))
    collections.append(df, store, "c")
    asked = spark.createDataFrame([(1, "quick fox"), (2, "lazy dog")], "query_id int, query string")
    got = {r["query_id"]: r["doc_id"] for r in api.search_corpus(spark, store, "c", asked).where("rank = 0").collect()}
    assert got == {1: "1", 2: "2"}
    assert {r["source"] for r in api.search_corpus(spark, store, "c", asked, source="dogs").collect()} == {"1981 Dogs - B.pdf"}
    assert [tuple(r) for r in api.list_documents(df).collect()] == [("1980 Foxes - A.pdf", 1), ("1981 Dogs - B.pdf", 2)]
    api.reindex(spark, store, "c", str(tmp_path / "ix"))
    assert collections.search_index(spark, str(tmp_path / "ix"), asked).count() == 2 + 0
    arms = api.sweep(lambda s: api.search_corpus(spark, store, "c", asked, settings=s), {"a": Settings(top_k=1), "b": Settings(top_k=2)})
    assert arms.where("config = 'a'").count() == 2 and arms.where("config = 'b'").count() == 4


def test_embedding_cache(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "text string")
    key = F.substring(F.sha2("text", 256), 1, 16)
    cache = rows.where("text = 'a'").select(key.alias("cache_key"), F.array(F.lit(9.0).cast("float")).alias("embedding"))
    got = {r["text"]: r["embedding"] for r in embed.embed_missing(rows, cache).collect()}
    assert got["a"] == [9.0] and len(got["b"]) == embed.DIMENSION


def test_pages_diffs_and_rounds(spark):
    pages = spark.createDataFrame([("s", 1, "one")], "source string, page int, text string")
    want = spark.createDataFrame([("s", 1), ("s", 2), ("../s", 1)], "source string, page int")
    assert sorted((r["page"], r["text"]) for r in api.get_page_text(pages, want).collect()) == [(1, "one"), (2, None)]
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "k string, v string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("z", "4")], "k string, v string")
    assert sorted(tuple(r) for r in api.golden_diff(a, b, ["k"], "v").collect()) == [("y", "2", "3"), ("z", None, "4")]
    asked, sources = spark.createDataFrame([(1, "q")], "query_id int, query string"), spark.createDataFrame([("A",), ("B",)], "source string")
    calls = []

    def find(left, i):
        calls.append(sorted(r["source"] for r in left.collect()))
        return spark.createDataFrame([(1, f"d{i}", "A" if i == 0 else "B"), (1, "d0", "A")], "query_id int, doc_id string, source string").distinct()

    assert sorted(r["doc_id"] for r in api.cover_sources(find, asked, sources).collect()) == ["d0", "d1"] and calls == [["A", "B"], ["B"]]
    assert [r["k"] for r in api.page_of(b, ["k"], 1, 1).collect()] == ["y"]


def test_packed_pages_and_shares(spark):
    p = spark.createDataFrame([("d", 1, "One two three. Four five six.\nSeven eight.")], "doc_id string, page int, text string")
    assert [r["text"] for r in chunking.packed_pages(p, 4, 0).orderBy("piece_no").collect()] == ["One two three.", "Four five six.", "Seven eight."]
    c = spark.createDataFrame([([3, 9], [4], "On the Rhizome", ["rhizome", "fold"])], "p array<int>, e array<int>, t string, n array<string>")
    assert c.select(metrics.page_accuracy(F.col("p"), F.col("e"), 1), metrics.named_share(F.col("t"), F.col("n"))).first()[:] == (0.5, 0.5)
