import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colophon.operators import answers, catalog, chunking, entities, metrics, mining, telemetry, tree, verify


def test_quotes(spark):
    t = 'He said "a long enough quote" and “another long quote”.\n> block one\n> goes on here\nend\n> short\n"a long enough quote"'
    df = spark.createDataFrame([(t,), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(verify.extract_quotes(F.col("t"))).collect()]
    assert got[0] == ["a long enough quote", "another long quote", "block one goes on here"] and got[1] == []


CHUNKS = [(0, "Some other text that says nothing of it.", "A", 3), (1, "Desire is a machine , and the object of desire is line-strokes (so to say).", "B", 47), (2, "The plane of immanence produces concepts and the concept is a multiplicity.", "C", 9)]


def chunk_table(spark):
    return spark.createDataFrame(CHUNKS, "chunk_ord int, text string, source string, page_start int")


def test_verification_tiers(spark):
    quotes = [("exact", "the object of desire is"), ("stripped", "Desire is a machine, and the object of desire is linestrokes"), ("markdown", "**Desire is a machine** , and the object"), ("fuzzy", "The plane of immanence produced concepts and the concept was a multiplicity"), ("wrong", "A fabricated sentence that no chunk has anywhere"), ("short", "machine")]
    got = {r["quote_id"]: r for r in verify.verify_quotes(spark.createDataFrame(quotes, "quote_id string, quote string"), chunk_table(spark)).collect()}
    assert {k: v["status"] for k, v in got.items()} == {"exact": "verified", "stripped": "verified", "markdown": "verified", "fuzzy": "approximate", "wrong": "unverified", "short": "too_short"}
    assert (got["exact"]["source"], got["exact"]["page"]) == ("B", 47) and got["fuzzy"]["source"] == "C"
    assert verify.verify_quotes(spark.createDataFrame([], "quote_id string, quote string"), chunk_table(spark)).count() == 0


def test_containment_join_equals_nested_loop(spark):
    words = "a bb ccc dd e fff gg h".split()
    hay = [(i, " ".join(words[(i * j) % 8] for j in range(1, 14))) for i in range(40)]
    needles = [(i, h[3 : 3 + 4 + i]) for i, (_, h) in enumerate(hay)] + [(100, "zz"), (101, "bb")]
    got = {tuple(r) for r in verify.containment_pairs(spark.createDataFrame(needles, "n int, k string"), spark.createDataFrame(hay, "h int, k string"), "n", "h").collect()}
    assert got == {(n, h) for n, k in needles for h, t in hay if k in t}


def test_citation_repair_and_footer(spark):
    text = 'He writes "the object of desire is line-strokes" [Source: AO, p. 999]. Then "a fabricated passage of text" [Source: X, p. 3] and [Source: Y, pp. 4-5].'
    df = spark.createDataFrame([("m", text), ("n", "no tags")], "answer_id string, text string")
    got = {r["answer_id"]: r for r in verify.repair_citations(df, chunk_table(spark)).collect()}
    assert got["m"]["repaired"] == 'He writes "the object of desire is line-strokes" [Source: B, p. 47]. Then "a fabricated passage of text" [unverified] and [unverified].'
    assert len(got["m"]["corrections"]) == 3 and got["n"]["repaired"] == "no tags" and got["n"]["corrections"] == []
    rows = [("m", 0, "q one", "verified", 1.0, True), ("m", 1, "q two", "unverified", 0.4, None), ("m", 2, "q", "too_short", 0.0, None), ("m", 3, "q four", "verified", 1.0, False)]
    footer = verify.verification_footer(spark.createDataFrame(rows, "answer_id string, seq int, quote string, status string, similarity double, source_verified boolean")).first()["footer"]
    assert footer == '\n---\n**Citation verification:** 2/3 verified, 1 unverified | 1/2 source-confirmed\n- ✗ "q two" — unverified (similarity: 40%)\n- ⚠ "q four" — verified in chunk but NOT found on cited page'


def test_pages(spark):
    results = spark.createDataFrame([("a", "the object of desire is", "verified", "B", 46), ("b", "the object of desire is", "verified", "B", 3), ("c", "x", "unverified", None, None), ("d", "the object", "verified", "Z", 1)], "quote_id string, quote string, status string, source string, page int")
    pages = spark.createDataFrame([("B", 47, CHUNKS[1][1]), ("B", 3, "else"), ("B", 46, "x")], "source string, page int, text string")
    assert {r["quote_id"]: r["source_verified"] for r in verify.cross_check_pages(results, pages).collect()} == {"a": True, "b": False, "c": None, "d": None}
    found = verify.find_quote_page(spark.createDataFrame([("q", "B", "The object  of desire is something that nobody wrote there")], "quote_id string, source string, quote string"), pages)
    assert [tuple(r) for r in found.collect()] == [("q", 47)]
    files = spark.createDataFrame([("1980_A_Thousand-Plateaus.pdf",), ("other.txt",)], "file string")
    assert verify.find_file(spark.createDataFrame([("1980 a thousand plateaus",)], "source string"), files).first()["file"].endswith("Plateaus.pdf")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=300), st.integers(1, 12), st.integers(0, 4))
def test_recursive_split_covers_the_text(text, most, overlap):
    out = chunking.recursive_pieces(text, most, overlap)
    assert all(len(text[a : a + n].split()) <= most for _, a, n in out)
    assert "".join("".join(text[a : a + n].split()) for _, a, n in out) == "".join(text.split())
    assert all(p.endswith(text[a : a + n]) for p, a, n in out)


def test_chunks_with_pages(spark):
    pages = [("d", 1, "# One\n" + "alpha beta gamma. " * 30), ("d", 2, "## Two\n" + "delta epsilon. " * 30)]
    df = spark.createDataFrame(pages, "doc_id string, page int, text string")
    docs = spark.createDataFrame([("d", "\n\n".join(p[2] for p in pages)), ("e", None)], "doc_id string, text string")
    got = chunking.chunk_documents(docs, df, most=40, overlap=5).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in got] == list(range(len(got)))
    assert {(r["heading"], r["page_start"]) for r in got} == {("One", 1), ("Two", 2)}
    sections = chunking.split_by_headers(spark.createDataFrame([(1, "intro\n# A\n text a\n## B\n\nb"), (2, "plain"), (3, "")], "doc_id int, text string")).orderBy("doc_id", "section_no").collect()
    assert [(r["doc_id"], r["heading"], r["text"], r["offset"]) for r in sections] == [(1, "", "intro", 0), (1, "A", "text a", 11), (1, "B", "b", 24), (2, "", "plain", 0), (3, "", "", 0)]


def test_headers_and_footers_of_pages(spark):
    rows = [("d", i, f"THE BOOK\nreal text {i}\nmore\n{'foot' if i < 3 else 'x' + str(i)}") for i in range(9)] + [("few", i, "SAME\nx") for i in range(3)]
    out = {(r["doc_id"], r["page"]): r["text"] for r in chunking.strip_headers_footers(spark.createDataFrame(rows, "doc_id string, page int, text string")).collect()}
    assert out[("d", 4)] == "real text 4\nmore\nx4" and out[("d", 1)] == "real text 1\nmore\nfoot" and out[("few", 0)] == "SAME\nx"


def test_windows_and_trim(spark):
    df = spark.createDataFrame([(1, " ".join(f"Sentence number {i} has some words in it." for i in range(6)))], "doc_id int, text string")
    w = chunking.sentence_windows(df, least=5).collect()
    assert len(w) == 4 and w[0]["text"].startswith("Sentence number 0") and w[0]["text"].count("Sentence") == 3
    t = spark.createDataFrame([("tail of one. Start here.",), ("no end",)], "t string").select(chunking.trim_to_sentence(F.col("t")))
    assert [r[0] for r in t.collect()] == ["Start here.", "no end"]


def gazetteer(spark):
    rows = [("d", "Gilles Deleuze", "PERSON", ["Deleuze"], 0), ("g", "Guattari", "PERSON", ["Félix Guattari"], 1), ("r", "rhizome", "CONCEPT", ["rhizomes", "rh"], 2)]
    return spark.createDataFrame(rows, "canonical_id string, label string, type string, aliases array<string>, load_order int")


def test_entities_both_ways(spark, monkeypatch):
    aliases = entities.alias_map(gazetteer(spark))
    docs = spark.createDataFrame([(1, "Rhizomes after Gilles Deleuze and FÉLIX GUATTARI"), (2, "deleuzean"), (3, "rh"), (4, None), (5, "a rhizome of Guattari")], "doc_id int, text string")
    want = {1: ["g", "d", "r"], 2: ["d"], 5: ["g", "r"]}

    def got():
        out = {}
        for r in sorted(entities.resolve(docs, aliases).collect(), key=lambda r: (r["doc_id"], r["pos"])):
            out.setdefault(r["doc_id"], []).append(r["canonical_id"])
        return out

    one = got()
    monkeypatch.setattr(entities, "MAX_ALIASES", 0)
    assert one == got() and {k: set(v) for k, v in one.items()} == {k: set(v) for k, v in want.items()}
    edges = entities.cooccurrence(entities.resolve(docs, aliases))
    assert {tuple(r) for r in edges.collect()} == {("d", "g", 1), ("d", "r", 1), ("g", "r", 2)}
    of = spark.createDataFrame([("d",)], "canonical_id string")
    assert {r[0] for r in entities.expand(edges, of).collect()} == {"d", "g", "r"}


def test_metrics(spark):
    hits = [(1, 0, 0.0), (1, 1, 0.0), (1, 2, 1.0), (1, 3, 1.0), (2, 0, 0.0)]
    m = {r["query_id"]: r for r in metrics.ranking_metrics(spark.createDataFrame(hits, "query_id int, rank int, relevant double"), 10).collect()}
    assert m[1]["mrr"] == pytest.approx(1 / 3, abs=1e-6) and m[1]["precision"] == 0.5 and m[2]["ndcg"] == 0
    pairs = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.1), (2, 3, 0.0)], "sentence_id int, citation_id int, entailment double")
    assert metrics.citation_quality(pairs).first()[:] == (2, 3, 0.5, 0.333333)
    v = spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "g string, v double")
    assert metrics.nearest_rank(v, "v", ["g"], {"p50": 0.5, "p95": 0.95}).first()[-2:] == (6.0, 10.0)
    c = spark.createDataFrame([(["a", "b"], ["b", "c"])], "x array<string>, y array<string>")
    assert c.select(metrics.recall(F.col("x"), F.col("y"))).first()[0] == 0.5


def test_structured_answers(spark):
    reply = '```json\n{"synthesis": "On anti-oedipus.", "per_work": [{"work": "Anti-Oedipus", "quote": "\\"Desire\\"", "page": "4", "gloss": "so"}]}\n```'
    df = spark.createDataFrame([(1, reply, ["1972 Anti-Oedipus - D.pdf", "A Thousand Plateaus"]), (2, "no json", None), (3, 'text {"synthesis": "x"} tail', [])], "query_id int, reply string, required array<string>")
    a = df.withColumn("answer", answers.parse_answer(F.col("reply")))
    cov = {r["query_id"]: r for r in answers.coverage(a).collect()}
    assert cov[1]["per_work_coverage"] == 0.5 and cov[1]["missing_in_per_work"] == ["A Thousand Plateaus"] and cov[2]["per_work_coverage"] == 1.0
    md = {r["query_id"]: r["markdown"] for r in answers.render_answers(a.withColumn("missing_works", F.array(F.lit("A Thousand Plateaus")))).collect()}
    assert '- **Anti-Oedipus:** "Desire" [Source: Anti-Oedipus, p. 4] — so' in md[1] and "no chunk for this work" in md[1]
    turns = spark.createDataFrame([("c", i, "x" * 100) for i in range(3)], "conversation_id string, turn_no int, content string")
    assert [r["turn_no"] for r in answers.history_budget(turns, 30).collect()] == [2]


def test_tree_and_kmeans(spark):
    rows = [(f"n{i:02d}", "s", f"Sentence of {i}. More.", i, i, [float(i // 8), 1.0]) for i in range(24)]
    leaves = spark.createDataFrame(rows, "id string, source string, text string, page_start int, page_end int, embedding array<float>")
    clusters = {r["id"]: r["cluster"] for r in tree.kmeans(leaves, 3).collect()}
    assert len(clusters) == 24 and len({clusters[f"n{i:02d}"] for i in range(8)}) == 1
    nodes = tree.summary_tree(leaves).collect()
    assert max(r["level"] for r in nodes) >= 1 and all(r["children_ids"] for r in nodes if r["level"] > 0)
    with pytest.raises(ValueError):
        tree.assign_centroids(leaves, spark.createDataFrame([(0, [0.0] * 10)], "cluster int, centroid array<double>").withColumn("centroid", F.array_repeat(F.lit(0.0), tree.MAX_FLOATS + 1)))


def test_clusters_inside_sources(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(f"a{i:04d}", "big", [float(x) for x in rng.normal(size=8) + 9 * (i % 40 == 0)]) for i in range(1500)]
    rows += [(f"b{i}", "same", [1.0] * 8) for i in range(300)] + [("c0", "one", [0.0] * 8), ("n", "one", None), ("m", "one", [])]
    df = spark.createDataFrame(rows, "id string, source string, embedding array<double>")
    got = {r["id"]: r["cluster"] for r in tree.clusters_within(df, cell=100).collect()}
    assert set(got) == {r[0] for r in rows if r[2]}
    sizes = {}
    for i, c in got.items():
        sizes[(i[0], c)] = sizes.get((i[0], c), 0) + 1
    assert len([k for k in sizes if k[0] == "a"]) > 200 and max(n for k, n in sizes.items() if k[0] == "a") <= 60
    assert got == {r["id"]: r["cluster"] for r in tree.clusters_within(df.repartition(7), cell=100).collect()}
    whole = df.withColumn("text", F.col("id")).withColumn("page_start", F.lit(1)).withColumn("page_end", F.lit(2))
    nodes = tree.summary_tree(whole.where("source <> 'same' and embedding is not null"))
    assert nodes.where("level > 0 and source = 'one'").count() == 0
    assert nodes.where("level = 1 and source = 'big'").agg(F.sum(F.size("children_ids"))).first()[0] == 1500


def test_catalog(spark):
    now = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, status string, n int")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, status string")
    assert sorted(tuple(r) for r in catalog.merge(now, new, ["id"]).collect()) == [(1, "a", 1), (2, "c", 2), (3, "d", None)]
    jobs = spark.createDataFrame([(1, "done", 1), (2, "pending", 3), (3, "pending", 2)], "id int, status string, created_at int")
    assert catalog.claim_oldest(jobs).first()["id"] == 3


def test_mining_and_telemetry(spark):
    page = "A Great Title\nby Someone\nTranslated by Jane Doe\nColumbia University Press\nISBN 978-0-231-08159-7\n1994"
    m = spark.createDataFrame([(page,)], "t string").select(mining.page_metadata(F.col("t")).alias("m")).first()["m"]
    assert (m["year"], m["publisher"], m["author"], m["title"]) == ("1994", "Columbia University Press", None, "A Great Title")
    assert m["translator"].startswith("Jane Doe")  # capitalised words run on over line ends
    assert m["isbn"].startswith("978-0-231-08159-7")
    around = spark.createDataFrame([("x" * 200 + "MARK" + "y" * 500,), ("none",)], "t string").select(mining.passage_around(F.col("t"), F.lit("MARK")))
    got = [r[0] for r in around.collect()]
    assert re.fullmatch("x{100}MARKy{396}", got[0]) and got[1] is None
    events = spark.createDataFrame([({"a": True}, {"x": 1.0, "y": 2.0}, 3, 0), ({"a": True}, {"x": 5.0}, 5, 1), ({}, None, None, None)], "flags map<string,boolean>, timings_ms map<string,double>, n_fused int, n_colbert int")
    assert [tuple(r) for r in telemetry.roll_up(events).collect()] == [("a=true", 2, 4.0, 4.0, 0.5), ("", 1, 0.0, 0.0, 0.0)]
