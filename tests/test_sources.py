import io
import zipfile

from pyspark.sql import functions as F

from colophon.sources import collections, files
from colophon.streaming import ingest


def epub(*chapters):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, c in enumerate(chapters):
            z.writestr(f"OEBPS/ch{i}.xhtml", f"<html><body>{c}</body></html>")
    return out.getvalue()


def docx(*paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    return out.getvalue()


def test_readers():
    assert files.read_epub(epub("<p>Copyright 1999</p>", "<h2>One</h2><p>Text &amp; more</p><ul><li>item</li></ul><script>x</script>")) == [(1, "## One\n\nText & more\n\n- item")]
    assert files.read_docx(docx(("Heading1", "Title"), ("", "Body"))) == [(0, "# Title\n\nBody\n\na | b")]


def test_extract_keeps_broken_files_as_rows(spark):
    df = spark.createDataFrame([("/x/a.epub", bytearray(epub("<p>Hello there</p>"))), ("/x/b.epub", bytearray(b"broken")), ("/x/c.pdf", bytearray(b"%PDF")), ("/x/d.txt", bytearray(b"plain"))], "path string, content binary")
    got = {r["path"]: r for r in files.extract_pages(df).collect()}
    assert got["/x/a.epub"]["text"] == "Hello there" and got["/x/d.txt"]["text"] == "plain"
    assert "BadZipFile" in got["/x/b.epub"]["error"] and "no reader" in got["/x/c.pdf"]["error"]


def test_classify_and_validate(spark):
    rows = [("a", p, "x" * 60, 10.0, 20.0, 99999, False, False) for p in range(4)] + [("a", 4, "", 10.0, 20.0, 99999, False, False), ("b", 1, "", 30.0, 20.0, 10, False, False), ("c", None, None, None, None, 5, False, False), ("d", 1, "t" * 60, 1.0, 2.0, 999, True, False)]
    df = spark.createDataFrame(rows, "doc_id string, page int, text string, width double, height double, n_bytes long, locked boolean, corrupt boolean")
    assert {r[0]: r[1] for r in files.classify_pages(df.where("page is not null")).collect()} == {"a": "pdf_digital", "b": "pdf_scanned", "d": "pdf_digital"}
    got = {r["doc_id"]: r for r in files.validate_pages(df).collect()}
    assert got["a"]["valid"] and got["b"]["warnings"] == ["mostly landscape", "mostly without text"] and got["c"]["errors"] == ["no pages"] and got["d"]["errors"] == ["locked"]


def test_gold_and_lines(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"questions": [{"query": "a", "pdf_page": 3}, {"query": " "}]}')
    assert [tuple(r) for r in files.gold_rows(spark, str(tmp_path / "g.json")).collect()] == [("a", None, 3, None)]
    (tmp_path / "l.jsonl").write_text('{"q": "a"}\nnot json\n{"q": "b"}\n')
    assert files.json_lines(spark, str(tmp_path / "l.jsonl"), "q string").count() == 2


def test_collections(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("1", "t1", "s", "p"), ("2", "t2", "z", None)], "id string, text string, source string, context_prefix string")
    collections.append(rows, path, "c")
    collections.append(rows, path, "c")  # adds nothing twice
    collections.append(rows, path, "other")
    assert collections.read(spark, path, "c").count() == 2
    collections.update(spark, path, "c", spark.createDataFrame([("1", "new")], "id string, text string"))
    assert {r["id"]: r["text"] for r in collections.read(spark, path, "c").collect()} == {"1": "new", "2": "t2"}
    collections.clone(spark, path, "c", "copy")
    assert collections.read(spark, path, "copy").where("context_prefix is null").count() == 2
    collections.delete_source(spark, path, "c", "s")
    assert [r["id"] for r in collections.read(spark, path, "c").collect()] == ["2"]
    collections.drop(spark, path, "copy")
    assert spark.read.parquet(path).where("collection = 'copy'").count() == 0 and collections.read(spark, path, "other").count() == 2
    assert collections.routes("a:b, c:d,bad") == {"a": "b", "c": "d"}


def test_saved_index_gives_the_same_answer(spark, tmp_path):
    from colophon.operators import index

    docs = spark.createDataFrame([(1, "quick brown fox"), (2, "lazy dog"), (3, "fox and dog and fox")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "fox dog")], "query_id int, query string")
    collections.save_index(docs, str(tmp_path / "ix"))
    same = lambda df: sorted(tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect())
    assert same(collections.search_index(spark, str(tmp_path / "ix"), asked)) == same(index.bm25_topk(docs, asked))
    assert collections.index_is_fresh(spark, str(tmp_path / "ix"))


def test_stream_ingests_each_content_once(spark, tmp_path):
    inbox, root = tmp_path / "inbox", str(tmp_path / "root")
    inbox.mkdir()
    (inbox / "a.txt").write_text("First sentence. " * 60)
    (inbox / "copy.txt").write_text("First sentence. " * 60)
    (inbox / "bad.epub").write_bytes(b"no zip")
    for extra in (None, "b.txt"):
        if extra:
            (inbox / extra).write_text("Another text of some words.")
        query = ingest.watch(spark, str(inbox), root, "c", once=True, most=50, overlap=5)
        query.awaitTermination(120)
        assert query.exception() is None
    chunks = collections.read(spark, f"{root}/chunks", "c")
    assert chunks.select("source").distinct().count() == 2 and chunks.count() == chunks.select("id").distinct().count()
    assert spark.read.parquet(f"{root}/failed").count() == 1
    # A batch that runs again changes nothing.
    again = spark.createDataFrame([(f"file:{inbox}/b.txt", bytearray(b"Another text of some words."))], "path string, content binary")
    n = chunks.count()
    ingest.ingest_batch(again, root, "c")
    assert collections.read(spark, f"{root}/chunks", "c").count() == n


def test_windows_and_hidden_thinking(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00", 2.0), (2, "2024-01-01 11:00:00", 4.0), (3, "2024-01-02 10:00:00", 6.0)], "k int, at string, v double").selectExpr("k", "cast(at as timestamp) as at", "v", "'a' as g")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ingest.windowed_counts(stream, "at", ["g"], "v").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["n"], r["mean_value"]) for r in spark.table("w").collect()) == [(1, 6.0), (2, 3.0)]
    tokens = spark.createDataFrame([("c", i, t) for i, t in enumerate(["<th", "ink>hid", "den</thi", "nk>\nShown"])], "conversation_id string, seq int, token string")
    assert ingest.visible_answer(tokens).first()["answer"] == "Shown"
