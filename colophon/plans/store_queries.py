"""Named queries over sources, collections, streams and the catalog, and their SQL.

What a query writes goes to a folder of its own in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from colophon.functions import text
from colophon.operators import catalog, embed
from colophon.plans import api
from colophon.plans.registry import BM25, SPACE, _asked, _documents, query
from colophon.sources import collections, files
from colophon.sources.tables import table
from colophon.storage import shared_dir
from colophon.streaming import ingest


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/colophon/query-{uuid.uuid4().hex}"


def _rows(spark, d):
    return table(spark, d, "chunk_result").groupBy(F.col("chunk_id").alias("id")).agg(F.min("text").alias("text"), F.min("source").alias("source"), F.min("page_start").alias("page"))


ROWS = "rows as (select chunk_id as id, min(text) as text, min(source) as source, min(page_start) as page from chunk_result group by 1)"


# --- files -----------------------------------------------------------------------------


@query("with p as (select source as doc_id, doc_id as page, text from documents where source is not null), s as (select doc_id, avg(case when length(trim(coalesce(text, ''))) >= 50 then 1.0 else 0.0 end) as a from p group by 1) select doc_id, case when a >= 0.8 then 'pdf_digital' else 'pdf_scanned' end as doc_type from s")
def page_classes(spark, d):
    return files.classify_pages(table(spark, d, "documents").where("source is not null").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text"))


@query("with p as (select source as doc_id, text, row_number() over (partition by source order by doc_id) as page from documents where source is not null) select doc_id, max(length(trim(coalesce(text, '')))) = 0 as scanned from p where page <= 5 group by 1")
def scanned_heads(spark, d):
    order = Window.partitionBy("source").orderBy("doc_id")
    p = table(spark, d, "documents").where("source is not null").select(F.col("source").alias("doc_id"), "text", F.row_number().over(order).alias("page"))
    return files.scanned_by_head(p)


@query("""with p as (select source as doc_id, doc_id as page, text, doc_id % 7 as w, 3 as h, n_chars as b, doc_id % 97 = 0 as locked from documents where source is not null),
a as (select doc_id, count(page) as n, max(b) as b, bool_or(locked) as locked, avg(case when w > 1.2 * h then 1.0 else 0.0 end) as wide, avg(case when length(trim(coalesce(text, ''))) < 10 then 1.0 else 0.0 end) as bare from p group by 1)
select doc_id, not locked as valid, case when locked then 'locked' else '' end as errors, array_to_string(list_filter([case when n > 2000 then 'more than 2000 pages' end, case when wide > 0.5 then 'mostly landscape' end, case when bare > 0.8 then 'mostly without text' end, case when n > 10 and b / n < 500 then 'few bytes a page' end], lambda x: x is not null), '|') as warnings from a""")
def page_validation(spark, d):
    i = F.col("doc_id")
    p = table(spark, d, "documents").where("source is not null").select(F.col("source").alias("doc"), i.alias("page"), "text", (i % 7).alias("width"), F.lit(3).alias("height"), F.col("n_chars").alias("n_bytes"), (i % 97 == 0).alias("locked"), F.lit(False).alias("corrupt"))
    return files.validate_pages(p, "doc").select(F.col("doc").alias("doc_id"), "valid", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"))


def _html(column):
    return F.concat(F.lit("<html><body><script>no</script><h2>"), text.escape_html(F.coalesce("source", F.lit("none"))), F.lit("</h2><p>"), text.escape_html(column), F.lit("</p></body></html>"))


@query(rf"""select 'f' || doc_id || '.html' as path, 1::bigint as page, md5('## ' || coalesce(source, 'none') || case when trim(regexp_replace(text, '{SPACE}+', ' ', 'g')) <> '' then chr(10) || chr(10) || trim(regexp_replace(text, '{SPACE}+', ' ', 'g')) else '' end) as key from documents where text is not null""")
def html_pages(spark, d):
    """Every document as an HTML file, read by the extractor."""
    f = _documents(spark, d).where("text is not null").select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".html")).alias("path"), F.encode(_html(F.col("text")), "UTF-8").alias("content"))
    return files.extract_pages(f).select("path", "page", F.md5("text").alias("key"))


@query("select 'f' || doc_id || case when doc_id % 2 = 0 then '.epub' else '.txt' end as path, doc_id % 2 = 1 as valid from documents where text is not null")
def file_validation(spark, d):
    """Plain files are valid; archives that are none are corrupt."""
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".epub").otherwise(".txt"))
    return files.validate_files(_documents(spark, d).where("text is not null").select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))).select("path", "valid")


@query("""with p as (select doc_id, case when doc_id % 4 = 0 then 'Head' || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10) || text || chr(10) || '| x |' || chr(10) || '| y |' else text end as text from documents where text is not null)
select doc_id, unnest([0, 1])::int as table_no, unnest(['| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |', '| x |' || chr(10) || '| y |']) as content, md5(left(text, 1500)) as context from p where doc_id % 4 = 0""")
def page_tables(spark, d):
    """Documents as pages, two tables set into every fourth one."""
    table_ = F.concat(F.lit("Head\n| a | b |\n|---|---|\n| 1 | 2 |\n"), "text", F.lit("\n| x |\n| y |"))
    p = _documents(spark, d).where("text is not null").select("doc_id", F.lit(1).alias("page"), F.when(F.col("doc_id") % 4 == 0, table_).otherwise(F.col("text")).alias("text"))
    return files.modal_tables(p).select("doc_id", "table_no", "content", F.md5("surrounding_text").alias("context"))


@query("select source, md5(array_to_string(list(text order by doc_id), chr(10) || chr(10))) as key from documents where source is not null and length(trim(text)) > 0 group by source")
def joined_pages(spark, d):
    p = table(spark, d, "documents").where("source is not null").select("source", F.col("doc_id").alias("page"), "text")
    return files.join_pages(p, "source").select("source", F.md5("text").alias("key"))


@query(r"""select doc_id::varchar as doc_id, md5(regexp_replace(text || ' ![x](y.png) end' || chr(10), '!\[[^\]]*\]\([^)]*\)', '', 'g')) as key from documents where text is not null""")
def markdown_files(spark, d):
    """Every document as a Markdown file with an image link, read without it."""
    folder = _folder(spark)
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat("text", F.lit(" ![x](y.png) end")).alias("value"))

    t.repartition("doc_id").write.partitionBy("doc_id").text(folder)
    return files.ocr_markdown(spark, folder, "*.txt").select(F.regexp_extract("path", r"doc_id=(\d+)/", 1).alias("doc_id"), F.md5("text").alias("key"))


@query("select query, source, coalesce(pdf_page, -1)::int as page, ground_truth as gold_quote from eval_item where length(trim(query)) > 0")
def gold_rows(spark, d):
    """The items written as one JSON object and read by the gold loader."""
    folder = _folder(spark)
    e = table(spark, d, "eval_item").select("query", "source", "pdf_page", "ground_truth")
    e.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("items"))).alias("value")).coalesce(1).write.text(folder)  # a gold set is small
    return files.gold_rows(spark, folder).withColumn("page", F.coalesce("page", F.lit(-1)))


@query("select id, name, status from corpus")
def json_lines(spark, d):
    folder = _folder(spark)
    table(spark, d, "corpus").select("id", "name", "status").write.json(folder)
    return files.json_lines(spark, folder, "id string, name string, status string")


@query("select chunk_id, sha256(concat_ws('|', source, rank::varchar, text, 'none')) as key, left(sha256(concat_ws(chr(31), source, rank::varchar, text)), 32) as stable from chunk_result")
def content_keys(spark, d):
    c = table(spark, d, "chunk_result")
    return c.select("chunk_id", files.prefix_key(F.col("source"), F.col("rank"), F.col("text"), F.lit("none")).alias("key"), collections.stable_id("source", F.col("rank").cast("string"), "text").alias("stable"))


# --- collections -----------------------------------------------------------------------


@query(f"with {ROWS} select id, case when page = 7 then 'moved' else source end as source, page, 'a' as collection from rows where source is null or source <> (select min(source) from rows) union all select id, source, page, 'b' from rows")
def collection_changes(spark, d):
    """Rows added to a collection twice, one source deleted, a column updated; a copy was taken before."""
    store, rows = f"{_folder(spark)}/store", _rows(spark, d)
    collections.append(rows, store, "a")
    collections.append(rows, store, "a")
    collections.clone(spark, store, "a", "b", ())
    collections.delete_source(spark, store, "a", rows.agg(F.min("source")).first()[0])
    collections.update(spark, store, "a", collections.read(spark, store, "a").where("page = 7").select("id", F.lit("moved").alias("source")))
    return collections.read(spark, store).select("id", "source", "page", F.col("collection").cast("string").alias("collection"))


@query(f"with {ROWS} select source, count(*) as n_chunks from rows where source is not null group by source order by source")
def stored_documents(spark, d):
    store = f"{_folder(spark)}/store"
    collections.append(_rows(spark, d), store, "a")
    collections.append(_rows(spark, d), store, "gone")
    collections.drop(spark, store, "gone")
    return api.list_documents(collections.read(spark, store))


@query(f"with {BM25} select query_id, doc_id, score, rank from bm25 where rank < 10")
def saved_index(spark, d):
    """An index written, then searched; only the questions' terms are read."""
    path = _folder(spark)
    collections.save_index(_documents(spark, d), path)
    return collections.search_index(spark, path, _asked(spark, d), 10)


@query("with f as (select doc_id::varchar as path, text as content, sha256(text) as sha256 from documents where text is not null), l as (select distinct sha256(text) as sha256 from documents where lang = 'fr') select min(path) as path, sha256 from f where sha256 not in (select sha256 from l where sha256 is not null) group by sha256")
def unseen_files(spark, d):
    f = table(spark, d, "documents").where("text is not null")
    log = f.where("lang = 'fr'").select(F.sha2("text", 256).alias("sha256")).distinct()
    return collections.unseen(f.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")), log).select("path", "sha256")


@query("select doc_id, doc_id in (select doc_id from documents where text in (select text from documents where lang = 'fr')) as cached from documents where text is not null")
def cached_texts(spark, d):
    docs = _documents(spark, d).where("text is not null").select("doc_id", "text", "lang")
    cache = docs.where("lang = 'fr'").select(F.substring(F.sha2("text", 256), 1, 16).alias("cache_key")).distinct().withColumn("embedding", F.array(F.lit(9.0).cast("float")))
    return embed.embed_missing(docs, cache).select("doc_id", (F.size("embedding") == 1).alias("cached"))


@query("with a as (select event_type as flag, count(*)::varchar as v from events where value < 50 group by 1), b as (select event_type as flag, count(*)::varchar as v from events group by 1) select flag, a.v as saved, b.v as live from a full join b using (flag) where a.v is distinct from b.v")
def manifest_changes(spark, d):
    e = table(spark, d, "events")
    flags = lambda x: x.groupBy("event_type").agg(F.count("*").cast("string").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("flags"))  # noqa: E731  few kinds of event
    return collections.manifest_diff(flags(e.where("value < 50")), flags(e))


@query("select trim(name) as slug, trim(collection_name) as collection from corpus")
def collection_routes(spark, d):
    setting = ",".join(f" {r[0]} : {r[1]} " for r in table(spark, d, "corpus").select("name", "collection_name").collect()) + ",no route"  # a dozen corpora
    return spark.createDataFrame(sorted(collections.routes(setting).items()), "slug string, collection string")


# --- pages, jobs, catalog --------------------------------------------------------------


@query("with w as (select distinct source, page_start as page from chunk_result where source is not null and page_start is not null and not regexp_matches(source, '(?i)[/\\\\]|\\.\\.|%2f|%5c')), p as (select source, page_start as page, min(text) as text from chunk_result where page_start % 2 = 0 group by all) select w.source, w.page, md5(p.text) as text from w left join p using (source, page)")
def page_texts(spark, d):
    c = table(spark, d, "chunk_result")
    wanted = c.where("source is not null and page_start is not null").select("source", F.col("page_start").alias("page")).distinct()
    pages = c.where("page_start % 2 = 0").groupBy("source", F.col("page_start").alias("page")).agg(F.min("text").alias("text"))
    return api.get_page_text(pages, wanted).withColumn("text", F.md5("text"))


@query("select id, filename from catalog_document order by created_at, id limit 30 offset 20")
def catalog_page(spark, d):
    return api.page_of(table(spark, d, "catalog_document"), ["created_at", "id"], 30, 20).select("id", "filename")


@query("with j as (select id, created_at, case when chunks % 5 = 0 then 'running' when chunks % 2 = 0 then 'pending' else 'done' end as status from catalog_document where chunks is not null) select id, status from j where status in ('pending', 'running') order by case when status = 'running' then 0 else 1 end, created_at, id limit 1")
def claimed_job(spark, d):
    status = F.when(F.col("chunks") % 5 == 0, "running").when(F.col("chunks") % 2 == 0, "pending").otherwise("done")
    return catalog.claim_oldest(table(spark, d, "catalog_document").where("chunks is not null").select("id", "created_at", status.alias("status"))).select("id", "status")


@query("select d.id, c.collection_name as corpus_id from catalog_document d join corpus c on c.id = d.corpus_id where c.status = 'ready'")
def migrated_ids(spark, d):
    ids = table(spark, d, "corpus").where("status = 'ready'").select(F.col("id").alias("old_id"), F.col("collection_name").alias("new_id"))
    return catalog.migrate(table(spark, d, "catalog_document").select("id", "corpus_id"), ids, "corpus_id")


@query("select d.corpus_id as id, c.collection_name from (select distinct corpus_id from catalog_document union select 'nowhere') d left join corpus c on c.id = d.corpus_id")
def corpus_collections(spark, d):
    keys = table(spark, d, "catalog_document").select(F.col("corpus_id").alias("id")).union(spark.createDataFrame([("nowhere",)], "id string")).distinct()
    return catalog.lookup(keys, table(spark, d, "corpus"), "id", "collection_name")


@query("select id, case when mode = 'general' then 'Renamed' else title end as title from conversation")
def renamed_conversations(spark, d):
    c = table(spark, d, "conversation").select("id", "title", "mode")
    changes = c.where("mode = 'general'").select("id", F.lit("Renamed").alias("title")).union(spark.createDataFrame([("nobody", "x")], "id string, title string"))
    return api.rename_conversations(c, changes).select("id", "title")


@query("select corpus_id, id from (select *, row_number() over (partition by corpus_id order by created_at desc, id desc) as r from catalog_document where created_at is not null) where r = 1")
def newest_jobs(spark, d):
    return api.newest_jobs(table(spark, d, "catalog_document").where("created_at is not null")).select("corpus_id", "id")


@query("with a as (select id as k, lower(filename) as v from catalog_document), b as (select id as k, filename as v from catalog_document where chunks > 50) select k, a.v as got, b.v as want from a full join b using (k) where a.v is distinct from b.v")
def golden_changes(spark, d):
    c = table(spark, d, "catalog_document")
    return api.golden_diff(c.select(F.col("id").alias("k"), F.lower("filename").alias("v")), c.where("chunks > 50").select(F.col("id").alias("k"), F.col("filename").alias("v")), ["k"], "v")


@query("with n as (select 'new' || id as id, corpus_id, title from conversation union all select 'lost' || id, 'nowhere', title from conversation union all select id, corpus_id, title from conversation) select id, title from conversation union all select id, title from n where starts_with(id, 'new') and corpus_id in (select id from corpus)")
def created_conversations(spark, d):
    c = table(spark, d, "conversation").select("id", "corpus_id", "title")
    new = c.withColumn("id", F.concat(F.lit("new"), "id")).union(c.select(F.concat(F.lit("lost"), "id"), F.lit("nowhere"), "title")).union(c)
    return api.create_conversations(c, table(spark, d, "corpus"), new)[0].select("id", "title")


@query("select id, conversation_id from message where conversation_id is null or conversation_id not in (select id from conversation where mode = 'general')")
def deleted_conversations(spark, d):
    c = table(spark, d, "conversation")
    gone = c.where("mode = 'general'").select("id").union(spark.createDataFrame([("nobody",)], "id string"))
    return api.delete_conversations(c, table(spark, d, "message").select("id", "conversation_id"), gone)[1]


@query("select c.id as corpus_id, count(d.id) as total_files, 'pending' as status from corpus c left join catalog_document d on d.corpus_id = c.id where c.status <> 'ready' group by c.id")
def reingested_corpora(spark, d):
    empty = spark.createDataFrame([], "id string, corpus_id string, status string, total_files bigint, completed_files bigint, created_at timestamp")
    docs, jobs = api.reingest(table(spark, d, "catalog_document").select("id", "corpus_id", "status"), empty, table(spark, d, "corpus").where("status <> 'ready'"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    n = docs.where("status = 'pending'").groupBy("corpus_id").agg(F.count("*").alias("n"))
    return jobs.join(n, "corpus_id", "left").select("corpus_id", F.coalesce("n", F.lit(0)).alias("total_files"), "status")


@query("with j as (select id, corpus_id, created_at, case when chunks % 5 = 0 then 'running' else 'done' end as status from catalog_document where chunks is not null), k as (select id, corpus_id from j where status = 'running' order by created_at, id limit 1) select k.id, k.corpus_id, (select count(distinct filename) from catalog_document d where d.corpus_id = k.corpus_id) as completed_files from k")
def resumed_job(spark, d):
    c = table(spark, d, "catalog_document")
    jobs = c.where("chunks is not null").select("id", "corpus_id", "created_at", F.when(F.col("chunks") % 5 == 0, "running").otherwise("done").alias("status"))
    return api.resume_job(jobs, c.select("corpus_id", F.col("filename").alias("path"))).select("id", "corpus_id", "completed_files")


@query("select item_id as query_id, source as result from eval_item where item_id % 3 = 0 and not regexp_matches(query, '\"[^\"]{10,}\"') and not regexp_matches(query, '“[^”]{10,}”') and source is not null")
def cached_results(spark, d):
    """Results stored for every third question, ten minutes ago; older ones for all count no more."""
    from colophon.functions.text import clean_query

    e = table(spark, d, "eval_item").where("source is not null")
    now = F.lit("2024-01-01 02:00:00").cast("timestamp")
    entry = lambda x, at, r: x.select(clean_query(F.concat(F.col("query"), F.lit(" #"), F.col("item_id").cast("string"))).alias("key"), r.alias("result"), F.lit(at).cast("timestamp").alias("at"))
    cache = entry(e.where("item_id % 3 = 0"), "2024-01-01 01:50:00", F.col("source")).union(entry(e, "2023-12-31 00:00:00", F.lit("stale")))
    asked = e.select(F.col("item_id").alias("query_id"), F.concat(F.col("query"), F.lit(" #"), F.col("item_id").cast("string")).alias("query"))
    return api.cached_answers(asked, cache, now)[0].select("query_id", "result")


@query("with r as (select heading as query_id, chunk_id, min(source) as source from chunk_result where heading is not null group by all), m as (select *, coalesce(contains(lower(source), lower(split_part(query_id, ' ', 1))), false) as hit from r), a as (select *, max(hit) over (partition by query_id) as any_hit from m) select query_id, chunk_id from a where hit or not any_hit")
def metadata_filter(spark, d):
    r = table(spark, d, "chunk_result").where("heading is not null").groupBy(F.col("heading").alias("query_id"), "chunk_id").agg(F.min("source").alias("source"))
    return api.filter_by_metadata(r, r.select("query_id", F.substring_index("query_id", " ", 1).alias("wanted")).distinct()).select("query_id", "chunk_id")


# --- streams ---------------------------------------------------------------------------


def _events(spark, d):
    stored = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return stored.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(spark, stream, mode: str, schema):
    """What a stream has written when all that is there was read."""
    folder = _folder(spark)
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


@query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(avg(value), 6) as mean_value from events group by all")
def streamed_days(spark, d):
    """Days of events as a stream with a watermark; the table is one file, so nothing is late."""
    got = ingest.windowed_counts(_events(spark, d), "ts", ["event_type"], "value")
    out = _drained(spark, got, "complete", got.schema)
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


@query("select event_id from events")
def streamed_once(spark, d):
    """Events read twice over as one stream: each id comes through once."""
    once = ingest.dedup_stream(_events(spark, d).union(_events(spark, d)).select("event_id", "ts"), "event_id", "ts", "1000 days")
    return _drained(spark, once, "append", once.schema).select("event_id")


@query("select doc_id::varchar || '.txt' as source, count(*) over () as n from (select arg_min(doc_id, doc_id::varchar || '.txt') as doc_id from documents where length(trim(text)) > 0 group by text)")
def ingested_files(spark, d):
    """Every document as a text file that arrives in an inbox; equal contents are taken once."""
    folder = _folder(spark)
    t = table(spark, d, "documents").where("length(trim(text)) > 0")
    pages = t.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    ingest.ingest_batch(pages, folder, "c", most=200, overlap=20)
    ingest.ingest_batch(pages, folder, "c", most=200, overlap=20)  # the same batch after a crash adds nothing
    log = spark.read.parquet(f"{folder}/log").where("chunks > 0")
    return log.select(F.col("path").alias("source"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("n"))
