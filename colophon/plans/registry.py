"""Named queries over the reference's operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colophon.functions import anchors, citations, text
from colophon.operators import answers, catalog, chunking, entities, index, metrics, mining, retrieve, telemetry, tree, verify
from colophon.sources.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with SQL where SQL can say the same."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# --- shared inputs and their SQL -------------------------------------------------------

SPACE = r"[\s\p{Z}\x{85}]"  # what (?U)\s means, for RE2
WORD = r"[\p{L}\p{N}\p{M}_]"


def _documents(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _asked(spark, d) -> DataFrame:
    return table(spark, d, "eval_item").select(F.col("item_id").alias("query_id"), "query")


def _chunks(spark, d) -> DataFrame:
    """Search hits, one row per chunk: repeated hits of a chunk differ in score and rank only."""
    return table(spark, d, "chunk_result").groupBy("chunk_id", "text", "source", "page_start", "page_end", "heading").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))


CHUNKS = "chunks as (select chunk_id, text, source, page_start, page_end, heading, min(rank) as rank, max(score) as score from chunk_result group by all)"


def _by_heading(spark, d) -> DataFrame:
    """Chunks as ranked lists: one list per heading."""
    order = Window.partitionBy("query_id").orderBy("rank0", "chunk_id")
    c = table(spark, d, "chunk_result").groupBy("chunk_id").agg(F.min("rank").alias("rank0"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"), F.min("source").alias("source"), F.min("heading").alias("heading"), F.min("page_start").alias("page_start"))
    return c.select(F.coalesce("heading", F.lit("")).alias("query_id"), F.col("chunk_id").alias("doc_id"), "score", "source", "page_start", "rank0", "chunk_id").withColumn("rank", F.row_number().over(order) - 1).drop("rank0", "chunk_id")


BY_HEADING = """h0 as (select chunk_id, min(rank) rank0, max(coalesce(score, 0.0)) score, min(source) source, min(heading) heading, min(page_start) page_start from chunk_result group by chunk_id),
by_heading as (select coalesce(heading, '') query_id, chunk_id doc_id, score, source, page_start, row_number() over (partition by coalesce(heading, '') order by rank0, chunk_id) - 1 as rank from h0)"""

BM25 = r"""tok as (select doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '[-–—]', ' ', 'g'), '\p{L}{2,}')) term from documents),
tf as (select doc_id, term, count(*) tf from tok group by all),
dl as (select doc_id, coalesce(len(regexp_extract_all(regexp_replace(lower(text), '[-–—]', ' ', 'g'), '\p{L}{2,}')), 0) dl from documents),
df as (select term, count(*) df from tf group by term),
raw as (select term, df, ln((select count(*) from documents) - df + 0.5) - ln(df + 0.5) r from df),
idf as (select term, df, case when r < 0 then 0.25 * (select avg(r) from raw) else r end idf from raw),
q as (select item_id query_id, unnest(regexp_extract_all(regexp_replace(lower(query), '[-–—]', ' ', 'g'), '\p{L}{2,}')) term from eval_item),
qt as (select query_id, term, count(*) qtf from q group by all),
scored as (select query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (select avg(dl) from dl)))), 6) score from qt join idf using (term) join tf using (term) join dl using (doc_id) group by all),
bm25 as (select *, row_number() over (partition by query_id order by score desc, doc_id) - 1 as rank from scored where score > 0)"""


# --- index and retrieval ---------------------------------------------------------------


@query(f"with {BM25} select query_id, doc_id, score, rank from bm25 where rank < 10")
def bm25_topk(spark, d):
    return index.bm25_topk(_documents(spark, d), _asked(spark, d), 10)


@query(f"with {BM25} select query_id, doc_id, score from bm25 where rank < 10")
def bm25_join(spark, d):
    # The plan for sets of queries that no executor could hold.
    return index.top_per_query(index.bm25_scores(_documents(spark, d), _asked(spark, d)), 10).drop("rank")


@query(f"with {BM25} select term, df, round(idf, 6) as idf from idf")
def term_stats(spark, d):
    return index.term_stats(_documents(spark, d)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"with {BM25} select term, doc_id, tf from tf")
def postings(spark, d):
    return index.postings(_documents(spark, d))


@query(f"with {BM25} select doc_id, dl from dl")
def doc_lengths(spark, d):
    return index.doc_lengths(_documents(spark, d))


KEYWORD = r"""w as (select item_id query_id, unnest(string_split_regex(trim(query), '\s+')) w, generate_subscripts(string_split_regex(trim(query), '\s+'), 1) i from eval_item),
lw as (select query_id, arg_min(w, (-length(w), i)) word from (select query_id, w, i from w where length(w) > 3) group by query_id),
kw as (select query_id, doc_id, row_number() over (partition by query_id order by doc_id) - 1 as rank from lw join documents on contains(text, word))"""


@query(f"with {KEYWORD} select query_id, doc_id, 1.0::double as score, rank from kw where rank < 10")
def keyword_fallback(spark, d):
    return index.keyword_fallback(table(spark, d, "documents"), _asked(spark, d), 10)


@query("""with s as (select q.vec_id query_id, v.vec_id doc_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) score from embeddings q, embeddings v where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) - 1 as rank from s) select query_id, doc_id, score, rank from r where rank < 10""")
def dense_topk(spark, d):
    v = table(spark, d, "embeddings")
    return retrieve.dense_topk(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 10)


@query(r"""with c as (select item_id query_id, case when regexp_matches(query, '"[^"]{5,}"') or regexp_matches(query, '“[^”]{5,}”') or regexp_matches(query, '(?i)p\.?\s*\d+') or regexp_matches(query, '\b[A-Z][a-z]+\s+[A-Z][a-z]+\b') then 'lexical' else 'semantic' end kind from eval_item)
select query_id, kind, case kind when 'lexical' then 0.35 else 0.70 end::double as dense, case kind when 'lexical' then 0.65 else 0.30 end::double as sparse from c""")
def query_classes(spark, d):
    q = _asked(spark, d).withColumn("kind", retrieve.query_class(F.col("query")))
    return q.withColumn("w", retrieve.channel_weights(F.col("kind"))).select("query_id", "kind", "w.dense", "w.sparse")


@query(f"""with {BM25}, {KEYWORD},
l as (select query_id, doc_id, 0 channel, rank, 0.6 / (60 + rank + 1) part from bm25 where rank < 50 union all select query_id, doc_id, 1, rank, 0.4 / (60 + rank + 1) from kw where rank < 50),
f as (select query_id, doc_id, round(sum(part), 8) rrf_score, min(channel * 1000000 + rank) first from l group by all),
r as (select query_id, doc_id, rrf_score, row_number() over (partition by query_id order by rrf_score desc, first, doc_id) - 1 as rank from f) select * from r where rank < 20""")
def rrf_hybrid(spark, d):
    docs, asked = _documents(spark, d), _asked(spark, d)
    return retrieve.fuse([(index.bm25_topk(docs, asked, 50), 0.6), (index.keyword_fallback(docs, asked, 50), 0.4)]).where("rank < 20")


@query(f"""with {BY_HEADING}, m as (select *, coalesce(starts_with(source, '19'), false) m from by_heading), a as (select *, max(m) over (partition by query_id) any_m from m)
select query_id, doc_id, rank from a where m or not any_m""")
def source_filter(spark, d):
    return retrieve.filter_by_source(_by_heading(spark, d), F.lit("19")).select("query_id", "doc_id", "rank")


@query(f"""with {BY_HEADING}, t as (select *, case when source is not null then row_number() over (partition by query_id, source order by rank) end turn, case when source is not null then min(rank) over (partition by query_id, source) end lead from by_heading)
select query_id, doc_id, row_number() over (partition by query_id order by turn nulls last, lead nulls last, rank) - 1 as balanced_rank from t""")
def work_balance(spark, d):
    return retrieve.balance_works(_by_heading(spark, d).withColumn("work", F.col("source"))).select("query_id", "doc_id", "balanced_rank")


@query("select chunk_id, min(rank) as rank from chunk_result group by chunk_id")
def keep_first(spark, d):
    return retrieve.keep_first(table(spark, d, "chunk_result").select("chunk_id", "rank"), ["chunk_id"], "rank")


@query(f"""with {BY_HEADING}, n as (select *, count(distinct source) over (partition by query_id) n from by_heading),
r as (select *, greatest(3, case when n = 0 then 1000000000 else floor(12 / n) end) q, row_number() over (partition by query_id, source order by score desc, doc_id) r from n),
g as (select *, row_number() over (partition by query_id order by r > q, score desc, doc_id) g from r) select query_id, doc_id, source from g where g <= 12""")
def source_quota(spark, d):
    return answers.quota_by_source(_by_heading(spark, d), 12).select("query_id", "doc_id", "source")


@query(f"""with {BY_HEADING}, c as (select query_id, doc_id, rank, case when score >= 0.6 then 'confident' when score >= 0.25 then 'ambiguous' else 'irrelevant' end as confidence from by_heading) select * from c""")
def confidence_classes(spark, d):
    return _by_heading(spark, d).select("query_id", "doc_id", "rank", retrieve.confidence(F.col("score")).alias("confidence"))


@query(f"""with {BM25} select query_id, '[Source ' || (rank + 1) || ': ' || coalesce(source, 'unknown') || ']' as label, doc_id from bm25 join documents using (doc_id) where rank < 3""")
def context_labels(spark, d):
    docs = _documents(spark, d)
    top = index.bm25_topk(docs, _asked(spark, d), 3).join(docs.select("doc_id", "source"), "doc_id")
    none = F.lit(None).cast("int")
    return top.select("query_id", retrieve.context_label(F.col("rank") + 1, F.col("source"), none, none, F.lit("")).alias("label"), "doc_id")


# --- text ------------------------------------------------------------------------------

MATCH = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[–—―−]', '-', 'g'), '-{{2,}}', '-', 'g'), '[\"''“”‘’«»]', '', 'g'), '{SPACE}+', ' ', 'g'))"


@query(f"select doc_id, md5({MATCH}) as key from documents")
def text_match_key(spark, d):
    return _documents(spark, d).select("doc_id", F.md5(text.normalize_for_matching(F.col("text"))).alias("key"))


@query(r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\.{3,}', '...', 'g'), '-{3,}', '---', 'g'), '_{3,}', '___', 'g'), ' {3,}', '  ', 'g')) as key from documents""")
def text_collapse(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.collapse_punctuation(F.col("text"))).alias("key"))


@query(r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\*{3}([^*]+)\*{3}', '\1', 'g'), '_{3}([^_]+)_{3}', '\1', 'g'), '\*{2}([^*]+)\*{2}', '\1', 'g'), '_{2}([^_]+)_{2}', '\1', 'g'), '\*([^*]+)\*', '\1', 'g')) as key from documents""")
def text_strip_markdown(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.strip_markdown(F.col("text"))).alias("key"))


@query(r"""select id, regexp_replace(content, '(?s)<think>.*?</think>\s*', '', 'g') as content from message""")
def message_without_think(spark, d):
    return table(spark, d, "message").select("id", text.drop_think(F.col("content")).alias("content"))


@query(r"""select id, case when regexp_matches(filename, '^(\d{4})\s+(.+?)\s+-\s+(.+)$') then regexp_extract(filename, '^(\d{4})\s+(.+?)\s+-\s+(.+)$', 2) else filename end as title,
regexp_extract(filename, '^(\d{4})\s+(.+?)\s+-\s+(.+)$', 3) as author, coalesce(try_cast(regexp_extract(filename, '^(\d{4})\s+(.+?)\s+-\s+(.+)$', 1) as int), 0) as year from catalog_document""")
def filename_metadata(spark, d):
    return table(spark, d, "catalog_document").select("id", F.inline(F.array(text.filename_parts(F.col("filename")))))


@query(r"""select id, left(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) as slug,
array_to_string(list_filter(list_transform(string_split(tags, ','), lambda t: left(trim(t), 50)), lambda t: t <> '')[1:10], '|') as tags from corpus""")
def corpus_slugs(spark, d):
    return table(spark, d, "corpus").select("id", text.slug(F.col("name")).alias("slug"), F.array_join(text.tag_list(F.col("tags")), "|").alias("tags"))


@query(r"""select id, regexp_matches(filename, '(?i)[/\\]|\.\.|%2f|%5c') as unsafe from catalog_document""")
def unsafe_names(spark, d):
    return table(spark, d, "catalog_document").select("id", text.unsafe_path(F.col("filename")).alias("unsafe"))


@query("select doc_id, (length(text) // 4)::int as tokens from documents")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


# --- chunking --------------------------------------------------------------------------

WORDS = rf"list_filter(string_split_regex(trim(text), '{SPACE}+'), lambda w: w <> '')"


@query(f"""with w as (select doc_id, {WORDS} w from documents where text is not null), c as (select doc_id, w, unnest(range(0, greatest(ceil((len(w) - 384) / 288)::int, 0) + 1)) i from w where len(w) > 0)
select doc_id, i::int as chunk_index, md5(array_to_string(w[i * 288 + 1 : i * 288 + 384], ' ')) as key, least(384, len(w) - i * 288)::int as n_tokens from c""")
def sliding_chunks(spark, d):
    return chunking.sliding_chunks(_documents(spark, d)).select("doc_id", "chunk_index", F.md5("text").alias("key"), "n_tokens")


@query(rf"""with s as (select doc_id, list_filter(list_transform(string_split_regex(text, '[.!?][ \n]+'), lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: length(x) > 20) s from documents),
w as (select doc_id, unnest(range(0, len(s) - 2)) i, s from s where len(s) >= 3), t as (select doc_id, i, array_to_string(s[i + 1 : i + 3], ' ') text from w)
select doc_id, i::int as window_index, md5(text) as key from t where len({WORDS}) between 15 and 512""")
def sentence_windows(spark, d):
    return chunking.sentence_windows(_documents(spark, d), boundary=r"[.!?][ \n]+").select("doc_id", "window_index", F.md5("text").alias("key"))


@query("select source, doc_id as page, coalesce(sum(length(text) + 2) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as offset from documents where source is not null and text is not null")
def page_offsets(spark, d):
    pages = table(spark, d, "documents").where("source is not null and text is not null").select("source", F.col("doc_id").alias("page"), "text")
    return chunking.breakpoints(pages, "source").withColumn("offset", F.col("offset").cast("bigint"))


@query("""with o as (select source, doc_id as page, length(text) n, coalesce(sum(length(text) + 2) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as o from documents where source is not null and text is not null),
p as (select source, page as piece_no, o + 10 as start, 500 as length from o),
a as (select p.source, p.piece_no, p.start, p.length, o.page as page_start from p asof join o on p.source = o.source and p.start >= o.o),
b as (select p.source, p.piece_no, o.page as page_end from p asof join o on p.source = o.source and p.start + p.length >= o.o)
select a.source, a.piece_no::int as piece_no, a.start, a.length, page_start::int as page_start, page_end::int as page_end from a join b using (source, piece_no)""")
def page_spans(spark, d):
    pages = table(spark, d, "documents").where("source is not null and text is not null").select("source", F.col("doc_id").cast("int").alias("page"), "text")
    points = chunking.breakpoints(pages, "source").withColumn("offset", F.col("offset").cast("bigint"))
    pieces = points.select("source", F.col("page").alias("piece_no"), (F.col("offset") + 10).alias("start"), F.lit(500).alias("length"))
    return chunking.page_spans(pieces, points, "source")


@query()
def recursive_chunks(spark, d):
    return chunking.chunk_documents(_documents(spark, d), most=200, overlap=30)


@query(r"""with p as (select doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g')), lambda x: x <> '') p from documents), u as (select doc_id, unnest(p) text, generate_subscripts(p, 1) - 1 paragraph_no from p),
h as (select *, case when regexp_matches(text, '^#{1,6}\s') and length(text) <= 80 then trim(regexp_replace(text, '^#{1,6}\s+', '')) end h from u),
c as (select *, coalesce(last_value(h ignore nulls) over (partition by doc_id order by paragraph_no), '') heading from h) select doc_id, paragraph_no::int as paragraph_no, heading, md5(text) as key from c where h is null""")
def markdown_paragraphs(spark, d):
    return chunking.markdown_paragraphs(table(spark, d, "documents")).select("doc_id", "paragraph_no", "heading", F.md5("text").alias("key"))


@query("""with i as (select source, chunk_id, row_number() over (partition by source order by chunk_id) as chunk_index from (select distinct source, chunk_id from chunk_result where source is not null)),
w as (select source, chunk_index as centre, unnest([chunk_index - 1, chunk_index, chunk_index + 1]) as chunk_index from i where chunk_index % 50 = 0)
select source, chunk_index::int as chunk_index, chunk_id, centre::int as centre from i join w using (source, chunk_index)""")
def neighbour_context(spark, d):
    order = Window.partitionBy("source").orderBy("chunk_id")
    c = table(spark, d, "chunk_result").where("source is not null").select("source", "chunk_id").distinct().withColumn("chunk_index", F.row_number().over(order))
    return chunking.neighbour_context(c, c.where("chunk_index % 50 = 0").select("source", "chunk_index"))


# --- entities --------------------------------------------------------------------------


def _gazetteer(spark, d) -> DataFrame:
    g = table(spark, d, "given_name_short").groupBy("given_name").agg(F.array_sort(F.collect_set("short_name")).alias("aliases"))
    order = F.row_number().over(Window.orderBy("given_name"))  # the gazetteer is a small dimension
    return entities.alias_map(g.select(F.lower("given_name").alias("canonical_id"), F.col("given_name").alias("label"), F.lit("PERSON").alias("type"), "aliases", order.alias("load_order")))


TAGS = """g as (select given_name, dense_rank() over (order by given_name) o, unnest(list_append(list(short_name), given_name)) alias from given_name_short group by given_name),
al as (select lower(trim(alias)) alias, arg_max(lower(given_name), o) canonical_id from g group by 1),
tags as (select distinct doc_id, canonical_id from documents join al on length(alias) >= 3 and contains(lower(text), alias)),
edges as (select a.canonical_id src, b.canonical_id dst, count(*) weight from tags a join tags b on a.doc_id = b.doc_id and a.canonical_id < b.canonical_id group by all)"""


@query(f"with {TAGS} select doc_id, canonical_id from tags")
def gazetteer_tags(spark, d):
    return entities.resolve(_documents(spark, d), _gazetteer(spark, d)).select("doc_id", "canonical_id")


@query(f"with {TAGS} select src, dst, weight from edges")
def entity_graph(spark, d):
    return entities.cooccurrence(entities.resolve(_documents(spark, d), _gazetteer(spark, d)))


@query(f"with {TAGS} select distinct n as canonical_id from (select dst n from edges where src = 'dorothea' union select src from edges where dst = 'dorothea' union select 'dorothea')")
def entity_expansion(spark, d):
    edges = entities.cooccurrence(entities.resolve(_documents(spark, d), _gazetteer(spark, d)))
    return entities.expand(edges, spark.createDataFrame([("dorothea",)], "canonical_id string"))


@query(f"with {TAGS} select canonical_id, source, count(*) as n from tags join documents using (doc_id) group by all")
def concept_sources(spark, d):
    docs = _documents(spark, d)
    return entities.concept_source_counts(entities.resolve(docs, _gazetteer(spark, d)).join(docs.select("doc_id", "source"), "doc_id"))


# --- anchors, quotes, citations --------------------------------------------------------


@query(r"""with v as (
select doc_id, 'page' kind, unnest(regexp_extract_all(text, '(?i)\bpp?\.?\s*(\d+(?:\s*[-–—]\s*\d+)?)\b', 1)) v from documents union all
select doc_id, 'section', unnest(regexp_extract_all(text, '(?i)(?:§|section)\s*(\d+(?:\.\d+)?)', 1)) from documents union all
select doc_id, 'chapter', unnest(regexp_extract_all(text, '(?i)\b(?:ch\.?|chapter)\s*(\d+)\b', 1)) from documents union all
select doc_id, 'kant_ab', unnest(regexp_extract_all(text, '\b([AB]\s*\d{1,4}(?:\s*/\s*[AB]\s*\d{1,4})?)\b', 1)) from documents union all
select doc_id, 'heidegger_sz', unnest(regexp_extract_all(text, '(?i)\bSZ[:\s]+(\d{1,4})\b', 1)) from documents union all
select doc_id, 'plateau', unnest(regexp_extract_all(text, '(?i)\b(?:plateau|ATP)\s+(\d+)\b', 1)) from documents)
select distinct doc_id, kind, regexp_replace(v, '\s+', '', 'g') as value from v""")
def text_anchors(spark, d):
    return table(spark, d, "documents").select("doc_id", F.inline(anchors.extract_anchors(F.col("text"))))


@query(r"""select doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, 'p{1,2}\.\s*(\d+)', 1), lambda x: x::int))), ',') as pages from documents where text is not null""")
def cited_pages(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(anchors.cited_pages(F.col("text")), ",").alias("pages"))


def _stripped(column: str) -> str:
    md = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\*{3}([^*]+)\\*{3}', '\\1', 'g'), '_{3}([^_]+)_{3}', '\\1', 'g'), '\\*{2}([^*]+)\\*{2}', '\\1', 'g'), '_{2}([^_]+)_{2}', '\\1', 'g'), '\\*([^*]+)\\*', '\\1', 'g')"
    key = MATCH.replace("lower(text)", f"lower({md})").replace("text", column)
    return rf"regexp_replace(regexp_replace(regexp_replace({key}, '{SPACE}*([.!?,;:)(\[\]]){SPACE}*', '\1', 'g'), '({WORD})-({WORD})', '\1\2', 'g'), '[., ;:!?]+$', '')"


@query(f"""with q as (select item_id, {_stripped('ground_truth')} k, length(ground_truth) n from eval_item), h as (select doc_id, {_stripped('text')} k from documents where text is not null),
m as (select item_id, min(doc_id) doc_id from q join h on q.n >= 20 and contains(h.k, q.k) group by item_id)
select item_id::varchar as quote_id, case when n < 20 then 'too_short' when m.doc_id is not null then 'verified' else 'unverified' end as status, source, case when m.doc_id is not null then 1.0 else 0.0 end::double as similarity
from q left join m using (item_id) left join documents using (doc_id)""")
def quote_verify_exact(spark, d):
    quotes = table(spark, d, "eval_item").select(F.col("item_id").cast("string").alias("quote_id"), F.col("ground_truth").alias("quote"))
    chunks = _documents(spark, d).where("text is not null").select(F.col("doc_id").alias("chunk_ord"), "text", "source", F.lit(None).cast("int").alias("page_start"))
    return verify.verify_quotes(quotes, chunks, fuzzy=False).select("quote_id", "status", "source", "similarity")


@query()
def quote_verify(spark, d):
    quotes = table(spark, d, "eval_item").select(F.col("item_id").cast("string").alias("quote_id"), F.col("ground_truth").alias("quote"))
    chunks = _documents(spark, d).where("text is not null").select(F.col("doc_id").alias("chunk_ord"), "text", "source", F.lit(None).cast("int").alias("page_start"))
    return verify.verify_quotes(quotes, chunks)


@query()
def citation_repair(spark, d):
    answers_ = table(spark, d, "message").where("content like '%[Source:%'").select(F.col("id").alias("answer_id"), F.col("content").alias("text")).distinct()
    ids = Window.orderBy("chunk_id")
    chunks = table(spark, d, "chunk_result").groupBy("chunk_id").agg(F.min("text").alias("text"), F.min("source").alias("source"), F.min("page_start").alias("page_start"))
    return verify.repair_citations(answers_, chunks.withColumn("chunk_ord", F.col("chunk_id")).drop("chunk_id"))


# --- answers ---------------------------------------------------------------------------


@query("""with m as (select distinct id, conversation_id, content from message where conversation_id is not null), t as (select *, row_number() over (partition by conversation_id order by id) turn_no from m),
r as (select *, sum(coalesce(length(content) // 4, 0)) over (partition by conversation_id order by turn_no desc rows between unbounded preceding and current row) running, row_number() over (partition by conversation_id order by turn_no desc) n from t)
select conversation_id, id from r where running <= 200 or n = 1""")
def history_budget(spark, d):
    m = table(spark, d, "message").where("conversation_id is not null").select("id", "conversation_id", "content").distinct()
    m = m.withColumn("turn_no", F.row_number().over(Window.partitionBy("conversation_id").orderBy("id")))
    return answers.history_budget(m, 200).select("conversation_id", "id")


# --- metrics ---------------------------------------------------------------------------

JUDGED = "j as (select query_id, rank, case when contains(text, left(ground_truth, 30)) then 1.0 else 0.0 end rel from bm25 join documents using (doc_id) join eval_item on item_id = query_id where rank < 20)"


@query(f"""with {BM25}, {JUDGED}, i as (select *, row_number() over (partition by query_id order by rel desc, rank) i from j)
select query_id, round(sum(case when rank < 10 and rel > 0 then 1 else 0 end) / count(case when rank < 10 then 1 end), 6)::double as precision, round(coalesce(1 / (min(case when rel > 0 then rank end) + 1), 0.0), 6)::double as mrr,
round(coalesce(sum(case when rank < 10 then rel / log2(rank + 2) end) / nullif(sum(case when i <= 10 then rel / log2(i + 1) end), 0), 0), 6)::double as ndcg from i group by query_id""")
def ranking_metrics(spark, d):
    docs = _documents(spark, d)
    gold = table(spark, d, "eval_item").select(F.col("item_id").alias("query_id"), F.substring("ground_truth", 1, 30).alias("g"))
    j = index.bm25_topk(docs, _asked(spark, d), 20).join(docs.select("doc_id", "text"), "doc_id").join(gold, "query_id").withColumn("relevant", F.when(F.col("text").contains(F.col("g")), 1.0).otherwise(0.0))
    return metrics.ranking_metrics(j.select("query_id", "rank", "relevant"))


@query("""with r as (select event_type, value v, row_number() over (partition by event_type order by value) - 1 r, count(*) over (partition by event_type) n from events where value is not null)
select event_type, count(*) as n, round(min(v), 2) as min, round(max(v), 2) as max, round(avg(v), 2) as mean, round(max(case when r = least(floor(n * 0.5), n - 1) then v end), 2) as p50, round(max(case when r = least(floor(n * 0.95), n - 1) then v end), 2) as p95 from r group by event_type""")
def latency_percentiles(spark, d):
    return metrics.nearest_rank(table(spark, d, "events"), "value", ["event_type"], {"p50": 0.5, "p95": 0.95})


# --- telemetry -------------------------------------------------------------------------


@query("""select event_type || '=true' as flags, count(*) as n_queries, round(avg(coalesce(value, 0.0)), 1) as mean_latency_ms, round(avg(coalesce(json_extract_string(props, '$.k')::int, 0)), 1) as mean_fused, 0.0::double as mean_colbert from events where event_type is not null group by event_type""")
def telemetry_rollup(spark, d):
    e = table(spark, d, "events").where("event_type is not null")
    return telemetry.roll_up(e.select(F.create_map("event_type", F.lit(True)).alias("flags"), F.create_map(F.lit("total"), "value").alias("timings_ms"), F.get_json_object("props", "$.k").cast("int").alias("n_fused"), F.lit(0).alias("n_colbert")))


@query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(avg(value), 6) as mean_value from events group by all")
def telemetry_daily(spark, d):
    return telemetry.daily(table(spark, d, "events"), "ts", ["event_type"], "value").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("select item_id, left(sha256(query), 16) as masked from eval_item")
def masked_queries(spark, d):
    return table(spark, d, "eval_item").select("item_id", telemetry.masked_query(F.col("query")).alias("masked"))


# --- catalog ---------------------------------------------------------------------------


@query("""select c.id, c.name, count(d.id) as n_documents, coalesce(sum(d.chunks), 0)::bigint as n_chunks from corpus c left join catalog_document d on d.corpus_id = c.id and d.status = 'done' group by c.id, c.name""")
def corpus_listing(spark, d):
    return catalog.corpus_listing(table(spark, d, "corpus"), table(spark, d, "catalog_document")).drop("created_at")


@query("select d.corpus_id, c.name as corpus_name, d.id as document_id, d.filename, d.status, d.chunks, row_number() over (partition by d.corpus_id order by d.created_at, d.id) as position from catalog_document d join corpus c on c.id = d.corpus_id")
def corpus_detail(spark, d):
    return catalog.corpus_detail(table(spark, d, "corpus"), table(spark, d, "catalog_document"))


@query("select r_regionkey, r_name, count(n_nationkey) as n from region left join nation on n_regionkey = r_regionkey group by all")
def count_by_parent(spark, d):
    return catalog.count_by_parent(table(spark, d, "region").select("r_regionkey", "r_name"), table(spark, d, "nation"), "r_regionkey", "n_regionkey")


@query("select corpus_id, id, row_number() over (partition by corpus_id order by created_at desc nulls last, id) as position from conversation")
def conversations_newest(spark, d):
    return catalog.newest_first(table(spark, d, "conversation"), ["corpus_id"], "created_at", "id").select("corpus_id", "id", "position")


@query("select corpus_id, id from (select *, row_number() over (partition by corpus_id order by created_at desc, id desc) r from conversation where created_at is not null) where r = 1")
def latest_conversation(spark, d):
    return catalog.latest(table(spark, d, "conversation").where("created_at is not null").select("corpus_id", "id", "created_at"), ["corpus_id"], "created_at", "id").select("corpus_id", "id")


@query("select c.id, title, count(m.conversation_id) as n_messages, min(m.created_at) as first_at, max(m.created_at) as last_at from conversation c left join message m on m.conversation_id = c.id group by c.id, title")
def conversation_detail(spark, d):
    return catalog.conversation_detail(table(spark, d, "conversation"), table(spark, d, "message").withColumnRenamed("created_at", "at"))


@query("select distinct id, case when length(content) > 80 then left(content, 80) || '...' else content end as title from message")
def default_titles(spark, d):
    return table(spark, d, "message").select("id", catalog.default_title(F.col("content")).alias("title")).distinct()


@query("select m.id, m.conversation_id from message m left join conversation c on c.id = m.conversation_id where c.id is null")
def orphan_messages(spark, d):
    return catalog.orphans(table(spark, d, "message").select("id", "conversation_id"), table(spark, d, "conversation"), "conversation_id")


@query("select d.id, d.corpus_id from catalog_document d left join corpus c on c.id = d.corpus_id and c.status <> 'ready' where c.id is null")
def cascade_delete(spark, d):
    gone = table(spark, d, "corpus").where("status <> 'ready'").select("id")
    return catalog.cascade_delete(table(spark, d, "catalog_document").select("id", "corpus_id"), gone, "corpus_id")


@query("select id, case when chunks > 300 then 'done' else status end as status, chunks from catalog_document")
def status_merge(spark, d):
    now = table(spark, d, "catalog_document").select("id", "status", "chunks")
    return catalog.merge(now, now.where("chunks > 300").select("id", F.lit("done").alias("status")), ["id"])


@query("select source, count(*) as n_chunks from chunk_result where source is not null and source not in (select filename from catalog_document where filename is not null) group by source")
def unregistered_sources(spark, d):
    return catalog.register_sources(table(spark, d, "chunk_result"), table(spark, d, "catalog_document"))


@query("select source, count(*) as n from chunk_result group by source")
def source_counts(spark, d):
    return table(spark, d, "chunk_result").groupBy("source").agg(F.count("*").alias("n"))


@query("select sha256(text) as sha, min(doc_id) as first_id, count(*) as n from documents where text is not null group by 1 having count(*) > 1")
def content_duplicates(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


# --- vectors and mining ----------------------------------------------------------------


@query("select label, (i - 1)::int as i, round(avg(x), 6) as x from (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) i from embeddings) group by all")
def centroid_means(spark, d):
    c = tree.centroid_means(table(spark, d, "embeddings"), ["label"])
    return c.select("label", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("""with m as (select label, list(a order by i) c from (select label, i, avg(x) a from (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) i from embeddings) group by all) group by label),
s as (select vec_id, m.label::int as cluster, round(list_sum(list_transform(list_zip(embedding::double[], c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) dist from embeddings e, m)
select vec_id, arg_min(cluster, (dist, cluster)) as cluster from s group by vec_id""")
def centroid_assignment(spark, d):
    v = table(spark, d, "embeddings")
    c = tree.centroid_means(v, ["label"]).select(F.col("label").cast("int").alias("cluster"), "centroid")
    return tree.assign_centroids(v, c, "vec_id").select("vec_id", "cluster")


@query("select span, count(*) as df from (select distinct chunk_id, unnest(string_split(lower(heading), ' ')) as span from chunk_result where heading is not null) where span <> '' group by span having count(*) >= 2")
def span_frequency(spark, d):
    s = table(spark, d, "chunk_result").where("heading is not null").select("chunk_id", F.explode(F.split(F.lower("heading"), " ")).alias("span")).where("span <> ''")
    return mining.document_frequency(s)


# The other queries register themselves when their modules are imported.
from colophon.plans import check_queries, ranking_queries, store_queries, text_queries  # noqa: E402, F401
