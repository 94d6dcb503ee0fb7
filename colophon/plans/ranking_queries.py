"""Named queries over ranking, fusion and reranking operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colophon.operators import answers, embed, index, rerank, retrieve
from colophon.plans.registry import BM25, BY_HEADING, KEYWORD, SPACE, _asked, _by_heading, _documents, query
from colophon.plans.search import one_work, search, several_works
from colophon.sources.tables import table


def _match(column: str) -> str:
    """T10 in SQL."""
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({column}), '[–—―−]', '-', 'g'), '-{{2,}}', '-', 'g'), '[\"''“”‘’«»]', '', 'g'), '{SPACE}+', ' ', 'g'))"


def _passage(rows: str) -> str:
    """R14 in SQL: ``pscore`` of ``rows`` (``query_id, doc_id, rank, query, text``)."""
    return rf"""ps1 as (select *, {_match('query')} as nq, {_match('text')} as nt, {_match("coalesce(nullif(regexp_extract(query, '\"([^\"]{10,})\"', 1), ''), nullif(regexp_extract(query, '“([^”]{10,})”', 1), ''))")} as np from {rows}),
ps2 as (select *, string_split(nq, ' ') as qw, string_split(np, ' ') as pw from ps1),
ps3 as (select *, list_distinct(list_filter([qw[i] || ' ' || qw[i + 1] for i in range(1, len(qw))], lambda b: length(b) > 5)) as bg,
  list_filter([coalesce(list_filter([array_to_string(pw[a : a + n - 1], ' ') for n in range(len(pw) - a + 1, 0, -1)], lambda p: length(p) > 10 and contains(nt, p))[1], '') for a in range(1, len(pw) + 1)], lambda x: x <> '') as parts from ps2),
pscore as (select *, coalesce(case when np is null then 0 when contains(nt, left(np, 50)) then 100 when contains(nt, left(np, 30)) then 80 when contains(nt, left(np, 20)) then 50 when len(parts) > 0 then least(40.0, length(parts[1]) * 0.5) else 0 end
  + 2 * len(list_intersect(list_distinct(list_filter(qw, lambda w: length(w) > 2)), list_distinct(list_filter(string_split(nt, ' '), lambda w: length(w) > 2))))
  + 5 * len(list_filter(bg, lambda b: contains(nt, b))), 0)::double as score14 from ps3)"""


#: BM25 over words between white space.
SPACED = BM25
for _name in ("text", "query"):
    SPACED = SPACED.replace(rf"regexp_extract_all(regexp_replace(lower({_name}), '[-–—]', ' ', 'g'), '\p{{L}}{{2,}}')", rf"list_filter(string_split_regex(lower({_name}), '{SPACE}+'), lambda w: w <> '')")
TOP = "top as (select query_id, doc_id, rank, query, text from bm25 join documents using (doc_id) join (select item_id as query_id, query from eval_item) using (query_id) where rank < {})"


@query(f"with {BM25}, {TOP.format(10)}, {_passage('top')} select query_id, doc_id, round(score14, 6) as passage_score from pscore")
def passage_scores(spark, d):
    docs, asked = _documents(spark, d), _asked(spark, d)
    top = index.bm25_topk(docs, asked, 10).join(docs.select("doc_id", "text"), "doc_id").join(asked, "query_id")
    return retrieve.with_passage_score(top).select("query_id", "doc_id", F.round("passage_score", 6).alias("passage_score"))


@query(f"with {BM25}, {TOP.format(30)}, {_passage('top')}, r as (select query_id, doc_id, round(score14, 6) as rerank_score, row_number() over (partition by query_id order by round(score14, 6) desc, rank) - 1 as rank from pscore) select * from r where rank < 5")
def reranked(spark, d):
    """The first thirty rescored, five kept; the passage score stands in for a model."""
    docs, asked = _documents(spark, d), _asked(spark, d)
    top = index.bm25_topk(docs, asked, 40).join(docs.select("doc_id", "text"), "doc_id").join(asked, "query_id")
    return rerank.rerank(top, 5, "late").select("query_id", "doc_id", "rerank_score", "rank")


# Each gold's opening words as a quoted phrase.
PHRASES = rf"""pq as (select item_id as query_id, {_match("replace(left(ground_truth, 60), chr(34), '')")} as p, length(replace(left(ground_truth, 60), chr(34), '')) as n from eval_item),
pw as (select query_id, string_split(p, ' ') as w from pq where n >= 10),
pt as (select query_id, w, list_concat(list_transform(list_sort([(-length(array_to_string(w[i : i + 2], ' ')), i, array_to_string(w[i : i + 2], ' ')) for i in range(1, len(w) - 1)]), lambda x: x[3]), list_transform(list_sort([(-length(array_to_string(w[i : i + 1], ' ')), i, array_to_string(w[i : i + 1], ' ')) for i in range(1, len(w))]), lambda x: x[3]), list_transform(list_sort([(-length(w[i]), i, w[i]) for i in range(1, len(w) + 1) if length(w[i]) > 3])[1:1], lambda x: x[3])) as terms from pw where len(w) >= 2),
px as (select query_id, unnest(terms) as term, generate_subscripts(terms, 1) as i from pt),
dn as (select doc_id, ' ' || {_match('text')} || ' ' as t from documents where text is not null),
ph as (select query_id, i, doc_id from px join dn on contains(t, ' ' || term || ' ')),
pm as (select query_id, min(i) as i from ph group by query_id),
phrase as (select query_id, doc_id, row_number() over (partition by query_id order by doc_id) - 1 as rank from ph join pm using (query_id, i))"""


def _phrased(spark, d):
    return table(spark, d, "eval_item").select(F.col("item_id").alias("query_id"), F.concat(F.lit('"'), F.regexp_replace(F.substring("ground_truth", 1, 60), '"', ""), F.lit('"')).alias("query"))


@query(f"with {PHRASES} select query_id, doc_id, rank, 100.0::double as score from phrase where rank < 10")
def phrase_search(spark, d):
    return retrieve.phrase_search(_documents(spark, d), _phrased(spark, d), 10)


# Titles as queries name them, and the works that a query names.
MENTIONS = r"""src as (select distinct concat_ws(' ', year::varchar, title) as source from catalog_document),
st as (select source, trim(regexp_replace(lower(source), '^\d{4}\s+', '')) as title from src),
sp as (select source, title, list_filter(string_split_regex(regexp_replace(trim(string_split(replace(title, '.pdf', ''), ' - ')[1]) || ' ', '^(?:(?:the|a|an|what|who|when|where|why|how|which|is|are|was|were|do|does|did) )+', ''), '\s+'), lambda w: w <> '') as w from st),
pa as (select distinct source, part from (select source, unnest([array_to_string(w[1:n], ' ') for n in range(1, len(w) + 1)]) as part from sp) where length(part) >= 5),
cl as (select distinct a.source, a.part from pa a join pa b on a.source <> b.source and (contains(a.part, b.part) or contains(b.part, a.part)) and len(list_intersect(string_split(a.part, ' '), string_split(b.part, ' '))) > 0),
un as (select * from pa anti join cl using (source, part)),
eq as (select item_id as query_id, query, lower(query) as low from eval_item),
me as (select query_id, source from eq join st on (length(title) >= 6 and contains(low, title)) or regexp_matches(query, '(?i)\bin\s+' || regexp_replace(regexp_replace(regexp_replace(title, '([\\.\[\]{}()*+?^$|])', '\\\1', 'g'), '-', '[-\\s]?', 'g'), '\s+', '\\s+', 'g') || '\b') where length(regexp_extract(title, '\w+')) > 0 and list_contains(regexp_extract_all(low, '\w+'), regexp_extract(title, '\w+'))
  union select query_id, source from eq join un on contains(low, part) and list_contains(regexp_extract_all(low, '\w+'), regexp_extract(part, '\w+'))),
mentions as (select query_id, source, count(*) over (partition by query_id) as n_sources from me)"""


def _mentions(spark, d):
    titles = table(spark, d, "catalog_document").select(F.concat_ws(" ", F.col("year").cast("string"), F.col("title")).alias("source"))
    return retrieve.source_mentions(_asked(spark, d), titles)


@query(f"with {MENTIONS} select * from mentions")
def source_mentions(spark, d):
    return _mentions(spark, d)


@query(f"with {MENTIONS} select query_id, source as work, (row_number() over (partition by query_id order by source) - 1)::int as work_no from mentions")
def named_works(spark, d):
    return several_works(_mentions(spark, d), 1)


@query(f"with {MENTIONS} select query_id, min(source) as source_prefix from mentions where n_sources = 1 group by query_id")
def one_named_work(spark, d):
    return one_work(_mentions(spark, d))


DENSE = """ds as (select e.item_id as query_id, v.vec_id as doc_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score from eval_item e join embeddings q on q.vec_id = e.item_id, embeddings v),
dense as (select *, row_number() over (partition by query_id order by score desc, doc_id) - 1 as rank from ds)"""
KIND = r"""kind as (select item_id as query_id, regexp_matches(query, '"[^"]{5,}"') or regexp_matches(query, '“[^”]{5,}”') or regexp_matches(query, '(?i)p\.?\s*\d+') or regexp_matches(query, '\b[A-Z][a-z]+\s+[A-Z][a-z]+\b') as lex from eval_item)"""


def _fused(name: str, lists: list[tuple[str, str, int]]) -> str:
    """R11 in SQL: ``name`` of ranked lists (table, weight, rows)."""
    parts = " union all ".join(f"select query_id, doc_id, {i} as channel, rank, round(({w})::double / (60 + rank + 1), 12) as part from {t} left join kind using (query_id) where rank < {n}" for i, (t, w, n) in enumerate(lists))
    return f"""{name}_l as ({parts}), {name}_f as (select query_id, doc_id, round(sum(part), 8) as rrf_score, min(channel * 10000000 + rank) as first from {name}_l group by all),
{name} as (select query_id, doc_id, rrf_score, row_number() over (partition by query_id order by rrf_score desc, first, doc_id) - 1 as rank from {name}_f)"""


def _vectors(spark, d):
    """The vector tables as chunks' and queries' embeddings: vector n belongs to document n and to item n."""
    v = table(spark, d, "embeddings")
    docs = _documents(spark, d).join(v.select(F.col("vec_id").cast("bigint").alias("doc_id"), "embedding"), "doc_id", "left")
    asked = _asked(spark, d)
    return docs, asked, asked.select("query_id").join(v.select(F.col("vec_id").cast("bigint").alias("query_id"), F.col("embedding").alias("vector")), "query_id")


@query(f"with {BM25}, {KIND}, {DENSE}, dense_d as (select d.* from (select ds.*, row_number() over (partition by query_id order by score desc, doc_id) - 1 as rank from ds join documents using (doc_id)) d), {_fused('f', [('dense_d', 'case when lex then 0.35 else 0.7 end', 100), ('bm25', 'case when lex then 0.65 else 0.3 end', 100)])} select query_id, doc_id, rrf_score, rank from f where rank < 20")
def dense_and_lexical(spark, d):
    """Both channels, weighed by the class of the query."""
    docs, asked, vectors = _vectors(spark, d)
    weights = asked.select("query_id", retrieve.channel_weights(retrieve.query_class(F.col("query"))).alias("w"))
    dense = retrieve.dense_topk(docs, vectors, 100, "doc_id").join(weights, "query_id")
    lexical = index.bm25_topk(docs, asked, 100).join(weights, "query_id")
    return retrieve.fuse([(dense, F.col("w.dense")), (lexical, F.col("w.sparse"))]).where("rank < 20")


@query(f"with {BM25}, {KIND}, {KEYWORD}, {DENSE}, {_fused('a', [('bm25', '1.0', 50), ('kw', '0.7', 50)])}, {_fused('b', [('a', '1.0', 1000000), ('dense', '0.4', 30)])} select query_id, doc_id, rrf_score, rank from b where rank < 20")
def three_lists(spark, d):
    """A second list fused in at .7, a third one at .4."""
    docs, asked, vectors = _vectors(spark, d)
    two = retrieve.fuse([(index.bm25_topk(docs, asked, 50), 1.0), (index.keyword_fallback(docs, asked, 50), 0.7)])
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("doc_id"), "embedding")
    return retrieve.fuse([(two, 1.0), (retrieve.dense_topk(v, vectors, 30, "doc_id"), 0.4)]).where("rank < 20")


FULL = f"""{BM25}, {KIND}, {DENSE}, dense_d as (select ds.*, row_number() over (partition by query_id order by score desc, doc_id) - 1 as rank from ds join documents using (doc_id)),
{_fused('f', [('dense_d', 'case when lex then 0.35 else 0.7 end', 200), ('bm25', 'case when lex then 0.65 else 0.3 end', 200)])},
win as (select query_id, 1000000 + doc_id as doc_id, rank from dense_d where rank < 200), {_fused('g', [('f', '1.0', 1000000), ('win', '0.7', 200)])},
top as (select query_id, doc_id, rank, query, text, source from g join (select doc_id, text, source from documents union all select 1000000 + vec_id, text, source from embeddings join documents on doc_id = vec_id) using (doc_id) join (select item_id as query_id, query from eval_item) using (query_id) where rank < 200 and not regexp_matches(query, '"[^"]{{10,}}"') and not regexp_matches(query, '“[^”]{{10,}}”')),
{_passage('top')}, r as (select query_id, doc_id, source, round(score14, 6) as rerank_score, row_number() over (partition by query_id order by round(score14, 6) desc, rank) - 1 as rank from pscore)"""


@query(f"with {FULL} select query_id, doc_id, rank, rerank_score, source from r where rank < 10")
def full_search(spark, d):
    """Dense, lexical and window channels, fusion, rerank, over all documents; questions without a quoted phrase."""
    docs, asked, vectors = _vectors(spark, d)
    asked = asked.where(retrieve.quoted_phrase(F.col("query")).isNull())
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("doc_id"), "embedding")
    windows = v.join(docs.select("doc_id", "text", "source"), "doc_id").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    return search(docs.select("doc_id", "text", "source", "embedding"), asked, vectors.join(asked.select("query_id"), "query_id"), windows=windows).select("query_id", "doc_id", "rank", "rerank_score", "source")


@query(f"""with {BM25}, {MENTIONS}, ws as (select query_id, source as work, row_number() over (partition by query_id order by source) - 1 as work_no from mentions where n_sources >= 1),
dw as (select d.doc_id, f.filename as source from documents d join (select filename, row_number() over (order by filename) as n, count(*) over () as c from catalog_document) f on f.n = d.doc_id % f.c + 1),
b as (select query_id, doc_id, rank from bm25 where rank < 60),
p as (select b.query_id, b.doc_id, b.rank, min(case when starts_with(dw.source, ws.work) then work_no end) as work_no from b left join dw using (doc_id) left join ws using (query_id) group by all),
t as (select *, case when work_no is not null then row_number() over (partition by query_id, work_no order by rank) end as turn from p)
select query_id, doc_id, (row_number() over (partition by query_id order by turn nulls last, work_no nulls last, rank) - 1) as rank from t""")
def works_by_turns(spark, d):
    """BM25 lists with the works a query names in turn; documents dealt to the catalog's files."""
    from pyspark.sql import Window

    from colophon.plans.search import by_turns

    docs, asked = _documents(spark, d), _asked(spark, d)
    files = table(spark, d, "catalog_document").select("filename")
    n = files.count()
    files = files.select(F.col("filename").alias("source"), F.row_number().over(Window.orderBy("filename")).alias("n"))  # the catalog is a small dimension
    source = docs.select("doc_id", (F.col("doc_id") % n + 1).alias("n")).join(files, "n").select("doc_id", "source")
    return by_turns(index.bm25_topk(docs, asked, 60), several_works(_mentions(spark, d), 1), source)


@query(f"""with {BY_HEADING}, l as (select *, case when rank % 7 = 0 then '1' when rank % 11 = 0 then 'x' else '0' end as level from by_heading) select query_id, doc_id from l where coalesce(try_cast(level as int), 0) = 0""")
def leaf_rows(spark, d):
    l = _by_heading(spark, d).withColumn("level", F.when(F.col("rank") % 7 == 0, "1").when(F.col("rank") % 11 == 0, "x").otherwise("0"))
    return retrieve.leaves_only(l).select("query_id", "doc_id")


@query(f"""with {BY_HEADING}, t as (select b.*, page_end, heading, text from by_heading b join (select chunk_id, min(page_end) as page_end, min(heading) as heading, min(text) as text from chunk_result group by 1) on chunk_id = doc_id where rank < 3),
l as (select query_id, rank, '[Source ' || (rank + 1) || ': ' || coalesce(source, 'unknown') || case when coalesce(page_start, 0) <> 0 and coalesce(page_end, 0) <> 0 then case when page_start = page_end then ', p. ' || page_start else ', pp. ' || page_start || '-' || page_end end else '' end || case when length(heading) > 0 then ' — ' || heading else '' end || ']' || chr(10) || text as b from t)
select query_id, md5(array_to_string(list(b order by rank), chr(10) || chr(10) || '---' || chr(10) || chr(10))) as context from l group by query_id""")
def prompt_contexts(spark, d):
    c = table(spark, d, "chunk_result").groupBy(F.col("chunk_id").alias("doc_id")).agg(F.min("page_end").alias("page_end"), F.min("heading").alias("heading"), F.min("text").alias("text"))
    return retrieve.prompt_context(_by_heading(spark, d).where("rank < 3").join(c, "doc_id")).withColumn("context", F.md5("context"))


@query("""with p as (select q.vec_id as query_id, v.vec_id as doc_id, [q.embedding[i : i + 15]::double[] for i in [1, 17, 33, 49]] as qt, [v.embedding[i : i + 15]::double[] for i in [1, 17, 33, 49]] as dt from embeddings q, embeddings v where q.vec_id % 50 = 0)
select query_id, doc_id, round(list_sum([list_max([list_sum([x[i] * y[i] for i in range(1, 17)]) for y in dt]) for x in qt]), 5) as score from p""")
def late_interaction(spark, d):
    """Each vector as four token vectors of sixteen numbers; every fiftieth as a query."""
    v = table(spark, d, "embeddings")
    parts = F.array(*[F.slice("embedding", i, 16) for i in (1, 17, 33, 49)])
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), parts.alias("q"))
    rows = v.select(F.col("vec_id").alias("doc_id"), parts.alias("t")).crossJoin(F.broadcast(asked))  # a set of queries against all rows
    return rows.select("query_id", "doc_id", F.round(rerank.max_similarity(F.col("q"), F.col("t")), 5).alias("score"))


@query("""with p as (select q.vec_id as query_id, v.vec_id as doc_id, [q.embedding[i : i + 15]::double[] for i in [1, 17, 33, 49]] as qt, [v.embedding[i : i + 15]::double[] for i in [1, 17, 33, 49]] as dt from embeddings q, embeddings v where q.vec_id % 50 = 0),
s as (select query_id, doc_id, round(list_sum([list_max([list_sum([x[i] * y[i] for i in range(1, 17)]) for y in dt]) for x in qt]), 6) as score from p), r as (select *, row_number() over (partition by query_id order by score desc, doc_id) - 1 as rank from s) select query_id, doc_id, rank from r where rank < 10""")
def late_search(spark, d):
    """The ten best of every fiftieth vector over all of them."""
    v = table(spark, d, "embeddings")
    t = F.array(*[F.slice("embedding", i, 16) for i in (1, 17, 33, 49)]).alias("tokens")
    return rerank.late_topk(v.select(F.col("vec_id").alias("doc_id"), t), v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), t)).select("query_id", "doc_id", "rank")


@query(f"with s as (select id, regexp_replace(content, '^{SPACE}+|{SPACE}+$', '', 'g') as t from message) select distinct id, case when length(t) > 0 then t else 'asked' end as text from s")
def hypothetical_texts(spark, d):
    return table(spark, d, "message").select("id", rerank.hypothetical(F.lit("asked"), F.col("content")).alias("text")).distinct()


@query(rf"""with w as (select item_id as query_id, list_distinct(list_filter(string_split(lower(query), ' '), lambda x: x <> '')) as w from eval_item) select query_id, array_to_string(list_transform(list_sort(list_transform(w, lambda x: (-length(x), x)))[1:5], lambda x: x[2]), ' ') as expanded from w""")
def sparse_expansion(spark, d):
    """The heaviest terms of an expansion; a word's length stands in for a learned weight."""
    words = F.array_distinct(F.filter(F.split(F.lower("query"), " "), lambda x: x != ""))
    q = _asked(spark, d).withColumn("m", F.map_from_arrays(words, F.transform(words, lambda w: F.length(w).cast("double"))))
    return q.select("query_id", rerank.expand_sparse(F.col("query"), F.col("m"), 5).alias("expanded"))


@query(r"""with m as (select distinct id, content from message where content is not null), l as (select id, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(regexp_replace(x, '^\s*(?:[-*•]|\d+[.)])\s*', ''))), lambda x: length(x) > 10) as l from m),
o as (select id, list_concat(['the question itself'], l) as o from l), u as (select id, x, i from (select id, unnest(o) as x, generate_subscripts(o, 1) as i from o)), f as (select id, x, min(i) as i from u group by id, x)
select id, array_to_string(list(x order by i)[1:4], '|') as queries from f group by id""")
def decomposed_queries(spark, d):
    m = table(spark, d, "message").where("content is not null").select("id", "content").distinct()
    return m.select("id", F.array_join(rerank.sub_queries(F.lit("the question itself"), F.col("content")), "|").alias("queries"))


@query("select distinct chunk_id, page_start::double as a, page_end::double as b from chunk_result where page_start is not null and page_end is not null")
def listed_scores(spark, d):
    c = table(spark, d, "chunk_result").where("page_start is not null and page_end is not null").select("chunk_id", "page_start", "page_end").distinct()
    reply = F.concat(F.lit("Scores: ["), F.concat_ws(", ", "page_start", "page_end"), F.lit("] as asked"))
    return c.withColumn("s", rerank.listed_scores(reply)).select("chunk_id", F.get("s", F.lit(0)).alias("a"), F.get("s", F.lit(1)).alias("b"))


@query(f"""with {BY_HEADING}, j as (select *, coalesce(score >= 0.6, false) as sure from by_heading), t as (select query_id, max(score) as s from by_heading group by query_id),
x as (select query_id, doc_id, rank from by_heading where rank % 2 = 1), kind as (select null::varchar as query_id where false),
u as (select query_id from t where not coalesce(s, 0) >= 0.6), e as (select x.query_id, x.doc_id, row_number() over (partition by query_id order by rank) - 1 as rank from x join u using (query_id)),
{_fused('w', [('by_heading', '1.0', 1000000000), ('e', '0.5', 1000000000)])} select query_id, doc_id, rrf_score, rank from w""")
def widened_lists(spark, d):
    """The confidence gate: lists whose best score is under .6 get a second list at half weight."""
    from pyspark.sql import Window

    main = _by_heading(spark, d)
    order = Window.partitionBy("query_id").orderBy("rank")
    extra = main.where("rank % 2 = 1").select("query_id", "doc_id", "rank").withColumn("rank", F.row_number().over(order) - 1)
    return retrieve.widen_if_unsure(main, extra, main.groupBy("query_id").agg((100 * F.max("score")).alias("passage_score")))


@query(f"with {SPACED} select query_id, doc_id, score from bm25 where rank < 10")
def whitespace_lexical(spark, d):
    """The evaluation's variant: tokens between white space."""
    return index.bm25_topk(_documents(spark, d), _asked(spark, d), 10, tokens=index.spaced_words).drop("rank")


# --- answers and prompts ---------------------------------------------------------------


@query("""select id, case mode when 'exact' then 'Quote the passage asked for word for word, with its source and page.' when 'exhaustive' then 'List every passage on the term, each word for word, with its source and page.' when 'precis' then 'Trace how the concept changes from work to work, with a quoted passage of each.' else 'Answer from the context only, with quoted passages and their sources.' end
|| chr(10) || 'Citation style: ' || coalesce(citation_style, 'chicago') || chr(10) || chr(10) || '## Context' || chr(10) || chr(10) || 'none' || chr(10) || chr(10) || '## Question' || chr(10) || chr(10) || title as prompt from conversation""")
def mode_prompts(spark, d):
    c = table(spark, d, "conversation")
    return c.select("id", answers.mode_prompt(F.col("mode"), F.col("title"), F.lit("none"), F.col("citation_style")).alias("prompt"))


TERMS = r"""t as (select distinct given_name as term, lower(given_name) as low, regexp_extract(lower(given_name), '\w+') as word from given_name_short),
c as (select distinct chunk_id, text from chunk_result), s as (select chunk_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) as sentence from c)"""


@query(f"with {TERMS} select distinct term, chunk_id as chunk, sentence from s join t on contains(lower(sentence), low) and list_contains(regexp_extract_all(lower(sentence), '\\w+'), word) where length(sentence) >= 20")
def term_sentences(spark, d):
    terms = table(spark, d, "given_name_short").select(F.col("given_name").alias("term")).distinct()
    return answers.term_sentences(table(spark, d, "chunk_result").select("chunk_id", "text").distinct(), terms)


@query(rf"""with q as (select distinct coalesce(conversation_id, '') as query_id, role as run, left({_match('content')}, 50) as key from message where content is not null) select query_id, key, count(distinct run) as n_runs from q group by all having count(distinct run) >= 2""")
def quote_consensus(spark, d):
    m = table(spark, d, "message").where("content is not null").select(F.coalesce("conversation_id", F.lit("")).alias("query_id"), F.col("role").alias("run"), F.col("content").alias("quote"), F.lit(True).alias("verified"))
    return answers.consensus(m, 3)


@query("""select * from (values ('baseline', '', ''), ('only_gate', 'true', ''), ('only_windows', '', 'true'), ('all', 'true', 'true')) v(config, gate, windows)""")
def config_matrix(spark, d):
    m = answers.config_matrix(spark, {"gate": "true", "windows": "true"})
    return m.select("config", F.coalesce(F.try_element_at("flags", F.lit("gate")), F.lit("")).alias("gate"), F.coalesce(F.try_element_at("flags", F.lit("windows")), F.lit("")).alias("windows"))


@query("select item_id as query_id, 256 as n, query = trim(query) as clean from eval_item")
def embedded_queries(spark, d):
    q = _asked(spark, d)
    return embed.embed_queries(q).join(q, "query_id").select("query_id", F.size("vector").alias("n"), (F.col("query") == F.trim("query")).alias("clean"))

