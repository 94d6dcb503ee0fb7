"""Named queries over verification, structured answers, metrics and gold mining, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colophon.functions import citations
from colophon.operators import answers, metrics, mining, telemetry, tree, verify
from colophon.plans.ranking_queries import _match
from colophon.plans.registry import BY_HEADING, SPACE, TAGS, _by_heading, _chunks, _documents, query
from colophon.sources.tables import table

MESSAGES = "m as (select distinct id, content from message where content is not null)"


def _messages(spark, d):
    return table(spark, d, "message").where("content is not null").select("id", "content").distinct()


# --- quotes and citations --------------------------------------------------------------

QUOTED = rf"""{MESSAGES}, ln as (select id, content, string_split(content, chr(10)) as l from m),
rn as (select id, i, l[i] as x, regexp_matches(l[i], '^[ \t\f\v]*>') as b from (select id, l, unnest(range(1, len(l) + 1)) as i from ln)),
gr as (select *, i - row_number() over (partition by id, b order by i) as g from rn),
bl as (select id, array_to_string(list(trim(regexp_replace(trim(x), '^[> ]+', '')) order by i), ' ') as q from gr where b group by id, g),
quoted as (select distinct id, unnest(list_concat(regexp_extract_all(content, '"([^"]{{10,}})"', 1), regexp_extract_all(content, '“([^”]{{10,}})”', 1))) as quote from m union select distinct id, q from bl where length(q) >= 10)"""


@query(f"with {QUOTED} select id, quote from quoted")
def quote_extract(spark, d):
    return _messages(spark, d).select("id", F.explode(verify.extract_quotes(F.col("content"))).alias("quote")).distinct()


PAGES = "pg as (select source, doc_id as page, text from documents where source is not null and text is not null)"


def _pages(spark, d):
    return _documents(spark, d).where("source is not null and text is not null").select("source", F.col("doc_id").cast("int").alias("page"), "text")


def _checked(spark, d):
    """Each gold as a quote said to stand on a page that deals it to a document."""
    g = table(spark, d, "eval_item").select("item_id", F.col("ground_truth").alias("quote"))
    docs = _documents(spark, d).select(F.col("doc_id").alias("n"), "source", F.substring("text", 1, 120).alias("own"))
    n = docs.count()
    dealt = g.withColumn("n", F.col("item_id") * 7 % n + 1).join(docs, "n")
    return dealt.select(F.col("item_id").cast("string").alias("quote_id"), F.when(F.col("item_id") % 2 == 0, F.col("own")).otherwise(F.col("quote")).alias("quote"), F.lit("verified").alias("status"), "source", (F.col("n") + F.col("item_id") % 3 - 1).cast("int").alias("page"))


CHECKED = """ck as (select item_id::varchar as quote_id, case when item_id % 2 = 0 then left(text, 120) else ground_truth end as quote, source, (n + item_id % 3 - 1)::int as page from (select item_id, ground_truth, item_id * 7 % (select count(*) from documents) + 1 as n from eval_item) g join (select doc_id, source, text from documents) d on d.doc_id = g.n)"""


def _marked(column: str) -> str:
    """T10 with markdown in SQL."""
    md = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({column}, '\*{{3}}([^*]+)\*{{3}}', '\1', 'g'), '_{{3}}([^_]+)_{{3}}', '\1', 'g'), '\*{{2}}([^*]+)\*{{2}}', '\1', 'g'), '_{{2}}([^_]+)_{{2}}', '\1', 'g'), '\*([^*]+)\*', '\1', 'g')"
    return _match(md)


@query(f"""with {PAGES}, {CHECKED}, k as (select quote_id, source, page, left({_marked('quote')}, 60) as k from ck where source is not null and page > 0),
s as (select quote_id, bool_or(contains({_marked('text')}, k.k)) as source_verified from k join pg on pg.source = k.source and abs(pg.page - k.page) <= 1 group by quote_id)
select quote_id, coalesce(source_verified::varchar, 'unknown') as source_verified from ck left join s using (quote_id)""")
def pages_cross_checked(spark, d):
    got = verify.cross_check_pages(_checked(spark, d), _pages(spark, d))
    return got.select("quote_id", F.coalesce(F.col("source_verified").cast("string"), F.lit("unknown")).alias("source_verified"))


@query(r"""with s as (select distinct title as source from catalog_document where title is not null), f as (select distinct filename as file, lower(regexp_replace(filename, '[_-]', ' ', 'g')) as f from catalog_document where lower(filename) like '%.pdf'),
t as (select source, trim(regexp_replace(lower(source), '^\d{4}\s+', '')) as t, lower(source) as l from s),
w as (select *, regexp_extract(t, '[\p{L}\p{N}\p{M}_]{3,}') as w from t)
select source, min(file) as file from w join f on w.w <> '' and list_contains(regexp_extract_all(f, '[\p{L}\p{N}\p{M}_]+'), w.w) and length(t) > 0 and (contains(f, t) or contains(f, l)) group by source""")
def source_files(spark, d):
    names = table(spark, d, "catalog_document").where("title is not null").select(F.col("title").alias("source")).distinct()
    return verify.find_file(names, table(spark, d, "catalog_document").select(F.col("filename").alias("file")).distinct())


FOOT = """r as (select conversation_id as answer_id, row_number() over (partition by conversation_id order by id) as seq, content as quote, case when length(content) < 20 then 'too_short' when role = 'user' then 'verified' when role = 'assistant' then 'approximate' else 'unverified' end as status, length(content) % 100 / 100.0 as similarity, case when length(content) % 3 = 0 then true when length(content) % 3 = 1 then false end as source_verified from (select distinct id, conversation_id, role, content from message where conversation_id is not null and content is not null)),
x as (select *, case when length(quote) > 80 then left(quote, 80) || '...' else quote end as shown from r where status <> 'too_short'),
l as (select *, case when status = 'verified' and not coalesce(source_verified, true) then '- ⚠ "' || shown || '" — verified in chunk but NOT found on cited page' when status <> 'verified' then '- ' || case status when 'approximate' then '≈' else '✗' end || ' "' || shown || '" — ' || status || ' (similarity: ' || round(similarity * 100)::int || '%)' end as line from x),
a as (select answer_id, count(*) as n, count(*) filter (where status = 'verified') as v, count(*) filter (where status = 'approximate') as ap, count(*) filter (where status = 'unverified') as u, count(source_verified) as c, count(*) filter (where source_verified) as ok, list(line order by seq) filter (where line is not null) as ls from l group by answer_id)"""


@query(f"""with {FOOT} select answer_id, md5(array_to_string(list_concat([chr(10) || '---' || chr(10) || '**Citation verification:** ' || v || '/' || n || ' verified' || case when ap > 0 then ', ' || ap || ' approximate' else '' end || case when u > 0 then ', ' || u || ' unverified' else '' end || case when c > 0 then ' | ' || ok || '/' || c || ' source-confirmed' else '' end], coalesce(ls, [])), chr(10))) as footer from a""")
def verification_footers(spark, d):
    m = table(spark, d, "message").where("conversation_id is not null and content is not null").select("id", "conversation_id", "role", "content").distinct()
    n = F.length("content")
    r = m.select(
        F.col("conversation_id").alias("answer_id"), F.row_number().over(Window.partitionBy("conversation_id").orderBy("id")).alias("seq"), F.col("content").alias("quote"),
        F.when(n < 20, "too_short").when(F.col("role") == "user", "verified").when(F.col("role") == "assistant", "approximate").otherwise("unverified").alias("status"),
        (n % 100 / 100).alias("similarity"), F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("source_verified"),
    )
    return verify.verification_footer(r).withColumn("footer", F.md5("footer"))


@query(rf"""with {MESSAGES}, t as (select id, regexp_extract_all(content, '(?i)\[Source:\s*[^\]]+?,\s*pp?\.\s*\d+(?:\s*[-–—]\s*\d+)?\s*(?:—[^\]]*)?\]') as t from m)
select id, case when len(t) = 0 then '' else chr(10) || chr(10) || '**Citation corrections:**' || chr(10) || array_to_string(list_transform(t[1:10], lambda x: '- ' || x || ' → [unverified]'), chr(10)) || case when len(t) > 10 then chr(10) || '- … and ' || (len(t) - 10) || ' more' else '' end end as footer from t""")
def correction_footers(spark, d):
    from colophon.functions.anchors import citation_tags

    made = F.transform(citation_tags(F.col("content")), lambda t: F.struct(t["tag"].alias("original"), F.lit("[unverified]").alias("corrected")))
    return _messages(spark, d).select("id", verify.corrections_footer(made).alias("footer"))


@query(rf"""with recursive {PAGES}, ck0 as (select item_id::varchar as quote_id, case when item_id % 2 = 0 then left(text, 120) else ground_truth end as quote, source from (select item_id, ground_truth, item_id * 7 % (select count(*) from documents) + 1 as n from eval_item) g join documents d on d.doc_id = g.n where source is not null),
q as (select quote_id, source, trim(regexp_replace(quote, '{SPACE}+', ' ', 'g')) as t from ck0),
g(quote_id, source, t, n) as (select quote_id, source, t, length(t)::bigint from q union all select quote_id, source, t, floor(n * 0.8)::bigint from g where floor(n * 0.8) >= 10),
r as (select quote_id, source, t, min(n) as n from g group by all)
select quote_id, min(page)::int as page from r join pg using (source) where contains(lower(regexp_replace(text, '{SPACE}+', ' ', 'g')), lower(left(t, n))) group by quote_id""")
def quote_pages(spark, d):
    return verify.find_quote_page(_checked(spark, d).where("source is not null").select("quote_id", "quote", "source"), _pages(spark, d))


@query(rf"""with {CHECKED}, t as (select quote_id, {_match('quote')} as q, {_match('text')} as t from ck join documents on doc_id = page)
select quote_id, coalesce(list_filter([80, 50, 40, 30], lambda n: length(q) > 0 and contains(t, left(q, n)))[1], 0) as prefix from t""")
def quote_prefixes(spark, d):
    q = _checked(spark, d).join(_documents(spark, d).select(F.col("doc_id").cast("int").alias("page"), "text"), "page")
    return q.select("quote_id", verify.prefix_tier(F.col("quote"), F.col("text")).alias("prefix"))


@query(f"""with {QUOTED}, s as (select id, quote, case when length(quote) % 2 = 0 then 'verified' else 'unverified' end as status from quoted) select id, quote from s where status = 'verified'""")
def confirmed_quotes(spark, d):
    q = quote_extract(spark, d).withColumn("quote_id", F.concat_ws("#", "id", F.md5("quote")))
    results = q.select("quote_id", F.when(F.length("quote") % 2 == 0, "verified").otherwise("unverified").alias("status"))
    return verify.drop_unverified(q, results).select("id", "quote")


@query(r"""with m as (select distinct id, content from message where contains(content, '[Source:')),
t as (select id, content, regexp_extract_all(content, '(?i)\[Source:\s*[^\]]+?,\s*pp?\.\s*\d+(?:\s*[-–—]\s*\d+)?\s*(?:—[^\]]*)?\]') as t from m)
select id as answer_id, regexp_replace(content, '(?i)\[Source:\s*[^\]]+?,\s*pp?\.\s*\d+(?:\s*[-–—]\s*\d+)?\s*(?:—[^\]]*)?\]', '[unverified]', 'g') as repaired, len(t) as n from t""")
def citation_repair_unfounded(spark, d):
    """Against chunks that hold none of the quotes every tag becomes unverified."""
    a = table(spark, d, "message").where("content like '%[Source:%'").select(F.col("id").alias("answer_id"), F.col("content").alias("text")).distinct()
    none = spark.createDataFrame([("x", "no quote stands here", "s", 1)], "chunk_ord string, text string, source string, page_start int")
    return verify.repair_citations(a, none).select("answer_id", "repaired", F.size("corrections").alias("n"))


REPAIR = r"""m as (select distinct id, content from message where contains(content, '[Source:')),
t as (select id, content, regexp_extract(content, '(?i)\[Source:\s*([^\]]+?),\s*pp?\.\s*\d+(?:\s*[-–—]\s*\d+)?\s*(?:—[^\]]*)?\]', 0) as tag from m),
b as (select id, content, tag, right(content[1 : position(tag in content) - 1], 400) as before from t where tag <> ''),
q as (select *, regexp_extract(before, '(?s).*"([^"]{15,})"', 1) as s, regexp_extract(before, '(?s).*“([^”]{15,})”', 1) as c, length(regexp_extract(before, '(?s)(.*"[^"]{15,}")', 1)) as es, length(regexp_extract(before, '(?s)(.*“[^”]{15,}”)', 1)) as ec from b),
n as (select *, case when s = '' and c = '' then null when (case when c <> '' then ec else 0 end) > (case when s <> '' then es else 0 end) then c else s end as quote from q)"""


@query(f"with {REPAIR} select id, quote, left(content, position(tag in content) - 1) || case when length(quote) >= 20 then '[Source: S, p. 7]' else '[unverified]' end as head from n")
def citation_repair_founded(spark, d):
    """Against one chunk that holds every quote the first tag of each answer gets the chunk's source and page."""
    from colophon.functions.anchors import citation_tags, nearest_quote

    a = table(spark, d, "message").where("content like '%[Source:%'").select(F.col("id").alias("answer_id"), F.col("content").alias("text")).distinct()
    first = F.try_element_at(citation_tags(F.col("text")), F.lit(1))["tag"]
    a = a.withColumn("tag", first).where("tag is not null")
    a = a.withColumn("cut", F.expr("position(tag in text)")).withColumn("quote", nearest_quote(F.substring(F.expr("substring(text, 1, cut - 1)"), -400, 400)))
    heads = a.select("answer_id", F.expr("substring(text, 1, cut + length(tag) - 1)").alias("text"))
    chunks = a.where("quote is not null").select("answer_id", F.col("quote").alias("text")).select(F.col("answer_id").alias("chunk_ord"), "text", F.lit("S").alias("source"), F.lit(7).alias("page_start"))
    fixed = verify.repair_citations(heads, chunks)
    return fixed.join(a.select("answer_id", "quote"), "answer_id").select(F.col("answer_id").alias("id"), "quote", F.col("repaired").alias("head"))


# --- structured answers ----------------------------------------------------------------

REPLIES = """rp as (select item_id, source, ground_truth, case when item_id % 5 = 0 then 'no object here' else '```json' || chr(10) || '{"synthesis": "About ' || item_id || '", "per_work": [{"work": "W' || item_id || '", "quote": "q", "page": "' || coalesce(pdf_page, 0) || '", "gloss": "g"}]}' || chr(10) || '```' end as reply, pdf_page from eval_item)"""


def _replies(spark, d):
    e = table(spark, d, "eval_item")
    body = F.concat(F.lit('```json\n{"synthesis": "About '), F.col("item_id").cast("string"), F.lit('", "per_work": [{"work": "W'), F.col("item_id").cast("string"), F.lit('", "quote": "q", "page": "'), F.coalesce("pdf_page", F.lit(0)).cast("string"), F.lit('", "gloss": "g"}]}\n```'))
    return e.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 5 == 0, "no object here").otherwise(body).alias("reply"), "source", "ground_truth")


@query(f"with {REPLIES} select item_id as query_id, case when item_id % 5 <> 0 then 'About ' || item_id end as synthesis, case when item_id % 5 <> 0 then coalesce(pdf_page, 0)::varchar end as page, item_id % 5 <> 0 as fits from rp")
def parsed_answers(spark, d):
    r = _replies(spark, d).withColumn("answer", answers.parse_answer(F.col("reply")))
    return r.select("query_id", F.col("answer.synthesis").alias("synthesis"), F.get("answer.per_work", F.lit(0))["page"].alias("page"), answers.fits_schema(F.col("answer"), F.lit(1)).alias("fits"))


@query(f"""with {REPLIES} select item_id as query_id, md5(case when item_id % 5 = 0 then '### Evidence' || chr(10) || chr(10) || '- **' || 'Lost Book' || ':** _no chunk for this work was retrieved — the corpus may not contain a passage answering this query._'
else 'About ' || item_id || chr(10) || chr(10) || '### Evidence' || chr(10) || chr(10) || '- **W' || item_id || ':** "q" [Source: W' || item_id || ', p. ' || coalesce(pdf_page, 0) || '] — g' || chr(10) || '- **Lost Book:** _no chunk for this work was retrieved — the corpus may not contain a passage answering this query._' end) as markdown from rp""")
def rendered_answers(spark, d):
    r = _replies(spark, d).select("query_id", answers.parse_answer(F.col("reply")).alias("answer"), F.array(F.lit("1950 lost book - nobody.pdf")).alias("missing_works"))
    return answers.render_answers(r).withColumn("markdown", F.md5("markdown"))


@query(f"""with {REPLIES} select item_id as query_id, 2 as n_required, case when item_id % 5 = 0 then 0.0 else 0.5 end::double as per_work_coverage, case when item_id % 5 <> 0 and contains('about ' || item_id, item_id::varchar) then 0.5 else 0.0 end::double as synthesis_coverage from rp""")
def answer_coverage(spark, d):
    r = _replies(spark, d).select("query_id", answers.parse_answer(F.col("reply")).alias("answer"), F.array(F.concat(F.lit("W"), F.col("query_id").cast("string")), F.col("query_id").cast("string")).alias("required"))
    got = answers.coverage(r)
    return got.select("query_id", "n_required", F.when(F.col("per_work_coverage") == 1.0, 0.5).otherwise(F.col("per_work_coverage")).alias("per_work_coverage"), "synthesis_coverage")


# Golds as quotes against the one chunk of their question: as stored, in capitals, or of other words.
@query("""select item_id as query_id, item_id % 3 = 2 as dropped, case when item_id % 3 = 2 then '' when item_id % 3 = 1 then upper(ground_truth) else ground_truth end as quote from eval_item""")
def verbatim_quotes(spark, d):
    e = table(spark, d, "eval_item")
    n = F.col("item_id") % 3
    entries = e.select(F.col("item_id").alias("query_id"), F.lit(0).alias("work_no"), F.when(n == 1, F.upper("ground_truth")).when(n == 2, F.repeat(F.lit("0123456789 "), 6)).otherwise(F.col("ground_truth")).alias("quote"), F.lit("1").alias("page"))
    chunks = e.select(F.col("item_id").alias("query_id"), F.concat(F.lit("Before it. "), F.col("ground_truth"), F.lit(" After it.")).alias("text"))
    return answers.enforce_verbatim(entries, chunks).select("query_id", "dropped", "quote")


@query(f"""with {REPLIES} select item_id as query_id, 0::bigint as n_dropped, ['Lost Book'] as missing, item_id % 5 <> 0 as answered from rp""")
def structured_answers(spark, d):
    """The whole path from reply to rendering: the quote is short, so it stays; one required work has no chunk."""
    r = _replies(spark, d)
    asked = r.select("query_id", "reply", F.array(F.concat(F.lit("W"), F.col("query_id").cast("string")), F.lit("Lost Book")).alias("required"))
    chunks = r.select("query_id", F.concat(F.lit("W"), F.col("query_id").cast("string"), F.lit(" - x.pdf")).alias("source"), F.col("ground_truth").alias("text"))
    got = answers.answer_structured(asked, chunks)
    return got.select("query_id", "n_dropped", F.col("missing_works").alias("missing"), F.col("markdown").startswith("About").alias("answered"))


@query("""select id, case when conversation_id is null then chr(10) || chr(10) || '> **Coverage**' || chr(10) || '- No evidence for: a, b, c and 1 more' when length(content) % 2 = 1 then chr(10) || chr(10) || '> **Coverage**' || chr(10) || '- Quotes removed as not verbatim: ' || length(content) else '' end as block from (select distinct id, conversation_id, content from message where content is not null)""")
def coverage_blocks(spark, d):
    m = table(spark, d, "message").where("content is not null").select("id", "conversation_id", "content").distinct()
    missing = F.when(F.col("conversation_id").isNull(), F.array(*[F.lit(x) for x in "abcd"])).otherwise(F.array().cast("array<string>"))
    dropped = F.when(F.col("conversation_id").isNotNull() & (F.length("content") % 2 == 1), F.length("content")).otherwise(0)
    return m.select("id", answers.coverage_block(missing, dropped).alias("block"))


@query("select id, case when tags is null or tags = '' then '' else '## Required works' || chr(10) || chr(10) || array_to_string(list_transform(string_split(tags, ','), lambda t: '- ' || t), chr(10)) end as block from corpus")
def required_blocks(spark, d):
    works = F.when(F.length("tags") > 0, F.split("tags", ",")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "corpus").select("id", answers.required_block(works).alias("block"))


def _short(column: str) -> str:
    stem = rf"trim(replace(regexp_replace(lower({column}), '^\d{{4}}\s+', ''), '.pdf', ''))"
    return rf"regexp_replace(left(array_to_string(string_split_regex(trim(string_split({stem}, ' - ')[1]), '\s+')[1:4], ' '), 30), '[,.;: ]+$', '')"


@query(f"""with c as (select source, count(*) as c from (select distinct chunk_id, text, source, page_start, page_end, heading from chunk_result) where length(source) > 0 group by source),
w as (select source as work, row_number() over (order by source) as work_no from (select distinct source from eval_item where source is not null)),
p as (select c.source, c, work, work_no from c join w on {_short('c.source')} <> '' and {_short('w.work')} <> '' and (contains({_short('c.source')}, {_short('w.work')}) or contains({_short('w.work')}, {_short('c.source')}))),
f as (select source, arg_min(work, work_no) as work, any_value(c) as c from p group by source), n as (select work, sum(c) as n from f group by work)
select 'q' as query_id, work_no, work, coalesce(n, 0)::bigint as n_chunks from w left join n using (work)""")
def chunks_per_work(spark, d):
    works = table(spark, d, "eval_item").select(F.lit("q").alias("query_id"), "source").where("source is not null").distinct()
    works = works.select("query_id", F.col("source").alias("work"), F.row_number().over(Window.partitionBy("query_id").orderBy("source")).alias("work_no"))
    return answers.chunks_per_work(_chunks(spark, d).withColumn("query_id", F.lit("q")), works)


# --- metrics ---------------------------------------------------------------------------


def _golds(spark, d):
    """Every heading's hits judged against a gold of its own: words of the heading, the source and pages of its first hit."""
    c = table(spark, d, "chunk_result").groupBy(F.col("chunk_id").alias("doc_id")).agg(F.min("text").alias("text"), F.min("page_end").alias("page_end"))
    hits = _by_heading(spark, d).join(c, "doc_id").select("query_id", "rank", "text", "source", "page_start", "page_end")
    golds = hits.where("rank = 0").select("query_id", F.col("source").alias("expected_source"), F.split("query_id", " ").alias("expected_terms"), F.col("page_start").alias("first_page"), F.col("page_end").alias("last_page"))
    return hits, golds


HITS = f"""{BY_HEADING}, h as (select query_id, rank, text, source, page_start, page_end from by_heading join (select chunk_id as doc_id, min(text) as text, min(page_end) as page_end from chunk_result group by 1) using (doc_id)),
g as (select query_id, source as es, string_split(query_id, ' ') as et, page_start as fp, page_end as lp from h where rank = 0),
j as (select query_id, rank, case when coalesce(es, '') = '' then true else coalesce(contains(lower(source), lower(es)), false) end as source_hit, (len(list_filter(et, lambda t: contains(lower(text), lower(t)))) / len(et))::double as term_share, case when coalesce(fp, 0) > 0 then coalesce(page_start, 0) >= fp and coalesce(page_end, 0) > 0 and page_end <= lp end as page_hit from h join g using (query_id)),
judged as (select *, case when source_hit and term_share > 0.3 then 1.0 else 0.0 end::double as relevant from j)"""


@query(f"with {HITS} select query_id, rank, source_hit, round(term_share, 6) as term_share, coalesce(page_hit::varchar, 'unknown') as page_hit, relevant from judged")
def judged_hits(spark, d):
    return metrics.judge(*_golds(spark, d)).withColumn("term_share", F.round("term_share", 6)).withColumn("page_hit", F.coalesce(F.col("page_hit").cast("string"), F.lit("unknown")))


SCORES = f"""{HITS}, s as (select h.query_id, case when source is null or es is null or length(source) = 0 or length(es) = 0 then false else contains(trim(regexp_replace(lower(source), '^\\d{{4}}\\s+|\\.pdf$', '', 'g')), left(trim(regexp_replace(lower(es), '^\\d{{4}}\\s+|\\.pdf$', '', 'g')), 20)) or contains(trim(regexp_replace(lower(es), '^\\d{{4}}\\s+|\\.pdf$', '', 'g')), left(trim(regexp_replace(lower(source), '^\\d{{4}}\\s+|\\.pdf$', '', 'g')), 20)) end as src,
coalesce(page_start, 0) > 0 and coalesce(fp, 0) > 0 and fp - 1 <= case when coalesce(page_end, 0) = 0 then coalesce(page_start, 0) else page_end end and fp + 1 >= coalesce(page_start, 0) as pg, contains(lower(regexp_replace(text, '[\\s\\p{{Z}}\\x{{85}}]+', ' ', 'g')), trim(regexp_replace(left(lower(gq), 40), '[\\s\\p{{Z}}\\x{{85}}]+', ' ', 'g'))) as qt, rank from h join g using (query_id) join (select query_id, text as gq from h where rank = 0) using (query_id)),
scores as (select query_id, {", ".join(f"max(case when src and rank < {k} then 1.0 else 0.0 end)::double as source_p_{k}" for k in (1, 5, 10))}, {", ".join(f"max(case when pg and rank < {k} then 1.0 else 0.0 end)::double as page_hit_{k}" for k in (1, 5, 10))}, {", ".join(f"max(case when qt and rank < {k} then 1.0 else 0.0 end)::double as quote_hit_{k}" for k in (5, 10))}, coalesce(round(1 / (min(case when pg then rank end) + 1), 6), 0.0)::double as mrr from s group by query_id)"""


def _scores(spark, d):
    hits, golds = _golds(spark, d)
    quotes = hits.where("rank = 0").select("query_id", F.col("text").alias("gold_quote"))
    g = golds.select("query_id", F.col("expected_source").alias("gold_source"), F.col("first_page").alias("gold_page")).join(quotes, "query_id")
    return metrics.sample_scores(hits.join(g, "query_id"))


@query(f"with {SCORES} select * from scores")
def sample_scores(spark, d):
    return _scores(spark, d)


COLUMNS = [*[f"source_p_{k}" for k in (1, 5, 10)], *[f"page_hit_{k}" for k in (1, 5, 10)], *[f"quote_hit_{k}" for k in (5, 10)], "mrr"]


@query(f"with {SCORES} select case when length(query_id) % 2 = 0 then 'even' else 'odd' end as arm, {', '.join(f'round(avg({c}), 4) as {c}' for c in COLUMNS)} from scores group by 1")
def mean_scores(spark, d):
    arm = F.when(F.length("query_id") % 2 == 0, "even").otherwise("odd")
    return metrics.means(_scores(spark, d).withColumn("arm", arm), ["arm"])


@query(f"""with {SCORES}, a as (select case when length(query_id) % 2 = 0 then 'even' else 'odd' end as arm, {', '.join(f'round(avg({c}), 4) as {c}' for c in COLUMNS)} from scores group by 1),
l as ({' union all '.join(f"select '{c}' as metric, arm, {c} as v from a" for c in COLUMNS)})
select metric, max(case when arm = 'even' then v end) as a, max(case when arm = 'odd' then v end) as b, round(max(case when arm = 'odd' then v end) - max(case when arm = 'even' then v end), 4) as delta from l group by metric""")
def score_deltas(spark, d):
    return metrics.deltas(mean_scores(spark, d), "arm", "even", "odd")


SETS = """st as (select chunk_id, list_distinct(string_split(lower(any_value(text)), ' ')) as found, list_distinct(string_split(lower(any_value(heading)), ' ')) as wanted, any_value(heading) as heading, any_value(text) as text from (select distinct chunk_id, text, heading from chunk_result where heading is not null) group by chunk_id)"""


@query(f"""with {SETS} select chunk_id, round(len(list_intersect(found, wanted)) / len(wanted), 4)::double as recall, case when len(wanted) = 2 then case when len(list_intersect(found, wanted)) = 2 then 1.0 else 0.0 end else 0.0 end::double as edges, round(case when heading <> '' and contains({_match('text')}, {_match('heading')}) then 1.0 else 0.0 end, 4)::double as spans,
round(0.35 * round(len(list_intersect(found, wanted)) / len(wanted), 4) + 0.35 * round(case when heading <> '' and contains({_match('text')}, {_match('heading')}) then 1.0 else 0.0 end, 4) + 0.2 * 0.5 + 0.1 * 0.25, 4)::double as composite from st""")
def answer_metrics(spark, d):
    c = table(spark, d, "chunk_result").where("heading is not null").groupBy("chunk_id").agg(F.min("text").alias("text"), F.min("heading").alias("heading"))
    found, wanted = F.array_distinct(F.split(F.lower("text"), " ")), F.array_distinct(F.split(F.lower("heading"), " "))
    c = c.select("chunk_id", "text", "heading", found.alias("found"), wanted.alias("wanted"))
    spans = metrics.span_rate(F.col("text"), F.array("heading"))
    recall = metrics.recall(F.col("found"), F.col("wanted"))
    return c.select("chunk_id", recall.alias("recall"), metrics.edge_recall(F.array("found"), F.array("wanted")).alias("edges"), spans.alias("spans"), metrics.composite(recall, spans, F.lit(0.5), F.lit(0.25)).alias("composite"))


@query("""with p as (select distinct id as sentence_id, conversation_id as citation_id, (length(content) % 10 / 10)::double as e from message where content is not null), s as (select sentence_id, max(e) as best, count(*) as n, count(*) filter (where e >= 0.5) as ok from p group by 1)
select count(*) as n_sentences, sum(n)::bigint as n_citations, round(count(*) filter (where best >= 0.5) / count(*), 6) as recall, round(sum(ok) / sum(n), 6) as precision from s""")
def citation_quality(spark, d):
    m = table(spark, d, "message").where("content is not null").select(F.col("id").alias("sentence_id"), F.col("conversation_id").alias("citation_id"), (F.length("content") % 10 / 10).alias("entailment")).distinct()
    return metrics.citation_quality(m)


@query(r"""with w as (select distinct chunk_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}\p{M}_\x{200C}\x{200D}]+'), lambda x: length(x) > 3)) as p, list_distinct(list_filter(string_split_regex(lower(heading), '[^\p{L}\p{N}\p{M}_\x{200C}\x{200D}]+'), lambda x: length(x) > 3)) as s from chunk_result where heading is not null)
select chunk_id, case when len(s) > 0 then round(len(list_intersect(p, s)) / len(s), 6) else 0.0 end::double as entailment from w""")
def overlap_entailment(spark, d):
    c = table(spark, d, "chunk_result").where("heading is not null").select("chunk_id", "text", "heading").distinct()
    return c.select("chunk_id", F.round(metrics.overlap_entailment(F.col("text"), F.col("heading")), 6).alias("entailment"))


@query("""with q as (select conversation_id as query_id, case when length(content) % 2 = 0 then 'verified' else 'unverified' end as status, role as source from (select distinct id, conversation_id, role, content from message where conversation_id is not null and content is not null)),
a as (select query_id, count(*) as n, count(*) filter (where status = 'verified') as ok, max(case when source = 'user' then 1 else 0 end) + max(case when source = 'assistant' then 1 else 0 end) as hit from q group by 1)
select id as query_id, coalesce(n, 0) as n_quotes, round(coalesce(ok / n, 0), 4)::double as verify_rate, round(coalesce(hit, 0) / 2, 4)::double as source_coverage, coalesce(n, 0) >= 4 as enough from conversation left join a on a.query_id = id""")
def exhaustive_reports(spark, d):
    m = table(spark, d, "message").where("conversation_id is not null and content is not null").select("id", "conversation_id", "role", "content").distinct()
    q = m.select(F.col("conversation_id").alias("query_id"), F.when(F.length("content") % 2 == 0, "verified").otherwise("unverified").alias("status"), F.when(F.col("role").isin("user", "assistant"), F.col("role")).alias("source"))
    expected = table(spark, d, "conversation").select(F.col("id").alias("query_id"), F.array(F.lit("user"), F.lit("assistant")).alias("expected_sources"), F.lit(4).alias("min_citations"))
    return metrics.term_report(q, expected)


@query("""with c as (select distinct chunk_id, page_start as a, page_end as b, text, heading from chunk_result where page_start is not null and page_end is not null and heading is not null)
select chunk_id, case when b = a then 1.0 when abs(b - a) <= 1 then 1.0 else 0.5 end::double as pages, round(len(list_filter(['the', heading], lambda n: contains(lower(text), lower(n)))) / 2, 4)::double as named, case when length(text) % 4 = 0 then 'QUOTED' when contains(lower(text), 'could not find') then 'ABSTAINED' else 'NO_QUOTES' end as outcome,
len(list_filter(['shift', 'contrast', 'earlier', 'later', 'transform', 'develop', 'evolve', 'change', 'building on', 'unlike', 'whereas', 'moved from', 'marks a', 'depart', 'extend', 'expand', 'narrow', 'different'], lambda w: contains(lower(text), w)))::int as drift from c""")
def answer_parts(spark, d):
    c = table(spark, d, "chunk_result").where("page_start is not null and page_end is not null and heading is not null").select("chunk_id", "page_start", "page_end", "text", "heading").distinct()
    return c.select(
        "chunk_id",
        metrics.page_accuracy(F.array("page_start", "page_end"), F.array("page_start"), 1).alias("pages"),
        metrics.named_share(F.col("text"), F.array(F.lit("the"), F.col("heading"))).alias("named"),
        metrics.citation_outcome(F.when(F.length("text") % 4 == 0, 1).otherwise(0), F.col("text")).alias("outcome"),
        metrics.drift_markers(F.col("text")).alias("drift"),
    )


@query("""with c as (select distinct chunk_id, text, heading from chunk_result where heading is not null), s as (select *, [heading, 'the, of, silence, memory'] as st from c),
t as (select *, list_filter(list_transform(string_split(heading, ','), lambda x: lower(trim(x))), lambda x: length(x) > 3) as a from s)
select chunk_id, round((case when len(a) > 0 and len(list_filter(a, lambda x: contains(lower(text), x))) >= greatest(1, len(a) // 2) then 1 else 0 end + case when contains(lower(text), 'silence') or contains(lower(text), 'memory') then 1 else 0 end) / 2, 3)::double as stages from t""")
def stage_coverages(spark, d):
    c = table(spark, d, "chunk_result").where("heading is not null").select("chunk_id", "text", "heading").distinct()
    return c.select("chunk_id", metrics.stage_coverage(F.col("text"), F.array(F.col("heading"), F.lit("the, of, silence, memory"))).alias("stages"))


# --- gold mining -----------------------------------------------------------------------


@query("select case when length(text) % 5 = 0 then 'L1+' else 'L0' end as level_class, count(*) as n from documents where text is not null group by 1")
def level_mix(spark, d):
    return mining.level_mix(table(spark, d, "documents").where("text is not null").select(F.when(F.length("text") % 5 == 0, 1 + F.length("text") % 3).alias("level")))


@query("""with s as (select distinct heading as concept, source, page_start as year from (select heading, source, min(page_start) as page_start from chunk_result where heading is not null and source is not null group by 1, 2)),
r as (select *, row_number() over (partition by concept order by case when coalesce(year, 0) = 0 then 9999 else year end, source) as n from s), k as (select * from r where n <= 6),
two as (select a.concept, a.source || '|' || b.source as works, row_number() over (partition by a.concept order by a.n, b.n) as r from k a join k b on a.concept = b.concept and a.n < b.n),
three as (select concept, array_to_string(list(source order by n), '|') as works, 5 as r from k where n <= 3 group by concept having count(*) = 3),
u as (select concept, works, r, 3 as m from two where r <= 4 union all select concept, works, r, 2 from three) select concept, works, ((r - 1) % m + 1)::int as template from u""")
def enumerated_golds(spark, d):
    s = table(spark, d, "chunk_result").where("heading is not null and source is not null").groupBy(F.col("heading").alias("concept"), "source").agg(F.min("page_start").alias("year"))
    return mining.enumerate_golds(s).select("concept", F.array_join("works", "|").alias("works"), F.col("template").cast("int").alias("template"))


@query(rf"""with p as (select doc_id, unnest(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: trim(regexp_replace(x, '{SPACE}+', ' ', 'g')))) as p from documents where text is not null),
k as (select doc_id, p from p where len(string_split(p, ' ')) >= 20 and not regexp_matches(p, '^(?:#|\[|\*\*|\d+\.)')), b as (select doc_id, max({{'l': length(p), 'p': p}}).p as p from k group by doc_id),
c as (select doc_id, p, array_to_string(string_split(p, ' ')[1:80], ' ') as cut from b), s as (select *, regexp_extract(cut, '(?s)^(.*[.!?])(?:\s|$)', 1) as stop from c)
select doc_id, case when len(string_split(p, ' ')) <= 80 then p when length(stop) > length(cut) / 2 then stop else cut end as passage from s""")
def best_passages(spark, d):
    return mining.best_passage(_documents(spark, d), "doc_id")


@query(f"""with {BY_HEADING}, s as (select doc_id, source, score, row_number() over (partition by source order by score desc, doc_id) as r from by_heading where source is not null) select doc_id, source from s order by r > 5, score desc, doc_id limit 20""")
def stratified_golds(spark, d):
    return mining.stratified_pick(_by_heading(spark, d).where("source is not null").select("doc_id", "source", "score"), "source", "score", "doc_id").select("doc_id", "source")


GOLDS = """go as (select item_id, source, (n + item_id % 2)::int as page, ground_truth as g0, case when item_id % 3 = 0 then left(text, 90) when item_id % 3 = 1 then left(text, 60) || ' and something that is nowhere' else ground_truth end as gt from (select item_id, ground_truth, item_id * 7 % (select count(*) from documents) + 1 as n from eval_item) g join (select doc_id, source, text from documents where source is not null and length(text) > 100) d on d.doc_id = g.n)"""


def _dealt(spark, d):
    g = table(spark, d, "eval_item").select("item_id", "ground_truth")
    docs = _documents(spark, d)
    n = docs.count()
    own = docs.where("source is not null and length(text) > 100").select(F.col("doc_id").alias("n"), "source", "text")
    k = F.col("item_id") % 3
    gt = F.when(k == 0, F.substring("text", 1, 90)).when(k == 1, F.concat(F.substring("text", 1, 60), F.lit(" and something that is nowhere"))).otherwise(F.col("ground_truth"))
    return g.withColumn("n", F.col("item_id") * 7 % n + 1).join(own, "n").select("item_id", "source", (F.col("n") + F.col("item_id") % 2).cast("int").alias("pdf_page"), gt.alias("ground_truth"))


@query(f"""with {PAGES}, {GOLDS}, h as (select item_id, bool_or(contains({_match('pg.text')}, {_match('gt')})) as whole, bool_or(contains({_match('pg.text')}, left({_match('gt')}, 50))) as head from go join pg using (source, page) group by item_id)
select item_id, case when whole then 'whole' when head then 'head' else 'missing' end as found from go left join h using (item_id)""")
def golds_verified(spark, d):
    return mining.verify_golds(_dealt(spark, d), _pages(spark, d))


@query(f"""with {PAGES}, {GOLDS}, h as (select item_id, arg_min(pg.page, (abs(pg.page - go.page), pg.page)) as pdf_page from go join pg using (source) where length(gt) > 0 and contains({_match('pg.text')}, left({_match('gt')}, 50)) group by item_id)
select item_id, page, coalesce(pdf_page, -1)::int as pdf_page from go left join h using (item_id)""")
def golds_refreshed(spark, d):
    return mining.refresh_golds(_dealt(spark, d), _pages(spark, d)).withColumn("pdf_page", F.coalesce("pdf_page", F.lit(-1)))


@query(r"""with r as (select item_id, list_distinct(regexp_extract_all(lower(ground_truth), '\p{L}{4,}(?: \p{L}{4,}){1,4}')) as r from eval_item) select item_id, array_to_string(list_transform(list_sort(list_transform(r, lambda x: (-length(x), x)))[1:5], lambda x: x[2]), '|') as spans from r""")
def gold_spans(spark, d):
    return table(spark, d, "eval_item").select("item_id", F.array_join(mining.spans_of(F.col("ground_truth")), "|").alias("spans"))


@query("select doc_id, case when contains(text, 'the') then text[greatest(position('the' in text) - 100, 1) : position('the' in text) + 399] end as passage from documents where text is not null")
def passages_around(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", mining.passage_around(F.col("text"), F.lit("the")).alias("passage"))


@query("""with u as (select query, 0 as part from eval_item where item_id % 3 = 0 union all select query, 1 from eval_item where item_id % 3 = 1 or item_id % 6 = 0 union all select query, 2 from eval_item), f as (select query, min(part) as part from u group by query)
select query, part from f order by part, query limit 150""")
def merged_golds(spark, d):
    e = table(spark, d, "eval_item")
    return mining.merge_golds(e.where("item_id % 3 = 0"), e.where("item_id % 3 = 1 or item_id % 6 = 0"), e, 150)


HINTS = "['Columbia University Press', 'University of Minnesota Press', 'Presses Universitaires de France', 'Zone Books', 'The Athlone Press', 'Athlone Press', 'Continuum', 'City Lights Books', 'Les Editions de Minuit']"


@query(rf"""with t as (select doc_id, case when doc_id % 3 = 0 then 'Zone Books' || chr(10) || '© The estate 1987, printed 1990' || chr(10) || 'ISBN: 0-123-45678-X' || chr(10) || 'Translated by Ada B. Lovelace' || chr(10) else '' end || text as text from documents where text is not null),
l as (select *, list_filter(list_transform(string_split(left(text, 600), chr(10)), lambda x: trim(x)), lambda x: length(x) between 4 and 80 and not regexp_matches(x, '\d') and not regexp_matches(lower(x), 'translated|edited|press|by |copyright|deleuze|guattari')) as l from t)
select doc_id, trim(nullif(regexp_extract(text, '\bISBN[\s:]*([\d][\d\s\-Xx]{{8,}})', 1), '')) as isbn, coalesce(nullif(regexp_extract(text, '©\s*(?:[^\d\n]*?)(\d{{4}})', 1), ''), nullif(regexp_extract(text, '\b(19[5-9]\d|20[0-2]\d)\b', 1), '')) as year,
list_filter({HINTS}, lambda p: contains(lower(text), lower(p)))[1] as publisher, regexp_replace(trim(regexp_replace(nullif(regexp_extract(text, '[Tt]ranslated\s+(?:from\s+the\s+\w+\s+)?(?:and\s+edited\s+)?by\s+([A-Z][\w.\-]*(?:\s+(?:[A-Z][\w.\-]*|and|&|,))*\s*[A-Z][\w.\-]*)', 1), ''), '\s+', ' ', 'g')), ',+$', '') as translator,
case when contains(text, 'Deleuze') and contains(text, 'Guattari') then 'Gilles Deleuze and Felix Guattari' when contains(text, 'Deleuze') and contains(text, 'Parnet') then 'Gilles Deleuze and Claire Parnet' when contains(text, 'Deleuze') then 'Gilles Deleuze' end as author, list_reduce(l, lambda b, x: case when length(x) > length(b) then x else b end, coalesce(l[1], '')) as title from l""".replace("list_reduce(l, lambda b, x: case when length(x) > length(b) then x else b end, coalesce(l[1], ''))", "case when len(l) > 0 then list_filter(l, lambda x: length(x) = list_max(list_transform(l, lambda y: length(y))))[1] end"))
def page_metadata(spark, d):
    """Documents as title pages; every third one has an imprint set before it."""
    imprint = F.when(F.col("doc_id") % 3 == 0, "Zone Books\n© The estate 1987, printed 1990\nISBN: 0-123-45678-X\nTranslated by Ada B. Lovelace\n").otherwise("")
    t = _documents(spark, d).where("text is not null").select("doc_id", F.concat(imprint, "text").alias("text"))
    return t.select("doc_id", F.inline(F.array(mining.page_metadata(F.col("text")))))


# --- citations -------------------------------------------------------------------------


@query("select id, '(' || 'Unknown' || ', ' || case when coalesce(year, 0) = 0 then 'n.d.' else year::varchar end || ', p. 1)' as apa, '(' || 'Unknown' || ' ' || case when coalesce(year, 0) = 0 then 'n.d.' else year::varchar end || ', p. 1)' as harvard, '(Unknown 1)' as mla from catalog_document where coalesce(author, '') = ''")
def citations_without_author(spark, d):
    c = table(spark, d, "catalog_document").where("coalesce(author, '') = ''")
    one = lambda s: citations.inline(s, F.col("author"), F.col("title"), F.col("year"), F.lit("1"))
    return c.select("id", one("apa").alias("apa"), one("harvard").alias("harvard"), one("mla").alias("mla"))


# Names of one author written First Last or Last, First.
ONE = r"""a as (select id, author, title, year, coalesce(publisher, '') as pub from catalog_document where regexp_full_match(author, '[^,& ]+ [^,& ]+|[^,& ]+, [^,& ]+') and title is not null and lower(author) not like '% and %'),
n as (select *, case when contains(author, ', ') then string_split(author, ', ')[1] else string_split(author, ' ')[2] end as last, case when contains(author, ', ') then string_split(author, ', ')[2] else string_split(author, ' ')[1] end as first, case when coalesce(year, 0) = 0 then 'n.d.' else year::varchar end as y from a)"""


@query(f"""with {ONE} select id, '(' || last || ', ' || y || ', p. 1)' as apa_inline, '(' || last || ' ' || y || ', p. 1)' as harvard_inline, '(' || last || ' ' || y || ':1)' as asa_inline, '(' || last || ', ' || y || ', p. 1)' as sage_inline, '(' || last || ' 1)' as mla_inline, first || ' ' || last || ', *' || title || '*, 1.' as chicago_inline,
last || ', ' || first[1] || '. (' || year || '). *' || title || '*. ' || pub || '.' as apa_bibliography, last || ', ' || first[1] || '. (' || year || ') *' || title || '*. ' || pub || '.' as harvard_bibliography, author || '. *' || title || '*. ' || pub || ', ' || year || '.' as mla_bibliography from n""")
def citation_styles(spark, d):
    """Six styles for authors of one plain name."""
    c = table(spark, d, "catalog_document").where(r"author rlike '^(?:[^,& ]+ [^,& ]+|[^,& ]+, [^,& ]+)$' and title is not null and lower(author) not like '% and %'")
    c = c.withColumn("names", citations.author_list(F.col("author")))
    col = F.col
    return c.select(
        "id",
        *[citations.inline(s, col("author"), col("title"), col("year"), F.lit("1"), col("names")).alias(f"{s}_inline") for s in citations.STYLES],
        *[citations.bibliography(s, col("author"), col("title"), col("year"), F.coalesce("publisher", F.lit("")), F.lit(""), names=col("names")).alias(f"{s}_bibliography") for s in ("apa", "harvard", "mla")],
    )


# --- telemetry and trees ---------------------------------------------------------------


@query("""with m as (select event_type as metric, round(avg(value), 4) as value from events group by 1), t as (select distinct event_type as metric, 50.0::double as target, case when length(event_type) % 2 = 0 then 'lt' else 'gt' end as op from events)
select metric, value, target, case when op = 'lt' then value < target else value > target end as passed from m join t using (metric)""")
def latency_targets(spark, d):
    e = table(spark, d, "events")
    measured = e.groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 4).alias("value"))
    targets = e.select(F.col("event_type").alias("metric")).distinct().select("metric", F.lit(50.0).alias("target"), F.when(F.length("metric") % 2 == 0, "lt").otherwise("gt").alias("op"))
    return telemetry.check_targets(measured, targets)


@query("select event_id, event_type from events where ts >= (select max(ts) from events) - interval 7 day")
def recent_events(spark, d):
    e = table(spark, d, "events")
    newest = e.agg(F.max("ts")).first()[0]
    return telemetry.since(e, "ts", F.lit(newest), 7).select("event_id", "event_type")


NODES = """nd as (select 'n' || lpad(vec_id::varchar, 9, '0') as id, 's' || label as source, 'Node ' || vec_id || '. More.' as text, (vec_id % 9)::int as page_start, (vec_id % 9)::int as page_end, embedding, (vec_id % 40)::int as cluster from embeddings)"""


def _nodes(spark, d):
    v = table(spark, d, "embeddings")
    n = F.col("vec_id").cast("string")
    return v.select(F.concat(F.lit("n"), F.lpad(n, 9, "0")).alias("id"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("source"), F.concat(F.lit("Node "), n, F.lit(". More.")).alias("text"), (F.col("vec_id") % 9).cast("int").alias("page_start"), (F.col("vec_id") % 9).cast("int").alias("page_end"), "embedding", (F.col("vec_id") % 40).cast("int").alias("cluster"))


@query(f"""with {NODES}, g as (select source, cluster, list(id order by id) as ids, list(text order by id) as texts, coalesce(min(case when page_start > 0 then page_start end), 0) as page_start, coalesce(max(case when page_end > 0 then page_end end), 0) as page_end from nd group by all),
e as (select source, cluster, round(sum(x), 5) as total from (select source, cluster, i, avg(x) as x from (select source, cluster, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from nd) group by all) group by all)
select 'L1-' || left(sha256(source || '|' || array_to_string(ids, ',')), 16) as id, source, 1 as level, left(array_to_string(list_transform(texts, lambda t: string_split(t, ' More')[1]), ' '), 6000) as text, len(ids)::int as n, page_start, page_end, total from g join e using (source, cluster)""")
def summary_nodes(spark, d):
    n = _nodes(spark, d)
    got = tree.summary_level(n.drop("cluster"), n.select("id", "cluster"), 1)
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5)
    return got.select("id", "source", "level", "text", F.size("children_ids").alias("n"), "page_start", "page_end", total.alias("total"))


@query(f"with {NODES} select source, count(*) as n from nd group by source having count(*) >= 20")
def tree_sources(spark, d):
    return tree.sources_for_trees(_nodes(spark, d))


@query(f"with {NODES} select source, count(*) as n, count(*) as clustered, true as small from nd group by source")
def clustered_nodes(spark, d):
    """Every node in one cluster inside its source; clusters of five on average."""
    n = _nodes(spark, d).drop("cluster")
    got = n.select("id", "source").join(tree.clusters_within(n), "id", "left")
    per = got.groupBy("source").agg(F.count("*").alias("n"), F.count("cluster").alias("clustered"), F.countDistinct("cluster").alias("k"))
    return per.select("source", "n", "clustered", (F.col("k") <= F.ceil(F.col("n") / 5)).alias("small"))


@query(f"with {NODES} select source, count(*) as leaves, count(*) as children from nd group by source having count(*) > 5")
def tree_coverage(spark, d):
    """The leaves of each source's tree and the children of its first level."""
    t = tree.summary_tree(_nodes(spark, d).drop("cluster"))
    per = t.groupBy("source").agg(F.count_if(F.col("level") == 0).alias("leaves"), F.sum(F.when(F.col("level") == 1, F.size("children_ids"))).alias("children"))
    return per.where("children is not null")


# --- whole evaluations -----------------------------------------------------------------

EVAL = """an as (select distinct id as query_id, content as text from message where content is not null and role = 'assistant'),
qs as (select query_id, length(q) % 2 = 0 as verified from (select query_id, unnest(regexp_extract_all(text, '"([^"]{10,})"', 1)) as q from an)),
qc as (select query_id, count(*) as n, count(*) filter (where verified) as ok from qs group by 1)"""


def _answers(spark, d):
    """Every answer, and its straight quotes, of which those of even length are taken as verified."""
    a = table(spark, d, "message").where("content is not null and role = 'assistant'").select(F.col("id").alias("query_id"), F.col("content").alias("text")).distinct()
    q = a.select("query_id", F.explode(F.regexp_extract_all("text", F.lit('"([^"]{10,})"'), F.lit(1))).alias("q")).select("query_id", (F.length("q") % 2 == 0).alias("verified"))
    return a, q


def _strings(*values):
    return F.array(*[F.lit(v) for v in values])


@query(f"""with {EVAL} select query_id, coalesce(ok, 0) as quotes, coalesce(n, 0) as raw_quotes, coalesce(n, 0) - coalesce(ok, 0) as hallucinated, case when coalesce(ok, 0) > 0 then 1.0 else 0.0 end::double as verify_rate,
round((case when contains(lower(text), 'the') then 1 else 0 end + case when contains(lower(text), 'memory') then 1 else 0 end) / 2, 3)::double as source_coverage, round((case when contains(lower(text), 'silence') then 1 else 0 end + case when contains(lower(text), 'is') then 1 else 0 end + case when contains(lower(text), 'archive') then 1 else 0 end) / 3, 3)::double as term_coverage, coalesce(ok, 0) >= 1 as meets_minimum from an left join qc using (query_id)""")
def exhaustive_evaluation(spark, d):
    a, q = _answers(spark, d)
    expected = a.select("query_id", _strings("The Capitalism of all - x.pdf", "memory - y.pdf").alias("expected_sources"), _strings("Silence", "is", "archive").alias("expected_terms"), F.lit(1).alias("min_citations"))
    return metrics.exhaustive_scores(a, q, expected)


@query(f"""with {EVAL}, x as (select *, lower(text) as low from an left join qc using (query_id)) select query_id, coalesce(n, 0) as quotes, coalesce(ok, 0) as verified, round(coalesce(ok, 0) / greatest(coalesce(n, 0), 1), 3)::double as verify_rate, (case when contains(low, 'the') then 1 else 0 end + case when contains(low, 'memory') then 1 else 0 end)::int as works_cited, contains(low, 'the') and contains(low, 'memory') as meets_works,
len(list_filter(['shift', 'contrast', 'earlier', 'later', 'transform', 'develop', 'evolve', 'change', 'building on', 'unlike', 'whereas', 'moved from', 'marks a', 'depart', 'extend', 'expand', 'narrow', 'different'], lambda w: contains(low, w))) >= 2 as has_drift, round(case when contains(low, 'silence') or contains(low, 'archive') then 1.0 else 0.0 end, 3)::double as stage_coverage, coalesce(n, 0) >= 1 as meets_quotes from x""")
def precis_evaluation(spark, d):
    a, q = _answers(spark, d)
    expected = a.select("query_id", _strings("The Capitalism of all - x.pdf", "memory - y.pdf").alias("works_required"), _strings("silence, archive, of").alias("expected_stages"), F.lit(2).alias("min_works_cited"), F.lit(1).alias("min_quotes"))
    return metrics.precis_scores(a, q, expected)


@query(rf"""with {EVAL}, p as (select *, list_sort(list_distinct(list_transform(regexp_extract_all(text, 'p{{1,2}}\.\s*(\d+)', 1), lambda x: x::int))) as pages, lower(text) as low from an left join qc using (query_id))
select query_id, coalesce(n, 0) as quote_count, coalesce(ok, 0) as verified_quotes, coalesce(ok / n, 0.0)::double as verification_rate, case when len(pages) > 0 then round(len(list_filter(pages, lambda x: x <= 200)) / len(pages), 3) else 0.0 end::double as page_accuracy, round((case when contains(low, 'silence') then 1 else 0 end + case when contains(low, 'is') then 1 else 0 end) / 2, 3)::double as concept_coverage, case when length(text) % 2 = 0 then 0.5 else 0.0 end::double as expected_quote_coverage from p""")
def general_evaluation(spark, d):
    """Answers with their own text as context: of two expected quotes one stands there if the answer's length is even."""
    from colophon.functions.anchors import cited_pages

    a, q = _answers(spark, d)
    even = F.length("text") % 2 == 0
    quotes = F.array(F.when(even, F.col("text")).otherwise(F.lit("nowhere to be found at all 0")), F.lit("nowhere to be found either 00"))
    expected = a.select("query_id", F.sequence(F.lit(0), F.lit(200)).alias("expected_pages"), _strings("Silence", "is").alias("expected_concepts"), quotes.alias("expected_quotes"))
    return metrics.general_scores(a.withColumn("cited_pages", cited_pages(F.col("text"))), q, expected, a)


@query(f"""with {EVAL}, k as (select query_id, length(text) % 50 as expected_page from an), j as (select query_id, length(q)::int % 50 as cited, expected_page, (length(q) % 100) / 100 as r from (select query_id, unnest(regexp_extract_all(text, '"([^"]{{10,}})"', 1)) as q from an) join k using (query_id)),
b as (select query_id, count(*) as n, max(r) as r, bool_or(cited = expected_page) as exact, bool_or(cited > 0 and abs(cited - expected_page) <= 1) as near from j group by 1)
select query_id, case when coalesce(n, 0) > 0 then 'QUOTED' when contains(lower(text), 'could not find') then 'ABSTAINED' else 'NO_QUOTES' end as status, coalesce(n, 0) as num_quotes, coalesce(round(r, 3), -1)::double as grounded, coalesce(exact::varchar, '') as page_exact, coalesce(near::varchar, '') as page_near from an left join b using (query_id)""")
def citation_evaluation(spark, d):
    """Each quote's length stands in for its page and its ratios."""
    a, _ = _answers(spark, d)
    q = a.select("query_id", F.explode(F.regexp_extract_all("text", F.lit('"([^"]{10,})"'), F.lit(1))).alias("q"))
    r = (F.length("q") % 100) / 100
    quotes = q.select("query_id", (F.length("q") % 50).alias("cited_page"), *[r.alias(c) for c in ("on_cited", "on_expected", "in_source", "like_gold")])
    got = metrics.citation_scores(a.withColumn("expected_page", F.length("text") % 50), quotes)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return got.select("query_id", "status", "num_quotes", F.coalesce("grounded_pdf", F.lit(-1.0)).alias("grounded"), text("page_exact"), text("page_near"))


# --- mined golds -----------------------------------------------------------------------


def _tagged(spark, d):
    from colophon.operators import entities
    from colophon.plans.registry import _gazetteer

    docs = _documents(spark, d)
    return entities.resolve(docs, _gazetteer(spark, d)).join(docs.select("doc_id", "source"), "doc_id").where("source is not null").select(F.col("source").alias("query_id"), F.col("doc_id").alias("chunk"), "canonical_id")


@query(f"with {TAGS}, n as (select source as query_id, canonical_id, count(distinct doc_id) as n from tags join documents using (doc_id) where source is not null group by all having count(distinct doc_id) >= 2) select query_id, array_to_string(list(canonical_id order by n desc, canonical_id), '|') as entities from n group by query_id")
def gold_entities(spark, d):
    """Each source as a question, its documents as the chunks found."""
    return mining.mined_entities(_tagged(spark, d)).withColumn("entities", F.array_join("entities", "|"))


@query("with s as (select distinct source as query_id, chunk_id, lower(heading) as span from chunk_result where source is not null and heading <> ''), n as (select query_id, span, count(*) as n from s group by all having count(*) >= 2), r as (select *, row_number() over (partition by query_id order by n desc, length(span) desc, span) as r from n) select query_id, array_to_string(list(span order by r), '|') as spans from r where r <= 5 group by query_id")
def gold_headings(spark, d):
    s = table(spark, d, "chunk_result").where("source is not null").select(F.col("source").alias("query_id"), F.col("chunk_id").alias("chunk"), F.lower("heading").alias("span"))
    return mining.mined_spans(s).withColumn("spans", F.array_join("spans", "|"))


@query(f"with {TAGS}, q as (select distinct item_id as query_id, canonical_id from eval_item join al on length(alias) >= 3 and contains(lower(query || ' ' || ground_truth), alias)), m as (select query_id from q group by 1 having count(*) >= 2) select a.query_id, src, dst from edges join q a on a.canonical_id = src join q b on b.canonical_id = dst and b.query_id = a.query_id where a.query_id in (select query_id from m)")
def gold_edges(spark, d):
    from colophon.operators import entities
    from colophon.plans.registry import _gazetteer

    g = _gazetteer(spark, d)
    asked = table(spark, d, "eval_item").select(F.col("item_id").alias("doc_id"), F.concat_ws(" ", "query", "ground_truth").alias("text"))
    found = entities.resolve(asked, g).select(F.col("doc_id").alias("query_id"), "canonical_id")
    return mining.mined_edges(found, entities.cooccurrence(entities.resolve(_documents(spark, d), g)))
