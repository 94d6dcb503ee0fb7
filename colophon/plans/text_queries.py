"""Named queries over text, chunking and entity operators, and their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from colophon.functions import anchors, text
from colophon.operators import chunking, entities, verify
from colophon.plans.registry import SPACE, TAGS, WORD, _asked, _chunks, _documents, _gazetteer, query
from colophon.sources.tables import table

def _on(sql: str, column: str) -> str:
    """A piece of SQL on a column."""
    return sql.replace("{}", column)


STRIP = rf"regexp_replace({{}}, '^{SPACE}+|{SPACE}+$', '', 'g')"
SQUEEZE = rf"trim(regexp_replace({{}}, '{SPACE}+', ' ', 'g'))"
#: Sentences: the text cut after ., ! or ? and white space (RE2 has no lookbehind).
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
CHUNK_TEXTS = "c as (select distinct chunk_id, text, source, page_start, page_end, heading from chunk_result)"


def _ending(e: str) -> str:
    return rf"{WORD}{{{max(0, 4 - len(e))},}}(?i:{e})"


HYPHENS = (
    "regexp_replace(regexp_replace({}, '(^|[^" + WORD[1:-1] + "])((?:" + "|".join(_ending(e) for e in text.WORD_ENDINGS.split("|")) + r"))-\s*\n\s*([a-z])', '\1\2-\3', 'g'), '(" + WORD + r"+)-\s*\n\s*([a-z])', '\1\2', 'g')"
)


def _unicode(column: str) -> str:
    """T1 in SQL: compatibility forms of widths, ligatures, spaces and the ellipsis by table; the operator maps all of Unicode."""
    wide = {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)} | {chr(0x3000): " "}
    out = f"nfc_normalize({column})"
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("…", "..."), ("²", "2"), ("³", "3"), ("¹", "1"), ("ª", "a"), ("º", "o")):
        out = f"replace({out}, '{a}', '{b}')"
    out = f"translate({out}, '{''.join(wide)}', '{''.join(wide.values()).replace(chr(39), chr(39) * 2)}')"
    out = f"regexp_replace({out}, '[\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}]', ' ', 'g')"
    out = f"translate({out}, '{text.SINGLE_QUOTES}{text.DOUBLE_QUOTES}', '{chr(39) * 2 * len(text.SINGLE_QUOTES)}{chr(34) * len(text.DOUBLE_QUOTES)}')"
    out = f"regexp_replace({out}, '[—–]', '--', 'g')"
    return f"regexp_replace({out}, '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{200E}}\\x{{200F}}\\x{{FEFF}}\\x{{AD}}]', '', 'g')"


def _ocr(column: str) -> str:
    """T2 in SQL; RE2 has no lookahead, so what follows is taken along."""
    edge = "(^|[^" + WORD[1:-1] + "])"
    out = column
    for followers in text.RN_FOLLOWERS:
        out = f"regexp_replace({out}, '{edge}rn({followers})', '\\1m\\2', 'g')"
    out = f"regexp_replace({out}, '{edge}cl({text.CL_FOLLOWERS})', '\\1d\\2', 'g')"
    out = f"regexp_replace({out}, 'tli({text.LI_FOLLOWERS})', 'th\\1', 'g')"
    out = f"regexp_replace({out}, '({SPACE})~({SPACE})', '\\1\\2', 'g')"
    for broken, whole in text.BROKEN_WORDS.items():
        out = f"replace({out}, '{broken}', '{whole}')"
    return out


WHITE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[\f\v]', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), '[\t\r\p{Zs}\x{85}\x{2028}\x{2029}]+\n', chr(10), 'g'), '[\t\r\p{Zs}\x{85}\x{2028}\x{2029}]+$', '')"
MARKS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\.{3,}', '...', 'g'), '-{3,}', '---', 'g'), '_{3,}', '___', 'g'), ' {3,}', '  ', 'g')"


@query(f"with {CHUNK_TEXTS} select chunk_id, md5({_unicode('text')}) as forms, md5({_ocr('text')}) as repaired, md5({_on(SQUEEZE, 'lower(' + _ocr(_unicode('text')) + ')')}) as compared from c")
def text_forms(spark, d):
    """Compatibility forms, scan repairs, and the key for comparison."""
    t = F.col("text")
    c = table(spark, d, "chunk_result").select("chunk_id", "text").distinct()
    return c.select("chunk_id", F.md5(text.normalize_unicode(t)).alias("forms"), F.md5(text.repair_ocr(t)).alias("repaired"), F.md5(text.normalize_for_comparison(t)).alias("compared"))


@query(f"select doc_id, {_on(MARKS, _on(WHITE, _on(HYPHENS, _ocr(_unicode('text')))))} as clean from documents")
def text_clean(spark, d):
    return _documents(spark, d).select("doc_id", text.clean_for_ingestion(F.col("text")).alias("clean"))


@query(f"with {CHUNK_TEXTS} select chunk_id, md5({_on(HYPHENS, 'text')}) as key from c")
def text_hyphenation(spark, d):
    c = table(spark, d, "chunk_result").select("chunk_id", "text").distinct()
    return c.select("chunk_id", F.md5(text.repair_hyphenation(F.col("text"))).alias("key"))


@query(rf"""with {CHUNK_TEXTS} select chunk_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\f\v]', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), '[\t\r\p{{Zs}}\x{{85}}\x{{2028}}\x{{2029}}]+\n', chr(10), 'g'), '[\t\r\p{{Zs}}\x{{85}}\x{{2028}}\x{{2029}}]+$', '')) as key from c""")
def text_whitespace(spark, d):
    c = table(spark, d, "chunk_result").select("chunk_id", "text").distinct()
    return c.select("chunk_id", F.md5(text.normalize_whitespace(F.col("text"))).alias("key"))


@query(r"""select item_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(query), '\.{3,}', '...', 'g'), '-{3,}', '---', 'g'), '_{3,}', '___', 'g'), ' {3,}', '  ', 'g') as query from eval_item""")
def clean_queries(spark, d):
    return table(spark, d, "eval_item").select("item_id", text.clean_query(F.col("query")).alias("query"))


STEM = r"trim(replace(regexp_replace(lower(filename), '^\d{4}\s+', ''), '.pdf', ''))"


@query(rf"""with s as (select id, {STEM} as stem from catalog_document) select id, stem, regexp_replace(left(array_to_string(string_split_regex(trim(string_split(stem, ' - ')[1]), '\s+')[1:4], ' '), 30), '[,.;: ]+$', '') as short from s""")
def source_keys(spark, d):
    f = F.col("filename")
    return table(spark, d, "catalog_document").select("id", text.source_stem(f).alias("stem"), text.short_title(f).alias("short"))


@query(rf"""select distinct chunk_id, trim(regexp_replace(lower(regexp_replace(heading, '[*_]{{1,3}}([^*_]+)[*_]{{1,3}}', '\1', 'g')), '{SPACE}+', ' ', 'g')) as key from chunk_result""")
def citation_keys(spark, d):
    return table(spark, d, "chunk_result").select("chunk_id", text.normalize_citation(F.col("heading")).alias("key")).distinct()


FIELD = rf"regexp_replace(trim(regexp_replace(regexp_replace(lower({{}}), '[^{WORD[1:-1]}\s\p{{Z}}]', ' ', 'g'), '{SPACE}+', ' ', 'g')), '^(?:the|a|an) ', '')"


@query(rf"""with f as (select id, title, filename, {_on(FIELD, 'title')} as a, {_on(FIELD, 'filename')} as b from catalog_document)
select id, a as field, case when title is null or filename is null then 'none' when trim(title) = trim(filename) then 'exact' when a = b then 'normalized' when length(a) >= 5 and length(b) >= 5 and (contains(a, b) or contains(b, a)) then 'substring' else 'none' end as match from f""")
def field_matches(spark, d):
    t, f = F.col("title"), F.col("filename")
    return table(spark, d, "catalog_document").select("id", text.normalize_field(t).alias("field"), text.field_match(t, f).alias("match"))


@query(r"""select distinct id, regexp_replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '\[Source: ([^\]]+?), (pp?\. ?[0-9–-]+)\]', '<span class="citation" title="\1">\2</span>', 'g') as html from message""")
def citation_badges(spark, d):
    return table(spark, d, "message").select("id", text.badge_citations(F.col("content")).alias("html")).distinct()


#: The model-free scan quality: words that mix figures into letters, or lack a vowel.
GARBLED = rf"""{CHUNK_TEXTS}, w as (select *, list_filter(string_split_regex(lower(text), '[^{WORD[1:-1]}\x{{200C}}\x{{200D}}]+'), lambda x: length(x) >= 4) as w from c)
select chunk_id, round(case when len(w) > 0 then len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}\d|\d\p{{L}}') or not regexp_matches(x, '[aeiouyäöüàâéèêëîïôùûœæ0-9]'))) / len(w) else 0 end, 4)::double as garbled from w"""


@query(f"with {GARBLED}")
def scan_quality(spark, d):
    return _chunks(spark, d).select("chunk_id", F.round(text.garbled_ratio(F.col("text")), 4).alias("garbled"))


# --- anchors and quotes ----------------------------------------------------------------


@query(rf"""with {CHUNK_TEXTS}, a as (select distinct chunk_id, page_start, page_end, regexp_replace(unnest(regexp_extract_all(text, '(?i)(?:^|[^{WORD[1:-1]}])pp?\.?{SPACE}*(\d+(?:{SPACE}*[-–—]{SPACE}*\d+)?)\b', 1)), '{SPACE}+', '', 'g') as value from c),
n as (select *, regexp_extract_all(value, '\d+')[1]::int as lo, regexp_extract_all(value, '\d+')[-1]::int as hi, case when coalesce(page_end, 0) = 0 then page_start else page_end end as e from a)
select chunk_id, value, case when coalesce(page_start, 0) = 0 then false else not (hi < page_start or lo > e) end as inside from n""")
def anchors_in_range(spark, d):
    c = table(spark, d, "chunk_result").select("chunk_id", "text", "page_start", "page_end").distinct()
    a = c.select("chunk_id", "page_start", "page_end", F.inline(anchors.extract_anchors(F.col("text")))).where("kind = 'page'")
    return a.select("chunk_id", "value", anchors.page_in_range(F.col("value"), F.col("page_start"), F.col("page_end")).alias("inside"))


@query(r"""with s as (select doc_id, unnest(regexp_extract_all(text, 'p{1,2}\.\s*(\d+(?:\s*[-–]\s*\d+)?)', 1)) as s from documents),
n as (select doc_id, regexp_extract_all(s, '\d+')[1]::int as a, regexp_extract_all(s, '\d+')[-1]::int as b from s)
select distinct doc_id, unnest(case when b >= a and b - a <= 1000 then range(a, b + 1) else [a] end)::int as page from n""")
def cited_page_ranges(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(anchors.cited_page_ranges(F.col("text"))).alias("page"))


@query(r"""with m as (select distinct id, content from message where content is not null),
q as (select id, content, regexp_extract(content, '(?s).*"([^"]{15,})"', 1) as s, regexp_extract(content, '(?s).*“([^”]{15,})”', 1) as c, length(regexp_extract(content, '(?s)(.*"[^"]{15,}")', 1)) as es, length(regexp_extract(content, '(?s)(.*“[^”]{15,}”)', 1)) as ec from m)
select id, case when s = '' and c = '' then null when (case when c <> '' then ec else 0 end) > (case when s <> '' then es else 0 end) then c else s end as quote from q""")
def nearest_quotes(spark, d):
    return table(spark, d, "message").where("content is not null").select("id", anchors.nearest_quote(F.col("content")).alias("quote")).distinct()


@query(r"""with m as (select distinct id, content from message where content is not null)
select id, x[1] as quote, x[2]::int as page from (select id, unnest(list_transform(regexp_extract_all(content, '(?s)["“][^"”]{15,}["”][^"“]{0,300}?\bpp?\.\s*\d+'), lambda m: [regexp_extract(m, '(?s)["“]([^"”]{15,})["”][^"“]{0,300}?\bpp?\.\s*(\d+)', 1), regexp_extract(m, '(?s)["“]([^"”]{15,})["”][^"“]{0,300}?\bpp?\.\s*(\d+)', 2)])) as x from m)""")
def quote_citations(spark, d):
    m = table(spark, d, "message").where("content is not null").select("id", "content").distinct()
    return m.select("id", F.inline(verify.quote_citation_pairs(F.col("content"))))


# --- chunking --------------------------------------------------------------------------


@query(f"with s as (select doc_id, {_on(SENTENCES, 'text')} as s from documents where text is not null) select doc_id, (i - 1)::int as i, s[i] as sentence from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from s)")
def sentence_list(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(chunking.sentences(F.col("text"))).alias("i", "sentence"))


@query(r"""with r as (select doc_id, text, trim(regexp_extract(text, '(?s)^.*?[.!?]\s+(.*)$', 1)) as rest from documents where text is not null) select doc_id, case when rest <> '' then rest else trim(text) end as text from r""")
def sentence_trimmed(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", chunking.trim_to_sentence(F.col("text")).alias("text"))


@query(rf"""select doc_id, md5(array_to_string(list_filter(string_split_regex(text, '{SPACE}+'), lambda w: w <> ''), ' ')) as words, true as fits from documents where text is not null and len(list_filter(string_split_regex(text, '{SPACE}+'), lambda w: w <> '')) > 0""")
def recursive_restored(spark, d):
    """The words of all pieces, overlaps aside, put together again."""
    docs = _documents(spark, d)
    pieces = chunking.recursive_split(docs, 120, 20).join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id")
    body = F.substring(F.col("whole"), F.col("start") + 1, F.col("length"))
    parts = F.array_sort(F.collect_list(F.struct("piece_no", body.alias("body"))))
    words = chunking.words_of(F.array_join(F.transform(parts, lambda p: p["body"]), " "))
    return pieces.groupBy("doc_id").agg(F.md5(F.array_join(words, " ")).alias("words"), F.min(F.size(chunking.words_of(body)) <= 120).alias("fits"))


@query(rf"""with p as (select source, doc_id as page, regexp_replace(text, '\s*\n\s*', ' ', 'g') as text from documents where source is not null and text is not null)
select source, page, md5(array_to_string(list_filter(string_split_regex(text, '{SPACE}+'), lambda w: w <> ''), ' ')) as words from p where trim(text) <> ''""")
def packed_pages(spark, d):
    pages = _documents(spark, d).where("source is not null and text is not null").select("source", F.col("doc_id").alias("page"), "text")
    whole = pages.select("source", "page", F.regexp_replace("text", r"\s*\n\s*", " ").alias("whole"))
    got = chunking.packed_pages(pages, 120, 0, "source").join(whole, ["source", "page"])
    parts = F.array_sort(F.collect_list(F.struct("piece_no", F.substring(F.col("whole"), F.col("start") + 1, F.col("length")).alias("body"))))
    return got.groupBy("source", "page").agg(F.md5(F.array_join(chunking.words_of(F.array_join(F.transform(parts, lambda p: p["body"]), " ")), " ")).alias("words"))


@query(rf"""with t as (select doc_id, text as t, regexp_extract_all(text, '(?m)^(#{{1,6}})\s+(.+)$') as h, string_split_regex(text, '(?m)^(?:#{{1,6}})\s+(?:.+)$') as b from documents where text is not null),
x as (select doc_id, t, b, i, b[i] as body, h[i - 1] as head, coalesce(list_sum(list_transform(b[1:i - 1], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda y: length(y))), 0) as a from (select *, unnest(range(1, len(b) + 1)) as i from t)),
y as (select doc_id, i, case when i = 1 then '' else trim(regexp_extract(head, '(?m)^(#{{1,6}})\s+(.+)$', 2)) end as heading, {_on(STRIP, 'body')} as text, a + length(body) - length(regexp_replace(body, '^{SPACE}+', '')) as o, len(b) as n, t from x),
z as (select doc_id, i, heading, text, o from y where length(text) > 0 union all select doc_id, i, '', t, 0 from y where n = 1 and length(text) = 0)
select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as section_no, heading, text, o::int as offset from z""")
def header_sections(spark, d):
    return chunking.split_by_headers(table(spark, d, "documents").where("text is not null"))


@query("""with p as (select source, doc_id as page, text, string_split(text, chr(10)) as l from documents where source is not null and text is not null),
f as (select *, list_filter(list_transform(l, lambda x: lower(trim(x))), lambda x: x <> '') as f from p),
e as (select source, 'first' as side, f[1] as line from f where len(f) > 0 union all select source, 'last', f[-1] from f where len(f) > 0),
k as (select source, count(*) as pages from p group by source having count(*) >= 4),
r as (select source, side, line from e join k using (source) where length(line) < 80 group by source, side, line, pages having count(*) >= floor(pages * 0.5)),
s as (select source, list(line) filter (where side = 'first') as a, list(line) filter (where side = 'last') as z from r group by source),
b as (select p.*, list_transform(l, lambda x: trim(x) <> '' and coalesce(list_contains(a, lower(trim(x))), false)) as ba, list_transform(list_reverse(l), lambda x: trim(x) <> '' and coalesce(list_contains(z, lower(trim(x))), false)) as bz from p left join s using (source)),
n as (select *, coalesce(list_position(ba, false) - 1, len(ba)) as na, coalesce(list_position(bz, false) - 1, len(bz)) as nz from b)
select source as doc_id, page, length(array_to_string(l[na + 1 : len(l) - nz], chr(10)))::int as n from n""")
def repeated_headers(spark, d):
    pages = table(spark, d, "documents").where("source is not null and text is not null").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text")
    return chunking.strip_headers_footers(pages).select("doc_id", "page", F.length("text").alias("n"))


@query(f"""with {CHUNK_TEXTS}, p as (select chunk_id, text, left(concat_ws(' — ', nullif(source, ''), nullif(heading, '')), 500) as prefix from c) select chunk_id, md5(case when length(prefix) > 0 then prefix || chr(10) || chr(10) || text else text end) as key from p""")
def contextual_texts(spark, d):
    c = table(spark, d, "chunk_result").select("chunk_id", "text", "source", "heading").distinct()
    return c.select("chunk_id", F.md5(chunking.contextual(F.col("text"), chunking.default_prefix(F.col("source"), F.col("heading")))).alias("key"))


@query("""with r as (select source, text, row_number() over (partition by source order by doc_id) as r from documents where source is not null)
select source, left(array_to_string(list(text order by r) filter (where text is not null), chr(10) || chr(10)), 8000) as sample from r where r <= 15 group by source""")
def document_samples(spark, d):
    docs = table(spark, d, "documents").where("source is not null").select("source", F.col("doc_id").alias("chunk_index"), "text")
    return chunking.document_sample(docs)


@query("select md5(case when length(heading) > 0 then heading || chr(10) || chr(10) || text else text end) as key, chunk_id from (select distinct chunk_id, text, heading from chunk_result)")
def described_texts(spark, d):
    c = table(spark, d, "chunk_result").select("chunk_id", "text", "heading").distinct()
    return c.select("chunk_id", F.md5(chunking.described(F.col("text"), F.col("heading"))).alias("key"))


# --- entities --------------------------------------------------------------------------


@query("select lower(given_name) as canonical_id, max(given_name) as label from given_name_short group by 1")
def gazetteer_labels(spark, d):
    g = table(spark, d, "given_name_short").select(F.lower("given_name").alias("canonical_id"), F.col("given_name").alias("label"), F.lit(0).alias("load_order")).distinct()
    return entities.label_map(g)


@query("select 'CANONICAL_PERSON' as label, array_to_string(list_filter(string_split_regex(lower(short_name), '\\s+'), lambda w: w <> ''), '|') as pattern, lower(given_name) as canonical_id from (select distinct given_name, short_name from given_name_short where given_name is not null and short_name is not null)")
def ruler_patterns(spark, d):
    g = table(spark, d, "given_name_short").where("given_name is not null and short_name is not null").groupBy("given_name").agg(F.collect_set("short_name").alias("aliases"))
    g = g.select(F.lower("given_name").alias("canonical_id"), F.lit("PERSON").alias("type"), "aliases")
    return entities.ruler_patterns(g).withColumn("pattern", F.array_join("pattern", "|"))


TAGGED = """g as (select given_name, dense_rank() over (order by given_name) o, unnest(list_append(list(short_name), given_name)) alias from given_name_short group by given_name),
al as (select lower(trim(alias)) alias, arg_max(lower(given_name), o) canonical_id, max(o) o from g group by 1),
{name} as (select {key}, canonical_id, min((-length(alias), o, alias)) as b from {table} join al on length(alias) >= 3 and contains(lower({text}), alias) group by all)"""


@query(f"with {TAGGED.format(name='t', key='doc_id', table='documents', text='text')}, l as (select doc_id, list(canonical_id order by b) as ids from t group by doc_id) select doc_id, coalesce(array_to_string(ids, '|'), '') as ids from documents left join l using (doc_id)")
def tagged_documents(spark, d):
    docs = _documents(spark, d)
    return entities.tag(docs, _gazetteer(spark, d)).select("doc_id", F.array_join("canonical_ids", "|").alias("ids"))


@query(f"with {TAGGED.format(name='t', key='item_id', table='eval_item', text='query')} select item_id as query_id, canonical_id, (row_number() over (partition by item_id order by b) - 1)::int as pos from t")
def query_ids(spark, d):
    return entities.resolve(_asked(spark, d), _gazetteer(spark, d), "query_id", "query").select(F.col("doc_id").alias("query_id"), "canonical_id", "pos")


@query(f"with {TAGS}, b as (select src as canonical_id, dst as neighbour from edges union select dst, src from edges) select * from b where canonical_id in (select lower(given_name) from given_name_short)")
def entity_neighbours(spark, d):
    g = _gazetteer(spark, d)
    edges = entities.cooccurrence(entities.resolve(_documents(spark, d), g))
    return entities.neighbours(edges, g.select("canonical_id"))


RUNS = rf"list_distinct(list_filter(list_transform(regexp_extract_all(query, '(?:^|[^{WORD[1:-1]}])(\p{{Lu}}[{WORD[1:-1]}''’-]*(?:\s+\p{{Lu}}[{WORD[1:-1]}''’-]*)*)', 1), lambda x: lower(x)), lambda x: length(x) > 1))"


@query(f"with r as (select item_id, query, {RUNS} as e from eval_item) select item_id as query_id, array_to_string(list_sort(e), '|') as entities from r")
def query_signals(spark, d):
    return _asked(spark, d).select("query_id", F.array_join(F.array_sort(entities.query_entities(F.col("query"))), "|").alias("entities"))


@query("""select item_id as query_id, query || ' ' || case when label is null then '' else label || ' ' || label || ' ' || label end || ' ' || coalesce(source, '') as expanded, case when source is null then query else query || ' ' || source end as rewritten from eval_item""")
def query_expansions(spark, d):
    one = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    e = table(spark, d, "eval_item")
    return e.select(
        F.col("item_id").alias("query_id"),
        entities.expand_query(F.col("query"), one(F.col("label")), one(F.col("source"))).alias("expanded"),
        entities.rewrite_query(F.col("query"), one(F.col("source"))).alias("rewritten"),
    )


@query(rf"""select item_id as query_id, array_to_string(list_filter(string_split_regex(lower(query), '[^{WORD[1:-1]}''’-]+'), lambda w: regexp_full_match(w, '\p{{L}}{{2,}}')), ' ') as lemmas from eval_item""")
def query_lemmas(spark, d):
    return _asked(spark, d).select("query_id", F.array_join(entities.lemmas(F.col("query")), " ").alias("lemmas"))


# --- conversations as text -------------------------------------------------------------


@query(r"""with m as (select distinct id, content from message where content is not null) select id, regexp_replace(content, '(?s)<think>.*?(?:</think>\s*|$)', '', 'g') as answer from m""")
def visible_answers(spark, d):
    from colophon.streaming.ingest import visible_answer

    m = table(spark, d, "message").where("content is not null").select("id", "content").distinct()
    tokens = m.select("id", F.posexplode(F.split("content", "")).alias("seq", "token"))  # a token a character
    return m.select("id").join(visible_answer(tokens, "id"), "id", "left").withColumn("answer", F.coalesce("answer", F.lit("")))


@query("""with m as (select distinct id, conversation_id, role, content, created_at from message where conversation_id is not null),
n as (select *, row_number() over (partition by conversation_id order by created_at nulls first, id) as n from m)
select c.id, c.title, n.n::int as position, n.id as message_id, n.role, n.content from conversation c join n on n.conversation_id = c.id""")
def conversation_messages(spark, d):
    from colophon.operators import catalog

    m = table(spark, d, "message").where("conversation_id is not null").select("id", "conversation_id", "role", "content", F.col("created_at").alias("at")).distinct()
    return catalog.conversation_messages(table(spark, d, "conversation"), m).select("id", "title", "position", "message_id", "role", "content")


