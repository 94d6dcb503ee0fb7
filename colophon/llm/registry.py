"""Named queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from colophon.llm.scans import found_repairs

    return found_repairs(table(spark, folder, "chunk_result"))


def p1_texts(spark: SparkSession, folder: str) -> DataFrame:
    from colophon.llm.scans import repaired_texts

    return repaired_texts(table(spark, folder, "chunk_result"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    from colophon.llm.neighbours import similar_pairs

    return similar_pairs(table(spark, folder, "loaded_chunk"), "id", "embedding", dim=64, k=5)


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    from colophon.llm.split import split_oversized

    return split_oversized(table(spark, folder, "chunk_result").select("chunk_id", "text", "page_start", "page_end"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).where("piece_no > 1").select("chunk_id").distinct()


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    from colophon.llm.split import split_oversized

    chunks = table(spark, folder, "chunk_result").select("chunk_id", "text", "page_start", "page_end").distinct()
    return split_oversized(chunks).drop("page_start", "page_end")


def p3_restored(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of each chunk come to when put together again, and whether they keep limit and overlap."""
    pieces = p3_pieces(spark, folder)
    body = F.expr("substring(piece_text, piece_body_offset - piece_offset + 1)")
    again = F.col("piece_body_offset") - F.col("piece_offset")
    fits = (F.length("piece_text") <= 2400) & (again <= 240) & ((F.col("piece_no") == 1) == (F.col("piece_body_offset") == 0))
    parts = F.array_sort(F.collect_list(F.struct("piece_body_offset", body.alias("body"))))
    return pieces.groupBy("chunk_id").agg(
        F.md5(F.array_join(F.transform(parts, lambda p: p["body"]), "")).alias("whole"),
        F.min(fits).alias("fits"),
        F.min("piece_page_start").alias("first_page"),
        F.max("piece_page_end").alias("last_page"),
        (F.count("*") > 1).alias("split"),
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    from colophon.llm.spellings import variant_pairs

    documents, short = table(spark, folder, "catalog_document"), table(spark, folder, "given_name_short")
    return variant_pairs(documents, ("author", "title"), short)


def p4_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Each spelling with its entity, without pairs."""
    from colophon.llm.spellings import spelling_entities

    documents, short = table(spark, folder, "catalog_document"), table(spark, folder, "given_name_short")
    return spelling_entities(documents, ("author", "title"), short)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    from colophon.llm.conversations import rebuild_conversations

    turns = rebuild_conversations(table(spark, folder, "message"), table(spark, folder, "conversation"))
    return turns.select("conversation_id", "turn_no", "message_id")


def p5_relinked(spark: SparkSession, folder: str) -> DataFrame:
    """The same conversations when only the first row of each keeps its identifier and every other names the row before it."""
    from pyspark.sql import Window

    from colophon.llm.conversations import rebuild_conversations

    columns = ["conversation_id", "role", "content", "metadata_json", "created_at"]
    rows = table(spark, folder, "message").where("conversation_id is not null and id is not null").groupBy("id").agg(F.min(F.struct(*columns)).alias("r")).select("id", "r.*")
    before = F.lag("id").over(Window.partitionBy("conversation_id").orderBy("id"))
    linked = rows.withColumn("_before", before).withColumn("metadata_json", F.when(F.col("_before").isNotNull(), F.to_json(F.struct(F.col("_before").alias("reply_to")))))
    lost = linked.withColumn("conversation_id", F.when(F.col("_before").isNull(), F.col("conversation_id"))).drop("_before")
    return rebuild_conversations(lost, table(spark, folder, "conversation")).select("conversation_id", "turn_no", "message_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    from colophon.llm.unify import alike_pairs

    chunks = alike_pairs(table(spark, folder, "chunk_result"), "chunk_id", "text").select(F.lit("chunk_result").alias("table_name"), "id_a", "id_b")
    return chunks.union(alike_pairs(table(spark, folder, "message"), "id", "content").select(F.lit("message").alias("table_name"), "id_a", "id_b"))


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of ``p6_found`` by its class, without pairs."""
    from colophon.llm.unify import alike_classes

    chunks = alike_classes(table(spark, folder, "chunk_result"), "chunk_id", "text").select(F.lit("chunk_result").alias("table_name"), "id", "class_id", "texts")
    return chunks.union(alike_classes(table(spark, folder, "message"), "id", "content").select(F.lit("message").alias("table_name"), "id", "class_id", "texts"))


def p6_texts(spark: SparkSession, folder: str) -> DataFrame:
    from colophon.llm.unify import unify_text

    chunks = unify_text(table(spark, folder, "chunk_result").select("chunk_id", "text"), "text").select(F.lit("chunk_result").alias("table_name"), F.col("chunk_id").alias("id"), "canonical")
    return chunks.union(unify_text(table(spark, folder, "message").select("id", "content"), "content").select(F.lit("message").alias("table_name"), "id", "canonical"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    from colophon.llm.leaks import find_leaks

    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item")).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Every place of every document that holds a passage."""
    from colophon.llm.leaks import find_leaks

    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item"), every=True)


def p7_cut(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, without the places that hold a passage."""
    from colophon.llm.leaks import cut_leaks

    return cut_leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "eval_item"))


def p8_selection(spark: SparkSession, folder: str) -> DataFrame:
    from colophon.llm.mixing import mix_sources

    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_target"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    from colophon.llm.mixing import share_report

    return share_report(p8_selection(spark, folder), table(spark, folder, "mix_target"))


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Of each target source with documents: whether its cap is kept, and its share to within two documents."""
    chosen = p8_selection(spark, folder)
    targets = table(spark, folder, "mix_target").join(table(spark, folder, "documents").where("length(text) > 0").select("source").distinct(), "source", "left_semi")
    per = chosen.groupBy("source").agg(F.sum(F.col("repeats") * F.col("n_tokens")).alias("tokens"), F.max("repeats").alias("most"), F.max("n_tokens").alias("longest"))
    total = per.agg(F.sum("tokens").alias("total"))
    share = targets.crossJoin(F.broadcast(targets.agg(F.sum("target_share").alias("whole")))).crossJoin(F.broadcast(total)).join(per, "source", "left")  # one row each
    off = F.abs(F.coalesce("tokens", F.lit(0)) - F.col("target_share") / F.col("whole") * F.col("total"))
    return share.select("source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("cap_kept"), (off <= 2 * F.coalesce("longest", F.lit(10_000))).alias("share_kept"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    from colophon.llm.stuffing import stuffed_pages

    return stuffed_pages(table(spark, folder, "documents")).select("doc_id")


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    from colophon.llm.stuffing import score_pages

    return score_pages(table(spark, folder, "documents")).select("doc_id", F.round("mean_pmi", 4).alias("mean_pmi"), F.round("stuffed", 4).alias("stuffed"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_texts": p1_texts,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_restored": p3_restored,
    "p4_found": p4_found,
    "p4_entities": p4_entities,
    "p5_found": p5_found,
    "p5_relinked": p5_relinked,
    "p6_found": p6_found,
    "p6_classes": p6_classes,
    "p6_texts": p6_texts,
    "p7_found": p7_found,
    "p7_spans": p7_spans,
    "p7_cut": p7_cut,
    "p8_selection": p8_selection,
    "p8_shares": p8_shares,
    "p8_kept": p8_kept,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
}

# The look-alikes that cut think tags in the data are undone by hand here; the operator undoes all.
CONVERSATIONS = r"""with m0 as (select id, min({'c': conversation_id, 'role': role, 'content': content, 'ts': created_at}) r from message where conversation_id is not null and id is not null group by id),
m1 as (select id, r.c as cid, lower(trim(regexp_replace(r.role, '[\s\p{Z}\p{Cf}]+', ' ', 'g'))) as role, r.content as content, r.ts as ts from m0),
m2 as (select id, cid, content,
  case when role in ('user','human','usr','prompter') then 'user' when role in ('assistant','ai','bot','model','gpt') then 'assistant' when role in ('system','sys','developer') then 'system' end as role,
  case when regexp_matches(ts, '^\s*\d{9,14}\s*$') then to_timestamp(ts::double / case when length(trim(ts)) >= 12 then 1000 else 1 end)
       when regexp_matches(ts, '^\s*\d{4}-\d{2}-\d{2}[Tt ]+\d{1,2}:\d{2}') then try_cast(case when regexp_matches(ts, '([Zz]|[+-]\d{2}:?\d{2})\s*$') then ts else ts || '+00' end as timestamptz) end as ts,
  regexp_matches(regexp_replace(translate(regexp_replace(nfc_normalize(content), '[\p{Cf}\x{34F}]', '', 'g'), 'тһіnkіѕ', 'thinkis'), '(?s)<think>.*?(</think>|$)', '', 'g'), '[\p{L}\p{N}]') as visible from m1),
good as (select cid from m2 join (select distinct id as cid from conversation) using (cid) group by cid having bool_and(role is not null and ts is not null)),
o as (select *, case role when 'system' then 0 when 'user' then 1 else 2 end as k from m2 where cid in (select cid from good)),
l as (select *, lag(role) over w as prole, lag(content) over w as pcontent, row_number() over w as n from o window w as (partition by cid order by ts, k, id)),
kept as (select * from l where (n = 1 or prole <> role or pcontent is distinct from content) and role <> 'system'),
t as (select cid, id, role, coalesce(visible, false) as visible, row_number() over (partition by cid order by ts, k, id) as turn from kept),
ok as (select cid from t group by cid having count(*) % 2 = 0 and bool_and(visible and role = case when turn % 2 = 1 then 'user' else 'assistant' end))
select cid as conversation_id, turn::int as turn_no, id as message_id from t where cid in (select cid from ok)"""

# Brute force; cosines in double precision.
NEAREST = """with v as (select id, any_value(embedding)::double[] as e from loaded_chunk where id is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by id),
s as (select a.id as a, b.id as b, list_cosine_similarity(a.e, b.e) as s from v a join v b on a.id <> b.id),
r as (select a, b, row_number() over (partition by a order by s desc, b) as r from s)
select distinct least(a, b) as id_a, greatest(a, b) as id_b from r where r <= 5"""

# Mean PMI of neighbours in exact counts; 12 pairs on either side, 4.4 bits, half of the text.
STUFFED = r"""with rep as (select row_number() over () as id, text from (select min(text) as text from documents group by case when trim(regexp_replace(lower(text), '[^\p{L}#]+', ' ', 'g')) <> '' then regexp_replace(lower(text), '[^\p{L}#]+', ' ', 'g') else text end)),
cut as (select false as own, doc_id as id, regexp_extract_all(lower(text), '(?:https?://|www\.)[^\s"''<>()\[\]]*|#[\p{L}\p{N}_-]+|[\p{L}\x{300}-\x{36F}]+') as l from documents
  union all select true, id, regexp_extract_all(lower(text), '(?:https?://|www\.)[^\s"''<>()\[\]]*|#[\p{L}\p{N}_-]+|[\p{L}\x{300}-\x{36F}]+') from rep),
tok as (select own, id, i, length(t) + 1 as w, case when regexp_matches(t, '^(https?://|www\.)') then '\url' when t[1] = '#' then '\tag' else t end as t from (select own, id, generate_subscripts(l, 1) as i, unnest(l) as t from cut)),
nx as (select *, lead(t) over (partition by own, id order by i) as u from tok),
wd as (select t, count(distinct id) as n from nx where own group by t),
pd as (select t, u, count(distinct id) as n from nx where own and u is not null group by t, u),
tot as (select (select count(*) from rep) as texts, (select sum(n) from wd) as words, (select sum(n) from pd) as pairs),
reach as (select t, max(m) as m from (select p.t, w.n as m from pd p join wd w on w.t = p.u union all select p.u, w.n from pd p join wd w on w.t = p.t) group by t),
wr as (select t, n, greatest(n, coalesce(m, 0)) as reach from wd left join reach using (t)),
x as (select nx.id, i, w, nx.t, u, wr.n, wr.reach, sum(w) over (partition by nx.id) as size, sum(w) over (partition by nx.id, nx.t) as c from nx join wr using (t) where not own),
y as (select *, texts / max(reach) over (partition by id) as scale, words, pairs from x, tot),
z as (select *, log2(greatest(greatest(n - 1, 1) / words * scale, (c - w) / greatest(size - w, 1))) as rate from y),
q as (select z.*, lead(rate) over o as rate2, lead(w) over o as w2, pd.n as m from z left join pd on pd.t = z.t and pd.u = z.u window o as (partition by id order by i)),
v as (select *, case when u is not null then (log2((greatest(m - 1, 0) + 0.5) / pairs * scale) - rate - rate2) * (w + w2) else 0 end as e, case when u is not null then w + w2 else 0 end as ew from q),
s as (select id, w, sum(e) over k as e, sum(ew) over k as ew from v window k as (partition by id order by i rows between 12 preceding and 11 following))
select id as doc_id from s group by id having sum(case when e < -4.4 * ew then w else 0 end) / sum(w) > 0.5"""

def _form(text: str) -> str:
    """SQL for the consistent form, by letter tables: the operator works on the whole Unicode database."""
    from colophon.llm.unify import ARMENIAN, CHEROKEE, CYRILLIC, GREEK, OTHER

    alike = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | OTHER | {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
    alike |= {"ό": "ó", "ά": "á", "ί": "í", "ύ": "ú", "ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï"}  # composed ones
    out = f"regexp_replace({text}, '[\\p{{Cf}}\\x{{34F}}\\x{{FE00}}-\\x{{FE0F}}\\x{{115F}}\\x{{1160}}\\x{{3164}}\\x{{FFA0}}]', '', 'g')"
    for joined, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("\r\n", "\n"), ("\r", "\n"), ("\u2028", "\n"), ("\u2029", "\n"), ("\x85", "\n")):
        out = f"replace({out}, '{joined}', '{letters}')"
    out = f"regexp_replace({out}, '[\\p{{Zs}}\\t\\v\\f]', ' ', 'g')"
    return f"nfc_normalize(translate(nfc_normalize({out}), '{''.join(alike)}', '{''.join(alike.values()).replace(chr(39), chr(39) * 2)}'))"


ALIKE = f"""with t as (select distinct 'chunk_result' as table_name, chunk_id as id, text as s, {_form('text')} as form from chunk_result where text is not null and chunk_id is not null
  union select distinct 'message', id, content, {_form('content')} from message where content is not null and id is not null),
m as (select * from t where regexp_matches(form, '\\S'))
"""

SCORES = (
    STUFFED[: STUFFED.index("select id as doc_id from s")]
    + """, f as (select id, sum(case when e < -4.4 * ew then w else 0 end) / sum(w) as stuffed from s group by id),
m as (select id, avg(log2((greatest(m - 1, 0) + 0.5) / pairs * scale) - rate - rate2) as mean_pmi from q where u is not null group by id)
select doc_id, round(mean_pmi, 4) as mean_pmi, round(coalesce(stuffed, 0.0), 4) as stuffed from documents left join f on f.id = doc_id left join m on m.id = doc_id"""
)

SQL: dict[str, str] = {
    "p9_scores": SCORES,
    "p6_texts": ALIKE[: ALIKE.index(",\nm as")].replace("distinct ", "").replace("union ", "union all ").replace(" and chunk_id is not null", "").replace(" and id is not null", "").replace(" where text is not null", "").replace(" where content is not null", "") + " select table_name, id, form as canonical from t",
    "p6_found": ALIKE + "select distinct a.table_name, a.id as id_a, b.id as id_b from m a join m b on a.table_name = b.table_name and a.form = b.form and a.id < b.id and a.s <> b.s",
    "p6_classes": ALIKE + ", c as (select table_name, form, min(id) as class_id, count(distinct s) as texts from m group by table_name, form having count(distinct s) > 1) select distinct table_name, id, class_id, texts from m join c using (table_name, form)",
    "p8_kept": "select source, true as cap_kept, true as share_kept from mix_target where source in (select source from documents where length(text) > 0)",
    "p2_found": NEAREST,
    "p9_found": STUFFED,
    "p5_found": CONVERSATIONS,
    "p5_relinked": CONVERSATIONS,
    "p3_restored": """select distinct chunk_id, md5(text) as whole, true as fits, case when coalesce(page_start, 0) = 0 then 0 else least(page_start, if(coalesce(page_end, 0) = 0, page_start, page_end)) end as first_page,
  case when coalesce(page_start, 0) = 0 then 0 else greatest(page_start, if(coalesce(page_end, 0) = 0, page_start, page_end)) end as last_page, length(text) > 2400 as split from chunk_result where text is not null""",
    "p3_found": "select distinct chunk_id from chunk_result where length(text) > 2400",
}
