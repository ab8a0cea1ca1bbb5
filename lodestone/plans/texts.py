"""Queries on texts: chunks, sections, processing results, and the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import chunking, processors, text
from lodestone.plans.model_sql import with_tables
from lodestone.plans.registry import query

_STRIP = "regexp_replace({}, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')"
_WORDS = "cast(len(list_filter(regexp_split_to_array({}, '[\\s\\x0b]+'), lambda x: x <> '')) as bigint)"


def _chunk_sql(parts: str, select: str) -> str:
    """``select`` over pieces (doc_id, s, step, piece, i) of parts (doc_id, s, body); i counts a document's pieces from 0."""
    return f"""with recursive {parts},
paras as (select doc_id, s, {_STRIP.format('x')} as p, k from (select doc_id, s, unnest(string_split(body, chr(10) || chr(10))) as x, generate_subscripts(string_split(body, chr(10) || chr(10)), 1) as k from parts)
  where {_STRIP.format('x')} <> ''),
ordered as materialized (select doc_id, s, p, row_number() over (partition by doc_id, s order by k) as k from paras),
fold as (
  select distinct doc_id, s, cast(1 as bigint) as next, '' as cur, null::varchar as piece, 0 as step from ordered
  union all
  select doc_id, s, case when act in ('flush', 'join') then next + 1 else next end,
    case act when 'cut' then {_STRIP.format('substring(cur, greatest(0, cut - 200) + 1)')}
      when 'flush' then case when length(cur) > 200 then right(cur, 200) || chr(10) || chr(10) || p else p end
      when 'join' then case when cur = '' then p else {_STRIP.format("cur || chr(10) || chr(10) || p")} end else '' end,
    case act when 'cut' then {_STRIP.format('left(cur, cut)')} when 'join' then null else {_STRIP.format('cur')} end, step + 1
  from (select *, case when dot > 0 and 1000 - dot >= 800 then 1000 - dot when blank > 0 and 1001 - blank >= 800 then 1001 - blank else 800 end as cut,
      case when length(cur) > 1500 then 'cut' when p is not null and cur <> '' and length(cur) + length(p) + 2 > 1000 then 'flush' when p is not null then 'join' else 'end' end as act
    from (select f.doc_id, f.s, f.next, f.cur, f.step, o.p, strpos(reverse(left(f.cur, 1000)), ' .') as dot, strpos(reverse(left(f.cur, 1000)), ' ') as blank
      from fold f left join ordered o on o.doc_id = f.doc_id and o.s = f.s and o.k = f.next) where cur <> '' or p is not null)),
pieces as (select *, cast(row_number() over (partition by doc_id order by s, step) - 1 as integer) as i from fold where piece <> '')
{select}"""


_SELECT = f"select doc_id, i as chunk_index, piece as content, {_WORDS.format('piece')} as token_count from pieces"
_WHOLE = "parts as (select doc_id, 0 as s, text as body from documents)"


@query("chunk_documents", _chunk_sql(_WHOLE, _SELECT))
def _(m):
    return chunking.chunks(m.read("documents")).select("doc_id", "chunk_index", "content", "token_count")


_LINED = "parts as (select doc_id, 0 as s, replace(text, chr(10), chr(10) || chr(10)) as body from documents)"


@query("chunk_documents_paragraphs", _chunk_sql(_LINED, _SELECT))
def _(m):
    return chunking.chunks(m.read("documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))).select("doc_id", "chunk_index", "content", "token_count")


_SECTIONS = """lines as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as k from (select doc_id, string_split(regexp_replace(text, '\\n([A-M])', chr(10) || '# \\1', 'g'), chr(10)) as l from documents)),
marked as (select *, sum(case when ltrim(line, ' ' || chr(9) || chr(13)) like '#%' then 1 else 0 end) over (partition by doc_id order by k) as s from lines),
parts as (select doc_id, s, string_agg(line, chr(10) order by k) as body, trim(ltrim(ltrim(case when s > 0 then arg_min(line, k) else '' end, ' ' || chr(9) || chr(13)), '#'), ' ' || chr(9) || chr(13)) as heading from marked group by doc_id, s)"""


def _marked(m):
    return m.read("documents").withColumn("text", F.regexp_replace("text", r"\n([A-M])", "\n# $1"))


@query("sections", _chunk_sql(_SECTIONS, f"select pieces.doc_id, i as chunk_index, piece as content, {_WORDS.format('piece')} as token_count, heading from pieces join parts using (doc_id, s)"))
def _(m):
    return chunking.chunks(_marked(m), by_section=True)


@query("chunk_page", _chunk_sql(_WHOLE, "select i as chunk_index, piece as content from pieces where doc_id = 0 order by i limit 5 offset 1"))
def _(m):
    return chunking.chunks(m.read("documents").where("doc_id = 0")).orderBy("chunk_index").offset(1).limit(5).select("chunk_index", "content")


@query("processing_results", _chunk_sql("parts as (select doc_id, 0 as s, text as body from documents where doc_id % 10 <> 3 and length(text) <= 20000)", """select doc_id, coalesce(n, 0) as n_chunks, case when doc_id % 10 = 3 or length(text) > 20000 then 0 else length(text) end as total_characters,
  case when doc_id % 10 = 3 then 'no text' when length(text) > 20000 then 'more than 20000 characters' end as error from documents left join (select doc_id, count(*) as n from pieces group by 1) using (doc_id)"""))
def _(m):
    d = m.read("documents").withColumn("text", F.when(F.col("doc_id") % 10 != 3, F.col("text")))
    return chunking.results(d, most=20_000)


_TOTALS = """totals as (select doc_id, cast(sum(length(body)) as bigint) as n from parts where trim(body, ' ' || chr(9) || chr(10) || chr(13)) <> '' group by 1)"""


@query("section_results", _chunk_sql(_SECTIONS, "select doc_id, coalesce(c.n, 0) as n_chunks, coalesce(t.n, 0) as total_characters, null as error from documents left join (select doc_id, count(*) as n from pieces group by 1) c using (doc_id) left join totals t using (doc_id)").replace("\npieces as (", f"\n{_TOTALS},\npieces as ("))
def _(m):
    return chunking.results(_marked(m), by_section=True)


@query("document_fetch", with_tables("docs", "pieces", sql=""", x as (select document_id, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by chunk_index) as c, count(*) as n from pieces where chunk_index between 1 and 5 group by 1)
select id, case when length(text) > 3000 then 'chunks' else 'full' end as mode, case when length(text) > 3000 then coalesce(c, '') else text end as content, cast(case when length(text) > 3000 then coalesce(n, 0) else 1 end as integer) as returned
from docs left join x on id = document_id"""))
def _(m):
    return chunking.fetched(m.documents().select("id", "text"), m.chunks(), offset=1, most=3000)


@query("document_chunk_counts", with_tables("docs", "pieces", sql=" select user_id, count(*) as chunks from pieces join docs on docs.id = document_id group by user_id"))
def _(m):
    d = m.documents().select(F.col("id").alias("document_id"), "user_id")
    return m.chunks().join(d, "document_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("chunks"))


@query("scalar_formats", with_tables("docs", sql=""" select id, case when n_chars * 997 >= 1000000 then printf('%.1f', floor(n_chars * 997 / 100000 + 0.5) / 10) || 'M' when n_chars * 997 >= 1000 then printf('%.1f', floor(n_chars * 997 / 100 + 0.5) / 10) || 'K' else cast(n_chars * 997 as varchar) end as tokens,
case when source = 'google_drive' then 'https://drive.google.com/file/d/' || json_extract_string(metadata, '$.drive_file_id') || '/view' end as url,
uploaded_at + interval 7 day as expires, left(text, 500) as error, left(text, 80) as title, case doc_id % 3 when 0 then 'old' when 1 then null else 'new' end as key,
case when doc_id % 20 / 10 < 0.4 then 1 when doc_id % 20 / 10 < 1.2 then 2 else 3 end as tier, '[Attached: ' || filename || ']' || chr(10) || '<file_content>' || chr(10) || text || chr(10) || '</file_content>' as attached from docs"""))
def _(m):
    c, i = F.col, F.col("doc_id")
    new = F.when(i % 3 == 0, "").when(i % 3 == 2, "new")
    return m.documents().select(
        "id", text.token_format(c("n_chars") * 997).alias("tokens"), text.drive_url(c("source"), c("metadata")).alias("url"), text.expiry(c("uploaded_at")).alias("expires"),
        text.shortened_to(c("text"), 500).alias("error"), text.shortened_to(c("text"), 80).alias("title"), text.kept_key(new, F.lit("old")).alias("key"),
        text.zoom_tier(i % 20 / 10).alias("tier"), text.attached(c("filename"), c("text")).alias("attached"),
    )


@query("labels_and_sizes", with_tables("ents", "files", sql=""" select distinct entity_type as name, regexp_replace(entity_type, '[^\\p{L}\\p{N}_]', '', 'g') as label, trim(regexp_replace(entity_type || '/ x', '[^\\p{L}\\p{N} _-]', '', 'g')) as title, '' as parent, '' as leaf, '' as size from ents
union all select distinct folder_path, null, null, case when contains(folder_path, '/') then string_split(folder_path, '/')[1] else '' end, string_split(folder_path, '/')[-1],
  case when max(size_bytes) < 1024 then printf('%.1f B', max(size_bytes)::double) when max(size_bytes) < 1048576 then printf('%.1f KB', max(size_bytes) / 1024) when max(size_bytes) < 1073741824 then printf('%.1f MB', max(size_bytes) / 1048576) else printf('%.1f GB', max(size_bytes) / 1073741824) end from files group by folder_path"""))
def _(m):
    e, f, none = F.col("entity_type"), F.col("folder_path"), F.lit(None).cast("string")
    labels = m.entities().select(e.alias("name"), text.safe_label(e).alias("label"), text.safe_title(F.concat(e, F.lit("/ x"))).alias("title"), *(F.lit("").alias(c) for c in ("parent", "leaf", "size"))).distinct()
    largest = m.files().groupBy("folder_path").agg(F.max("size_bytes").alias("b"))
    return labels.union(largest.select(f, none, none, text.path_parent(f), text.path_leaf(f), text.human_size(F.col("b"))))


@query("process_documents", _chunk_sql("parts as (select doc_id, 0 as s, text as body from documents where doc_id % 3 <> 2)", f"""select doc_id, i as chunk_index, '' as heading, piece as content, {_WORDS.format('piece')} as token_count, null as error from pieces
union all select doc_id, null, null, null, null, case when doc_id % 2 = 0 then 'no processor for application/zip' else 'no content' end from documents where doc_id % 3 = 2"""))
def _(m):
    processors.register(m.spark)
    i = F.col("doc_id")
    kind = F.when(i % 3 == 0, "text/plain").when(i % 3 == 1, "TXT").when(i % 2 == 0, "application/zip").otherwise("txt")
    content = F.when((i % 3 != 2) | (i % 2 == 0), F.encode("text", "utf-8"))
    files = m.read("documents").select(i, kind.alias("kind"), content.alias("content"))
    return m.spark.sql("select doc_id, p.* from {files}, lateral process_document(kind, content, 1000, 200) p", files=files)
