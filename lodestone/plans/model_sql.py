"""The tables of ``lodestone.sources.tables`` as common table expressions for DuckDB."""

from __future__ import annotations

from lodestone.sources.tables import PRICES, STAGES

_PRICES = ", ".join(f"('{m}', {a}, {b})" for m, (a, b) in PRICES.items())
_STAGES = "[" + ", ".join(f"'{s}'" for s in STAGES) + "]"
_NAME = "'doc_' || doc_id || case when doc_id % 2 = 1 then '.docx' else '.pdf' end"
_AT = "to_timestamp(1704067200 + doc_id * 60)::timestamp"

CTES = {
    "ents": """ents as (
  select 'region:' || r_regionkey as id, r_name as name, 'Region' as entity_type, null::varchar as description, null::varchar as source_document_id from region
  union all select 'nation:' || n_nationkey, n_name, 'Nation', null, null from nation
  union all select 'customer:' || c_custkey, c_name, 'Customer', c_mktsegment, null from customer
  union all select 'supplier:' || s_suppkey, s_name, 'Supplier', null, null from supplier
  union all select 'part:' || p_partkey, p_name, p_type, p_brand, 'doc:' || (p_partkey % (select count(*) from documents)) from part)""",
    "rels": """rels as (
  select 'IN_REGION:' || n_nationkey || ':nation' as id, 'nation:' || n_nationkey as source, 'region:' || n_regionkey as target, 'IN_REGION' as relationship_type, 1.0::double as weight from nation
  union all select 'LOCATED_IN:' || c_custkey || ':customer', 'customer:' || c_custkey, 'nation:' || c_nationkey, 'LOCATED_IN', 1.0 from customer
  union all select 'LOCATED_IN:' || s_suppkey || ':supplier', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN', 1.0 from supplier
  union all select distinct 'SUPPLIED_BY:' || l_partkey || ':' || l_suppkey, 'part:' || l_partkey, 'supplier:' || l_suppkey, 'SUPPLIED_BY', 1.0 from lineitem
  union all select 'ORDERED:' || o_custkey || ':' || l_partkey, 'customer:' || o_custkey, 'part:' || l_partkey, 'ORDERED', least(1.0, count(*) / 10) from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_partkey)""",
    "cands": """cands as (
  select l_orderkey as chunk, l_linenumber as position, p_name as name, p_type as entity_type, p_brand as description from lineitem join part on l_partkey = p_partkey)""",
    "docs": f"""docs as (
  select 'doc:' || doc_id as id, doc_id, {_NAME} as filename, cast(doc_id % 5 as integer) as user_id,
    case doc_id % 10 when 0 then 'processing' when 1 then 'failed' when 2 then 'expired' else 'ready' end as status,
    case when doc_id % 2 = 1 then 'google_drive' else 'upload' end as source, doc_id % 2 = 1 as is_base_knowledge,
    '{{"drive_file_id": "drive-' || doc_id || '"}}' as metadata, {_AT} as uploaded_at,
    case when doc_id % 2 = 0 then {_AT} + interval 7 day end as expires_at, n_chars, lang, source as origin, text from documents)""",
    "vecs": """vecs as (
  select vec_id as chunk_id, vec_id % (select count(*) from documents) as document_id, label, embedding from embeddings)""",
    "files": f"""files0 as (
  select 'file:' || doc_id as id, 'drive-' || doc_id as drive_file_id, 'job:' || source as job_id, doc_id, {_NAME} as file_name,
    concat_ws('/', source, lang) as folder_path, n_chars * 100 as size_bytes, ({_STAGES})[cast(doc_id % 13 as integer) + 1] as stage,
    cast(doc_id % 4 as integer) as retry_count, {_AT} as created_at from documents),
files1 as (select * from files0 union all
  select id || ':old', drive_file_id, job_id, doc_id, file_name, folder_path, size_bytes, 'failed', retry_count, created_at - interval 1 day from files0 where doc_id % 7 = 0),
files as (select *, case when stage in ('failed', 'embed_failed', 'kg_failed') then 'failed' when stage = 'skipped' then 'skipped' when stage = 'kg_done' then 'completed'
  when stage in ('pending', 'cancelled') then 'pending' else 'processing' end as status from files1)""",
    "jobs": """jobs0 as (
  select job_id, count(*) as total_files, count(*) filter (status = 'completed') as processed_files, count(*) filter (status = 'failed') as failed_files,
    count(*) filter (status = 'skipped') as skipped_files, row_number() over (order by job_id) - 1 as n from files group by job_id),
jobs as (select job_id, total_files, processed_files, failed_files, skipped_files, to_timestamp(1704067200 + 9 * 86400 - n * 3600)::timestamp as started_at,
  case n % 4 when 0 then 'pending' when 1 then 'processing' when 2 then 'completed' else 'failed' end as status,
  null::varchar as folder_id, null::varchar as error_message, null::timestamp as completed_at from jobs0)""",
    "calls": f"""prices(model, a, b) as (values {_PRICES}),
calls0 as (select event_id, user_id, ts, event_type as model, coalesce(cast(json_extract_string(props, '$.k') as bigint), 0) * 10 as input_tokens,
  cast(floor(coalesce(value, 0) * 10) as bigint) as output_tokens, case when event_id % 10 = 0 then coalesce(value, 0) / 100 else 0 end as given from events),
calls as (select c.* exclude (given), case when given = 0 then (input_tokens * coalesce(a, 0) + output_tokens * coalesce(b, 0)) / 1e6 else given end as cost from calls0 c left join prices using (model))""",
    "pieces": """pieces as (
  select 'chunk:' || doc_id || ':' || i as id, 'doc:' || doc_id as document_id, cast(i as integer) as chunk_index, substring(text, i * 1000 + 1, 1000) as content
  from (select doc_id, text, unnest(range(0, (length(text) - 1) // 1000 + 1)) as i from documents where text <> ''))""",
    "convs": """convs as (
  select c as conversation_id, cast(c % 5 as integer) as user_id, case when c % 2 = 0 then 'Chat ' || c end as title,
    to_timestamp(1704067200 + c * 60)::timestamp as created_at, to_timestamp(1704067200 + c * 60)::timestamp as updated_at
  from (select distinct conv_id as c from conversations union all select distinct conv_id + 1000000 from conversations where conv_id % 10 = 0))""",
    "msgs": """msgs as (
  select conv_id as conversation_id, turn, role, text as content, cast(conv_id % 5 as integer) as user_id,
    to_timestamp(1704067200 + conv_id * 3600 + turn)::timestamp as created_at, length(text) // 4 as token_count from conversations)""",
    "tree": """tree as (
  select 'region:' || r_regionkey as id, r_name as label, null::varchar as parent_id from region
  union all select 'nation:' || n_nationkey, n_name, 'region:' || n_regionkey from nation),
members as (select 'customer:' || c_custkey as node_id, 'nation:' || c_nationkey as cluster_id from customer
  union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey from supplier)""",
}


def with_tables(*names: str, sql: str) -> str:
    """``sql`` after the named common table expressions; it may go on with its own (starting with a comma)."""
    needs = list(names)
    if "jobs" in needs and "files" not in needs:
        needs.insert(needs.index("jobs"), "files")
    return "with recursive " + ",\n".join(CTES[n] for n in needs) + sql
