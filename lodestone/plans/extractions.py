"""Queries on what is extracted from texts and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import extraction, kg
from lodestone.plans.model_sql import with_tables
from lodestone.plans.registry import query
from lodestone.sources.scratch import saved
from lodestone.sources.tables import Model

_LISTS = {t: "[" + ", ".join(f"'{w}'" for w in words) + "]" for t, words in extraction.CONTEXTS.items()}
_KIND = " ".join(f"when list_contains({x}, lower(b)) then '{t}'" for t, x in _LISTS.items())
_FORMS = " || ".join(f"list_transform(regexp_extract_all(content, '{p}'), lambda x: struct_pack(name := x, entity_type := '{t}'))" for t, p in extraction.FORMS.items())
_FOUND = f""", found as materialized (select document_id, chunk_index as chunk, {_FORMS} ||
    list_transform(list_zip(regexp_extract_all(content, '{extraction.NAME}', 1), regexp_extract_all(content, '{extraction.NAME}', 2)),
      lambda z: struct_pack(name := z[2], entity_type := case {_KIND.replace('lower(b)', 'lower(z[1])')} else 'Name' end)) as ms from pieces),
mention as materialized (select document_id, chunk, unnest(ms) as m, generate_subscripts(ms, 1) - 1 as position from found where len(ms) > 0),
named as materialized (select document_id, chunk, position, m.name as name, m.entity_type as entity_type from mention)"""
_RELATED = """, related as materialized (select a.document_id, a.chunk, a.name as source, b.name as target, 'MENTIONED_WITH' as type from named a
  join named b on a.document_id = b.document_id and a.chunk = b.chunk and b.position > a.position and b.position <= a.position + 3 where lower(a.name) <> lower(b.name))"""
_MERGED = """, ents0 as materialized (select lower(name) as n, lower(entity_type) as t, min(struct_pack(d := document_id, c := chunk, p := position, n := name, t := entity_type)) as f, count(*) as mentions from named group by 1, 2)"""


def _found(m: Model) -> DataFrame:
    return extraction.extracted(m.chunks())


def _candidates(m: Model, found: DataFrame) -> DataFrame:
    """Candidates with the document ahead of the chunk in their order."""
    c = extraction.candidates(found)
    return c.withColumn("chunk", F.struct("document_id", "chunk"))


@query("extracted_mentions", with_tables("pieces", sql=_FOUND + " select document_id, chunk, cast(position as integer) as position, name, entity_type from named"))
def _(m):
    return extraction.candidates(_found(m)).drop("description")


@query("extracted_relations", with_tables("pieces", sql=_FOUND + _RELATED + " select document_id, chunk, source, target, type, count(*) as n from related group by all"))
def _(m):
    return extraction.co_mentions(_found(m)).groupBy("document_id", "chunk", "source", "target", "type").agg(F.count(F.lit(1)).alias("n"))


@query("extracted_entities", with_tables("pieces", sql=_FOUND + _MERGED + " select f.n as name, f.t as entity_type, f.d as document_id, f.c as chunk, cast(f.p as integer) as position, mentions from ents0"))
def _(m):
    e = kg.first_entities(_candidates(m, _found(m)))
    return e.select("name", "entity_type", F.col("chunk.document_id").alias("document_id"), F.col("chunk.chunk").alias("chunk"), "position", "mentions")


@query("extracted_graph", with_tables("pieces", sql=_FOUND + _RELATED + _MERGED + """, by_name as (select n, max(struct_pack(d := f.d, c := f.c, p := f.p, t := f.t, n := f.n)) as o from ents0 group by n),
ids as (select n, 'entity:' || lower(o.n) || ':' || lower(o.t) as id from by_name)
select a.id as source_id, b.id as target_id, type, count(*) as n from related join ids a on lower(source) = a.n join ids b on lower(target) = b.n where a.id <> b.id group by all"""))
def _(m):
    found = saved(_found(m), "extracted")
    e = kg.first_entities(_candidates(m, found))
    order = F.struct("chunk", "position", "entity_type", "name")
    entities = e.select(F.concat(F.lit("entity:"), F.lower("name"), F.lit(":"), F.lower("entity_type")).alias("id"), "name", order.alias("ordinal"))
    return kg.resolved_relationships(extraction.co_mentions(found), entities).groupBy("source_id", "target_id", "type").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- classification answers


def _answers(m: Model) -> tuple[DataFrame, DataFrame]:
    """(files, answers): a folder a source and language; its answer is an array, an object with an id, one without, or broken."""
    d, i = m.read("documents"), F.col("doc_id")
    folder = F.concat_ws("/", "source", "lang")
    files = d.select(folder.alias("folder"), F.concat(F.lit("f"), i).alias("file_id"))
    entry = F.concat(F.lit('{"file_id": "f'), i, F.lit('", "major": "'), "lang", F.lit('", "year": '), i % 5 + 2020, F.lit("}"))
    some = F.array_sort(F.collect_list(F.when(i % 3 != 0, F.struct(i.alias("i"), entry.alias("e")))))
    by = d.groupBy(folder.alias("folder"), "source", "lang").agg(some.alias("all"), F.min("doc_id").alias("first"))
    array = F.concat(F.lit("Sure:\n```json\n["), F.array_join("all.e", ", "), F.lit("]\n```"))
    kind = F.substring("source", 4, 9).cast("int") % 4
    one = F.concat(F.lit('{"file_id": "f'), "first", F.lit('", "category": "exam"}'))
    every = F.concat(F.lit('The answer is {"course": "'), "lang", F.lit('", "terms": [1, 2]} as asked'))
    answer = F.when(kind == 0, array).when(kind == 1, one).when(kind == 2, every).otherwise('[{"file_id": "f1", ')
    return files, by.select("folder", answer.alias("answer"))


@query("folder_classifications", """with f as (select concat_ws('/', source, lang) as folder, doc_id, lang, cast(substring(source, 4) as integer) % 4 as kind, min(doc_id) over (partition by source, lang) as first from documents)
select folder, 'f' || doc_id as file_id, case when kind = 0 and doc_id % 3 <> 0 then '{"major":"' || lang || '","year":' || (doc_id % 5 + 2020) || '}' when kind = 1 and doc_id = first then '{"category":"exam"}'
  when kind = 2 then '{"course":"' || lang || '","terms":[1,2]}' else '{}' end as classification from f""")
def _(m):
    return extraction.classifications(*_answers(m))
