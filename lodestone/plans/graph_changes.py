"""Queries that build, change, export and view graphs in full."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import clusters, fulltext, graph, kg
from lodestone.plans import catalog
from lodestone.plans.model_sql import with_tables
from lodestone.plans.registry import query, rounded
from lodestone.sources import jsonl
from lodestone.sources.scratch import saved, shared_folder
from lodestone.sources.tables import Model

# ---------------------------------------------------------------- results in full

_RELATIONS = """, k as (select * from bm join ents using (id) order by round(bm.score, 9) desc, id limit 10),
n as (select source as id, relationship_type as r, target as o from rels where source in (select id from k) union select target, relationship_type, source from rels where target in (select id from k)),
l as (select n.id, list(distinct r || ' -> ' || e.name || ' (' || e.entity_type || ')') as x from n join ents e on e.id = o group by n.id)"""


def _lines(column: str = "relations") -> F.Column:
    line = F.transform(column, lambda r: F.concat(r.relation, F.lit(" -> "), r.target, F.lit(" ("), r.target_type, F.lit(")")))
    return F.array_join(F.sort_array(line), "\n")


@query("fulltext_relations", with_tables("ents", "rels", sql=catalog._BM25 + _RELATIONS + " select id, name, round(least(score / 5, 1.0), 6) as relevance, coalesce(array_to_string(list_sort(x), chr(10)), '') as relations from k left join l using (id)"))
def _(m):
    found = fulltext.search_with_relations(m.entities(), m.relationships(), catalog.WORDS)
    return rounded(found.select("id", "name", "relevance", _lines().alias("relations")), "relevance")


def _around(m: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    return graph.neighbourhood(m.entities(), m.relationships(), "customer:1", 2, 50)


_NEAR = catalog._reach_sql(2, True, 50).rsplit(" select distinct id from (", 1)
_AROUND = _NEAR[0].replace("with recursive ", "with recursive " + with_tables("ents", sql="").removeprefix("with recursive ") + ", ", 1) + f", near as (select distinct id from ({_NEAR[1]})" + """,
nodes as (select id, name, entity_type, description from ents where id in (select id from near) or id = 'customer:1'),
edges as (select * from rels where source in (select id from nodes) and target in (select id from nodes) and exists (select * from near))"""


@query("neighborhood_nodes", _AROUND + " select * from nodes")
def _(m):
    return _around(m)[0].select("id", "name", "entity_type", "description")


@query("neighborhood_edges", _AROUND + " select * from edges")
def _(m):
    return _around(m)[1]


@query("neighborhood_totals", _AROUND + " select (select count(*) from nodes) as total_nodes, (select count(*) from edges) as total_edges")
def _(m):
    return _around(m)[2]


@query("visualization_totals", with_tables("ents", "rels", sql=" select (select count(*) from ents) as total_nodes, (select count(*) from rels) as total_edges"))
def _(m):
    return graph.visualization(m.entities(), m.relationships(), ["Region", "Nation", "Supplier"])[2]


@query("graph_export_edges", with_tables("ents", "rels", sql=" select r.*, s.name as source_name, s.entity_type as source_type, t.name as target_name, t.entity_type as target_type from rels r join ents s on s.id = source join ents t on t.id = target"))
def _(m):
    return graph.exported_edges(m.relationships(by="target"), m.entities())


@query("tier_view_nodes", with_tables("tree", "ents", sql=catalog._PLACED[1] + """, c as (select cluster_id, entity_type, count(*) as n, min(node_id) as first from placed join ents on id = node_id group by 1, 2),
d as (select cluster_id, entity_type from c qualify row_number() over (partition by cluster_id order by n desc, first) = 1)
select t.id, label || ' (' || count(*) || ')' as label, any_value(d.entity_type) as entity_type, count(*) as size from placed p join tree t on t.id = p.cluster_id left join d on d.cluster_id = t.id group by t.id, label
union all select id, name, entity_type, 1 from ents where id not in (select node_id from placed) and id not in (select id from tree)"""))
def _(m):
    tree, members = m.clusters()
    return clusters.tier_view(tree, members, m.entities(), m.relationships(), 1)[0]


@query("cluster_deep_tiers", """with recursive p as (select p_partkey as k from part where p_partkey > 0), up as (select k, k as top from p where k < 6 union all select p.k, up.top from up join p on p.k // 3 = up.k where p.k > 5),
t as (select distinct k, top from up)
select tier, case when tier = 1 then 'c1' else 'c' || top end as cluster_id, count(*) as nodes from t, (select unnest([1, 2]) as tier) group by 1, 2""")
def _(m):
    # every part below the one of a third of its number, the first five below the first
    k = F.col("p_partkey")
    p = m.read("part").where("p_partkey > 0")
    parent = F.when(k > 3, F.concat(F.lit("c"), F.floor(k / 3))).when(k > 1, F.lit("c1"))
    tree = p.select(F.concat(F.lit("c"), k).alias("id"), F.concat(F.lit("c"), k).alias("label"), parent.alias("parent_id"))
    members = p.select(F.concat(F.lit("part:"), k).alias("node_id"), F.concat(F.lit("c"), k).alias("cluster_id"))
    tiers = [clusters.node_clusters(tree, members, t).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("nodes")).select(F.lit(t).alias("tier"), "cluster_id", "nodes") for t in (1, 2)]
    return tiers[0].union(tiers[1])


# ---------------------------------------------------------------- creating, merging, importing

_FIRST = """, g as (select lower(name) as n, lower(entity_type) as t, min(struct_pack(c := chunk, p := position, n := name, t := entity_type, d := description)) as f, count(*) as mentions from cands
  where trim(coalesce(name, '')) <> '' and trim(coalesce(entity_type, '')) <> '' group by 1, 2),
made as (select 'entity:' || md5(n || '|' || t) as id, f.n as name, f.t as entity_type, regexp_replace(f.t, '[^\\p{L}\\p{N}_]', '', 'g') as label, f.d as description,
  case when mentions > 1 then '{"mentions":' || mentions || '}' end as properties_json, 'doc:1' as source_document_id, f.c * 1000 + f.p as ordinal from g)"""
_RAW = """, raw as (select a.p_name as source, upper(b.p_name) as target, case when a.p_partkey % 2 = 0 then b.p_brand end as description from part a join part b on b.p_partkey = a.p_partkey + 1),
by_name as (select lower(name) as n, arg_max(id, ordinal) as id from made group by 1)"""


def _raw(m: Model) -> DataFrame:
    p = m.read("part").select("p_partkey", "p_name")
    following = m.read("part").select((F.col("p_partkey") - 1).alias("p_partkey"), F.upper("p_name").alias("target"), "p_brand")
    note = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("description")
    return p.join(following, "p_partkey").select(F.col("p_name").alias("source"), "target", F.lit("NEXT").alias("type"), note)


@query("kg_create_entities", with_tables("cands", sql=_FIRST + " select id, name, entity_type, label, description, properties_json, source_document_id from made"))
def _(m):
    return kg.built(m.candidates(), _raw(m), "doc:1")[0]


@query("kg_create_relationships", with_tables("cands", sql=_FIRST + _RAW + """ select a.id as source_id, b.id as target_id, 'NEXT' as relationship_type, 1.0::double as weight,
  case when coalesce(description, '') <> '' then '{"description":"' || description || '"}' end as properties_json, 'doc:1' as source_document_id
from raw join by_name a on lower(source) = a.n join by_name b on lower(target) = b.n where a.id <> b.id"""))
def _(m):
    return kg.built(m.candidates(), _raw(m), "doc:1")[1]


@query("kg_merge_edges", with_tables("rels", sql=""", u as (select id, source, target, relationship_type, weight / 4 as weight from rels where relationship_type = 'ORDERED' and weight > 0.1
  union all select id || ':more', source, target, 'RATED', 0.75 from rels where relationship_type = 'LOCATED_IN')
select * from rels anti join u using (source, target, relationship_type, id) union all select * from u"""))
def _(m):
    r = saved(m.relationships(), "relationships")
    changed = r.where("relationship_type = 'ORDERED' and weight > 0.1")
    twice = changed.withColumns({"weight": F.col("weight") / 2, "seq": F.lit(1)}).union(changed.withColumns({"weight": F.col("weight") / 4, "seq": F.lit(2)}))
    added = r.where("relationship_type = 'LOCATED_IN'").withColumns({"id": F.concat("id", F.lit(":more")), "relationship_type": F.lit("RATED"), "weight": F.lit(0.75), "seq": F.lit(1)})
    return kg.merged_edges(r, twice.union(added))


@query("graph_import_edges", with_tables("ents", "rels", sql=""" select * from rels union all
select id || ':new', source, target, 'OFFERS', weight from rels where relationship_type = 'SUPPLIED_BY'"""))
def _(m):
    r = m.relationships()
    some = r.where("relationship_type = 'SUPPLIED_BY'")
    new = some.withColumns({"id": F.concat("id", F.lit(":new")), "relationship_type": F.lit("OFFERS")})
    lost = some.withColumns({"id": F.concat("id", F.lit(":lost")), "target": F.lit("supplier:none")})
    known = some.withColumn("weight", F.lit(9.0))
    return kg.imported_edges(r, new.union(new).union(lost).union(known), m.entities())


@query("graph_import_entities", with_tables("ents", sql=""" select * from ents union all select 'nation:new' || r_regionkey, min(n_name), 'Nation', null, null from nation join region on r_regionkey = n_regionkey group by r_regionkey"""))
def _(m):
    none = F.lit(None).cast("string")
    seeds = m.read("nation").select(F.concat(F.lit("nation:new"), "n_regionkey").alias("id"), F.col("n_name").alias("name"), F.lit("Nation").alias("entity_type"), none.alias("description"), none.alias("source_document_id"))
    e = m.entities()
    return kg.inserted(e, seeds.union(e.where("entity_type = 'Nation'").withColumn("name", F.lit("late"))), ["id"], ["name"])


@query("graph_wipe", with_tables("ents", "rels", sql=" select 'entity' as kind, count(*) as held, cast(0 as bigint) as n from ents union all select 'relationship', count(*), cast(0 as bigint) from rels"))
def _(m):
    tables = {"entity": m.entities(), "relationship": m.relationships()}
    left = dict(zip(tables, kg.wiped(*tables.values()), strict=True))
    count = lambda df, kind, name: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias(name))
    both = [count(tables[k], k, "held").join(count(left[k], k, "n"), "kind") for k in tables]
    return both[0].union(both[1])


@query("graph_export_entities", with_tables("ents", sql=" select id, name, entity_type, description, row_number() over (order by entity_type, name, id) - 1 as place from ents"))
def _(m):
    return graph.exported_entities(m.entities())


@query("export_shards", with_tables("ents", sql=" select entity_type as kind, count(*) as rows, 0 as too_large, 0 as gaps from ents group by 1"))
def _(m):
    path, bound = shared_folder(m.spark, "shards"), 4096
    files = jsonl.write_shards(m.entities(), path, "entity_type", ["id"], file_bytes=bound)
    back = m.spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), (F.octet_length("value") + 1).alias("size"))
    read = back.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.sum("size").alias("size"))
    found = files.withColumn("file", F.url_encode("file")).join(read.withColumn("file", F.url_encode(F.url_decode("file"))), "file")
    over = F.count_if((F.col("size") > bound) & (F.col("lines") > 1)).cast("int")
    return found.groupBy("kind").agg(F.sum("lines").alias("rows"), over.alias("too_large"), (F.max("shard") - F.count(F.lit(1))).cast("int").alias("gaps"))
