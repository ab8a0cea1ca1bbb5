"""Sub-graphs, neighbourhoods and counts of an entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.running import numbered
from lodestone.sources.scratch import saved

#: So many relations of a node fit a row.
RELATIONS = 10_000


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(edges.columns)


def reachable(edges: DataFrame, start: str, depth: int, outward: bool) -> DataFrame:
    """(id) at the end of a directed path of 1 to ``depth`` edges from the start; the start only on a cycle.

    A breadth-first step is one semi-join of the edges with what the last step
    found. That is written, so that its size is known (a small one is broadcast)
    and no step plans the ones before it again.
    """
    a, b = ("source", "target") if outward else ("target", "source")
    edges = edges.select("source", "target")
    front = edges.where(F.col(a) == start).select(F.col(b).alias("id")).distinct()
    if depth == 1:
        return front
    front = seen = saved(front, "frontier")
    for hop in range(2, depth + 1):
        ahead = edges.join(front.withColumnRenamed("id", a), a, "left_semi").select(F.col(b).alias("id")).distinct()
        front = ahead.join(seen, "id", "left_anti")
        if hop < depth:
            front = saved(front, "frontier")
        seen = seen.union(front)
    return seen


def neighbours(edges: DataFrame, start: str, depth: int = 1, limit: int | None = 50, both: bool = True, written: bool = False) -> DataFrame:
    """(id) around a node: reached outward, and inward too, each way's first ``limit`` by id. Edges that are written (saved) aren't written again."""
    if not 1 <= depth <= 3:
        raise ValueError("depth must be from 1 to 3")
    if depth > 1 and not written:  # each hop and way reads them
        edges = saved(edges.select("source", "target"), "ends")
    ways = [reachable(edges, start, depth, outward) for outward in ((True, False) if both else (True,))]
    if limit:
        ways = [w.orderBy("id").limit(limit) for w in ways]
    out = ways[0].union(ways[1]) if both else ways[0]
    return out.distinct()


def neighbourhood(entities: DataFrame, edges: DataFrame, start: str, depth: int = 1, limit: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, totals) around a node: itself and its neighbours that are entities, the edges among them, and how many there are.

    A node without neighbours stands alone, without edges (a self-loop makes it its own neighbour).
    """
    edges = saved(edges, "edges")
    near = saved(neighbours(edges, start, depth, limit, written=True).select("id"), "near")  # 2 * limit rows at most
    ids = near.union(edges.sparkSession.range(1).select(F.lit(start).alias("id"))).distinct()
    nodes = entities.join(F.broadcast(ids), "id", "left_semi")
    some = near.limit(1).select(F.lit(True).alias("some"))  # a row, or none without neighbours
    among = induced_edges(edges, nodes.select("id")).crossJoin(F.broadcast(some)).select(edges.columns)
    return nodes, among, counted(nodes, among)


def counted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: total_nodes, total_edges."""
    one = edges.agg(F.count(F.lit(1)).alias("total_edges"))
    return nodes.agg(F.count(F.lit(1)).alias("total_nodes")).crossJoin(F.broadcast(one))  # one row


def relation_rows(found: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, r: relation, target, target_type), a row for each distinct relation at found (id, ...), either way; a hub has many."""
    ids = found.select("id").distinct()
    out = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("source").alias("id"), "relationship_type", F.col("target").alias("other"))
    back = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("target").alias("id"), "relationship_type", F.col("source").alias("other"))
    ends = entities.select(F.col("id").alias("other"), F.col("name").alias("target"), F.col("entity_type").alias("target_type"))
    each = out.union(back).join(ends, "other").select("id", F.struct(F.col("relationship_type").alias("relation"), "target", "target_type").alias("r"))
    return each.distinct()


def relations(found: DataFrame, edges: DataFrame, entities: DataFrame, most: int = RELATIONS) -> DataFrame:
    """found (id, ...) with ``relations``: the first ``most`` of each row's relations (see ``relation_rows``), in order; empty without any."""
    first = Window.partitionBy("id").orderBy("r")
    each = relation_rows(found, edges, entities).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    lists = each.groupBy("id").agg(F.sort_array(F.collect_list("r")).alias("relations"))
    none = F.array().cast("array<struct<relation:string,target:string,target_type:string>>")
    return found.join(lists, "id", "left").withColumn("relations", F.coalesce("relations", none))


def exported_entities(entities: DataFrame) -> DataFrame:
    """Entities as an export holds them, by type and name, with their place in that order (from 0)."""
    return numbered(entities.select("id", "name", "entity_type", "description"), ["entity_type", "name", "id"], "place")


def exported_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the names and types of both ends, those without one left out; in order of type and source name."""
    end = lambda e: entities.select(F.col("id").alias(e), F.col("name").alias(f"{e}_name"), F.col("entity_type").alias(f"{e}_type"))
    named = edges.join(end("target"), "target").join(end("source"), "source")
    return named.select(*edges.columns, "source_name", "source_type", "target_name", "target_type").orderBy("relationship_type", "source_name", "id")


def incident(edges: DataFrame, node: str) -> DataFrame:
    """A node's edges with their direction: id, other, relationship_type, direction. A self-loop stands once, as out."""
    out = edges.where(F.col("source") == node).select("id", F.col("target").alias("other"), "relationship_type", F.lit("out").alias("direction"))
    back = edges.where((F.col("target") == node) & (F.col("source") != node)).select("id", F.col("source").alias("other"), "relationship_type", F.lit("in").alias("direction"))
    return out.union(back)


def with_names(rows: DataFrame, entities: DataFrame, key: str = "other") -> DataFrame:
    """rows with the name of the entity in column ``key``; an empty one where there is none."""
    names = entities.select(F.col("id").alias(key), F.col("name").alias(f"{key}_name"))
    return rows.join(names, key, "left").withColumn(f"{key}_name", F.coalesce(f"{key}_name", F.lit("")))


def stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by type, and totals: kind, type (null: total), n."""
    rows = entities.select(F.lit("entity").alias("kind"), F.col("entity_type").alias("type")).union(edges.select(F.lit("relationship"), F.col("relationship_type")))
    by_type = rows.groupBy("kind", "type").agg(F.count(F.lit(1)).alias("n"))
    return by_type.union(by_type.groupBy("kind").agg(F.sum("n").alias("n")).select("kind", F.lit(None).cast("string").alias("type"), "n"))


def visualization(entities: DataFrame, edges: DataFrame, types: list[str] | None = None, limit: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, totals): the first ``limit`` entities by id, of the given types only, the edges among them, and the counts of the whole graph."""
    if not 1 <= limit <= 5000:
        raise ValueError("limit must be from 1 to 5000")
    nodes = entities.where(F.col("entity_type").isin(types)) if types else entities
    nodes = nodes.orderBy("id").limit(limit)
    return nodes, induced_edges(edges, nodes), counted(entities, edges)


def contexts(found: DataFrame, edges: DataFrame, entities: DataFrame, most: int = 5) -> DataFrame:
    """(id, context) of found entities (id, name, entity_type, description): their description and first relations, as text."""
    ids = found.select("id")
    out = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("source").alias("id"), "relationship_type", F.col("target").alias("other"))
    back = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").where("source <> target").select(F.col("target").alias("id"), "relationship_type", F.col("source").alias("other"))
    near = with_names(out.union(back), entities)
    line = F.concat(F.lit("  - "), "relationship_type", F.lit(" -> "), "other_name").alias("line")
    first = Window.partitionBy("id").orderBy("line")  # each task keeps the first of a hub's
    some = near.select("id", line).distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    some = some.groupBy("id").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    head = F.concat(F.lit("Entity: "), "name", F.lit(" ("), "entity_type", F.lit(")"))
    parts = F.concat(F.array(head), F.when(F.col("description").isNotNull(), F.array("description")).otherwise(F.array().cast("array<string>")), F.coalesce("lines", F.array().cast("array<string>")))
    return found.join(some, "id", "left").select("id", F.array_join(parts, "\n").alias("context"))
