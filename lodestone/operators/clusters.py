"""Clusters of a graph, seen at three tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import saved


#: Up to so many nodes (two ids each) are broadcast to the edges.
BROADCAST = 200_000


def ancestry(tree: DataFrame) -> DataFrame:
    """(id, root, second, depth) of clusters; those whose chain doesn't end at a root, a missing parent or a cycle, are left out.

    second: the cluster below the root on the way, null for roots. A level is a
    join with the one before, which is written; cycles never meet a root, so the
    levels end where the tree does, however deep it is.
    """
    none = F.lit(None).cast(tree.schema["id"].dataType)
    front = tree.where("parent_id is null").select("id", F.col("id").alias("root"), none.alias("second"), F.lit(0).alias("depth"))
    front = seen = saved(front, "level")
    depth = 0
    while not front.isEmpty():
        depth += 1
        above = front.select(F.col("id").alias("parent_id"), "root", "second")
        below = tree.select("id", "parent_id").join(above, "parent_id")
        front = saved(below.select("id", "root", F.coalesce("second", "id").alias("second"), F.lit(depth).alias("depth")), "level")
        seen = seen.union(front)
    return seen


def node_clusters(tree: DataFrame, members: DataFrame, tier: int) -> DataFrame:
    """(node_id, cluster_id): tier 1 names roots, 2 the cluster below a root (a root for its own nodes), 3 each node's own."""
    if tier not in (1, 2, 3):
        raise ValueError("tier must be 1, 2 or 3")
    if tier == 3:
        return members.select("node_id", "cluster_id")
    to = F.col("root") if tier == 1 else F.coalesce("second", "root")
    up = ancestry(tree).select(F.col("id").alias("cluster_id"), to.alias("to"))
    return members.join(up, "cluster_id").select("node_id", F.col("to").alias("cluster_id"))


def cluster_nodes(tree: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, label, size): clusters with nodes, labelled with their number."""
    n = placed.groupBy(F.col("cluster_id").alias("id")).agg(F.count(F.lit(1)).alias("size"))
    return tree.join(n, "id").select("id", F.concat("label", F.lit(" ("), "size", F.lit(")")).alias("label"), "size")


def dominant_type(placed: DataFrame, types: DataFrame) -> DataFrame:
    """(cluster_id, entity_type, n): each cluster's most frequent type of node; at a tie the one whose first node, by id, comes first."""
    kinds = placed.join(types.select(F.col("id").alias("node_id"), "entity_type"), "node_id")
    counts = kinds.groupBy("cluster_id", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first"))
    top = counts.groupBy("cluster_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "entity_type")).alias("x"))
    return top.select("cluster_id", F.col("x.entity_type").alias("entity_type"), (-F.col("x.m")).alias("n"))


def cluster_edges(edges: DataFrame, placed: DataFrame, tasks: int = 0) -> DataFrame:
    """(source, target, relationship_type, weight): edges between clusters, weights summed; nodes in no cluster stay themselves.

    tasks: the edges come partitioned by source in so many. More nodes than
    ``BROADCAST`` are joined in as many tasks, and never sent whole to one: by
    source, then by target with the sums of each cluster's edges to it.
    """
    placed = saved(placed, "placed")  # both ends need it
    to = lambda end: placed.select(F.col("node_id").alias(end), F.col("cluster_id").alias(f"{end}_c"))
    if placed.count() <= BROADCAST:
        moved = edges.join(F.broadcast(to("source")), "source", "left").join(F.broadcast(to("target")), "target", "left")
        moved = moved.select(F.coalesce("source_c", "source").alias("source"), F.coalesce("target_c", "target").alias("target"), "relationship_type", "weight")
    else:
        n = tasks or max(edges.sparkSession.sparkContext.defaultParallelism, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = lambda end: to(end).repartition(n, end).hint("merge")  # noqa: E731  Spark would broadcast millions of nodes that are small as a file
        edges = edges if tasks else edges.repartition(n, "source")
        moved = edges.join(dealt("source"), "source", "left").select(F.coalesce("source_c", "source").alias("source"), "target", "relationship_type", "weight")
        moved = moved.repartition(n, "target").groupBy("source", "target", "relationship_type").agg(F.sum("weight").alias("weight"))
        moved = moved.join(dealt("target"), "target", "left").select("source", F.coalesce("target_c", "target").alias("target"), "relationship_type", "weight")
    return moved.where("source <> target").groupBy("source", "target", "relationship_type").agg(F.sum("weight").alias("weight"))


def tier_view(tree: DataFrame, members: DataFrame, entities: DataFrame, edges: DataFrame, tier: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a tier: clusters with label, dominant type and size, entities in no cluster as themselves, and the edges between."""
    placed = saved(node_clusters(tree, members, tier), "placed")
    kinds = dominant_type(placed, entities).select(F.col("cluster_id").alias("id"), "entity_type")
    grouped = cluster_nodes(tree, placed).join(kinds, "id", "left").select("id", "label", "entity_type", "size")
    alone = entities.join(placed.select(F.col("node_id").alias("id")), "id", "left_anti")
    alone = alone.join(tree.select("id"), "id", "left_anti").select("id", F.col("name").alias("label"), "entity_type", F.lit(1).cast("long").alias("size"))
    return grouped.union(alone), cluster_edges(edges, placed)
