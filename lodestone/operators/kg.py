"""Building and changing a knowledge graph: every change gives a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import safe_label
from lodestone.sources.scratch import saved


def first_entities(candidates: DataFrame) -> DataFrame:
    """One entity for each name and type, case aside: the first by (chunk, position). Malformed ones go.

    An aggregate with partial minima: a name that many chunks hold costs a row a task.
    """
    good = candidates.where("trim(coalesce(name, '')) <> '' and trim(coalesce(entity_type, '')) <> ''")
    first = F.min(F.struct("chunk", "position", "name", "entity_type", "description")).alias("f")
    return good.groupBy(F.lower("name").alias("n"), F.lower("entity_type").alias("t")).agg(first, F.count(F.lit(1)).alias("mentions")).select(
        F.col("f.name").alias("name"), F.col("f.entity_type").alias("entity_type"), F.col("f.description").alias("description"), F.col("f.chunk").alias("chunk"), F.col("f.position").alias("position"), "mentions"
    )


def resolved_relationships(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """raw (source, target, type by name) with entity ids. Of equal names the last entity counts; unresolved ones and self-loops go.

    entities: id, name, ordinal.
    """
    return _by_ids(raw, entities).select("source_id", "target_id", "type")


def _by_ids(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """raw with source_id and target_id."""
    by_name = entities.groupBy(F.lower("name").alias("n")).agg(F.max_by("id", "ordinal").alias("id"))
    s = by_name.select(F.col("n").alias("sn"), F.col("id").alias("source_id"))
    t = by_name.select(F.col("n").alias("tn"), F.col("id").alias("target_id"))
    both = raw.join(s, F.lower("source") == F.col("sn")).join(t, F.lower("target") == F.col("tn"))
    return both.where("source_id <> target_id")


def merged_nodes(base: DataFrame, update: DataFrame) -> DataFrame:
    """Upsert by id: update's columns overwrite, nulls included; of an id's rows in update, the last by seq."""
    rank = F.max_by(F.struct("name", "entity_type", "description"), "seq").alias("r")
    last = update.groupBy("id").agg(rank).select("id", "r.name", "r.entity_type", "r.description")
    kept = base.join(last.select("id"), "id", "left_anti").select("id", "name", "entity_type", "description")
    return kept.union(last)


def without_document(entities: DataFrame, edges: DataFrame, document_id: str) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) without a document's entities and the edges at them."""
    gone = entities.where(F.col("source_document_id") == document_id).select("id")
    left = edges
    for end in ("source", "target"):
        left = left.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return entities.where(~F.col("source_document_id").eqNullSafe(document_id)), left.select(edges.columns)


def inserted(base: DataFrame, more: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """base, and of more the first row, by ``order``, of each key that base lacks; what is there stays as it is.

    Base's keys aren't made distinct for that: nearly all are, and a task would hold them. Where the key has a type
    of relation, base's rows of other types than more's aren't shuffled.
    """
    rest = [c for c in base.columns if c not in key]
    first = more.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")) if rest else more.select(key).distinct()
    there = base.select(key)
    if "relationship_type" in key:
        there = there.join(F.broadcast(more.select("relationship_type").distinct()), "relationship_type", "left_semi").select(key)  # a row a type
    new = first.join(there, key, "left_anti")
    return base.union(new.select(*(F.col(f"r.{c}").alias(c) if c in rest else F.col(c) for c in base.columns)))


def merged_graph(base: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """base, and one row (that of the least id) of more for each key that base lacks."""
    return inserted(base, more, key, ["id"])


def with_known_ends(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges both of whose ends are entities."""
    ids = entities.select("id")
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return edges.select("id", "source", "target", "relationship_type", "weight")


def imported_edges(base: DataFrame, more: DataFrame, entities: DataFrame) -> DataFrame:
    """base and the edges of more whose id is new and whose ends are both entities; of an id's several rows the first by its ends counts."""
    return inserted(base, with_known_ends(more, entities), ["id"], ["source", "target", "relationship_type", "weight"])


def created_entities(first: DataFrame, document_id: str) -> DataFrame:
    """Entities from ``first_entities``: id (of name and type, so that a repeated run makes the same), label, properties as JSON if there are any.

    The label is the type without what isn't a letter, digit or underscore.
    """
    key = F.concat_ws("|", F.lower("name"), F.lower("entity_type"))
    properties = F.when(F.col("mentions") > 1, F.to_json(F.struct("mentions")))
    return first.select(
        F.concat(F.lit("entity:"), F.md5(key.cast("binary"))).alias("id"), "name", "entity_type", safe_label(F.col("entity_type")).alias("label"), "description",
        properties.alias("properties_json"), F.lit(document_id).alias("source_document_id"),
    )


def created_relationships(raw: DataFrame, entities: DataFrame, document_id: str) -> DataFrame:
    """Relationships from raw ones by name (source, target, type, description): ends resolved, weight 1, the description, if any, as JSON.

    Repeated ones stay, each with its own row; entities: id, name, ordinal.
    """
    both = _by_ids(raw, entities)
    described = F.when(F.coalesce("description", F.lit("")) != "", F.to_json(F.struct("description")))
    return both.select("source_id", "target_id", F.col("type").alias("relationship_type"), F.lit(1.0).alias("weight"), described.alias("properties_json"), F.lit(document_id).alias("source_document_id"))


def built(candidates: DataFrame, raw: DataFrame, document_id: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of a document's extraction: merged, created, and resolved by name."""
    first = saved(first_entities(candidates), "entities")
    entities = created_entities(first, document_id)
    key = F.concat_ws("|", F.lower("name"), F.lower("entity_type"))
    ordered = first.select(F.concat(F.lit("entity:"), F.md5(key.cast("binary"))).alias("id"), "name", F.struct("chunk", "position").alias("ordinal"))
    return entities, created_relationships(raw, ordered, document_id)


def merged_edges(base: DataFrame, update: DataFrame) -> DataFrame:
    """Upsert by (source, target, relationship_type, id): update's weight overwrites; of its repeats the one of the largest seq counts."""
    key = ["source", "target", "relationship_type", "id"]
    last = update.groupBy(key).agg(F.max_by("weight", "seq").alias("weight"))
    kept = base.join(last.select(key), key, "left_anti")
    return kept.select("id", "source", "target", "relationship_type", "weight").union(last.select("id", "source", "target", "relationship_type", "weight"))


def wiped(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """The same tables without rows."""
    return tuple(t.where(F.lit(False)) for t in tables)
