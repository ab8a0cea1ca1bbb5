"""Full-text search over entities by BM25, as one expression a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import relevance
from lodestone.operators.graph import relations
from lodestone.sources.scratch import saved

K1, B = 1.2, 0.75


def bm25(entities: DataFrame, query: str) -> DataFrame:
    """entities that hold any of the query's terms, with their ``score``.

    Terms are counted in each row's own array of tokens. Document frequencies
    and the mean length are one aggregate, whose row is broadcast: no shuffle
    but of a row a task.
    """
    terms = sorted({t.lower() for t in query.split()})
    found = F.regexp_extract_all(F.lower(F.concat_ws(" ", "name", "description")), F.lit(r"([\p{L}\p{N}]+)"), 1)
    held = [c for c in entities.columns if not c.startswith("_")]
    at = lambda i, t: F.size(F.filter("_tokens", lambda x: x == t)).alias(f"_tf{i}")
    counted = entities.withColumn("_tokens", found).select(*held, F.size("_tokens").alias("_len"), *(at(i, t) for i, t in enumerate(terms)))
    df = [F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))]
    total = counted.agg(F.count(F.lit(1)).alias("_all"), F.avg("_len").alias("_mean"), *df)
    tf = [F.col(f"_tf{i}") for i in range(len(terms))]
    some = counted.where(sum(tf, F.lit(0)) > 0).crossJoin(F.broadcast(total))  # one row
    norm = K1 * (1 - B + B * F.col("_len") / F.col("_mean"))
    idf = [F.log(1 + (F.col("_all") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)) for i in range(len(terms))]
    return some.select(*held, sum((w * n * (K1 + 1) / (n + norm) for w, n in zip(idf, tf, strict=True)), F.lit(0.0)).alias("score"))


def search(entities: DataFrame, query: str, k: int = 10, types: list[str] | None = None) -> DataFrame:
    """The k best entities, of the given types only: id, name, entity_type, description, score. Ties go to the smaller id."""
    if not 1 <= k <= 50:
        raise ValueError("k must be from 1 to 50")
    found = bm25(entities, query)
    if types:
        found = found.where(F.col("entity_type").isin(types))
    return found.orderBy(F.desc(F.round("score", 9)), "id").limit(k).select("id", "name", "entity_type", "description", "score")


def search_with_relations(entities: DataFrame, edges: DataFrame, query: str, k: int = 10, types: list[str] | None = None) -> DataFrame:
    """The k best entities with their relevance (0 to 1) and relations."""
    found = saved(search(entities, query, k, types), "hits")  # k rows
    return relations(found.withColumn("relevance", relevance(F.col("score"))), edges, entities)
