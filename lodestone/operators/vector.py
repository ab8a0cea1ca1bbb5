"""Exact cosine search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many components the product is one generated expression.
UNROLLED = 256


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine of a vector column and a fixed vector; null for other lengths, nulls and zero vectors."""
    norm = math.sqrt(sum(x * x for x in query))
    if len(query) <= UNROLLED:
        at = [F.get(vector, F.lit(i)).cast("double") for i in range(len(query))]
        dot = sum((x * F.lit(float(q)) for x, q in zip(at, query, strict=True)), F.lit(0.0))
        own = F.sqrt(sum((x * x for x in at), F.lit(0.0)))
    else:
        add = lambda s, x: s + x
        dot = F.aggregate(F.zip_with(vector, F.array(*map(F.lit, map(float, query))), lambda a, b: a.cast("double") * b), F.lit(0.0), add)
        own = F.sqrt(F.aggregate(F.transform(vector, lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), add))
    return F.when((F.size(vector) == len(query)) & (own > 0) & (norm > 0), dot / (own * F.lit(norm)))


def search(vectors: DataFrame, query: list[float], k: int = 10, threshold: float = 0.7, document_id: int | None = None) -> DataFrame:
    """The k most similar chunks at or above the threshold: chunk_id, document_id, similarity.

    Ties go to the smaller chunk_id. A scan and a top-k a task; nothing is shuffled but k rows a task.
    """
    if not 1 <= k <= 100:
        raise ValueError("k must be from 1 to 100")
    rows = vectors if document_id is None else vectors.where(F.col("document_id") == document_id)
    found = rows.select("chunk_id", "document_id", cosine(F.col("embedding"), query).alias("similarity"))
    return found.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "chunk_id").limit(k)


def query_vector(vectors: DataFrame, chunk_id: int) -> list[float]:
    """One row's vector, to search with."""
    row = vectors.where(F.col("chunk_id") == chunk_id).select("embedding").first()
    return [float(x) for x in row["embedding"]] if row else []
