"""Hybrid retrieval: vector and full-text results, weighted, in one ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import relevance
from lodestone.operators import fulltext, vector

#: Similarity from which the hybrid search takes a chunk.
THRESHOLD = 0.3


def hybrid(vectors: DataFrame, entities: DataFrame, query: str, query_vector: list[float], k: int = 10, vector_weight: float = 0.5, document_id: int | None = None) -> DataFrame:
    """The k best of both: source, key, score. At equal scores chunks come first, then the better rank in its own search.

    A branch whose weight is 0 isn't run. document_id narrows the chunks alone.
    Keys of chunks and entities never meet, so this is a union, not a join.
    """
    if not 0 <= vector_weight <= 1:
        raise ValueError("vector_weight must be from 0 to 1")
    branches = []
    scored = lambda source, key, raw, score, n: [F.lit(source).alias("source"), key.alias("key"), score.alias("score"), raw.alias("raw"), n.alias("n")]
    if vector_weight > 0:
        near = vector.search(vectors, query_vector, k, THRESHOLD, document_id)
        s = F.col("similarity")
        branches.append(near.select(*scored("vector", F.concat(F.lit("chunk:"), "chunk_id"), s, s * vector_weight, F.col("chunk_id").cast("long"))))
    if vector_weight < 1:
        texts = fulltext.search(entities, query, min(k, 50))
        s = F.col("score")
        branches.append(texts.select(*scored("graph", F.concat(F.lit("entity:"), "id"), s, relevance(s) * (1 - vector_weight), F.lit(None).cast("long"))))
    both = branches[0].union(branches[1]) if len(branches) == 2 else branches[0]
    rank = [F.desc(F.round("score", 9)), F.col("source") == "graph", F.desc(F.round("raw", 9)), "n", "key"]
    return both.orderBy(*rank).limit(k).select("source", "key", "score")
