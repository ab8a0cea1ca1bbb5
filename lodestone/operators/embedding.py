"""Vectors of chunks by feature hashing, in batches that may fail.

The vectors need no model: each token adds one, with a sign, to the component
that its MD5 names, and the sum is brought to length one. Tokens and their
components are column expressions; a batch's sums are one numpy histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chunks of a document that are embedded in one call, and attempts at a call (fixed values).
BATCH, ATTEMPTS = 100, 3
OUT = "document_id string, chunk_index int, embedding array<float>"


def components(text: Column, dims: int) -> Column:
    """Signed components, from 1 to dims or from -1 to -dims, of the tokens of ``text``."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    code = lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long")
    signed = lambda c: F.when(F.floor(c / dims) % 2 == 0, c % dims + 1).otherwise(-(c % dims) - 1)
    return F.transform(F.transform(tokens, code), lambda c: signed(c).cast("int"))


def _summed(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(2)
            n = len(batch)
            row = np.repeat(np.arange(n), codes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            code = codes.flatten().to_numpy(zero_copy_only=False)
            sums = np.bincount(row * dims + np.abs(code) - 1, weights=np.sign(code), minlength=n * dims).reshape(n, dims)
            norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            unit = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["document_id", "chunk_index", "embedding"])

    return run


def vectors(chunks: DataFrame, dims: int = 64) -> DataFrame:
    """(document_id, chunk_index, embedding) of chunks (document_id, chunk_index, content), of length one; zero without tokens."""
    if not 1 <= dims <= 4096:
        raise ValueError("dims must be from 1 to 4096")
    rows = chunks.select(F.col("document_id").cast("string"), F.col("chunk_index").cast("int"), F.coalesce(components(F.col("content"), dims), F.array().cast("array<int>")).alias("codes"))
    return rows.mapInArrow(_summed(dims), OUT)


def batch_outcomes(chunks: DataFrame, failing: Column | None = None, batch: int = BATCH, attempts: int = ATTEMPTS) -> DataFrame:
    """A row a batch of chunks (document_id, chunk_index, ...): document_id, batch, chunks, attempts, wait_seconds, failed.

    failing says of a chunk how many attempts at its batch fail (the most of a
    batch's counts). A batch is tried ``attempts`` times, with 1, 2, 4, ...
    seconds between; one that never succeeds has failed.
    """
    fails = F.least(F.coalesce(F.max(F.lit(0) if failing is None else failing), F.lit(0)), F.lit(attempts)).cast("int")
    groups = chunks.groupBy("document_id", F.floor(F.col("chunk_index") / batch).cast("int").alias("batch"))
    rows = groups.agg(F.count(F.lit(1)).alias("chunks"), fails.alias("_fails"))
    tried = F.least(F.col("_fails") + 1, F.lit(attempts))
    wait = (F.pow(F.lit(2), tried - 1) - 1).cast("long")
    return rows.select("document_id", "batch", "chunks", tried.alias("attempts"), wait.alias("wait_seconds"), (F.col("_fails") >= attempts).alias("failed"))


def failures(outcomes: DataFrame) -> DataFrame:
    """(document_id, failed_batches, error) of documents of which a batch failed."""
    bad = outcomes.groupBy("document_id").agg(F.count_if("failed").alias("failed_batches"), F.min(F.when(F.col("failed"), F.col("batch"))).alias("first"), F.max("attempts").alias("attempts"))
    error = F.concat(F.lit("Failed to embed chunks: batch "), F.col("first").cast("string"), F.lit(" after "), F.col("attempts").cast("string"), F.lit(" attempts"))
    return bad.where("failed_batches > 0").select("document_id", "failed_batches", error.alias("error"))


def embedded(chunks: DataFrame, failing: Column | None = None, dims: int = 64, batch: int = BATCH, attempts: int = ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(vectors, failures): a document is embedded whole or not at all, as one batch that fails ends its call."""
    bad = failures(batch_outcomes(chunks, failing, batch, attempts))
    return vectors(chunks.join(bad.select("document_id"), "document_id", "left_anti"), dims), bad


def query_vector(spark, text: str, dims: int = 64) -> list[float]:
    """The vector of a query's text, to search with."""
    row = vectors(spark.createDataFrame([("", 0, text)], "document_id string, chunk_index int, content string"), dims).first()
    return [float(x) for x in row["embedding"]]
