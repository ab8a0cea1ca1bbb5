"""Exact top-k inner-product search with block-at-a-time pruning.

1. Vectors become integers, are ordered by the signs of their first components,
   and that order is cut into ranges, one a partition. A range holds forward
   blocks of a few thousand vectors; each range, block and sub-block carries
   its largest and least value of every component (a term's maxima).
2. A query's bound of a range or block is the sum over components of the larger
   of q * max and q * min. Each query first goes to its range of the highest
   bound; the k scores found there are its first threshold.
3. It then goes to the ranges whose bound reaches its threshold, and there
   through blocks in order of their bounds, until these fall below its kth.
   How much this prunes is the data's doing: README has the share.
4. The partial answers, k rows a query and range at most, are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm._common import Scratch

#: Vectors in a block row and in a sub-block; ranges at most (their bounds go to the driver and to every task); queries in a chunk.
BLOCK, SUB, RANGES, CHUNK = 8192, 64, 4096, 512
SIGNS = 12
#: Components of up to so much are held in four bytes.
NARROW = (1 << 31) - 1

BLOCKS = "part int, dim int, ids binary, values binary, hi binary, lo binary"
HITS = "q long, query_id long, vec_id long, score long"


def as_integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector, or a component, is null or isn't finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _by_dim(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch's rows by the length of their vectors."""
    n = batch.column(batch.schema.get_field_index(name)).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(n).tolist():
        yield dim, batch.take(pa.array(np.flatnonzero(n == dim)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, rows in _by_dim(batch, "v"):
            part = rows.column(rows.schema.get_field_index("part"))[0].as_py()
            ids, values = rows.column(rows.schema.get_field_index("vec_id")).to_numpy(), _matrix(rows, "v", dim)
            for i in range(0, len(ids), BLOCK):
                x = values[i : i + BLOCK]
                held = x.astype(np.int32) if np.abs(x).max() <= NARROW else x
                edge = np.arange(0, len(x), SUB)
                hi, lo = np.maximum.reduceat(x, edge, axis=0), np.minimum.reduceat(x, edge, axis=0)
                columns = [pa.array([part], pa.int32()), pa.array([dim], pa.int32()), *(pa.array([y.tobytes()], pa.binary()) for y in (ids[i : i + BLOCK], held, hi, lo))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "dim", "ids", "values", "hi", "lo"])


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: range and the block's extremes of each component."""
    for batch in batches:
        for r in batch.to_pylist():
            hi, lo = (np.frombuffer(r[x], np.int64).reshape(-1, r["dim"]) for x in ("hi", "lo"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["part"]], pa.int32()), pa.array([r["dim"]], pa.int32()), pa.array([hi.max(axis=0).tolist()], pa.list_(pa.int64())), pa.array([lo.min(axis=0).tolist()], pa.list_(pa.int64()))],
                names=["part", "dim", "hi", "lo"],
            )


def _bounds(q: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """(queries, blocks): no inner product is larger; exact up to 2**53."""
    q = q.astype(np.float64)
    return np.maximum(q, 0) @ hi.T.astype(np.float64) + np.minimum(q, 0) @ lo.T.astype(np.float64)


def _routes(ranges: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], first: bool):
    """Queries -> chunks for ranges: for the best one, or for all others that reach the threshold ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim, batch in _by_dim(whole, "v"):
                if dim not in ranges:
                    continue
                parts, hi, lo = ranges[dim]
                values, q = _matrix(batch, "v", dim), batch.column(0).to_numpy()
                query = batch.column(1).to_numpy()
                least = np.full(len(q), -(1 << 62), np.int64) if first else batch.column(3).to_numpy()
                for i in range(0, len(q), CHUNK):
                    b = _bounds(values[i : i + CHUNK], hi, lo)
                    best = b.argmax(axis=1)
                    go = np.zeros(b.shape, dtype=bool)
                    if first:
                        go[np.arange(len(b)), best] = True
                    else:
                        go = b >= least[i : i + CHUNK, None]
                        go[np.arange(len(b)), best] = False
                    for j in np.flatnonzero(go.any(axis=0)).tolist():
                        rows = np.flatnonzero(go[:, j]) + i
                        data = [pa.array([x.tobytes()], pa.binary()) for x in (q[rows], query[rows], least[rows], values[rows])]
                        yield pa.RecordBatch.from_arrays([pa.array([int(parts[j])], pa.int32()), pa.array([dim], pa.int32()), *data], names=["part", "dim", "q", "query", "least", "qv"])

    return run


CHUNKS = "part int, dim int, q binary, query binary, least binary, qv binary"


def search_block(values: np.ndarray, ids: np.ndarray, hi: np.ndarray, lo: np.ndarray, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores): each query's k best of a block, sub-blocks taken in order of their bounds."""
    top = int(np.abs(values).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, values.shape[1])
    kind = np.float64 if top < 1 << 53 else np.int64
    x, y = values.astype(kind), queries.astype(kind)
    bounds = _bounds(queries, hi, lo)
    order = np.argsort(-bounds, axis=1, kind="stable")
    for i in range(len(queries)):
        got_ids, got, kth = np.zeros(0, np.int64), np.zeros(0, np.int64), int(least[i])
        at, step = 0, 4
        while at < len(order[i]) and bounds[i, order[i, at]] >= kth:
            blocks = order[i, at : at + step]
            blocks = blocks[bounds[i, blocks] >= kth]
            rows = (blocks[:, None] * SUB + np.arange(SUB)).ravel()
            rows = rows[rows < len(ids)]
            score = np.rint(x[rows] @ y[i]).astype(np.int64) if kind is np.float64 else x[rows] @ y[i]
            keep = (score >= kth) & (ids[rows] != own[i])
            got_ids, got = np.concatenate((got_ids, ids[rows[keep]])), np.concatenate((got, score[keep]))
            if len(got) > k:
                best = np.lexsort((got_ids, -got))[:k]
                got_ids, got = got_ids[best], got[best]
            if len(got) >= k:
                kth = max(kth, int(got.min()))
            at, step = at + step, step * 2
        yield i, got_ids, got


def _hits(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                d = r["dim"]
                n = len(r["ids"]) // 8
                kind = np.int32 if len(r["values"]) == 4 * n * d else np.int64
                values, queries = np.frombuffer(r["values"], kind).reshape(n, d), np.frombuffer(r["qv"], np.int64).reshape(len(r["q"]) // 8, d)
                ids, q, query, least = (np.frombuffer(r[c], np.int64) for c in ("ids", "q", "query", "least"))
                hi, lo = (np.frombuffer(r[c], np.int64).reshape(-(-n // SUB), d) for c in ("hi", "lo"))
                out = [(i, a, b) for i, a, b in search_block(values, ids, hi, lo, queries, query, least, k) if len(a)]
                if out:
                    at = np.repeat([i for i, _, _ in out], [len(a) for _, a, _ in out])
                    yield pa.RecordBatch.from_arrays(
                        list(map(pa.array, (q[at], query[at], np.concatenate([a for _, a, _ in out]), np.concatenate([b for _, _, b in out])))), names=["q", "query_id", "vec_id", "score"]
                    )

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """One row per query and rank: query_id, rank, vec_id, score (the k highest inner products).

    vectors and queries: vec_id, embedding. Components become
    floor(scale * x). A query is compared with all rows of its own length but
    those of its own vec_id; ties go to the smaller vec_id. Inner products are
    exact below 2**63.

    Vectors that are null, empty or hold a null or non-finite component, and rows with
    a null vec_id, take no part. Repeated rows count once. Other columns are
    ignored. An empty table, or one without partners, gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    whole = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), as_integers(F.col("embedding"), scale).alias("v")).where("vec_id is not null and v is not null and size(v) > 0").distinct()
    rows = scratch.save(whole(vectors), "vectors")
    asked = scratch.save(whole(queries).select(F.xxhash64("vec_id", "v").alias("q"), F.col("vec_id").alias("query_id"), "v"), "queries")
    total = rows.count()
    ranges = max(1, min(RANGES, -(-total // BLOCK)))
    signs = sum((F.when(F.get("v", F.lit(i)) >= 0, 1 << i).otherwise(0) for i in range(SIGNS)), F.lit(0))
    placed = rows.withColumn("c", signs).repartitionByRange(ranges, F.size("v"), "c", "vec_id").sortWithinPartitions("c", "vec_id")
    blocks = scratch.save(placed.select(F.spark_partition_id().alias("part"), "vec_id", "v").mapInArrow(_blocks, BLOCKS), "blocks")

    bounds: dict[int, list] = {}
    ends = blocks.mapInArrow(_summary, "part int, dim int, hi array<long>, lo array<long>")
    extreme = ends.select("part", "dim", F.posexplode(F.arrays_zip("hi", "lo"))).groupBy("part", "dim", "pos").agg(F.max("col.hi").alias("hi"), F.min("col.lo").alias("lo"))
    whole_range = extreme.groupBy("part", "dim").agg(F.sort_array(F.collect_list(F.struct("pos", "hi", "lo"))).alias("x")).orderBy("part", "dim")
    for r in whole_range.collect():  # a row a range, of which there are few
        bounds.setdefault(r["dim"], []).append((r["part"], [e["hi"] for e in r["x"]], [e["lo"] for e in r["x"]]))
    shape = {d: tuple(np.array(c, dtype=np.int64) for c in zip(*x, strict=True)) for d, x in bounds.items()}

    def scored(chunks: DataFrame, name: str) -> DataFrame:
        chunks = scratch.save(chunks, f"{name}-chunks")
        return scratch.save(chunks.join(blocks, ["part", "dim"]).mapInArrow(_hits(k), HITS), name)

    first = scored(asked.mapInArrow(_routes(shape, True), CHUNKS), "first")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("q", F.col("score").alias("least"))
    rest = asked.join(kth, "q", "left").select("q", "query_id", "v", F.coalesce("least", F.lit(-(1 << 62))).alias("least"))
    other = scored(rest.mapInArrow(_routes(shape, False), CHUNKS), "other")
    merged = first.union(other).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP4_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
