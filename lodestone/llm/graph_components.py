"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component: its smallest node.

    Each round rewires every neighbourhood to its minimum, so paths shrink
    geometrically; all rows stay in tables and the driver sees a count and a
    checksum a round. Self-loops and null ends are ignored.
    """
    e = scratch.save(_canonical(edges), "edges")
    before = _state(e)
    while before[0]:
        after = scratch.save(_small_star(_large_star(e)), "edges")
        scratch.drop(e)
        e, state = after, _state(after)
        if state == before:
            break
        before = state
    out = e.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return out.union(e.select(F.col("a"), F.col("a")).distinct())


def _canonical(e: DataFrame) -> DataFrame:
    return e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _canonical(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(e: DataFrame) -> DataFrame:
    # a < b holds, so the smaller neighbours of b are its a's
    least = e.groupBy("b").agg(F.min("a").alias("m"))
    near = e.join(least, "b").select(F.col("a"), F.col("m").alias("b"))
    return _canonical(near.union(least.select(F.col("b"), F.col("m"))).toDF("a", "b"))
