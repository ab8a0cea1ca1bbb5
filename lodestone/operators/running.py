"""Numbers of rows in an order over a whole table, without a task that sees them all.

Rows are dealt to tasks by ranges of the order and sorted there; what lies
before a range is a sum over one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import saved


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (saved) with _part, the number of their range in the order, and _row, their number in it, from 0.

    Order by columns that tell all rows apart, or a value that very many share stays in one range.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the low bits count a partition's rows
    return saved(placed.withColumns({"_part": F.spark_partition_id(), "_row": row}), "ranged")


def before(placed: DataFrame, amount: Column, by: list[str] | None = None) -> DataFrame:
    """(_part, by, _before): what ``amount``, an aggregate, gives over the ranges before; one row a range (and value of ``by``)."""
    sums = placed.groupBy("_part", *(by or [])).agg(amount.alias("_sum"))
    earlier = Window.partitionBy(*(by or [])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", *(by or []), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their number in the order, from 0, in column ``name``."""
    placed = ranged(rows, order)
    return placed.join(F.broadcast(before(placed, F.count(F.lit(1)))), "_part").withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")  # a row a range


def numbered_within(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """rows with their number, from 0, among those of the same value of ``by`` (null is one too), however many share it."""
    placed = ranged(rows, [by, *order])
    here = placed.groupBy("_part", F.col(by).alias("_by")).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    shift = here.select(F.col("_part").alias("_at"), "_by", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    both = placed.join(shift, (F.col("_part") == F.col("_at")) & F.col(by).eqNullSafe(F.col("_by")))
    return both.withColumn(name, F.col("_row") + F.col("_shift")).drop("_part", "_row", "_at", "_by", "_shift")
