"""What the logs of agents' runs say: iterations, calls open at once, and what the limit of iterations cut.

events: run_id, seq, ts, event. One sort by run serves every figure, and frames
run from a run's first event, so a run of any length needs a few numbers of memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Iterations after which a run ends, whatever is open (fixed value).
MOST = 5


def _is(event: str) -> Column:
    return F.col("event") == event


def swept(events: DataFrame) -> DataFrame:
    """events with their iteration (from 1), the calls open after each, and the time to the next (microseconds; null at the end).

    An iteration is what lies between two answers of tools and what follows
    them: the next begins with the first event after a result that isn't one
    (gaps and islands). Open calls are a running sum over starts and ends; a
    result without an open call doesn't count below none (the sum less its least
    value so far).
    """
    run = Window.partitionBy("run_id").orderBy("seq")
    so_far = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = (~_is("tool_result") & (F.lag("event").over(run) == "tool_result")).cast("long")
    step = F.when(_is("tool_start"), 1).when(_is("tool_result"), -1).otherwise(0)
    rows = events.select("run_id", "seq", "ts", "event", F.coalesce(begins, F.lit(0)).alias("_begins"), step.alias("_step"))
    rows = rows.withColumn("_sum", F.sum("_step").over(so_far))
    open_ = F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(so_far))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.select(
        "run_id", "seq", "ts", "event", (F.sum("_begins").over(so_far) + 1).alias("iteration"), open_.alias("open"),
        (F.lead(micros).over(run) - micros).alias("micros"),
    )


def iterations(events: DataFrame, most: int = MOST) -> DataFrame:
    """A row an iteration of a run: events, calls, results, most calls open at once, its time, and whether the limit cuts it."""
    each = swept(events).groupBy("run_id", "iteration").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(_is("tool_start")).alias("calls"), F.count_if(_is("tool_result")).alias("results"),
        F.max("open").alias("peak_open"), F.coalesce(F.sum("micros"), F.lit(0)).alias("micros"),
    )
    return each.withColumn("cut", F.col("iteration") > most)


def summary(events: DataFrame, most: int = MOST) -> DataFrame:
    """A row a run: iterations, calls, calls_cut (those of iterations beyond ``most``), peak_open, and microseconds with one
    call open or more (busy) and with several (parallel). Figures but calls_cut are of the whole log."""
    rows = swept(events)
    time = lambda least: F.coalesce(F.sum(F.when(F.col("open") >= least, F.col("micros"))), F.lit(0))
    return rows.groupBy("run_id").agg(
        F.max("iteration").alias("iterations"), F.count_if(_is("tool_start")).alias("calls"),
        F.count_if(_is("tool_start") & (F.col("iteration") > most)).alias("calls_cut"), F.max("open").alias("peak_open"),
        time(1).alias("busy_micros"), time(2).alias("parallel_micros"),
    )
