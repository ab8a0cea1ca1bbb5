"""Logs of runs against a loop over their events."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from lodestone.operators import agent_runs


def plain(rows, most):
    out = {}
    runs = defaultdict(list)
    for r in rows:
        runs[r[0]].append(r)
    for run, log in runs.items():
        log.sort(key=lambda r: r[1])
        iteration, open_, peak, busy, parallel, calls, cut = 1, 0, 0, 0, 0, 0, 0
        for i, (_, _, ts, event) in enumerate(log):
            if i and event != "tool_result" and log[i - 1][3] == "tool_result":
                iteration += 1
            if event == "tool_start":
                calls, open_, cut = calls + 1, open_ + 1, cut + (iteration > most)
            elif event == "tool_result":
                open_ = max(0, open_ - 1)
            peak = max(peak, open_)
            if i + 1 < len(log):
                t = (log[i + 1][2] - ts) // timedelta(microseconds=1)
                busy += t * (open_ >= 1)
                parallel += t * (open_ >= 2)
        out[run] = (iteration, calls, cut, peak, busy, parallel)
    return out


def test_summary_equals_a_loop(spark):
    rng = random.Random(5)
    at = datetime(2024, 1, 1)
    rows = [(rng.randrange(7), i, at + timedelta(microseconds=rng.randrange(10**9) + i * 10**9), rng.choice(["tool_start", "tool_result", "tool_result", "token", "thinking"])) for i in range(600)]
    df = spark.createDataFrame(rows, "run_id long, seq long, ts timestamp, event string")
    found = {r["run_id"]: (r["iterations"], r["calls"], r["calls_cut"], r["peak_open"], r["busy_micros"], r["parallel_micros"]) for r in agent_runs.summary(df, 5).collect()}
    assert found == plain(rows, 5)
    each = agent_runs.iterations(df, 5).collect()
    assert sum(r["calls"] for r in each if r["cut"]) == sum(x[2] for x in found.values())
    assert {r["run_id"]: 0 for r in each}.keys() == found.keys()


def test_runs_without_calls_and_empty_logs(spark):
    schema = "run_id long, seq long, ts timestamp, event string"
    at = datetime(2024, 1, 1)
    row = agent_runs.summary(spark.createDataFrame([(1, 1, at, "token"), (1, 2, None, "tool_result")], schema)).first()
    assert (row["iterations"], row["calls"], row["peak_open"], row["busy_micros"]) == (1, 0, 0, 0)
    assert agent_runs.summary(spark.createDataFrame([], schema)).count() == 0


def test_one_sort_serves_all(spark):
    df = spark.createDataFrame([(1, 1, None, "token")], "run_id long, seq long, ts timestamp, event string")
    plan = agent_runs.summary(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
