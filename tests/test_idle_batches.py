"""Batches that close by a timer when nothing comes."""

import time

import pytest

from lodestone.operators import ingest
from lodestone.streaming import stateful

SCHEMA = "job_id string, file_id string, n_chunks long"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set(name, before)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def until(query, ready, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if query.exception():
            raise query.exception()
        if ready():
            return
        time.sleep(0.2)
    raise AssertionError("it didn't come")


def test_an_open_batch_closes_after_a_gap(spark, rocks, tmp_path):
    at = f"{tmp_path}/in"
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(at)
    first = [("a", f"a{i}", 10) for i in range(7)] + [("b", "b0", 250), ("b", "b1", 1)]
    put(first)
    stream = spark.readStream.schema(SCHEMA).parquet(at)
    query = stateful.idle_batches(stream, idle_ms=1500).writeStream.format("memory").queryName("closed").outputMode("append")
    query = query.option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="300 milliseconds").start()
    rows = lambda: {(r["file_id"], r["batch"], r["reason"]) for r in spark.table("closed").collect()}
    try:
        until(query, lambda: len(rows()) >= 9)
        assert rows() == {(f"a{i}", 0, "full") for i in range(5)} | {("b0", 0, "full"), ("a5", 1, "idle"), ("a6", 1, "idle"), ("b1", 1, "idle")}
        put([("a", "a7", 100), ("b", "b2", 3)])
        until(query, lambda: len(rows()) >= 11)
        assert {("a7", 2, "full"), ("b2", 2, "idle")} <= rows()
    finally:
        query.stop()
    # without gaps the batches are those of the files in order
    ordered = spark.createDataFrame([(j, f, i, n) for i, (j, f, n) in enumerate(first)], "job_id string, file_id string, seq long, n_chunks long")
    want = {(r["file_id"], r["batch"]) for r in ingest.embed_batches(ordered).collect()}
    assert {(f, b) for f, b, _ in rows() if f in {x[1] for x in first}} == want
