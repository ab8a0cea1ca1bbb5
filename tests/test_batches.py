"""Batches of files in blocks, against a loop."""

import random

import pytest

from lodestone.operators import ingest
from lodestone.operators.running import numbered_within

FILES = "job_id string, file_id string, seq long, n_chunks long, block long"


def looped(rows, chunks, most):
    out = {}
    for job in {r[0] for r in rows}:
        batch = held = count = 0
        for _, file, _, n, _ in sorted((r for r in rows if r[0] == job), key=lambda r: (r[2], r[1])):
            out[job, file] = batch
            held, count = held + (n or 0), count + 1
            if held >= chunks or count >= most:
                batch, held, count = batch + 1, 0, 0
    return out


@pytest.mark.parametrize(("chunks", "most", "block"), [(100, 5, 5), (100, 5, 7), (30, 3, 8), (10**9, 4, 6), (1, 5, 5), (50, 1, 3)])
def test_batches_by_blocks_equal_a_loop(spark, chunks, most, block):
    r = random.Random(block)
    rows = [("hot" if i % 3 else r.choice(["a", "b", None]), f"f{i}", r.randrange(150), r.choice([0, 1, 7, 20, 60, 120, None]), -1) for i in range(400)]
    rows += [("one", "x", 0, 5, -1), ("exact", "y0", 0, 1, -1)] + [("exact", f"y{i}", i, 1, -1) for i in range(1, block)]
    df = spark.createDataFrame(rows, FILES)
    got = ingest.embed_batches(df, chunks, most, block).collect()
    assert len(got) == len(rows)
    assert {(x["job_id"], x["file_id"]): x["batch"] for x in got} == looped(rows, chunks, most)
    assert sorted(str(x["n_chunks"]) for x in got) == sorted(str(x[3]) for x in rows)


def test_batches_of_nothing_and_of_no_size(spark):
    empty = spark.createDataFrame([], FILES)
    assert ingest.embed_batches(empty).collect() == []
    with pytest.raises(ValueError, match="block"):
        ingest.embed_batches(empty, block=4)


def test_numbers_within_a_value(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None, "hot", "hot"]), i, r.randrange(50)) for i in range(300)]
    got = numbered_within(spark.createDataFrame(rows, "g string, i long, o long"), "g", ["o", "i"], "k").collect()
    want = {}
    for g in {x[0] for x in rows}:
        for k, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (x[2], x[1]))):
            want[x[1]] = k
    assert {x["i"]: x["k"] for x in got} == want
