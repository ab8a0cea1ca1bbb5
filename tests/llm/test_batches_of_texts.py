"""What a Python worker of op2 holds follows from pieces of a batch of texts, not from the batch."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import lm_scoring


def sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])


def test_batches_are_bounded_in_bytes(spark):
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with lm_scoring.small_batches(spark):
        found = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 15_000_000 and max(found) < 1.2 * lm_scoring.BATCH
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_pieces_are_all_rows_in_order():
    size = lm_scoring.TOGETHER
    texts = ["a" * (size // 3)] * 7 + [None, "", "b" * (2 * size), "c", None]
    pieces = list(lm_scoring.pieces_of(pa.RecordBatch.from_pydict({"text": texts})))
    assert [x for _, _, part in pieces for x in part] == [None if x is None else x.encode() for x in texts]
    assert [lo for lo, _, _ in pieces] == [0, *(hi for _, hi, _ in pieces[:-1])] and pieces[-1][1] == len(texts)
    assert all(sum(len(x or b"") for x in part) <= size or len(part) == 1 for _, _, part in pieces)
    assert list(lm_scoring.pieces_of(pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())}))) == []


def test_a_worker_holds_pieces_of_a_batch():
    rng = np.random.default_rng(0)
    words = np.array([f"w{i}" for i in range(50_000)])
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(rng.choice(words, 2_000)) for _ in range(3_000)]})
    assert batch.nbytes > 32 << 20
    guesses = lm_scoring.Guesses(np.zeros(1 << lm_scoring.GUESS_BITS, np.uint32), np.zeros(1 << lm_scoring.GUESS_BITS, np.int32))
    tracemalloc.start()
    written = list(lm_scoring._gather(SimpleNamespace(value=guesses))(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows = [r for b in written for r in zip(*(b.column(i).to_pylist() for i in (0, 1, 2)))]
    assert most < 118 << 20, most  # of it what is written
    kinds = {k: [r for r in rows if r[0] == k] for k in (lm_scoring.HEADS, lm_scoring.TOKEN)}
    assert sum(r[2] for r in kinds[lm_scoring.TOKEN]) == sum(r[2] for r in kinds[lm_scoring.HEADS]) == 6_003_000
    assert len(kinds[lm_scoring.TOKEN]) == len({r[1] for r in kinds[lm_scoring.TOKEN]}) == 50_001  # summed before they are written
