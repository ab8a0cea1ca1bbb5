"""Stages with commits: a run that is stopped and started again ends as an unbroken one."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import embedding, vector
from lodestone.streaming import staged


def rows(n):
    text = "We went to Rome with Ann Lee, as said. " * 40
    return [(i, None if i % 7 == 0 else f"{text}{i}", i * 1000, "403: fileNotExportable" if i % 11 == 1 else "timeout" if i % 11 == 2 else None, "pending", None) for i in range(n)]


def incoming(spark, path, n=60, files=3):
    spark.createDataFrame(rows(n), staged.FILES).repartition(files, "doc_id").write.parquet(path)
    return lambda: spark.readStream.schema(staged.FILES).option("maxFilesPerTrigger", 1).parquet(path)


def pipeline(spark, root):
    return staged.ingestion(spark, root, most_mb=50_000 / (1 << 20), failing=F.when(F.col("document_id") == "30", 3))


def whole(p):
    return (
        sorted(map(tuple, p.states(staged.FILES).select("doc_id", "stage", "error").collect()), key=str),
        sorted(map(tuple, p.table("chunks").select("document_id", "chunk_index").collect())),
        sorted(map(tuple, p.table("vectors").select("document_id", "chunk_index").collect())),
        sorted(map(tuple, p.table("mentions").select("document_id", "chunk", "position", "name").collect())),
    )


@pytest.fixture(scope="module")
def unbroken(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('staged')}"
    p = pipeline(spark, f"{root}/out")
    p.run(incoming(spark, f"{root}/in")())
    return whole(p)


def test_states_and_tables_of_a_whole_run(unbroken):
    states = {i: (stage, error) for i, stage, error in unbroken[0]}
    assert len(states) == 60
    assert states[1] == ("skipped", "403: fileNotExportable") and states[2] == ("failed", "timeout") and states[7] == ("failed", "no text")
    assert states[55] == ("skipped", "larger than 0.0476837 MB") and states[30][0] == "embed_failed" and states[3] == ("kg_done", None)
    chunked, embedded, named = ({i for i, *_ in table} for table in unbroken[1:])
    assert chunked - embedded == {"30"} and embedded == named == {str(i) for i, (s, _) in states.items() if s == "kg_done"}


@pytest.mark.parametrize("broken", ["downloaded", "embedded", "linked"])
def test_a_run_that_fails_between_stages_goes_on(spark, tmp_path, unbroken, broken):
    root = f"file://{tmp_path}"
    stream = incoming(spark, f"{root}/in")
    ran = []

    def watched(p, fails):
        for i, stage in enumerate(p.stages):
            def run(files, read, stage=stage):
                if fails and stage.name == broken and ran.count((stage.name,)) == 1:
                    raise RuntimeError("stopped here")
                ran.append((stage.name,))
                return stage.run(files, read)

            p.stages[i] = staged.Stage(stage.name, stage.after, run, stage.tables)
        return p

    with pytest.raises(Exception, match="stopped here"):
        watched(pipeline(spark, f"{root}/out"), True).run(stream())
    p = watched(pipeline(spark, f"{root}/out"), False)
    p.run(stream())
    assert whole(p) == unbroken
    assert all(ran.count((s.name,)) == 3 for s in p.stages)  # each stage ran once a batch: what was committed wasn't run again
    p.run(stream())  # nothing is left
    assert whole(p) == unbroken


def test_a_write_that_was_cut_short_is_written_anew(spark, tmp_path, unbroken):
    root = f"file://{tmp_path}"
    stream = incoming(spark, f"{root}/in")
    p = pipeline(spark, f"{root}/out")
    spark.createDataFrame(rows(3), staged.FILES).write.parquet(f"{root}/out/extracted/batch=0")
    (tmp_path / "out/extracted/batch=0/_SUCCESS").unlink()
    assert p.states(staged.FILES).count() == 0
    p.run(stream())
    assert whole(p) == unbroken


def test_vectors_and_failures(spark):
    chunks = spark.createDataFrame([("a", i, f"word{i} again {i}") for i in range(250)] + [("b", 0, "word1 again 1"), ("c", 0, ""), ("d", 0, None), ("e", 0, "x")], "document_id string, chunk_index int, content string")
    fails = F.when((F.col("document_id") == "a") & (F.col("chunk_index") == 120), 2).when(F.col("document_id") == "e", 9).otherwise(0)
    outcome = {(r["document_id"], r["batch"]): (r["chunks"], r["attempts"], r["wait_seconds"], r["failed"]) for r in embedding.batch_outcomes(chunks, fails).collect()}
    assert outcome[("a", 0)] == (100, 1, 0, False) and outcome[("a", 1)] == (100, 3, 3, False) and outcome[("a", 2)] == (50, 1, 0, False)
    assert outcome[("e", 0)] == (1, 3, 3, True)
    v, bad = embedding.embedded(chunks, fails, dims=16)
    assert [tuple(r) for r in bad.collect()] == [("e", 1, "Failed to embed chunks: batch 0 after 3 attempts")]
    found = {(r["document_id"], r["chunk_index"]): r["embedding"] for r in v.collect()}
    assert len(found) == 253 and found[("a", 1)] == found[("b", 0)] and len(found[("a", 1)]) == 16
    assert abs(sum(x * x for x in found[("a", 7)]) - 1) < 1e-6 and set(found[("c", 0)]) == set(found[("d", 0)]) == {0.0}
    near = vector.search(v.select(F.concat("document_id", "chunk_index").alias("chunk_id"), "document_id", "embedding"), embedding.query_vector(spark, "WORD1, again 1", 16), k=2, threshold=0.99)
    assert {r["chunk_id"] for r in near.collect()} == {"a1", "b0"}


def test_the_query_has_four_batches_of_many_files(spark, sf_dir, monkeypatch):
    """A batch is dealt over all tasks, not read from one file."""
    from lodestone.plans import ingestion_runs
    from lodestone.sources.tables import Model

    seen = []
    run = staged.Pipeline.run_batch
    monkeypatch.setattr(staged.Pipeline, "run_batch", lambda self, files, batch: (seen.append(files.rdd.getNumPartitions()), run(self, files, batch)) and None)
    assert ingestion_runs._ran(Model(spark, sf_dir)).states(staged.FILES).count() > 0
    assert len(seen) == 4 and min(seen) > 1
