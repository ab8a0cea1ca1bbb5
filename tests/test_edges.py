"""Cases that the generated tables don't hold."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import chunking
from lodestone.operators import changes, chat, clusters, graph, ingest, kg, retrieval, vector
from lodestone.sources import jsonl
from lodestone.streaming import stateful

EDGES = "id string, source string, target string, relationship_type string, weight double"


def test_vectors(spark):
    v = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, None), (3, 2, [0.0, 0.0]), (4, 2, [1.0, 1.0]), (5, 2, [1.0])], "chunk_id long, document_id long, embedding array<double>")
    got = vector.search(v, [1.0, 0.0], 5, 0.5).collect()
    assert [(r.chunk_id, round(r.similarity, 4)) for r in got] == [(1, 1.0), (4, 0.7071)]
    assert vector.search(v, [], 5, 0.0).count() == 0
    assert vector.search(v, [0.0] * 300, 5, 0.0).count() == 0


def test_graph(spark):
    e = spark.createDataFrame([("1", "a", "a", "T", 1.0), ("2", "a", "b", "T", 1.0), ("3", "b", "a", "T", 1.0), ("4", "b", "c", "U", 1.0), ("5", "x", "missing", "U", 1.0)], EDGES)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(graph.neighbours(e, "a", 2, None, both=False)) == ["a", "b", "c"]
    assert ids(graph.neighbours(e, "c", 1, None, both=False)) == []
    assert [(r.id, r.direction) for r in graph.incident(e, "a").orderBy("id", "direction").collect()] == [("1", "out"), ("2", "out"), ("3", "in")]
    assert ids(graph.induced_edges(e, spark.createDataFrame([("a",), ("c",)], "id string"))) == ["1"]


def test_kg(spark):
    c = spark.createDataFrame([(2, 1, "Foo", "T", "late"), (1, 5, "FOO", "t", "first"), (1, 6, " ", "T", None), (1, 7, None, "T", None), (3, 0, "foo", "U", None)], "chunk long, position long, name string, entity_type string, description string")
    assert sorted((r.name, r.entity_type, r.description, r.mentions) for r in kg.first_entities(c).collect()) == [("FOO", "t", "first", 2), ("foo", "U", None, 1)]
    ents = spark.createDataFrame([("e1", "Foo", 1), ("e2", "foo", 2), ("e3", "Bar", 3)], "id string, name string, ordinal long")
    raw = spark.createDataFrame([("FOO", "bar", "R"), ("foo", "Foo", "R"), ("foo", "nobody", "R")], "source string, target string, type string")
    assert [tuple(r) for r in kg.resolved_relationships(raw, ents).collect()] == [("e2", "e3", "R")]


def test_clusters(spark):
    tree = spark.createDataFrame([("r", "R", None), ("n", "N", "r"), ("m", "M", "n"), ("o", "O", "gone")], "id string, label string, parent_id string")
    members = spark.createDataFrame([("1", "r"), ("2", "n"), ("3", "m"), ("4", "o")], "node_id string, cluster_id string")
    placed = lambda tier: sorted(map(tuple, clusters.node_clusters(tree, members, tier).collect()))
    assert placed(1) == [("1", "r"), ("2", "r"), ("3", "r")]
    assert placed(2) == [("1", "r"), ("2", "n"), ("3", "n")]
    assert len(placed(3)) == 4


def test_guards(spark):
    size = spark.createDataFrame([(None,), (0,), (50 * 1024 * 1024,), (50 * 1024 * 1024 + 1,)], "s long").select(ingest.size_action(F.col("s")).alias("a"))
    assert [r.a for r in size.collect()] == ["pending", "pending", "pending", "skipped"]


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "n": 2}\n\nnot json\n{"id": "2", "n": 3}\n')
    got = jsonl.read_jsonl(spark, [f"{tmp_path}/a.jsonl", f"{tmp_path}/none.jsonl"], "id string, n long")
    assert sorted((r.id, r.n) for r in got.collect()) == [("1", 2), ("2", 3)]
    assert jsonl.read_jsonl(spark, [f"{tmp_path}/none.jsonl"], "id string").count() == 0


def _streamed(spark, tmp_path, rows, schema, f, mode):
    source = f"{tmp_path}/in"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    name = f"t_{abs(hash(str(tmp_path)))}"
    stream = f(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source))
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_stream_of_stages(spark, tmp_path):
    got = _streamed(spark, tmp_path, [("f", "pending", 1), ("f", "kg_done", 3), ("f", "extracting", 2), ("g", "failed", 1)], "file_id string, stage string, ts long", stateful.file_states, "complete")
    assert sorted((r.file_id, r.stage, r.ended) for r in got) == [("f", "kg_done", True), ("g", "failed", True)]


def test_stream_of_batches(spark, tmp_path):
    rows = [("j", f"f{i}", n) for i, n in enumerate([60, 50, 10, 10, 10, 10, 10, 5])]
    got = _streamed(spark, tmp_path, rows, "job_id string, file_id string, n_chunks long", stateful.embed_batches, "append")
    assert sorted((r.file_id, r.batch) for r in got) == [("f0", 0), ("f1", 0), ("f2", 1), ("f3", 1), ("f4", 1), ("f5", 1), ("f6", 1), ("f7", 2)]


def test_stream_of_requests(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(i, 1, t + dt.timedelta(seconds=s)) for i, s in enumerate([0, 10, 20, 61, 62, 200])]
    got = _streamed(spark, tmp_path, rows, "event_id long, user_id long, ts timestamp", lambda df: stateful.rate_limits(df, 60, 2), "append")
    batch = ingest.rate_limited(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp"), 60, 2).collect()
    want = [(0, 0, True), (1, 1, True), (2, 2, False), (3, 2, False), (4, 3, False), (5, 0, True)]
    for found in (got, batch):
        assert sorted((r.event_id, r.recent, r.allowed) for r in found) == want


def test_walk_without_end(spark):
    """Deeper than any fixed number of levels, with a shortcut back to the top, trash and a shortcut to a file."""
    folder, cut, pdf = ingest.FOLDER, ingest.SHORTCUT, ingest.READ[0]
    rows = [("d0", None, "top", folder, None, None, False)]
    rows += [(f"d{i}", f"d{i - 1}", f"n{i}", folder, None, None, False) for i in range(1, 40)]
    rows += [("back", "d39", "again", cut, "d0", folder, False), ("f", "d39", "deep.pdf", pdf, None, None, False), ("g", "d1", "gone.pdf", pdf, None, None, True), ("h", "d1", "link", cut, "f", pdf, None)]
    entries = ingest.listed(spark.createDataFrame(rows, "id string, parent_id string, name string, mime string, target_id string, target_mime string, trashed boolean"))
    found = ingest.walk(entries, ["d0"]).collect()
    assert [(r.id, r.path.count("/")) for r in found] == [("f", 40)]
    assert ingest.walk(entries, ["none"]).count() == 0


def test_cluster_levels(spark):
    """More levels than sixteen; a cycle and what hangs on it have no root."""
    rows = [("c0", "c0", None)] + [(f"c{i}", f"c{i}", f"c{i - 1}") for i in range(1, 25)] + [("x", "x", "y"), ("y", "y", "x"), ("z", "z", "y")]
    tree = spark.createDataFrame(rows, "id string, label string, parent_id string")
    up = {r.id: (r.root, r.second, r.depth) for r in clusters.ancestry(tree).collect()}
    assert len(up) == 25 and up["c24"] == ("c0", "c1", 24) and up["c0"] == ("c0", None, 0)


def test_dominant_type_at_a_tie(spark):
    placed = spark.createDataFrame([("1", "c"), ("2", "c"), ("3", "c"), ("4", "c")], "node_id string, cluster_id string")
    types = spark.createDataFrame([("1", "Z"), ("2", "A"), ("3", "A"), ("4", "Z")], "id string, entity_type string")
    assert [tuple(r) for r in clusters.dominant_type(placed, types).collect()] == [("c", "Z", 2)]


def test_lonely_node(spark):
    ents = spark.createDataFrame([("a", "A", "T", None), ("b", "B", "T", None)], "id string, name string, entity_type string, description string")
    edges = spark.createDataFrame([("1", "b", "b", "T", 1.0)], EDGES)
    nodes, among, totals = graph.neighbourhood(ents, edges, "a")
    assert ([r.id for r in nodes.collect()], among.count(), tuple(totals.first())) == (["a"], 0, (1, 0))
    nodes, among, totals = graph.neighbourhood(ents, edges, "b")
    assert ([r.id for r in nodes.collect()], among.count(), tuple(totals.first())) == (["b"], 1, (1, 1))


def test_insert_if_absent(spark):
    base = spark.createDataFrame([("1", "old")], "id string, v string")
    more = spark.createDataFrame([("1", "new"), ("2", "b"), ("2", "a"), (None, "n")], "id string, v string")
    assert sorted(map(tuple, kg.inserted(base, more, ["id"], ["v"]).collect()), key=str) == [("1", "old"), ("2", "a"), (None, "n")]


JOBS = "job_id string, total_files long, processed_files long, failed_files long, skipped_files long, started_at timestamp, status string, folder_id string, error_message string, completed_at timestamp"


def test_jobs(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    job = lambda i, status, hours: (i, 1, 0, 1, 0, t - dt.timedelta(hours=hours), status, None, None, None)
    jobs = spark.createDataFrame([job("a", "processing", 3), job("b", "completed", 9), job("c", "failed", 1)], JOBS)
    files = spark.createDataFrame([("f", "c", "failed", "failed"), ("g", "b", "completed", "kg_done")], "id string, job_id string, status string, stage string")
    now = "2024-01-01 00:00:00"
    assert {r.job_id: r.status for r in changes.triggered(jobs, "n", now).collect()} == {"a": "failed", "b": "completed", "c": "failed", "n": "pending"}
    with pytest.raises(changes.JobRunningError):
        changes.triggered(jobs, "n", "2023-12-31 22:00:00")
    with pytest.raises(changes.NotFoundError):
        changes.with_cancelled(jobs, "none", now)
    with pytest.raises(ValueError):
        changes.retried(jobs, files, "b")
    again, reset = changes.retried(jobs, files, "c")
    assert {r.job_id: (r.status, r.failed_files) for r in again.collect()}["c"] == ("processing", 0)
    assert {r.id: r.stage for r in reset.collect()} == {"f": "pending", "g": "kg_done"}


def test_steps(spark):
    """A result ends the latest call of its name that runs; one that none waits for is ignored."""
    rows = [
        (1, "tool_result", "x", "r0", False), (2, "tool_start", "x", None, False), (3, "tool_start", "x", None, False), (4, "tool_start", "y", None, False),
        (5, "tool_result", "x", "r1", True), (6, "tool_result", "x", "r2", False), (7, "tool_result", "x", "r3", False), (8, "tool_start", "x", None, False),
        (9, "narration_end", None, "so", False), (10, "token", None, "a", False), (11, "token", None, "b", False),
    ]
    e = spark.createDataFrame([(1, *r) for r in rows], "run_id long, seq long, event string, name string, content string, failed boolean")
    got = {r.seq: (r.kind, r.status, r.summary) for r in chat.assembled_steps(e).collect()}
    assert got == {2: ("tool_call", "done", "r2"), 3: ("tool_call", "error", "r1"), 4: ("tool_call", "running", None), 8: ("tool_call", "running", None), 9: ("narration", None, None)}
    assert [r.answer for r in chat.answers(e).collect()] == ["ab"]


def test_citation_scores(spark):
    """The first measure that is there counts, though it is null; what isn't an object is skipped."""
    rows = [(1, '{"content": "x", "similarity": null, "score": 0.5}'), (2, '[{"content": "x", "score": 0.5}, "text", {"content": ""}]'), (3, '{"content": "x"}'), (4, None)]
    got = chat.citations(spark.createDataFrame(rows, "call_id long, result string")).collect()
    assert sorted((r.call_id, r.ordinal, r.score) for r in got) == [(1, 0, None), (2, 0, 0.5), (3, 0, 0.0)]


def test_required(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert chat.required(ids("a", "a"), ids("a", "b")).count() == 1
    with pytest.raises(LookupError, match="x, y"):
        chat.required(ids("a", "x", "y"), ids("a"))


def test_hybrid_ties(spark):
    """Relevances above 1 are cut to 1, and keep their search's order."""
    v = spark.createDataFrame([(10, 1, [1.0, 0.0]), (9, 1, [1.0, 0.0])], "chunk_id long, document_id long, embedding array<double>")
    words = " ".join(["rare"] * 40)
    e = spark.createDataFrame([("b", "rare rare rare", "T", words), ("a", "rare", "T", None)] + [(f"z{i}", "other", "T", None) for i in range(3000)], "id string, name string, entity_type string, description string")
    got = retrieval.hybrid(v, e, "rare", [1.0, 0.0], k=4).collect()
    assert [r.key for r in got] == ["chunk:9", "chunk:10", "entity:b", "entity:a"]


def test_ranges(spark):
    e = spark.createDataFrame([], EDGES)
    for call in (lambda: graph.neighbours(e, "a", 4), lambda: graph.visualization(e, e, None, 0), lambda: vector.search(e, [1.0], 0), lambda: chat.page(e, [], 0, 5), lambda: retrieval.hybrid(e, e, "x", [1.0], vector_weight=2.0)):
        with pytest.raises(ValueError):
            call()


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(str(i), "ab"[i % 2], "x" * 50) for i in range(400)], "id string, kind string, text string")
    jsonl.write_jsonl(df, f"{tmp_path}/out", "kind", file_bytes=5_000)
    made = jsonl.export_manifest(df, f"{tmp_path}/out", "kind", "1.0.9")
    assert (made["version"], made["counts"]) == ("1.0.10", {"a": 200, "b": 200})
    files = list((tmp_path / "out").rglob("*.json"))
    assert len(files) >= 6 and max(f.stat().st_size for f in files) < 6_000
    assert jsonl.verified(spark, f"{tmp_path}/out", made)
    files[0].write_text("{}")
    for crc in files[0].parent.glob(f".{files[0].name}.crc"):
        crc.unlink()
    assert not jsonl.verified(spark, f"{tmp_path}/out", made)


def test_results_with_errors(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 50), (4, "words " * 3)], "doc_id long, text string")
    got = {r.doc_id: (r.n_chunks, r.total_characters, r.error) for r in chunking.results(d, most=40).collect()}
    assert got == {1: (0, 0, "no text"), 2: (0, 0, None), 3: (0, 0, "more than 40 characters"), 4: (1, 18, None)}
