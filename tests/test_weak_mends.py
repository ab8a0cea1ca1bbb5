"""Bounded relations, decoded attachments, spans of rate limits, settings, artifacts, totals of sections."""

import random
from datetime import datetime, timedelta


from lodestone.functions import chunking
from lodestone.operators import changes, chat, clusters, graph, ingest

EDGES = "id string, source string, target string, relationship_type string, weight double"
NAMES = "id string, name string, entity_type string, description string"


def hub(spark, n=60):
    edges = [(f"e{i}", "hub", f"n{i % n}", "R", 1.0) for i in range(2 * n)]
    ents = [("hub", "Hub", "T", None)] + [(f"n{i}", f"name {i:03}", "T", None) for i in range(n)]
    return spark.createDataFrame(edges, EDGES), spark.createDataFrame(ents, NAMES)


def test_relations_are_bounded_and_rows_are_whole(spark):
    edges, ents = hub(spark)
    found = ents.where("id = 'hub'")
    (row,) = graph.relations(found, edges, ents, most=7).collect()
    assert [r.target for r in row["relations"]] == [f"name {i:03}" for i in range(7)]
    assert len(graph.relations(found, edges, ents).first()["relations"]) == 60 == graph.relation_rows(found, edges, ents).count()


def test_contexts_keep_the_first_lines_in_each_task(spark):
    edges, ents = hub(spark)
    df = graph.contexts(ents.where("id = 'hub'"), edges, ents, most=5)
    assert df.first()["context"].split("\n") == ["Entity: Hub (T)"] + [f"  - R -> name {i:03}" for i in range(5)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "WindowGroupLimit" in plan


def test_attachments_that_are_not_utf8(spark):
    rows = [(1, 1, "a.txt", "text/plain", b"\xff\xfeok\xc3"), (1, 2, "b.txt", "text/plain", "é".encode()), (2, 1, "c.txt", "text/plain", None)]
    out = {r["message_id"]: r["context"] for r in chat.attachment_context(spark.createDataFrame(rows, "message_id long, seq long, file_name string, mime string, content binary")).collect()}
    assert "��ok�" in out[1] and "é" in out[1] and out[2] == ""


def test_rate_limits_equal_a_loop_for_a_user_with_most_requests(spark):
    r = random.Random(6)
    at = datetime(2024, 1, 1)
    rows = [(i, 1 if i % 3 else r.randrange(5), at + timedelta(seconds=r.randrange(900), microseconds=r.choice([0, 0, 1, 999_999]))) for i in range(500)]
    got = {x["event_id"]: (x["recent"], x["allowed"]) for x in ingest.rate_limited(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp"), 60, 10).collect()}
    order = sorted(rows, key=lambda x: (x[2], x[0]))
    for n, (i, user, ts) in enumerate(order):
        recent = sum(1 for _, u, t in order[:n] if u == user and t > ts - timedelta(seconds=60))
        assert got[i] == (recent, recent < 10)


def test_settings_are_created_once(spark):
    schema = "key string, value string, seq long"
    settings = spark.createDataFrame([("a", "old", 1), ("a", None, 2), ("b", "x", 1)], schema)
    asked = spark.createDataFrame([("a", "d"), ("c", "d"), ("c", "d")], "key string, value string")
    everything, found = changes.get_or_created(settings, asked)
    assert sorted(map(tuple, found.collect()), key=str) == [("a", None, False), ("c", "d", True)]
    again, second = changes.get_or_created(everything, asked)
    assert again.count() == everything.count() == 4 and second.where("created").count() == 0


def test_artifacts_of_no_conversation_are_left_out(spark):
    at = [datetime(2024, 1, d) for d in range(1, 6)]
    conversations = spark.createDataFrame([(1, at[1]), (2, at[1])], "conversation_id long, updated_at timestamp")
    schema = "artifact_id string, conversation_id long, title string, created_at timestamp"
    held = spark.createDataFrame([("a", 1, "t", at[0])], schema)
    new = spark.createDataFrame([("a", 1, "again", at[4]), ("b", 1, "t", at[3]), ("c", 9, "t", at[3]), ("d", 2, "t", at[0])], schema)
    newer, artifacts = changes.with_artifacts(conversations, held, new)
    assert {r["artifact_id"] for r in artifacts.collect()} == {"a", "b", "d"}
    assert {r["conversation_id"]: r["updated_at"] for r in newer.collect()} == {1: at[3], 2: at[1]}


def test_totals_of_sections(spark):
    text = "before\n# One\nbody\n\n   \n## Two\n# Three\nlast"
    rows = spark.createDataFrame([(1, text), (2, None), (3, " \n "), (4, "plain")], "doc_id long, text string")
    got = {r["doc_id"]: (r["total_characters"], r["error"]) for r in chunking.results(rows, by_section=True).collect()}
    assert got == {1: (sum(len(b) for _, b in chunking.sections_of(text)), None), 2: (0, "no text"), 3: (0, None), 4: (5, None)}
    assert {r["doc_id"]: r["total_characters"] for r in chunking.results(rows).collect()}[1] == len(text)


def test_cluster_edges_with_and_without_a_broadcast(spark, monkeypatch):
    edges = spark.createDataFrame([("1", "a", "b", "R", 1.0), ("2", "a", "c", "R", 2.0), ("3", "x", "a", "R", 4.0), ("4", "b", "c", "R", 8.0)], EDGES)
    placed = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "B")], "node_id string, cluster_id string")
    want = {("A", "B", 3.0), ("x", "A", 4.0)}
    for bound in (10, 0):
        monkeypatch.setattr(clusters, "BROADCAST", bound)
        assert {(r["source"], r["target"], r["weight"]) for r in clusters.cluster_edges(edges, placed).collect()} == want


def test_parsed_citations_keep_their_kinds(spark):
    results = [(1, '[{"document_id": 5, "content": "x", "similarity": "0.5"}, 3, null, {"entity_name": "E", "score": null, "relevance_score": 1}]'), (2, "broken"), (3, None)]
    rows = chat.citations(spark.createDataFrame(results, "call_id long, result string")).orderBy("ordinal").collect()
    assert [(r["document_id"], r["snippet"], r["score"]) for r in rows] == [("5", "x", 0.5), (None, "E (): ", None)]
