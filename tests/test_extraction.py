"""Mentions, relations and classifications on small texts and answers."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import extraction


def found(spark, *texts):
    chunks = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "document_id string, chunk_index int, content string")
    return extraction.extracted(chunks)


def test_mentions_by_form_and_context(spark):
    text = "Alone starts. We met in New York with Ann Lee, wrote to a.b@mail.example.org from 10.0.0.1 or +1 (521) 555-2373. The End, by Éva"
    rows = extraction.candidates(found(spark, text)).orderBy("position").collect()
    assert [(r["name"], r["entity_type"]) for r in rows] == [
        ("a.b@mail.example.org", "Email"), ("10.0.0.1", "Address"), ("+1 (521) 555-2373", "Phone"), ("New York", "Place"), ("Ann Lee", "Person"), ("End", "Work"), ("Éva", "Person"),
    ]


def test_texts_without_mentions_have_no_row(spark):
    assert found(spark, None, "", "nothing here. Or here. ", "A b C").count() == 0


def test_mentions_are_those_of_the_plain_patterns(spark):
    """Odd texts against NAME and FORMS as they stand; the looked-for patterns try fewer places."""
    r = random.Random(8)
    parts = ["Rome", "Éva", "Ab-Cd", "x", "in", " ", "  ", "\t", "\n", ".", "!", "-", "a.b@c.example", "@", "+1 (521) 555-2373", "10.0.0.1", "Ll9", "\u00a0", "\U0001f600", "ÀB c", "B"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(600)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    plain = [F.regexp_extract_all("t", F.lit(extraction.NAME), F.lit(g)) for g in (1, 2)] + [F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in extraction.FORMS.values()]
    kind = lambda b: next((t for t, words in extraction.CONTEXTS.items() if b.lower() in words), "Name")
    for row in df.select("t", *(c.alias(f"c{i}") for i, c in enumerate(plain)), extraction.mentions(F.col("t")).alias("got")).collect():
        if row["t"] is None:
            assert row["got"] is None
            continue
        want = [(x, k) for k, c in zip(extraction.FORMS, ("c2", "c3", "c4"), strict=True) for x in row[c]] + [(n, kind(b)) for b, n in zip(row["c0"], row["c1"], strict=True)]
        assert [tuple(x) for x in row["got"]] == want, row["t"]


def test_texts_are_looked_through_once(spark):
    """Conditions on mentions don't repeat the search, and a chunk isn't cut from the whole text again."""
    f = found(spark, "go to Rome with Ann")
    for df in (extraction.candidates(f), extraction.co_mentions(f)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1 + len(extraction.FORMS), plan


def test_chunks_are_pieces_of_equal_length(spark, tmp_path):
    from lodestone.sources.tables import Model

    texts = ["", None, "x", "é\U0001f600\n" * 7, "\n\r\u2028" * 10, "a" * 20, "b" * 21]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["document_id"], r["chunk_index"], r["content"]) for r in Model(spark, str(tmp_path)).chunks(10).collect())
    assert got == sorted((f"doc:{i}", j // 10, t[j : j + 10]) for i, t in enumerate(texts) if t for j in range(0, len(t), 10))


@pytest.mark.parametrize("window", [1, 3])
def test_relations_reach_as_far_as_the_window(spark, window):
    names = ["Xa", "Xb", "xa Xa", "Xc", "Xb", "Xd"]
    text = "go " + ", ".join(f"to {n}" for n in names)
    f = found(spark, text, "just Xa here, one Xa more")
    order = [r["name"] for r in extraction.candidates(f).where("chunk = 0").orderBy("position").collect()]
    assert order == re.findall(r"X\w", text)
    want = sorted((a, b) for i, a in enumerate(order) for b in order[i + 1 : i + 1 + window] if a.lower() != b.lower())
    got = sorted((r["source"], r["target"]) for r in extraction.co_mentions(f, window).collect())
    assert got == want


def test_answers_of_all_kinds(spark):
    answers = {
        "array": 'Here:\n```json\n[{"file_id": "1", "a": 1}, {"file_id": "2", "b": [1, {"c": null}]}, {"x": 1}, 7, {"file_id": "", "z": 1}, {"file_id": "1", "a": 2}]\n```',
        "one": '{"file_id": "1", "k": "v"}',
        "all": 'I think {"k": "é"} fits',
        "broken": '[{"file_id": "1"',
        "number": "12",
        "empty": "",
        "null": None,
        "other": '{"file_id": 1, "k": 2}',
    }
    files = spark.createDataFrame([(f, i) for f in [*answers, "none"] for i in ("1", "2")], "folder string, file_id string").withColumn("size", F.lit(3))
    rows = spark.createDataFrame(list(answers.items()), "folder string, answer string")
    got = {(r["folder"], r["file_id"]): json.loads(r["classification"]) for r in extraction.classifications(files, rows).collect()}
    want = {(f, i): {} for f in [*answers, "none"] for i in ("1", "2")}
    want |= {("array", "1"): {"a": 2}, ("array", "2"): {"b": [1, {"c": None}]}, ("one", "1"): {"k": "v"}, ("all", "1"): {"k": "é"}, ("all", "2"): {"k": "é"}, ("other", "1"): {"k": 2}}
    assert got == want
