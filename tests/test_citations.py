"""Citations of documents without a text or with a very long one, against SQL; results with items that no variant holds."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.operators import chat
from lodestone.plans import catalog

TEXTS = {0: None, 1: None, 2: None, 3: "", 4: "", 6: "a", 7: "b", 9: "long", 10: "long", 13: " "}


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """A folder with documents of TEXTS; long ones have 21,000,000 characters, more than parse_json reads in a text."""
    at = str(tmp_path_factory.mktemp("citations"))
    rows = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    text = F.when(F.col("text") == "long", F.repeat(F.lit("word "), 4_200_000)).otherwise(F.col("text"))
    rows.select("doc_id", text.alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(0).cast("long").alias("n_chars")).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", ["citations_enrich", "citations_extract", "citations_dedup"])
def test_documents_without_text_and_with_a_long_one(spark, texts, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{texts}/documents.parquet/*.parquet')")
    found = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert Counter(tuple(r) for r in catalog.queries()[name](spark, texts).select(*names).collect()) == Counter(found.fetchall())


def test_bare_documents_are_cited_only_when_asked_for(spark):
    rows = spark.createDataFrame([(1, '[{"document_id": "d"}, {"document_id": "e", "content": "x"}, {"document_id": "f", "content": ""}, {"document_id": ""}, {"content": ""}]')], "call_id long, result string")
    assert [r["document_id"] for r in chat.citations(rows).collect()] == ["e"]
    assert [(r["document_id"], r["snippet"]) for r in chat.citations(rows, bare=True).collect()] == [("d", None), ("e", "x"), ("f", "")]


def test_items_beyond_a_variant(spark):
    parts = ('[{"document_id": 5, "similarity": null, "content": "', '"}, "text", null, {"entity_name": "E", "score": 0.5}]')
    rows = spark.range(1).select(F.col("id").alias("call_id"), F.concat(F.lit(parts[0]), F.repeat(F.lit("x"), 135_000_000), F.lit(parts[1])).alias("result"))
    got = chat.citations(rows).collect()
    assert sorted((r["ordinal"], r["document_id"], r["snippet"], r["score"]) for r in got) == [(0, "5", "x" * 200, None), (3, None, "E (): ", 0.5)]
