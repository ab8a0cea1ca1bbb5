"""Relationships of the tables: what a task holds doesn't grow with them, and an export shuffles whole edges once a join less."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.operators import graph
from lodestone.sources import tables


@pytest.fixture
def shuffled_joins(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()))


def test_export_does_not_shuffle_edges_for_their_targets(spark, sf_dir, shuffled_joins):
    out = entry.queries()["graph_export_edges"](spark, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(target#\d+, \d+\), ENSURE_REQUIREMENTS", plan)) == 1, plan  # the entities, not the edges
    assert len(re.findall(r"hashpartitioning\(source#\d+, \d+\), ENSURE_REQUIREMENTS", plan)) == 2
    assert plan.index("[source#") < plan.index("SortMergeJoin [target#")  # a source's edges come in a row to the sort's shuffle


def test_export_is_whole_and_in_order(spark, sf_dir):
    m = tables.Model(spark, sf_dir)
    ends = {r["id"]: (r["name"], r["entity_type"]) for r in m.entities().collect()}
    got = [tuple(r) for r in entry.queries()["graph_export_edges"](spark, sf_dir).collect()]
    want = [(*r, *ends[r["source"]], *ends[r["target"]]) for r in m.relationships().collect() if r["source"] in ends and r["target"] in ends]
    assert len(got) > 5_000 and sorted(got) == sorted(want)
    assert [(x[3], x[5], x[0]) for x in got] == sorted((x[3], x[5], x[0]) for x in got)


def test_export_leaves_out_edges_without_an_end(spark):
    edges = spark.createDataFrame([("1", "a", "b", "R", 1.0), ("2", "a", "x", "R", 1.0), ("3", "x", "a", "R", 1.0), ("4", "a", None, "R", 1.0)], "id string, source string, target string, relationship_type string, weight double")
    ents = spark.createDataFrame([("a", "A", "t"), ("b", "B", "u")], "id string, name string, entity_type string")
    assert [tuple(r) for r in graph.exported_edges(edges, ents).collect()] == [("1", "a", "b", "R", 1.0, "A", "t", "B", "u")]


@pytest.mark.parametrize("by", ["source", "target"])
def test_relationships_are_the_same_by_an_end(spark, sf_dir, by):
    m = tables.Model(spark, sf_dir)
    found = m.relationships(by)
    assert found.columns == m.relationships().columns and rows(found) == rows(m.relationships())
    assert found.select(by, F.spark_partition_id().alias("p")).distinct().groupBy(by).count().where("count > 1").isEmpty()


def test_tasks_hold_a_bounded_number_of_edges(spark, sf_dir, monkeypatch):
    m = tables.Model(spark, sf_dir)
    want = rows(entry.queries()["cluster_edges"](spark, sf_dir))
    monkeypatch.setattr(tables, "LINES", 100, raising=False)
    many = m.relationships().where("relationship_type in ('SUPPLIED_BY', 'ORDERED')")
    most = many.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 250 < many.count() / 8  # not the rows of one in eight tasks
    assert rows(entry.queries()["cluster_edges"](spark, sf_dir)) == want


def test_many_nodes_are_not_sent_whole_to_each_task(spark, sf_dir, monkeypatch):
    want = rows(entry.queries()["cluster_edges"](spark, sf_dir))
    monkeypatch.setattr("lodestone.operators.clusters.BROADCAST", 10)
    out = entry.queries()["cluster_edges"](spark, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [target" not in plan and "BroadcastHashJoin [source" not in plan, plan
    assert not re.search(r"hashpartitioning\((source|target)#\d+, \d+\), ENSURE_REQUIREMENTS", plan), plan  # edges come by their sources
    assert rows(out) == want
