"""What graph queries hold and write: keys aren't made distinct in tasks, edges are written once."""

from lodestone.operators import graph, kg

EDGES = "id string, source string, target string, relationship_type string, weight double"


def edges(spark):
    return spark.createDataFrame([(f"{t}{i}", f"n{i}", f"n{i + 1}", t, 1.0) for t in "ab" for i in range(6)], EDGES)


def test_insertion_holds_no_distinct_keys_of_base(spark):
    base = edges(spark)
    more = spark.createDataFrame([("z", "n0", "n1", "a", 5.0), ("y", "n0", "n1", "c", 6.0), ("x", "n0", "n1", "c", 7.0)], EDGES)
    for key, ids in ((["source", "target", "relationship_type"], {"x"}), (["id"], {"x", "y", "z"})):
        out = kg.merged_graph(base, more, key)
        assert {r["id"] for r in out.collect()} == {r["id"] for r in base.collect()} | ids
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate") == (2 if "relationship_type" in key else 1), plan  # more's rows by key, and its types


def test_edges_of_a_neighbourhood_are_written_once(spark, monkeypatch):
    names = []
    kept = graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, name="table": names.append(name) or kept(df, name))
    entities = spark.createDataFrame([(f"n{i}", f"N{i}", "t", None) for i in range(7)], "id string, name string, entity_type string, description string")
    nodes, among, _ = graph.neighbourhood(entities, edges(spark), "n3", 2, 50)
    assert sorted(r["id"] for r in nodes.collect()) == ["n1", "n2", "n3", "n4", "n5"] and among.count() == 8
    assert names.count("edges") == 1 and "ends" not in names
