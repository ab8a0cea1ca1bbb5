"""Connectors: registry, pages, what is pushed, and walks over them."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ingest
from lodestone.sources import connectors

SCHEMA = "id string, parent_id string, name string, mime string, target_id string, target_mime string, trashed boolean, size long"
PDF = ingest.READ[0]


@pytest.fixture(scope="module")
def drive(spark, tmp_path_factory):
    rows = [("root", None, "Base", connectors.FOLDER, None, None, False, None), ("a/b:ä", "root", "A", connectors.FOLDER, None, None, False, None), ("empty", "root", "E", connectors.FOLDER, None, None, False, None)]
    rows += [(f"f{i}", "a/b:ä", f"n{i:04}", PDF if i % 3 else "image/png", None, None, i % 10 == 9, i) for i in range(500)]
    rows += [("odd", "", "in a folder without a name", PDF, None, None, False, 1)]
    rows += [("s", "root", "short", ingest.SHORTCUT, "a/b:ä", connectors.FOLDER, None, None)]
    path = f"file://{tmp_path_factory.mktemp('drive')}/d"
    connectors.write_drive(spark.createDataFrame(rows, SCHEMA), path)
    return path


def test_unknown_connectors_and_columns_raise(spark, drive):
    with pytest.raises(ValueError, match="Unknown source connector: 'box'"):
        connectors.listing(spark, "box", path=drive)
    with pytest.raises(ValueError, match="size"):
        connectors.listing(spark, "drive", {"size": [1]}, path=drive)
    assert connectors.connectors()["drive"] is connectors.Drive
    with pytest.raises(Exception, match="path"):
        connectors.listing(spark, "drive").count()


def test_pages_hold_a_hundred_entries_in_listing_order(spark, drive):
    rows = connectors.listing(spark, "drive", {"parent_id": ["a/b:ä"]}, path=drive).collect()
    assert len(rows) == 450
    assert [r["name"] for r in rows] == sorted(r["name"] for r in rows)
    sizes = {}
    for r in rows:
        sizes[r["page"]] = sizes.get(r["page"], 0) + 1
    assert max(sizes.values()) == connectors.PAGE
    top = connectors.listing(spark, "drive", {"parent_id": ["root"]}, path=drive).collect()
    assert [r["name"] for r in top] == ["A", "E", "short"]


def test_wanted_folders_alone_are_opened(spark, drive):
    some = connectors.listing(spark, "drive", {"parent_id": ["root", "no such"], "mime": [connectors.FOLDER]}, path=drive)
    assert some.rdd.getNumPartitions() == 1 and {r["id"] for r in some.collect()} == {"a/b:ä", "empty"}
    assert connectors.listing(spark, "drive", {"parent_id": ["empty"]}, path=drive).count() == 0


def test_filters_are_pushed_with_the_option(spark, drive):
    rows = connectors.listing(spark, "drive", pushdown="true", path=drive)
    some = rows.where((F.col("parent_id") == "a/b:ä") & F.col("mime").isin(PDF, "x") & (F.col("size") > 100))
    plan = some._jdf.queryExecution().explainString(some.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "parent_id" in pushed and "mime" in pushed and "size" not in pushed
    want = sum(1 for i in range(101, 500) if i % 3 and i % 10 != 9)
    assert some.count() == want and some.rdd.getNumPartitions() == 1


def test_a_frame_without_the_option_can_be_filtered_twice(spark, drive):
    rows = connectors.listing(spark, "drive", path=drive)
    a, b = rows.where("parent_id = 'root'"), rows.where("parent_id = 'a/b:ä'")
    assert a.union(b).count() == 453 and a.count() == 3 and b.count() == 450
    assert rows.where("parent_id is null").count() == 1
    assert connectors.listing(spark, "drive", {"parent_id": [""]}, path=drive).first()["id"] == "odd"


def test_walk_goes_through_shortcuts_once(spark, drive):
    rows = connectors.listing(spark, "drive", path=drive).withColumn("trashed", F.lit(False))
    found = ingest.walk(ingest.listed(rows), ["root"]).collect()
    assert len(found) == sum(1 for i in range(500) if i % 3 and i % 10 != 9) and {r["path"].split("/")[1] for r in found} == {"A"}
