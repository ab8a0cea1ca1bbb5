"""Shards of exports: names, bounds and order, with rows of very uneven size."""

import json
import random

from lodestone.operators import running
from lodestone.sources import jsonl

SCHEMA = "kind string, id long, note string"


def rows(n=400):
    r = random.Random(4)
    return [(("Big one", "small", "Ä/b", None)[i % 4] if i % 10 else "lone", i, "x" * r.choice([1, 5, 40, 300, 2500])) for i in range(n)] + [("tiny", 1, "é")]


def test_shards_keep_the_bound_and_the_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jsonl, "SHARDS", 5)
    df = spark.createDataFrame(rows(), SCHEMA)
    named = [r.asDict() for r in jsonl.write_shards(df, f"{tmp_path}/out", "kind", ["id"], file_bytes=2000).collect()]
    found = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")}
    assert {r["file"]: r["bytes"] for r in named} == {name: len(b) for name, b in found.items()}
    for r in named:
        lines = found[r["file"]].decode().splitlines()
        assert len(lines) == r["rows"] and (r["bytes"] <= 2000 or r["rows"] == 1)
    assert "tiny.jsonl" in found and "lone_001.jsonl" in found and "Ä_b_001.jsonl" in found and "Big_one_010.jsonl" in found
    for kind in ("Big one", "small", "Ä/b", None, "lone"):
        files = sorted((r for r in named if r["kind"] == kind), key=lambda r: r["shard"])
        assert [r["shard"] for r in files] == list(range(1, len(files) + 1))
        back = [json.loads(x) for r in files for x in found[r["file"]].decode().splitlines()]
        assert [(x["kind"], x["id"], x["note"]) for x in back] == sorted((x for x in rows() if x[0] == kind), key=lambda x: x[1])


def test_files_are_written_by_tasks_over_many_ranges(spark, tmp_path, monkeypatch):
    """Every task names its own files: the driver renames none, and no range is smaller than RANGE_BYTES."""
    assert not hasattr(jsonl, "_renamed")
    df = spark.createDataFrame(rows(), SCHEMA)
    monkeypatch.setattr(jsonl, "SHARDS", 1)
    made = {}
    for least in (1, 4 << 20):
        monkeypatch.setattr(jsonl, "RANGE_BYTES", least)
        out = tmp_path / f"out{least}"
        named = jsonl.write_shards(df, f"file://{out}", "kind", ["id"], file_bytes=900).collect()
        assert sorted(p.name for p in out.iterdir()) == sorted(r["file"] for r in named)
        found = {r["file"]: (out / r["file"]).read_bytes() for r in named}
        assert all(len(found[r["file"]]) == r["bytes"] and (r["bytes"] <= 900 or r["rows"] == 1) for r in named)
        made[least] = {k: b"".join(found[r["file"]] for r in sorted(named, key=lambda r: r["shard"]) if r["kind"] == k) for k in {r["kind"] for r in named}}
        made[least, "files"] = len(named)
    assert made[1] == made[4 << 20] and made[1, "files"] > made[4 << 20, "files"]


def test_one_range_rolls_as_a_single_pass(spark, monkeypatch):
    monkeypatch.setattr(jsonl, "SHARDS", 1000)
    df = spark.createDataFrame(rows(), SCHEMA)
    got = jsonl.sharded(df, "kind", ["id"], 3000).collect()
    by = {}
    for r in got:
        by.setdefault((r["kind"], r["shard"]), []).append(len(r["line"].encode()))
    for kind in {k for k, _ in by}:
        shard, held = 1, 0
        want = {}
        for _, i, note in sorted((x for x in rows() if x[0] == kind), key=lambda x: x[1]):
            n = len((json.dumps({"kind": kind, "id": i, "note": note}, ensure_ascii=False, separators=(",", ":")) + "\n").encode())
            if held and held + n > 3000:
                shard, held = shard + 1, 0
            held += n
            want.setdefault(shard, []).append(n)
        assert {s: sum(x) for (k, s), x in by.items() if k == kind} == {s: sum(x) for s, x in want.items()}


def test_numbers_follow_the_order_over_ranges(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("(id * 7919) % 5000 as x", "id")
    out = running.numbered(df, ["x"], "n")
    assert out.where("n <> x").count() == 0 and out.columns == ["x", "id", "n"]
