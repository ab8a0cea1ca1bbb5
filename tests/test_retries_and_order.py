"""Repeated retries and orders of discovery against plain loops."""

from collections import deque

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ingest


def test_retries_equal_a_loop(spark):
    stages = ["failed", "downloading", "embed_failed", "kg_failed", "kg_done", "pending"]
    files = [(f"f{i}", stages[i % 6], i // 6 % 4) for i in range(72)]
    number = lambda i, a: (int(i[1:]) * 7 + a) % 5

    def end(i, attempt, step):
        return {0: "kg_done", 1: "failed" if step == "download" else "kg_failed", 2: "embed_failed", 3: "kg_failed", 4: "failed" if step == "download" else "embed_failed"}[number(i, attempt)]

    want = []
    for i, stage, count in files:
        while stage in stages[:4]:
            step, cap = ("download", 2) if stage in stages[:2] else ("embed", 4)
            if count >= cap:
                break
            wait, count = min(2**count, 30), count + 1
            stage = end(i, count, step)
            want.append((i, count, step, wait, stage, stage != "kg_done" and count >= (2 if stage == "failed" else 4)))

    def outcome(i, attempt, step):
        n = (F.substring(i, 2, 9).cast("long") * 7 + attempt) % 5
        return F.when(n == 0, "kg_done").when(n == 1, F.when(step == "download", "failed").otherwise("kg_failed")).when(n == 2, "embed_failed").when(n == 3, "kg_failed").otherwise(F.when(step == "download", "failed").otherwise("embed_failed"))

    df = spark.createDataFrame(files, "id string, stage string, retry_count int")
    got = [tuple(r) for r in ingest.retried(df, outcome, 2, 4).collect()]
    assert sorted(got) == sorted(want) and max(a for _, a, *_ in got) == 4
    assert ingest.retried(df.where("stage = 'pending'"), outcome).count() == 0


@pytest.mark.parametrize("scanners", [1, 2, 3])
def test_discovery_equals_queues(spark, scanners):
    folder, pdf = ingest.FOLDER, ingest.READ[0]
    entries = [("root", None, "Base", folder)]
    for i in range(7):
        entries.append((f"d{i}", "root", f"n{(i * 3) % 7}", folder))
        entries += [(f"d{i}{j}", f"d{i}", f"m{(j * 2) % 3}", folder) for j in range(3)] + [(f"d{(i + 2) % 7}", f"d{i}", "loop", folder)]
        entries += [(f"f{i}{j}", f"d{i}{j % 3}", f"x{j}", pdf if j % 4 else "image/png") for j in range(8)] + [(f"g{i}", f"d{i}", "g", pdf)]
    entries += [(f"r{i}", "root", f"z{i}", pdf) for i in range(3)]
    children = {}
    for i, parent, name, mime in entries:
        children.setdefault(parent, []).append((name, i, mime))
    for c in children.values():
        c.sort()
    want = [(None, n, i, "", name) for n, (name, i, _) in enumerate(x for x in children["root"] if x[2] == pdf)]
    tops = [(i, name) for name, i, mime in children["root"] if mime == folder]
    for s in range(scanners):
        queue, seen, place = deque(tops[s::scanners]), {i for i, _ in tops[s::scanners]}, 0
        while queue:
            at, path = queue.popleft()
            for name, i, mime in children.get(at, []):
                if mime == pdf:
                    want.append((s, place, i, path, name))
                    place += 1
                elif mime == folder and i not in seen:
                    seen.add(i)
                    queue.append((i, f"{path}/{name}"))
    df = spark.createDataFrame(entries, "id string, parent_id string, name string, mime string")
    got = [tuple(r) for r in ingest.discovered(df, "root", scanners).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
