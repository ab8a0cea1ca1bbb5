import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontamination, topk_search
from lodestone.llm.decontamination import contained_items, decontaminated
from lodestone.llm.topk_search import top_k

VECTORS = "vec_id long, embedding array<float>"


def brute_top(rows, queries, k):
    whole = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = [math.floor(256 * x) for x in v]
    out = []
    for q in queries:
        if q in whole:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows = [(i, [float(f"{x:.3f}") for x in v]) for i, v in rows]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]  # ties
    rows += [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, [1.0] * 5), (2004, [float("inf")] * 8), (2005, [-2.0] * 5), (None, [1.0] * 8), (2006, [])]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"part": F.lit(1), "score": F.lit("x"), "q": F.lit(2)}).repartition(5)
    rows = [(x.vec_id, x.embedding) for x in df.select("vec_id", "embedding").collect()]
    got = sorted(tuple(x) for x in top_k(df, df.where("vec_id % 50 = 0")).collect())
    assert got == brute_top(rows, [i for i, _ in rows if i is not None and i % 50 == 0], 5)


@pytest.mark.parametrize("block, wide", [(32, False), (50, True)])
def test_top_k_over_many_ranges(spark, monkeypatch, block, wide):
    """Several ranges and blocks, tight clusters that bounds prune, components beyond four bytes."""
    r = random.Random(block)
    monkeypatch.setattr(topk_search, "BLOCK", block)
    centres = [[r.choice([-1, 1]) * r.uniform(0.5, 1) for _ in range(12)] for _ in range(9)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in centres[i % 9]]) for i in range(500)]
    if wide:
        rows += [(600 + i, [centres[i % 9][0] * 1e7, *centres[i % 9][1:]]) for i in range(60)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    rows = [(x.vec_id, x.embedding) for x in df.select("vec_id", "embedding").collect()]
    got = sorted(tuple(x) for x in top_k(df, df.where("vec_id % 50 = 0")).collect())
    assert got == brute_top(rows, [i for i, _ in rows if i % 50 == 0], 5)


def test_bounds_leave_out_blocks_of_other_clusters():
    r = np.random.default_rng(2)
    sub = topk_search.SUB
    values = np.concatenate([np.round(256 * (c + r.normal(0, 0.02, (4 * sub, 16)))) for c in np.sign(r.normal(0, 1, (8, 16)))]).astype(np.int64)
    hi, lo = (f(values.reshape(-1, sub, 16), axis=1) for f in (np.max, np.min))
    query = values[:1]
    kth = np.sort(query @ values.T)[0, -5]
    share = (topk_search._bounds(query, hi, lo) >= kth).mean()
    assert share <= 0.25 and (topk_search._bounds(query, hi, lo)[0] >= (query @ values.T).reshape(-1, sub).max(axis=1)).all()


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], VECTORS)
    assert top_k(df, df).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0])], VECTORS)
    assert top_k(one, one).count() == 0


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return set() if not w else {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


@pytest.mark.parametrize("most", [None, 0])  # all is broadcast; all is joined by shuffle
def test_containment_against_brute_force(spark, frame, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", most)
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", most)
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([4, 5, 6, 8, 9, 13, 20, 40, 70, 3])] + [(20, None), (21, " "), (3, text(12)), (4, text(9)), (None, text(10))]
    docs = [(100, None), (101, ""), (102, items[0][1].upper()), (103, "A  b")]
    for i in range(60):
        w = text(80).split()
        held = r.choice(items)[1] or ""
        part = held.split()
        for _ in range(r.randrange(3)):
            if part:
                part[r.randrange(len(part))] = "changed"
        docs.append((200 + i, " ".join(w[:40] + part + w[40:])))
    docs += [(200, docs[5][1]), (None, docs[6][1])]
    want = {}
    for d, t in docs:
        for i, s in items:
            a, b = shingles(s), shingles(t)
            if a and 100 * len(a & b) >= 75 * len(a):
                want[d, i] = max(want.get((d, i), (0, 0)), (len(a & b), -len(a)))
    df = frame(docs).withColumn("words", F.lit(3))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    got = {(x.doc_id, x.item_id): (x.n_shared, -x.n_item) for x in contained_items(df, bench).collect()}
    assert got == want
    dirty = lambda t: any((a := shingles(s)) and 100 * len(a & shingles(t)) >= 75 * len(a) for _, s in items)
    left = sorted(((x.doc_id, x.text) for x in decontaminated(df, bench).collect()), key=str)
    assert left == sorted(((d, t) for d, t in docs if not dirty(t)), key=str)
    assert contained_items(frame([]), bench).count() == 0 and contained_items(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("most", [None, 0])
def test_templates_of_items_lead_to_no_pairs(spark, frame, monkeypatch, most):
    """A phrase that all items and most documents have: found as by brute force, and each item is looked for by its own shingles."""
    if most is not None:
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", most)
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", most)
    head = " ".join(f"t{i}" for i in range(12))
    items = [(i, head + " " + " ".join(f"i{i}w{j}" for j in range(20))) for i in range(40)] + [(99, head)]
    docs = [(i, f"before {head} " + " ".join(f"d{i}w{j}" for j in range(10))) for i in range(100)]
    docs += [(200 + i, f"{items[i][1]} after") for i in range(5)] + [(300, "y" * 40 + " " + head.upper() + " " + "long words " * 120_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in contained_items(frame(docs), bench).collect()}
    assert got == {(d, 99) for d, _ in docs} | {(200 + i, i) for i in range(5)}
    scratch = decontamination.Scratch(spark, "test")
    sets = bench.select(F.col("item_id").alias("item"), decontamination.words_of(F.col("text")).alias("words"))
    sets = sets.select("item", F.array_sort(decontamination.shingle_hashes(5)).alias("hashes")).withColumn("n_item", F.size("hashes"))
    sketch = decontamination._sketches(sets, 75, scratch).where("item <> 99")
    assert sketch.groupBy("h").count().where("count > 1").count() == 0
