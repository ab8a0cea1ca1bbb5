"""SimHash fingerprints, the ring's budgets, and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from lodestone.llm import simhash_dedup as sd
from lodestone.llm._common import Scratch


def plain_fingerprint(text, width=4):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, most):
    """The least index reachable, of fingerprints in a list."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprint_is_the_plain_one():
    rng = random.Random(3)
    texts = [None, "", " \t\n ", "One", "a b c", "a b c d", "A B\x0bC\x0cD e É é", " ".join(rng.choice(["x", "yy", "Z", "中"]) for _ in range(3000))]
    assert [sd.fingerprint(t.encode() if t is not None else None) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_long_texts_are_hashed_in_slices(monkeypatch):
    text = " ".join(str(i % 97) for i in range(500))
    monkeypatch.setattr(sd, "SLICE", 64)
    assert sd.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("most", [0, 1, 3, 4, 7])
def test_each_near_pair_meets_in_a_key_and_keeps_the_budgets(most):
    rng = random.Random(most)
    ring = sd.Ring(most)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, most)):
            y ^= 1 << b
        starts = [i for i in range(ring.m) if sd.Ring.linked(ring, np.array([x ^ y], dtype=np.uint64), i)[0]]
        assert starts
        assert any((x ^ y) & ring.masks[i][ring.head - 1] in ring.errors(i) for i in starts)


def noisy(rng, base, n, flips):
    out = []
    for _ in range(n):
        x = base
        for b in rng.sample(range(64), rng.randint(0, flips)):
            x ^= 1 << b
        out.append(x)
    return out


@pytest.mark.parametrize("small", [32, 4])
def test_links_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(sd, "SMALL", small)
    rng = random.Random(small)
    prints = [rng.getrandbits(64) for _ in range(60)] + noisy(rng, rng.getrandbits(64), 150, 7) + noisy(rng, 0, 40, 5) + [0, (1 << 64) - 1]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    classes = spark.createDataFrame([(p, 1) for p in signed], "fp long, n long")
    scratch = Scratch(spark, "test-simhash")
    label = sd.fingerprint_links(scratch.save(classes, "classes"), 4, scratch)
    found = {r["node"]: r["component"] for r in label.collect()}
    expected = plain_components(prints, 4)
    groups = {}
    for s, e in zip(signed, expected, strict=True):
        groups.setdefault(e, set()).add(s)
    for members in groups.values():
        assert len({found.get(s, s) for s in members}) == 1
    assert len({found.get(s, s) for s in signed}) == len(groups)


def test_blocks_give_a_forest_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(sd, "SMALL", 2)
    real = sd._block_links
    monkeypatch.setattr(sd, "_block_links", lambda many, most, scratch: real(many, most, scratch, block=16))
    rng = random.Random(9)
    prints = sorted(set(noisy(rng, rng.getrandbits(64), 200, 6)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    scratch = Scratch(spark, "test-simhash")
    label = sd.fingerprint_links(scratch.save(spark.createDataFrame([(p, 1) for p in signed], "fp long, n long"), "classes"), 4, scratch)
    found = {r["node"]: r["component"] for r in label.collect()}
    assert len({found.get(s, s) for s in signed}) == len(set(plain_components(prints, 4)))


def test_documents_with_every_edge(spark, frame):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long), (2, long + " end"), (9, long), (9, "another text with the same id"), (None, long), (None, "alone of no id"), (7, None), (3, ""), (8, " \n"), (4, "one two"), (6, "ONE  two")]
    out = [r.asDict() for r in sd.simhash_duplicates(frame(rows)).collect()]
    assert len(out) == len(rows)
    prints = [plain_fingerprint(t) for _, t in rows]
    part = plain_components(prints, 4)
    least = {}
    for (i, _), p in zip(rows, part, strict=True):
        if i is not None:
            least[p] = min(i, least.get(p, i))
    want = sorted((str(i), f"{x:016x}", str(least.get(p))) for (i, _), x, p in zip(rows, prints, part, strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in out) == want
    assert {r["component_id"] for r in out if r["doc_id"] in (7, 3, 8)} == {3}
    assert sd.simhash_duplicates(frame([])).count() == 0


def test_a_third_of_rows_as_copies_of_one_text(spark, frame):
    rng = random.Random(1)
    words = [f"v{i}" for i in range(50)]
    rows = [(i, "the same text again and again and again") for i in range(0, 3000, 3)]
    rows += [(i, " ".join(rng.choices(words, k=30))) for i in range(1, 301, 3)]
    out = {r["doc_id"]: r for r in sd.simhash_duplicates(frame(rows)).collect()}
    part = plain_components([plain_fingerprint(t) for _, t in rows], 4)
    assert all(out[i]["component_id"] == min(rows[k][0] for k in range(len(rows)) if part[k] == p) for (i, _), p in list(zip(rows, part, strict=True))[::37])
    assert out[3]["n_alike"] == 1000
