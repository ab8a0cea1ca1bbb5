"""What op2's passes cost: rows of guesses follow from blocks of many slots; what leaves a bit out is looked up, not computed."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import lm_scoring


def followers(texts):
    return [r for b in lm_scoring._followers(iter([pa.RecordBatch.from_pydict({"text": texts})])) for r in b.to_pylist()]


def best(rows):
    rows = sorted(rows, key=lambda r: r["block"])
    batch = pa.RecordBatch.from_arrays([pa.array([r["block"] for r in rows], pa.int32()), pa.array([r["data"] for r in rows], pa.binary())], names=["block", "data"])
    return {r["slot"]: (r["h"] & 0xFFFFFFFF, r["n"]) for b in lm_scoring._best_guesses(iter([batch])) for r in b.to_pylist()}


def test_guesses_are_written_in_few_rows_and_all_of_them():
    rng = np.random.default_rng(0)
    words = np.array([f"w{i}" for i in range(300)])
    texts = [" ".join(rng.choice(words, 1_000)) for _ in range(120)]
    rows = followers(texts)
    assert len(rows) <= 2_048, len(rows)  # 16,129 before, in blocks of 256 slots
    slot, name = lm_scoring.guess_keys(lm_scoring.tokens_of([t.encode() for t in texts]))
    codec = pa.Codec("zstd")
    found = {}
    for r in rows:
        key, n = lm_scoring.unpacked(r["block"], r["data"], codec)
        assert (key[1:] > key[:-1]).all()
        found |= dict(zip(key.tolist(), n.tolist(), strict=True))
    key, n = np.unique((slot.astype(np.uint64) << np.uint64(32)) | name, return_counts=True)
    assert found == dict(zip(key.tolist(), n.tolist(), strict=True))
    want = {}
    for k, times in sorted(found.items()):
        s, h = k >> 32, k & 0xFFFFFFFF
        if times >= lm_scoring.GUESS_COPIES and times > want.get(s, (0, 0))[1]:
            want[s] = (h, times)  # at a tie the smaller name stays
    assert best(rows) == want
    twice = {s: (h, 2 * times) for s, (h, times) in best(rows).items()}
    again = best(rows + rows)
    assert all(again[s] == x for s, x in twice.items()) and len(again) > len(twice)


def test_odds_without_a_bit_are_those_of_the_counts_without_it():
    rng = np.random.default_rng(1)
    n0, n1 = (rng.integers(0, 40, lm_scoring.SLOTS).astype(np.float32) * rng.integers(0, 2, lm_scoring.SLOTS) for _ in range(2))
    n0, n1 = n0.astype(np.float32), n1.astype(np.float32)
    t = lm_scoring.tokens_of([b"ab abcdefghijk a zz", b"", b"the other one"])
    b = lm_scoring.bits_of(t, np.arange(len(t.codes)), lm_scoring.huffman(np.arange(256)), False)
    odds, gate = lm_scoring.LeftOut.of(n0, n1).look(b)
    for i, y in enumerate(b.bit.tolist()):
        for o, slots in zip(odds, b.slots, strict=True):
            zeros, ones = max(float(n0[slots[i]]) - (1 - y), 0), max(float(n1[slots[i]]) - y, 0)
            assert abs(o[i] - np.log((ones + 0.3) / (zeros + 0.3))) < 1e-5
        n = max(float(n0[b.slots[-1][i]] + n1[b.slots[-1][i]]) - 1, 0)
        assert gate[i] == int(b.place[i]) * 4 + (n > 0) + (n > 3) + (n > 30)


def test_rounds_sum_only_what_they_are_read_for():
    counts = lm_scoring.LeftOut.of(*(np.full(lm_scoring.SLOTS, n, np.float32) for n in (3, 5)))
    t = lm_scoring.tokens_of([b"ab abcdefghijk a zz"])
    code, weights = lm_scoring.huffman(np.arange(256)), np.full((len(lm_scoring.BITS), lm_scoring.GATES), 0.3, np.float32)
    times = np.array([5, 4, 3, 2, 1])
    step, last = (lm_scoring.round_sums(t, times, False, code, counts, weights, x) for x in (False, True))
    edge = sum(lm_scoring._SIZES[:2])
    assert step[:edge].any() and not step[edge:].any() and not last[:edge].any()
    b = lm_scoring.bits_of(t, np.arange(5), code, False)
    size, ones = np.split(last[edge:], 2)
    assert size.sum() == times[b.token].sum() and ones.sum() == (times[b.token] * b.bit).sum()


def test_distinct_tokens_are_all_tokens():
    t = lm_scoring.tokens_of([b"b a b", None, b"a c", b""])
    rows, back = lm_scoring.distinct(t)
    assert (np.diff(t.codes[rows].astype(object)) > 0).all() and (t.codes[rows][back] == t.codes).all()
    assert [len(x) for x in lm_scoring.distinct(lm_scoring.tokens_of([]))] == [0, 0]


def test_as_many_tokens_are_frequent_as_may_be():
    n, rows = np.array([1, 50, 3, 2]), np.array([700, 1, 20, 100])
    assert [lm_scoring.least_count(n, rows, k) for k in (821, 820, 121, 120, 21, 20, 1, 0)] == [1, 2, 2, 3, 3, 4, 4, 51]
    assert lm_scoring.least_count(n[:0], rows[:0], 5) == 1


def test_scores_are_the_same_however_counts_come(spark, monkeypatch):
    """Tokens below the bound go by the join, so many as the bound leaves, with the same results."""
    r = random.Random(4)
    df = spark.createDataFrame([(i, " ".join(f"word{int(r.random() ** 3 * 60)}" for _ in range(30)) + " new" * (i % 3) + f" one{i}") for i in range(150)], "doc_id long, text string")
    score, sent = lm_scoring._score, []

    def spy(shared, frequent, *more):
        sent.append([len(x.key) for x in frequent.value])
        return score(shared, frequent, *more)

    monkeypatch.setattr(lm_scoring, "_score", spy)
    found = []
    for most in (1 << 19, 40, 1):
        monkeypatch.setattr(lm_scoring, "FREQUENT", most)
        found.append({x.doc_id: x for x in lm_scoring.score_texts(df).collect()})
    words = df.where(~F.expr("pmod(crc32(cast(doc_id as string)), 10) = 0")).select(F.explode(F.split("text", " ")))
    assert sent[0][0] == words.distinct().count() + 1 and sent[0][1] > 0  # all, and the end
    assert 30 <= sent[1][0] <= 40 and 0 < sent[1][1] <= 40 and max(sent[2]) <= 1
    for other in found[1:]:
        for d, x in found[0].items():
            y = other[d]
            assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (y.held_out, y.n_tokens, y.n_known, y.train_tokens)
            assert abs(x.base_score - y.base_score) < 1e-9 * abs(x.base_score) and abs(x.score - y.score) < 1e-6 * abs(x.score)
