"""Spelling variants against a plain version that compares each word with each."""

import random
import re
import zlib
from collections import Counter

import pytest

from lodestone.llm import spelling


def one_apart(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(rows, least=7, factor=10, one_in=31):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    out = {}
    for w, n in words.items():
        near = [v for v in words if one_apart(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= factor * n else None
        out[w] = [form, None, n, len(near), words[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def variants(rng, base, n):
    letters = "abcdefghéÿ×"
    for _ in range(n):
        i, kind = rng.randrange(len(base)), rng.randrange(3)
        yield base[:i] + (rng.choice(letters) if kind else "") + base[i + (kind < 2) :]


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for b in ("aaaaaaaa", "international", "Straßenbahn", "abababab", "zzzzzzz"):
        words = [b] * 200 + [v for v in variants(rng, b, 30) for _ in range(rng.randint(1, 25))] + [w for v in variants(rng, b, 5) for w in variants(rng, v, 3)] * 2
        rng.shuffle(words)
        words += [b] * 400 + [b + "x"] * 30 + [b + "xy"] * 3
        rows += [(len(rows) + i, " ".join(words[at : at + 50])) for i, at in enumerate(range(0, len(words), 50))]
    return rows


def test_equals_the_plain_version(spark, frame):
    rows = corpus(1)
    want = plain(rows)
    assert any(x[0] for x in want.values()) and any(x[1] != w and x[1] != x[0] for w, x in want.items())
    assert found(spelling.spelling_variants(frame(rows))) == want


@pytest.mark.parametrize("shard", [3, 11])
def test_hot_halves_are_dealt_over_shards_and_blocks(spark, frame, monkeypatch, shard):
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "BLOCK", 7)
    rows = corpus(2)
    assert found(spelling.spelling_variants(frame(rows))) == plain(rows)


def test_edges(spark, frame):
    rows = [(None, "Letters letters LETTERS lettres"), (None, None), (3, ""), (3, "letters Életters"), (3, "letters"), (4, "x" * 40 + " " + "x" * 40), (5, "short so few")]
    assert found(spelling.spelling_variants(frame(rows))) == plain(rows)
    assert spelling.spelling_variants(frame([])).count() == 0


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "abcdefghij klmnopqrst " * 40 + "z" * 500 + " uvwxyzabc"
    whole = list(spelling._runs(text, 7))
    monkeypatch.setattr(spelling, "PIECE", 15)
    assert list(spelling._runs(text, 7)) == whole == re.findall("[a-z]{7,}", text)


def test_deleted_letters_follow_the_id():
    runs = [f"wordnumber{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    short = [r for r in runs if spelling.altered(17, r, 31) != r]
    assert 5 < len(short) < 60 and all(zlib.crc32(f"17:{r}".encode()) % 31 == 0 for r in short)
