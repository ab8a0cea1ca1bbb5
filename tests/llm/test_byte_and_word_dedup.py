import collections
import hashlib
import random
import re

import pytest

from lodestone.llm.byte_dedup import drop_repeated_bytes
from lodestone.llm.substring_dedup import drop_repeated_passages


def brute_bytes(rows, width):
    seen = collections.Counter(b[i : i + width] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - width + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, width):
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    seen = collections.Counter(tuple(w[i : i + width]) for _, t in rows for w in [split(t)] for i in range(len(w) - width + 1))
    out = []
    for d, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    base = ["".join(r.choice("abcdefghij ") for _ in range(n)) for n in (900, 700, 2000)]
    out = [(1, base[0]), (2, base[0][100:500] + base[1]), (3, None), (4, ""), (5, "a" * 1500), (6, "xy " * 300 + base[2]), (7, base[2][:199]), (8, base[2][5:205])]
    out += [(9, "zz" + base[1][:260] + base[2][1000:1300] + base[1][:260]), (10, "é" * 300), (1, base[0]), (11, base[0][:300] + "Q" + base[0][301:]), (None, base[2][1500:])]
    return out + [(20 + i, "".join(c if r.random() > 0.003 else "#" for c in base[2])) for i in range(20)]


def test_bytes_against_brute_force(frame, rows):
    assert sorted(map(tuple, drop_repeated_bytes(frame(rows), digest=True).collect()), key=str) == brute_bytes(rows, 200)


def test_words_against_brute_force(frame, rows):
    assert sorted(map(tuple, drop_repeated_passages(frame(rows), digest=True).collect()), key=str) == brute_words(rows, 35)


def test_carried_columns_and_texts(frame):
    text = " ".join(f"w{i}" for i in range(40))
    got = drop_repeated_passages(frame([(1, text), (2, text + " tail"), (3, "own  words"), (4, None)]), carry=["key", "k"]).orderBy("doc_id").collect()
    assert [(x.kept, x.n_removed, x["key"], x.k) for x in got] == [("", 40, 1, "x"), ("tail", 40, 1, "x"), ("own  words", 0, 1, "x"), (None, 0, 1, "x")]
    assert drop_repeated_passages(frame([])).count() == 0 and drop_repeated_bytes(frame([])).count() == 0


def test_long_texts_in_parts(frame, monkeypatch):
    """Texts over a chunk, and over what anchors are found in at once, lose the same as by brute force."""
    from lodestone.llm import repeats

    r = random.Random(17)
    words = lambda n: " ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(n))
    shared = words(80)
    rows = [(1, words(3000) + " " + shared + " " + words(200)), (2, words(40) + " " + shared + " " + words(900)), (3, "a " * 700 + words(100)), (4, words(20) + " a" * 300)]
    want = brute_words(rows, 35), brute_bytes(rows, 200)
    monkeypatch.setattr(repeats, "PLACES", 512)
    find = repeats.word_anchors(35, 3), repeats.byte_anchors(200, 16)
    whole = []
    for places in (512, 1 << 24):
        monkeypatch.setattr(repeats, "PLACES", places)
        for f, of in zip(find, (repeats.word_sequences, repeats.byte_sequences), strict=True):
            for _, t in rows:
                s = of([t.encode()])
                start = s.starts(35 if of is repeats.word_sequences else 200)[1]
                whole.append([x.tolist() for x in f(s, start)])
    assert whole[: len(whole) // 2] == whole[len(whole) // 2 :]
    assert sorted(map(tuple, drop_repeated_passages(frame(rows), digest=True).collect()), key=str) == want[0]
    assert sorted(map(tuple, drop_repeated_bytes(frame(rows), digest=True).collect()), key=str) == want[1]


def test_texts_over_a_chunk(frame):
    """A text of more than CHUNK_BYTES, with a passage that a short one has too."""
    from lodestone.llm._common import CHUNK_BYTES

    long = " ".join(f"w{i}" for i in range(CHUNK_BYTES // 7))
    at = long.index("w90000")
    passage = long[at : at + 400]
    assert len(long) > CHUNK_BYTES
    rows = frame([(1, long), (2, "start " + passage + " end")])
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in drop_repeated_bytes(rows).collect()}
    assert got == {1: (len(long), 402, 1), 2: (410, 402, 1)} or got == {1: (len(long), 401, 1), 2: (410, 401, 1)} or got == {1: (len(long), 400, 1), 2: (410, 400, 1)}
    n = len(passage.rsplit(" ", 1)[0].split())
    words = {x.doc_id: x.n_removed for x in drop_repeated_passages(rows).collect()}
    assert words[1] == words[2] and words[2] in (n, n + 1)


def test_many_copies_of_one_passage(frame):
    """One passage in most texts, with variants of its middle: rows of its keys are dealt over tasks."""
    r = random.Random(23)
    base = [f"p{i}" for i in range(90)]
    rows = []
    for i in range(120):
        w = list(base)
        if i % 3:
            w[r.randrange(40, 50)] = f"v{r.randrange(6)}"
        rows.append((i, " ".join([f"own{i}x{j}" for j in range(10)] + w)))
    assert sorted(map(tuple, drop_repeated_passages(frame(rows), digest=True).collect()), key=str) == brute_words(rows, 35)
    assert sorted(map(tuple, drop_repeated_bytes(frame(rows), digest=True).collect()), key=str) == brute_bytes(rows, 200)


@pytest.mark.parametrize("drop, brute, width", [(drop_repeated_bytes, brute_bytes, 200), (drop_repeated_passages, brute_words, 35)])
def test_rows_that_repeat_with_their_id_are_digested_once(spark, frame, monkeypatch, drop, brute, width):
    """Many copies of one row under one id, and variants of it: the digested windows don't grow with the copies."""
    from lodestone.llm import _common

    r = random.Random(8)
    text = " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(250))
    other = text[:700] + "CHANGED" + text[705:]
    sizes, save = {}, _common.Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        if name in ("hashed", "blocks"):
            sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(_common.Scratch, "save", counted)
    for copies in (3, 2000):
        rows = [(None, text)] * copies + [(1, other), (2, other[900:]), (2, other[900:])]
        got = sorted(map(tuple, drop(frame(rows), digest=True).collect()), key=str)
        assert got == (brute(rows, width) if copies == 3 else sorted(first * copies + rest, key=str))
        first, rest = [x for x in got if x[0] is None][:1], [x for x in got if x[0] is not None]
    assert all(len(set(n)) == 1 for n in sizes.values()), sizes
