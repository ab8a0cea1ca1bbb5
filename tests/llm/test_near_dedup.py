import random
import re

import pytest

from lodestone.llm import near_dedup
from lodestone.llm.near_dedup import near_duplicates


def shingles(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {(d, len(s), find(d), find(d) == d) for d, s in sets}


def changed(words, n, r, vocabulary):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = r.choice(vocabulary)
    return out


@pytest.mark.parametrize(("direct", "classes"), [(64, 7), (0, 1024)])  # in blocks; by rounds alone
def test_variants_against_brute_force(frame, monkeypatch, direct, classes):
    monkeypatch.setattr(near_dedup, "DIRECT", direct)
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", classes)
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [r.choice(vocabulary) for _ in range(120)]
    rows = [(1, " ".join(base))]
    for i in range(36):  # many of these link to each other only through shared changes, or not at all
        rows.append((2 + i, " ".join(changed(base, r.randrange(1, 14), r, vocabulary))))
    second = changed(base, 9, r, vocabulary)
    for i in range(12):
        rows.append((200 + i, " ".join(changed(second, r.randrange(0, 5), r, vocabulary)[: r.choice((120, 110, 100))])))
    rows += [(300 + i, " ".join(r.choice(vocabulary) for _ in range(60))) for i in range(10)]
    rows += [(400, None), (401, ""), (402, " \n "), (403, "a b"), (404, "A  b"), (405, "a b c"), (406, rows[3][1].upper())]
    got = {tuple(x)[:4] for x in near_duplicates(frame(rows)).collect()}
    assert got == brute(rows)


def test_empty_and_null_ids(frame):
    assert near_duplicates(frame([])).count() == 0
    got = near_duplicates(frame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert sorted((str(x.doc_id), str(x.component_id), x.kept) for x in got) == [("1", "1", True), ("1", "1", True), ("None", "None", True)]


def test_an_id_with_several_texts(frame):
    """Each text has its own links; components of unlike texts share an id, not a group."""
    y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "yz")
    rows = [(5, y), (5, z), (6, y + " more"), (7, z + " more"), (8, "something else of seven words it is"), (5, y), (5, None), (5, "short")]
    got = sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in near_duplicates(frame(rows)).collect())
    assert got == sorted([(5, 56, 5, True)] * 3 + [(6, 57, 5, False), (7, 57, 5, False), (8, 3, 8, True), (5, 0, 5, True), (5, 1, 5, True)])
    groups = {}
    for x in near_duplicates(frame(rows)).collect():
        groups.setdefault(x.group_id, []).append(x.doc_id)
    assert sorted(map(sorted, groups.values())) == [[5], [5], [5, 5, 6], [5, 7], [8]] and groups[None] == [5]


def test_many_variants_of_one_pivot(frame, monkeypatch):
    """A pivot that many need, dealt over tasks, against brute force."""
    r = random.Random(15)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [r.choice(vocabulary) for _ in range(80)]
    rows = [(i, " ".join(changed(base, r.randrange(0, 6), r, vocabulary))) for i in range(150)]
    assert {tuple(x)[:4] for x in near_duplicates(frame(rows)).collect()} == brute(rows)


def test_a_third_are_copies_of_one_text(frame):
    """Exact copies, empty texts and rows without an id, each a large part of all, against brute force."""
    r = random.Random(25)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [r.choice(vocabulary) for _ in range(60)]
    rows = [(i, " ".join(base)) for i in range(1, 200)] + [(200 + i, " ".join(changed(base, r.randrange(0, 5), r, vocabulary))) for i in range(60)]
    rows += [(300 + i, r.choice([None, "", " "])) for i in range(150)] + [(500 + i, " ".join(r.choice(vocabulary) for _ in range(30))) for i in range(40)]
    unnamed = [(None, " ".join(base))] * 80
    got = near_duplicates(frame(rows + unnamed)).collect()
    assert {tuple(x)[:4] for x in got if x.doc_id is not None} == brute(rows)
    assert [tuple(x)[:5] for x in got if x.doc_id is None] == [(None, len(shingles(" ".join(base))), None, True, None)] * 80
