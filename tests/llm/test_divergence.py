"""Source divergence against plain loops, with small cells, batches and buckets."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from lodestone.llm import divergence


def plain(rows, least_docs, k):
    groups, langs, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        c = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text))
        groups[lang, source].update(c)
        docs[lang].update(set(c))
        langs[lang].update(c)
    out = []
    for (lang, source), own in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)

        def shares(c):
            total = sum(c[t] for t in kept)  # noqa: B023
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}  # noqa: B023

        p, q = shares(own), shares(langs[lang])
        pair = [(sum(abs(p[t] - o) for t, o in shares(c).items()), s) for (x, s), c in groups.items() if x == lang and s != source]
        term = [(p[t] - q[t], t) for t in kept if own[t] > 0 and p[t] > q[t]]
        for part, found, most in (("pair", pair, None), ("term", term, k)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def corpus(seed, sources=7):
    rng = random.Random(seed)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] + ["Été", "中文", "zz"]
    rows = []
    for lang in ("en", "de", None):
        for s in range(sources):
            mine = rng.sample(words, 60)
            rows += [(" ".join(rng.choices(mine, k=rng.randint(0, 30))), lang, f"s{s}" if s else None) for _ in range(6)]
    rows += [(None, "en", "void"), ("123 !", "fr", "x"), ("", "fr", "y"), ("lone words here", "it", "only")]
    return rows


SCHEMA = "text string, lang string, source string"


def result(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_equals_plain_loops(spark, frame):
    rows = corpus(1)
    assert result(divergence.source_divergence(frame(rows, SCHEMA), least_docs=3, k=10)) == plain(rows, 3, 10)


@pytest.mark.parametrize("sources, terms, growth", [(2, 16, 2), (3, 5, 3)])
def test_small_cells_and_batches(spark, frame, monkeypatch, sources, terms, growth):
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "GROWTH", growth)
    monkeypatch.setattr(divergence, "HELD", 20)
    rows = corpus(2)
    assert result(divergence.source_divergence(frame(rows, SCHEMA), least_docs=2, k=4)) == plain(rows, 2, 4)


def test_repeated_rows_ties_and_nothing_kept(spark, frame):
    rows = [("a b c d", "en", "x")] * 3 + [("a b c e", "en", "y")] * 3 + [("a", "en", "z")]
    assert result(divergence.source_divergence(frame(rows, SCHEMA), least_docs=3, k=2)) == plain(rows, 3, 2)
    none = divergence.source_divergence(frame(rows, SCHEMA), least_docs=30)
    assert result(none) == plain(rows, 30, 50) and {r[4] for r in result(none)} == {0}
    assert divergence.source_divergence(frame([], SCHEMA)).count() == 0


def test_a_hot_source_and_very_long_texts(spark, frame, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 50)
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(" ".join(rng.choices(words, k=40)), "en", "hot" if i % 2 else f"s{i % 5}") for i in range(300)]
    rows.append((" ".join(rng.choices(words, k=20_000)), "en", "hot"))
    assert result(divergence.source_divergence(frame(rows, SCHEMA), least_docs=5, k=20)) == plain(rows, 5, 20)


def test_sums_are_sent_on_when_they_are_many(monkeypatch):
    rows = corpus(3)
    batch = pa.table({"lang": [x or "" for _, x, _ in rows], "source": [s or "" for *_, s in rows], "text": [t for t, *_ in rows]}).to_batches()[0]
    sums = []
    for held in (1 << 20, 25):
        monkeypatch.setattr(divergence, "HELD", held)
        out, batches = Counter(), list(divergence._count_terms(iter([batch])))
        for b in batches:
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["term"], "n"] += r["n"]
                out[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        sums.append(out)
    assert sums[0] == sums[1] and len(batches) > 30


def test_cells_take_terms_in_slabs(monkeypatch):
    rng = random.Random(2)
    names, base = [f"s{i}" for i in range(5)], [3, 5, 5, 9, 1]
    rows = [("en", s, 0, None, b) for s, b in zip(names, base, strict=True)]
    p = {(s, f"t{t}"): base[i] + rng.randrange(1, 50) for i, s in enumerate(names) for t in range(40) if rng.random() < 0.4}
    rows += [("en", s, 0, t, v) for (s, t), v in p.items()]
    cell = pa.table({n: [r[i] for r in rows] for i, n in enumerate(("lang", "source", "block", "term", "p"))})
    terms = {t for _, t in p}
    want = {(a, b): sum(abs(p.get((a, t), base[i]) - p.get((b, t), base[j])) - abs(base[i] - base[j]) for t in terms) for i, a in enumerate(names) for j, b in enumerate(names) if i < j}
    for slab in (1000, 7):
        monkeypatch.setattr(divergence, "TERMS", slab)
        assert {(r["source"], r["item"]): r["more"] for r in divergence._cell_sums(cell).to_pylist()} == want
