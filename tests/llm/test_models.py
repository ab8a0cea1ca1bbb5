import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import language_id, lm_scoring, toxicity

LANGUAGES = {"aa": ["the", "and", "with", "that", "ing"], "bb": ["der", "und", "mit", "dass", "ung"], "cc": ["élé", "eaux", "que", "dans", "çon"]}


def test_gradients_against_differences():
    r = np.random.default_rng(0)
    texts, y = [b"abcabc", b"bca", b"cc"], np.array([0, 1, 1])
    net = language_id.train(texts, y, ["x", "y"], hidden=2, epochs=0)
    for a in (net.x, net.u, net.o, net.b):
        a += r.standard_normal(a.shape).astype(np.float32) * 0.3
    codes, real, doc = language_id.windows(texts, 8)
    weight = np.ones(len(doc), dtype=np.float32)

    def loss():
        p = net.probabilities(codes, net.states(0, codes), net.states(1, codes))
        return -(np.log(p[:, y[doc], np.arange(len(doc))]) * real).sum() / real.sum()

    for param, grad in zip((net.x, net.u, net.o, net.b), language_id._gradients(net, codes, real, y[doc], weight), strict=True):
        for i in np.argsort(-np.abs(grad).ravel())[:4]:
            at = np.unravel_index(i, param.shape)
            old = param[at]
            param[at] = old + 5e-3
            up = loss()
            param[at] = old - 5e-3
            down = loss()
            param[at] = old
            assert abs((up - down) / 1e-2 - grad[at]) < 2e-2 * max(0.1, abs(grad[at]))


def test_languages(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(LANGUAGES[lang]) for _ in range(r.randrange(4, 60))), lang) for i in range(150) for lang in [r.choice(sorted(LANGUAGES))]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !", "bb"), (1003, rows[1][1] * 3000, None), (None, rows[2][1], rows[2][2]), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit("no"), "score": F.lit(1), "h": F.lit(2)})
    got = language_id.identify_languages(df, carry=["lang", "score"]).toDF("doc_id", "held_out", "pred", "p", "lang", "same").collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.held_out == (x.doc_id is not None and crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.p <= 1 and x.same == 1
        if x.doc_id in (1000, 1001, 1002):
            assert (x.pred, x.p) == ("und", 0.0)
    held = [x for x in got if x.held_out and x.pred != "und" and x.lang]
    assert sum(x.pred == x.lang for x in held) >= 0.95 * len(held)
    assert language_id.identify_languages(df.limit(0)).count() == 0
    assert {x.lang_pred for x in language_id.identify_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_more_languages_than_two_hundred(spark, monkeypatch):
    """Each of 230 languages can be predicted, however few its documents."""
    monkeypatch.setattr(language_id, "EPOCHS", 1)
    monkeypatch.setattr(language_id, "STEPS", 5)
    rows = [(i, f"text {i} " * 3, f"l{i % 230}") for i in range(460)]
    net = language_id.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(net.labels) == 230 and net.o.shape[0] == 230


def _pairs(seed, label):
    r = random.Random(seed)
    texts, y = [], []
    for _ in range(1500):
        words = [r.choice("abcdefgh") * 2 for _ in range(6)]
        a, b = r.random() < 0.5, r.random() < 0.5
        texts.append(" ".join(words + ["insult"] * a + ["group"] * b).encode())
        y.append(float(label(a, b)))
    return *toxicity.term_sets(texts), np.array(y)


def test_pairs_that_lines_cannot_learn():
    """Toxic is one of two words without the other, which says nothing by itself: the factors must carry it. And both together."""
    for label in (lambda a, b: a != b, lambda a, b: a and b):
        fm = toxicity.train(*_pairs(6, label))
        doc, term, y = _pairs(7, label)
        assert ((fm.scores(doc, term, len(y)) >= 0) == (y > 0)).mean() > 0.95


def test_machine_against_a_double_loop():
    r = np.random.default_rng(1)
    fm = toxicity.Machine(0.3, r.standard_normal(7), r.standard_normal((7, 3)))
    sets = [[0, 2, 5], [], [1], [0, 1, 2, 3, 4, 5, 6]]
    doc, term = (np.array(x) for x in zip(*((i, t) for i, s in enumerate(sets) for t in s), strict=True))
    want = [0.3 + sum(fm.w[t] for t in s) + sum(fm.v[a] @ fm.v[b] for a in s for b in s if a < b) for s in sets]
    assert np.allclose(fm.scores(doc, term, 4), want)
    y = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        odds = fm.scores(doc, term, 4)
        return ((np.logaddexp(0, odds) - y * odds) * np.where(y > 0, toxicity.POSITIVE, 1)).sum()

    d0, used, dw, dv = toxicity._gradients(fm, doc, term, y)
    assert used.tolist() == list(range(7))
    for param, grad in ((fm.w, dw), (fm.v, dv)):
        for at in np.ndindex(param.shape):
            old = param[at]
            param[at] = old + 1e-5
            up = loss()
            param[at] = old - 1e-5
            down = loss()
            param[at] = old
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-6
    fm.w0 += 1e-5
    up = loss()
    fm.w0 -= 2e-5
    assert abs((up - loss()) / 2e-5 - d0) < 1e-6


def test_toxicity(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        bad = r.random() < 0.2
        rows.append((i, " ".join([r.choice(["fine", "day", "tree", "house", "walk"]) for _ in range(20)] + ["Idiot!"] * bad)))
        if i % 2:
            labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "idiot")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("y", F.lit(1)).withColumn("toxic", F.lit(1))
    marks = spark.createDataFrame(labels + [(7, None), (None, 1)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    got = {x.doc_id: x for x in toxicity.score_toxicity(df, marks).collect()}
    assert len(got) == len(rows)
    wrong = [i for i, t in rows[:600] if got[i].predicted != int("Idiot" in t)]
    assert len(wrong) <= 6 and all(0 <= x.score <= 1 for x in got.values()) and got[1000].score == got[1001].score
    assert {x.score for x in toxicity.score_toxicity(df, marks.limit(0)).collect()} != set() and toxicity.score_toxicity(df.limit(0), marks).count() == 0


def test_lm_against_counts(spark, monkeypatch):
    r = random.Random(9)
    names = [f"n{i}x" for i in range(80)]
    rows = [(i, " ".join(r.choice(names) for _ in range(r.randrange(0, 50)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\t"), (503, "NEW zzz é" * 30), (7, rows[7][1]), (None, "n1x N2X"), (20, "x" * 900)]
    monkeypatch.setattr(lm_scoring, "FREQUENT", 200)  # so that counts come both ways
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "rest": F.lit(2)})
    out = sorted((tuple(x) for x in lm_scoring.score_texts(df).collect()), key=lambda x: (str(x[0]), x[2]))
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w] + [None]
    held = lambda d: d is not None and crc32(str(d).encode()) % 10 == 0
    count = Counter(w for d, t in rows if not held(d) for w in split(t))
    n, v = sum(count.values()), len(count)
    want = sorted(((d, held(d), len(split(t)), sum(count[w] > 0 for w in split(t)), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t))) for d, t in rows), key=lambda x: (str(x[0]), x[2]))
    assert [x[:5] for x in out] == [x[:5] for x in want]
    assert all(abs(a[5] - b[5]) < 1e-9 * max(1, abs(b[5])) for a, b in zip(out, want, strict=True))
    assert all(math.isfinite(x[6]) and x[6] < 0 and x[7] > 0 for x in out)
    assert lm_scoring.score_texts(df.limit(0)).count() == 0
    assert all(math.isfinite(x.score) for x in lm_scoring.score_texts(df.where("doc_id = 30")).collect())


def test_lm_is_a_distribution():
    """Spelling probabilities of all one-byte tokens, and the end, can't exceed 1."""
    code = lm_scoring.huffman(np.arange(256))
    mixer = lm_scoring.fit(code, np.zeros((lm_scoring.SLOTS, 2), dtype=np.int64), [])
    t = lm_scoring.tokens_of([bytes([b]) for b in range(256) if b not in (9, 10, 11, 12, 13, 32)] + [b""])
    first = t.first[:-1]
    assert (10 ** mixer.log10(t, first, False)).sum() <= 1 + 1e-6 and not mixer.log10(t, first, True).any()


def test_lm_heads_and_tails_are_all_bits():
    """A token's bits are its head's and its tail's, and the head's as of the number that stands for it."""
    t = lm_scoring.tokens_of([b"ab abcdefghijk a \xc3\xa9t\xc3\xa9 zz", b"", None, b"abcdefghijk ab"] + [bytes([97 + i % 26, 97 + i // 26]) for i in range(300)])
    rows, back = lm_scoring.distinct(t)
    heads, which = lm_scoring.heads_of(t, rows, back)
    assert (np.diff(heads) > 0).all() and len(which) == len(t.codes)
    code = lm_scoring.huffman(np.arange(256))
    every = np.arange(len(t.codes))
    whole = lm_scoring.bits_of(t, every, code, False)
    alone = lm_scoring.bits_of(lm_scoring.head_tokens(heads), which, code, False)
    for x, y in zip([*whole.slots, whole.node, whole.bit, whole.place, whole.token], [*alone.slots, alone.node, alone.bit, alone.place, alone.token], strict=True):
        assert (x == y).all()
    tail = lm_scoring.bits_of(t, every, code, True)
    symbols = t.end - t.start + 1
    size = np.diff(code.first)
    for i in range(8):
        text = [*t.buf[t.start[i] : t.end[i]].tolist(), 0x20]
        assert (whole.token == i).sum() == size[text[:3]].sum() and (tail.token == i).sum() == size[text[3:]].sum() and symbols[i] == len(text)


def test_lm_scores_against_a_plain_loop(spark, monkeypatch):
    """score from the fitted parts, token by token and bit by bit, with plain dictionaries; equal at 4 and at 100 partitions."""
    r = random.Random(21)
    names = [f"{a}{b}" for a in ("ka", "to", "mirel", "s") for b in ("", "n", "dor", "xyz")]
    rows = [(i, " ".join(r.choice(names) for _ in range(r.randrange(0, 30))) + (" unseen" * (i % 3))) for i in range(90)] + [(200, None), (201, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}
    score = lm_scoring._score

    def spy(shared, frequent, total, base, new):
        seen.update(mixer=shared.value[0], guesses=shared.value[1], total=total, new=new)
        return score(shared, frequent, total, base, new)

    monkeypatch.setattr(lm_scoring, "_score", spy)
    monkeypatch.setattr(lm_scoring, "FREQUENT", 50)
    by = [{x.doc_id: x.score for x in lm_scoring.score_texts(df.repartition(n)).collect()} for n in (4, 100)]
    assert all(abs(by[0][d] - by[1][d]) < 1e-6 * max(1, abs(by[0][d])) for d, _ in rows)
    mixer, guesses = seen["mixer"], seen["guesses"]
    split = lambda t: (t or "").lower().split() + [""]
    count = Counter(w for d, t in rows if crc32(str(d).encode()) % 10 for w in split(t))

    def spelt(word, before):
        text = b"  "[: 2 - min(len(before), 2)] + before[-2:] if before else b"  "
        t = lm_scoring.Tokens(np.frombuffer(word or b"x", dtype=np.uint8), np.zeros(1, np.uint64), np.zeros(1, np.int64), np.array([len(word)]), np.array([text[0] << 8 | text[1]], np.uint16), np.array([0, 1]))
        lost = 0.0
        for tail in (False, True):
            b = lm_scoring.bits_of(t, np.array([0]), mixer.code, tail)
            for i, node in enumerate(b.node):
                known = mixer.known[b.slots[-1][i] - lm_scoring._OFFSET[-2]]
                x = sum(float(mixer.weights[k, b.place[i] * 4 + known]) * float(mixer.odds[b.slots[k][i]]) for k in range(5))
                z = min(max(x, -7.999), 7.999) * 2 + 16
                row = mixer.refined[int(node)]
                p = row[int(z)] * (1 - z + int(z)) + row[int(z) + 1] * (z - int(z))
                p = min(max((p + 1 / (1 + math.exp(-x))) / 2, 1e-6), 1 - 1e-6)
                lost += math.log10(p if b.bit[i] else 1 - p)
        return lost

    for d, text in rows:
        words, total, run, right, due = [w.encode() for w in split(text)], 0.0, 0, 0.0, 0.0
        t = lm_scoring.tokens_of([(text or "").encode()])
        slot, name = lm_scoring.guess_keys(t)
        for i, w in enumerate(words):
            at, p, hit = slot[i], 0.0, False
            if guesses.name[at] and guesses.count[at] >= lm_scoring.GUESS_COPIES:
                hit = guesses.name[at] == name[i]
                first = float(guesses.chance(np.array([min(run, 7) * 8 + min(int(math.log2(guesses.count[at])), 7)]), np.array([guesses.name[at] >> 20]))[0])
                odds = first / (1 - first) * ((right + 2) / (due + 2)) ** lm_scoring.FOLLOW
                p, right, due = min(max(odds / (1 + odds), 1e-4), 1 - 1e-4), right + hit, due + first
            run = run + 1 if hit else 0
            if hit:
                total += math.log10(p)
            else:
                before = words[i - 1] if i else b""
                total += math.log10((1 - p) * (seen["new"] * 10 ** spelt(w, before) + (1 - seen["new"]) * count[w.decode()] / seen["total"]))
        assert abs(total - by[0][d]) < 2e-5 * max(1, abs(total)), (d, total, by[0][d])


def test_lm_guesses_are_those_of_all_texts():
    """A continuation that is second in each task, or there once a task, is first over all of them."""
    import pyarrow as pa

    def task(*after):
        return list(lm_scoring._followers(iter([pa.RecordBatch.from_pydict({"text": [f"a b {x}" for x in after]})])))

    tasks = [task("x", "x", "x", "m", "m"), task("y", "y", "y", "m", "m"), task("z", "z", "z", "m", "m")] + [task("c d" if i else "e f") for i in range(3)]
    rows = sorted(((r["block"], r["data"]) for t in tasks for b in t for r in b.to_pylist()), key=lambda x: x[0])
    batch = pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["block", "data"])
    best = {r["slot"]: (r["h"] & 0xFFFFFFFF, r["n"]) for b in lm_scoring._best_guesses(iter([batch])) for r in b.to_pylist()}
    slot, name = lm_scoring.guess_keys(lm_scoring.tokens_of([b"a b m", b"b c d"]))
    assert best[slot[2]] == (name[2], 6)
    slot, name = lm_scoring.guess_keys(lm_scoring.tokens_of([b"a b c d"]))
    assert best[slot[3]] == (name[3], 2)


def test_lm_contexts_reach_into_the_token_before(spark):
    """The same token after another last byte has another head, with bits in other slots, and its spelling is learned by it."""
    t = lm_scoring.tokens_of([b"a x", b"b x", b"a x"])
    rows, back = lm_scoring.distinct(t)
    heads, which = lm_scoring.heads_of(t, rows, back)
    assert (len(rows), len(heads)) == (4, 5) and which[1] == which[7] != which[4]
    code = lm_scoring.huffman(np.arange(256))
    bits = [lm_scoring.bits_of(t, np.array([i]), code, False).slots for i in (1, 4)]
    assert [bool((x != y).any()) for x, y in zip(*bits, strict=True)] == [False, True, True, True, False]
    r = random.Random(3)
    begin = {"q": "zu", "w": "ko"}
    word = lambda last, inside: "".join(r.choice("aeiou") for _ in range(3)) + inside + last

    def text():
        out, last = [], "q"
        for _ in range(60):
            last, out = (now := r.choice("qw")), [*out, begin[last] + word(now, "m")]
        return " ".join(out)

    rows = [(i, text()) for i in range(300)] + [(1000, "aaamq zuxxxmq"), (1001, "aaamq koxxxmq")]
    by = {x.doc_id: x.score for x in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), held_out="doc_id >= 1000").collect()}
    assert by[1000] > by[1001] + 0.5


def test_lm_is_fitted_on_all_training_texts(spark, monkeypatch):
    """A sample of one text of one word only starts the fit: guesses and weights come from all texts."""
    r = random.Random(5)
    follow = {w: r.sample(["red", "green", "blue", "grey", "pink", "black"], 2) for w in ("the", "a", "his", "her")}
    phrase = lambda: " ".join(f"{w} very {r.choice(follow[w])}{r.randrange(300)} {w} is" for w in r.choices(sorted(follow), k=8))
    rows = [(i, phrase()) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def held(docs, chars):
        monkeypatch.setattr(lm_scoring, "SAMPLE_DOCS", docs)
        monkeypatch.setattr(lm_scoring, "SAMPLE_CHARS", chars)
        return sum(x.score for x in lm_scoring.score_texts(df).collect() if x.held_out)

    whole, start = held(2_000, 3_000), held(1, 3)
    assert abs(start - whole) < 0.02 * abs(whole), (start, whole)


def test_lm_takes_no_sample(spark, monkeypatch):
    """Weights and refinement come from all training texts: the bounds of a sample change no score."""
    r = random.Random(6)
    df = spark.createDataFrame([(i, " ".join(f"{r.choice('abc')}{r.randrange(40)}" for _ in range(30))) for i in range(200)], "doc_id long, text string")
    whole = {x.doc_id: x.score for x in lm_scoring.score_texts(df).collect()}
    monkeypatch.setattr(lm_scoring, "SAMPLE_DOCS", 1)
    monkeypatch.setattr(lm_scoring, "SAMPLE_CHARS", 3)
    assert all(abs(x.score - whole[x.doc_id]) < 1e-6 * abs(whole[x.doc_id]) for x in lm_scoring.score_texts(df).collect())


def test_rare_insults_and_long_texts_are_learned():
    """A term in three of 4,000 texts, all toxic, counts; and a long text goes with all its terms."""
    import pyarrow as pa

    r = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    insults = [f"insult{i}" for i in range(130)]
    bad = [x for x in insults for _ in range(3)]
    texts = [" ".join(r.choices(words, k=20)) for _ in range(4000)]
    at = r.sample(range(4000), len(bad))
    for i, x in zip(at, bad, strict=True):
        texts[i] += " " + x
    y = np.zeros(4000)
    y[at] = 1
    doc, term = toxicity.term_sets([t.encode() for t in texts])
    fm = toxicity.train(doc, term, y)
    clean = [" ".join(r.choices(words, k=20)) for _ in insults]
    odds = lambda x: fm.scores(*toxicity.term_sets([t.encode() for t in x]), len(x))
    assert (odds([f"{t} {x}" for t, x in zip(clean, insults, strict=True)]) > odds(clean) + 1).mean() > 0.95
    long = " ".join(f"t{i}" for i in range(9000))
    batch = pa.RecordBatch.from_pydict({"h": [1, 2, 3], "y": [0, 1, 0], "text": [long, "", "a b"]})
    (got,) = toxicity._terms_of(iter([batch]))
    assert list(map(len, got.column(2).to_pylist())) == [len(toxicity.term_sets([long.encode()])[0]), 0, 2] and len(got.column(2)[0]) > 8000
