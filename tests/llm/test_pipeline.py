import random

import corpus_pipeline
from lodestone.llm import registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    r = random.Random(2)
    words = {"en": ["the", "and", "that", "with", "ing", "ther"], "fr": ["eaux", "que", "dans", "élé", "pour", "ont"]}
    text = lambda lang, n: " ".join(r.choice(words[lang]) + r.choice(words[lang]) + r.choice("abcdefghij") for _ in range(n))
    rows = [(i, text(lang, 120), lang, "s") for i, lang in enumerate(["en", "fr"] * 20)]
    shared, item = text("en", 50), text("en", 30)
    rows += [(100, rows[0][1] + " more", "en", "s"), (101, text("en", 60) + " " + shared, "en", "s"), (102, shared + " " + text("en", 60), "en", "s")]
    rows += [(103, text("fr", 50) + " " + item, "fr", "s"), (104, None, "en", "s"), (105, "12 3", "en", "s"), (106, rows[2][1], "en", "s")]
    rows = [(*x, len(x[1] or "")) for x in rows]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({x.doc_id for x in docs.select("doc_id").collect()})
    everything = {x[0] for x in rows}
    assert kept[0] == everything - {104, 105}
    assert kept[1] == kept[0] - {100, 106}
    assert kept[2] == kept[1]
    after = {x.doc_id: x for x in spark.read.parquet(f"{tmp_path}/substring_dedup").collect()}
    assert len(after[101].text.split()) == 60 and len(after[102].text.split()) == 60 and after[101].n_chars == len(after[101].text)
    assert kept[3] == kept[2] - {103} and kept[4] == kept[3]
    ran = {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ran == kept[4]


def _stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_rows_of_one_id_and_of_none(spark, tmp_path):
    """Unlike texts under one id stay; so do rows without an id, of which only the contaminated one goes."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(5, text("a")), (5, text("b")), (6, text("c")), (6, text("c")), (7, text("c") + " more"), (None, text("d")), (None, text("d")), (8, ""), (8, None), (9, text("e"))]
    df = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], DOCS)
    got = _stage("near_dedup")(spark, df, str(tmp_path))
    assert got.columns == df.columns
    kept = sorted(((x.doc_id, x.text) for x in got.collect()), key=str)
    assert kept == sorted([(5, text("a")), (5, text("b")), (6, text("c")), (None, text("d")), (None, text("d")), (8, ""), (8, None), (9, text("e"))], key=str)
    spark.createDataFrame([(1, text("d")), (2, text("b"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    more = df.union(spark.createDataFrame([(None, text("f"), "en", "s", 0)], DOCS))
    left = sorted(((x.doc_id, x.text) for x in _stage("decontamination")(spark, more, str(tmp_path)).collect()), key=str)
    assert left == sorted([r for r in [*rows, (None, text("f"))] if r[1] not in (text("d"), text("b"))], key=str)


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    clash = "doc_id long, text string, lang string, source string, n_chars long, k string, kept boolean, score string, several int, held_out string, _k int, size string"
    for name, rows in (("empty", []), ("full", [(i, f"the house number {i} of the old street was red and blue {i * 7}", "en" if i % 2 else "fr", "s", 1, "k", False, "x", 1, "h", 2, "z") for i in range(20)])):
        spark.createDataFrame(rows, clash).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, docs, f"{tmp_path}/{name}")
            assert out.columns == docs.columns, stage
            out.write.parquet(f"{tmp_path}/{name}/{stage}")
            docs = spark.read.parquet(f"{tmp_path}/{name}/{stage}")
        assert corpus_pipeline.packing(spark, docs, "").count() == len(rows)


def test_hardly_a_language_goes(spark, monkeypatch):
    """A text in which four languages mix is nearer to chance than the others, and is rejected."""
    monkeypatch.setattr(corpus_pipeline, "LEAST_OVER_CHANCE", 2.4)
    r = random.Random(9)
    signs = {"en": "abc", "fr": "def", "de": "ghi", "es": "jkl"}
    rows = [(i, " ".join("".join(r.choice(signs[lang]) for _ in range(5)) for _ in range(60)), lang) for i in range(200) for lang in [r.choice(sorted(signs))]]
    mixed = " ".join("".join(r.choice(signs[lang]) for _ in range(3)) for _ in range(80) for lang in sorted(signs))
    df = spark.createDataFrame([(*x, "s", 0) for x in [*rows, (500, mixed, None)]], DOCS)
    kept = {x.doc_id for x in corpus_pipeline.language_id(spark, df, "").collect()}
    assert kept == {x[0] for x in rows}


def test_registered():
    names = registry.queries()
    assert [n for n in range(1, 11) if sum(x.startswith(f"op{n}_") for x in names) != 1] == [] and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names)
