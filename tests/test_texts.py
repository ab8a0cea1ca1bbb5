import pytest
from pyspark.sql import functions as F

from lodestone.functions import chunking, text


def plain_chunks(body, size, overlap):
    """The contract of chunk_text, cut by cut on copies."""
    out, cur = [], ""

    def cut():
        nonlocal cur
        while len(cur) > 1.5 * size:
            i = cur.rfind(". ", 0, size)
            if i < 0 or i + 1 < size - overlap:
                i = cur.rfind(" ", 0, size)
            if i < 0 or i + 1 < size - overlap:
                i = size - overlap - 1
            out.append(cur[: i + 1].strip())
            cur = cur[max(0, i + 1 - overlap) :].strip()

    for p in (x.strip() for x in body.split("\n\n")):
        if p:
            if cur and len(cur) + len(p) + 2 > size:
                out.append(cur.strip())
                cur = cur[-overlap:] + "\n\n" + p if 0 < overlap < len(cur) else p
            else:
                cur = cur + "\n\n" + p if cur else p
            cut()
    return out + [cur.strip()] if cur.strip() else out


@pytest.mark.parametrize(("size", "overlap"), [(1000, 200), (600, 0), (300, 50), (500, 50), (400, 100), (10, 3)])
@pytest.mark.parametrize("body", ["", " \n\n ", "short", "First paragraph. " * 30, "\n\n".join(["A paragraph of some words."] * 10), "Word " * 500, "A " * 300 + "B " * 300, "x" * 2500, "a.  b. " * 400])
def test_chunks(body, size, overlap):
    assert list(chunking.chunk_text(body, size, overlap)) == plain_chunks(body, size, overlap)


def test_sections():
    assert list(chunking.sections_of("intro\n# One\nbody\n  ## Two \n\n#\n \n")) == [("", "intro"), ("One", "# One\nbody"), ("Two", "  ## Two \n"), ("", "#\n \n")]


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "# H\n" + "word " * 600), (2, None), (3, "  ")], "doc_id long, text string")
    rows = chunking.chunks(df, 500, 50, by_section=True).collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and {r.doc_id for r in rows} == {1} and {r.heading for r in rows} == {"H"}
    with pytest.raises(ValueError):
        chunking.chunks(df, 100, 100)


def test_functions(spark):
    c = F.col("c")
    row = lambda value, *columns: tuple(spark.createDataFrame([(value,)], "c string").select(*columns).first())
    assert row("Ünï_x y-1", text.safe_label(c), text.safe_filename(c), text.safe_title(c)) == ("Ünï_xy1", "Ünï_x_y_1", "Ünï_x y-1")
    assert row("a b  c", text.word_count(c), text.tokens_by_length(c)) == (3, 1)
    assert row("x/y/z.PDF", text.path_parent(c), text.path_leaf(c), text.extension(c), text.processor(c)) == ("x/y", "z.PDF", "pdf", "pdf")
    assert row("1.2.9", text.bumped_patch(c)) == ("1.2.10",)
    assert row("1536", text.human_size(c)) == ("1.5 KB",)
    assert row('ok ```json\n{"a": 1}\n``` end', text.salvaged_json(c)) == ('{"a": 1}',)
    assert row('so {"a": {"b": 2}} it is', text.salvaged_json(c)) == ('{"a": {"b": 2}}',)
    assert row("none", text.salvaged_json(c)) == (None,)
    assert row("5", text.backoff_seconds(c.cast("int"))) == (30,)
