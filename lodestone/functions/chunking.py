"""Texts to chunks and sections, as Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNKS = "doc_id long, chunk_index int, content string, token_count long, heading string"
#: Chunks in an output batch.
BATCH = 4096


def chunk_text(text: str, size: int = 1000, overlap: int = 200) -> Iterator[str]:
    """Chunks of about ``size`` characters that overlap by ``overlap``.

    Paragraphs are gathered while they fit. What grows past half as much again
    is cut behind the last full stop, or else blank, that leaves a chunk more
    than the overlap; or else at that length.
    """
    held = ""
    for part in filter(None, map(str.strip, text.split("\n\n"))):
        if not held:
            held = part
        elif len(held) + 2 + len(part) <= size:
            held = f"{held}\n\n{part}".strip()
        else:
            yield held.strip()
            held = f"{held[-overlap:]}\n\n{part}" if 0 < overlap < len(held) else part
        at = 0  # a moving start, so that a long paragraph isn't copied for each cut
        while len(held) - at > size * 1.5:
            ends = (held.rfind(mark, at, at + size) - at + 1 for mark in (". ", " "))
            cut = next((e for e in ends if e > 0 and e >= size - overlap), size - overlap)
            yield held[at : at + cut].strip()
            at += max(1, cut - overlap)
            while at < len(held) and held[at].isspace():
                at += 1
        held = held[at:].strip() if at else held
    if held.strip():
        yield held.strip()


def sections_of(text: str) -> Iterator[tuple[str, str]]:
    """(heading, section): a line whose first sign is # begins one and stays in it; blank ones are left out."""
    heading, lines = "", []
    for line in [*text.split("\n"), None]:
        if line is None or line.lstrip().startswith("#"):
            body = "\n".join(lines)
            if body.strip():
                yield heading, body
            if line is not None:
                heading, lines = line.lstrip().lstrip("#").strip(), [line]
        else:
            lines.append(line)


def chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, by_section: bool = False) -> DataFrame:
    """One row a chunk of docs (doc_id, text): doc_id, chunk_index, content, token_count (words), heading.

    With ``by_section`` sections are cut singly, and heading names theirs. Null
    and blank texts have no chunks.
    """
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                parts = sections_of(text) if by_section else [(None, text)]
                pieces = ((c, h) for h, body in parts for c in chunk_text(body, size, overlap))
                for i, (c, h) in enumerate(pieces):
                    rows.append((doc_id, i, c, len(c.split()), h))
                    if len(rows) >= BATCH:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CHUNKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=re.findall(r"(\w+) \w+", CHUNKS))


def section_characters(docs: DataFrame) -> DataFrame:
    """(doc_id, characters) of docs (doc_id, text): the sum of the sections' lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [sum(len(body) for _, body in sections_of(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64())], names=["doc_id", "characters"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, characters long")


def results(docs: DataFrame, size: int = 1000, overlap: int = 200, by_section: bool = False, most: int = 200_000) -> DataFrame:
    """One row a document (doc_id, text): doc_id, n_chunks, total_characters, error.

    A text that can't be processed (null, or of more than ``most`` characters)
    has no chunks and an error, and is a result like any other. With
    ``by_section`` total_characters is the sum over the sections.
    """
    length = F.char_length("text")
    error = F.when(F.col("text").isNull(), "no text").when(length > most, F.concat(F.lit("more than "), F.lit(str(most)), F.lit(" characters")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", error.alias("error"))
    each = chunks(rows.where("error is null").select("doc_id", "text"), size, overlap, by_section).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    total = F.when(F.col("error").isNull(), length).otherwise(0).cast("long").alias("total_characters")
    sized = rows.select("doc_id", total, "error")
    if by_section:
        sums = section_characters(rows.where("error is null")).groupBy("doc_id").agg(F.sum("characters").alias("_sum"))
        sized = sized.drop("total_characters").join(sums, "doc_id", "left").withColumn("total_characters", F.coalesce("_sum", F.lit(0)))
    return sized.join(each, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_chunks"), "total_characters", "error")


def fetched(docs: DataFrame, pieces: DataFrame, offset: int = 0, most: int = 100_000, page: int = 5) -> DataFrame:
    """(id, mode, content, returned) of docs (id, text): the whole text up to ``most`` characters, else ``page`` chunks from
    ``offset`` on, between rules. pieces: document_id, chunk_index, content."""
    some = pieces.where(F.col("chunk_index").between(offset, offset + page - 1)).groupBy("document_id")
    some = some.agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("x"))  # a page's chunks a document
    long = F.char_length("text") > most
    joined = docs.join(some, F.col("id") == F.col("document_id"), "left")
    return joined.select(
        "id", F.when(long, "chunks").otherwise("full").alias("mode"),
        F.when(long, F.coalesce(F.array_join("x.content", "\n\n---\n\n"), F.lit(""))).otherwise(F.col("text")).alias("content"),
        F.when(long, F.coalesce(F.size("x"), F.lit(0))).otherwise(1).alias("returned"),
    )
