"""Processors of documents as table functions of SQL, by the kind of a file.

A processor turns a file's bytes into text, and that into chunks. It is known by
the types that it supports; ``process_document`` of SQL takes a file's type and
bytes and gives rows, to be joined laterally with the files.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lodestone.functions.chunking import chunk_text, sections_of


class Processor:
    """Text and chunks of files of some types."""

    #: MIME types and extensions, lower-case.
    types: tuple[str, ...] = ()

    def can_process(self, kind: str | None) -> bool:
        return (kind or "").lower().strip(".") in self.types

    def text(self, content: bytes) -> str:
        """The content as text; bytes that aren't UTF-8 become U+FFFD."""
        return content.decode("utf-8", "replace")

    def process(self, content: bytes, size: int, overlap: int) -> Iterator[tuple[str, str]]:
        """(heading, chunk) of the content, in order."""
        return (("", c) for c in chunk_text(self.text(content), size, overlap))


class PlainText(Processor):
    types = ("text/plain", "txt", "text")


class Markdown(Processor):
    """Sections by headings, each cut by itself."""

    types = ("text/markdown", "md")

    def process(self, content: bytes, size: int, overlap: int) -> Iterator[tuple[str, str]]:
        return ((heading, c) for heading, body in sections_of(self.text(content)) for c in chunk_text(body, size, overlap))


_PROCESSORS: list[Processor] = []


def register_processor(processor: Processor) -> None:
    """Makes a processor known; of several for one type the last counts."""
    _PROCESSORS.insert(0, processor)


def processor_for(kind: str | None) -> Processor | None:
    return next((p for p in _PROCESSORS if p.can_process(kind)), None)


register_processor(PlainText())
register_processor(Markdown())


def supported(kind: Column) -> Column:
    """Is there a processor for this type?"""
    return F.lower(F.trim(F.lit("."), kind)).isin(sorted({t for p in _PROCESSORS for t in p.types}))


@udtf(returnType="chunk_index int, heading string, content string, token_count long, error string")
class ProcessDocument:
    """Chunks of a file; a row with an error alone for one that can't be processed, as a null text or an unknown type."""

    def eval(self, kind: str, content: bytes, size: int = 1000, overlap: int = 200):
        processor = processor_for(kind)
        if processor is None or content is None:
            yield None, None, None, None, f"no processor for {kind}" if processor is None else "no content"
            return
        if not 0 <= overlap < size:
            raise ValueError("0 <= overlap < size")
        for i, (heading, chunk) in enumerate(processor.process(bytes(content), size, overlap)):
            yield i, heading, chunk, len(chunk.split()), None


def register(spark: SparkSession) -> None:
    """Makes process_document(kind, content, size, overlap) known to SQL."""
    spark.udtf.register("process_document", ProcessDocument)
