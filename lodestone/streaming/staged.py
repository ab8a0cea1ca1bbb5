"""Files through stages, batch by batch, with a commit a stage: a run that was stopped goes on where it was.

The stream's own checkpoint says which files a batch has, and the same batch has
the same number when it is run again. A stage's results of a batch are written
under that number; what has been committed isn't run or written again, and what
was cut short is written anew. So each file passes each stage once in effect.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions import chunking
from lodestone.operators import embedding, extraction, ingest


#: Reads a table that a stage before has written for the same batch.
Read = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Stage:
    """``run`` takes the files that are at one of the stages ``after``, and gives them with their new stage, and tables beside them.

    tables: the schemas of these, by name.
    """

    name: str
    after: tuple[str, ...]
    run: Callable[[DataFrame, Read], tuple[DataFrame, dict[str, DataFrame]]]
    tables: dict[str, str] = field(default_factory=dict)


class Pipeline:
    """Stages over a stream of files with the columns stage, error and others, under a folder that all executors share."""

    def __init__(self, spark: SparkSession, stages: list[Stage], root: str):
        self.spark, self.stages, self.root = spark, stages, root.rstrip("/")
        self.tables = {name: schema for s in stages for name, schema in s.tables.items()}

    # ------------------------------------------------------------ commits

    def _path(self, table: str, batch: int) -> str:
        return f"{self.root}/{table}/batch={batch}"

    def _committed(self, table: str, batch: int | str) -> list[str]:
        """Folders of a table's whole batches; batch may be a pattern."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._path(table, batch)}/_SUCCESS")
        found = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
        return [f.getPath().getParent().toString() for f in found or []]

    def _commit(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(path)  # _SUCCESS comes last

    def run_batch(self, files: DataFrame, batch: int) -> None:
        """All stages over one batch; stages that are committed for it are read, not run."""
        rows, schema = files, files.schema
        read = lambda name: self.spark.read.schema(self.tables[name]).parquet(self._path(name, batch))
        for stage in self.stages:
            path = self._path(stage.name, batch)
            if not self._committed(stage.name, batch):
                here = F.col("stage").isin(*stage.after)
                moved, tables = stage.run(rows.where(here), read)
                for name, df in tables.items():  # before the stage's own commit, which says that they are whole
                    self._commit(df, self._path(name, batch))
                self._commit(moved.select(files.columns).unionByName(rows.where(~here)), path)
            rows = self.spark.read.schema(schema).parquet(path)

    # ------------------------------------------------------------ runs

    def run(self, stream: DataFrame) -> None:
        """Every batch that the stream has now, one after the other; returns when none is left, raises where a batch fails."""
        out = stream.writeStream.foreachBatch(self.run_batch).option("checkpointLocation", f"{self.root}/_offsets")
        out.trigger(availableNow=True).start().awaitTermination()

    def states(self, schema: str) -> DataFrame:
        """Files as the last stage left them, of whole batches."""
        return self._whole(self.stages[-1].name, schema)

    def table(self, name: str) -> DataFrame:
        """A table that stages write beside the files, of whole batches."""
        return self._whole(name, self.tables[name])

    def _whole(self, name: str, schema: str) -> DataFrame:
        found = self._committed(name, "*")
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)


# ---------------------------------------------------------------- the stages of ingestion

FILES = "doc_id long, text string, size_bytes long, fault string, stage string, error string"
CHUNKS = "document_id string, chunk_index int, content string"
MENTIONS = "document_id string, chunk int, position int, name string, entity_type string, description string"


def _moved(files: DataFrame, stage: Column, error: Column) -> DataFrame:
    return files.withColumns({"stage": stage, "error": F.coalesce("error", error)})


def _download(most_mb: float):
    def run(files: DataFrame, read: Read) -> tuple[DataFrame, dict]:
        too_large = ingest.size_action(F.col("size_bytes"), most_mb) == "skipped"
        stage = F.when(too_large, "skipped").when(F.col("fault").isNotNull(), ingest.failure_stage(F.col("fault"))).otherwise("downloaded")
        return _moved(files, stage, F.when(too_large, F.lit(f"larger than {most_mb:g} MB")).otherwise(F.substring("fault", 1, 500))), {}

    return run


def _extract(size: int, overlap: int):
    def run(files: DataFrame, read: Read) -> tuple[DataFrame, dict]:
        empty = F.trim(F.coalesce("text", F.lit(""))) == ""
        pieces = chunking.chunks(files.where(~empty).select("doc_id", "text"), size, overlap)
        pieces = pieces.select(F.col("doc_id").cast("string").alias("document_id"), "chunk_index", "content")
        return _moved(files, F.when(empty, "failed").otherwise("extracted"), F.when(empty, "no text")), {"chunks": pieces}

    return run


def _embed(failing: Column | None, dims: int):
    def run(files: DataFrame, read: Read) -> tuple[DataFrame, dict]:
        vectors, bad = embedding.embedded(read("chunks"), failing, dims)
        failed = bad.select(F.col("document_id").cast("long").alias("doc_id"), F.col("error").alias("_why"))
        rows = files.join(failed, "doc_id", "left")
        return _moved(rows, F.when(F.col("_why").isNotNull(), "embed_failed").otherwise("embedded"), F.col("_why")), {"vectors": vectors}

    return run


def _link(files: DataFrame, read: Read) -> tuple[DataFrame, dict]:
    linked = read("chunks").join(files.select(F.col("doc_id").cast("string").alias("document_id")), "document_id", "left_semi")
    return _moved(files, F.lit("kg_done"), F.lit(None).cast("string")), {"mentions": extraction.candidates(extraction.extracted(linked))}


def ingestion(spark: SparkSession, root: str, most_mb: float = 50, failing: Column | None = None, size: int = 1000, overlap: int = 200, dims: int = 64) -> Pipeline:
    """Files (see FILES) downloaded, extracted, embedded and linked: kg_done in the end, or how they ended before.

    doc_id tells files apart; fault is what a download reports (null: nothing).
    failing: see ``embedding.batch_outcomes``, over document_id and chunk_index.
    Tables beside the files: chunks, vectors and mentions.
    """
    stages = [
        Stage("downloaded", ("pending",), _download(most_mb)),
        Stage("extracted", ("downloaded",), _extract(size, overlap), {"chunks": CHUNKS}),
        Stage("embedded", ("extracted",), _embed(failing, dims), {"vectors": embedding.OUT}),
        Stage("linked", ("embedded",), _link, {"mentions": MENTIONS}),
    ]
    return Pipeline(spark, stages, root)
