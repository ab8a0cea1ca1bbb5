"""JSON-lines exports of a graph: read, write in parts, and a manifest to verify them by."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators.running import before
from lodestone.sources.scratch import saved


def read_jsonl(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame:
    """Rows of the files that exist; blank and malformed lines are left out."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs

    def there(path: str) -> bool:
        p = hadoop.Path(path)
        return bool(p.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(p))

    found = [p for p in paths if there(p)]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(found)


def write_jsonl(df: DataFrame, path: str, by: str | None = None, file_bytes: int = 40 << 20) -> None:
    """Files of about ``file_bytes`` at most, in a folder for each value of ``by`` if given.

    A file's rows follow from the mean size of a row, which one scan gives.
    """
    size = df.agg(F.avg(F.octet_length(F.to_json(F.struct(*df.columns))) + 1)).first()[0]
    out = df.write.mode("overwrite").option("maxRecordsPerFile", max(1, int(file_bytes / max(size or 1, 1))))
    (out.partitionBy(by) if by else out).json(path)


#: Ranges of an export hold so many shards, and so many bytes, at least: all of a range but the last are rolled as one pass over the whole would.
SHARDS, RANGE_BYTES = 64, 4 << 20
#: Files that a task writes, about.
FILES = 1_000


def sharded(df: DataFrame, kind: str, order: list[str], file_bytes: int = 40 << 20) -> DataFrame:
    """(kind, shard, line, row): rows as JSON lines, each in a shard (from 1) of at most ``file_bytes`` of its kind; row is its place in that.

    A shard takes rows in order until the next would make it larger; a row larger
    than a shard has one of its own. Two passes: the first deals rows to ranges
    of about SHARDS shards (RANGE_BYTES, if that is more) and rolls shards in each,
    the second adds how many shards the ranges before have. So a shard may be short where a range ends.
    """
    line = F.concat(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), F.lit("\n"))
    rows = df.select(F.col(kind).cast("string").alias("kind"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), line.alias("line"))
    rows = rows.withColumn("bytes", F.octet_length("line").cast("long"))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    ranges = max(1, -(-total // max(SHARDS * file_bytes, RANGE_BYTES)))
    keys = ["kind", *(f"_o{i}" for i in range(len(order)))]
    placed = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).select("kind", "line", "bytes", F.spark_partition_id().alias("_part"))
    placed = saved(placed.mapInArrow(_rolled(file_bytes), "kind string, line string, _part int, _shard long, row long"), "shards")
    ahead = before(placed, F.max("_shard") + 1, ["kind"]).select(F.col("_part").alias("_p"), F.col("kind").alias("_k"), "_before")
    joined = placed.join(F.broadcast(ahead), (F.col("_part") == F.col("_p")) & F.col("kind").eqNullSafe(F.col("_k")))  # a row a range and kind in it
    return joined.select("kind", (F.col("_before") + F.col("_shard") + 1).alias("shard"), "line", "row")


def _rolled(file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held, shard, row = object(), 0, -1, 0
        for batch in batches:
            kinds, size = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            out, place = np.empty((2, len(size)), np.int64)
            for i, (k, n) in enumerate(zip(kinds, size.tolist(), strict=True)):
                if k != kind:
                    kind, held, shard, row = k, 0, 0, 0
                elif held and held + n > file_bytes:
                    held, shard, row = 0, shard + 1, 0
                out[i], place[i] = shard, row
                held, row = held + n, row + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out), pa.array(place)], names=["kind", "line", "_part", "_shard", "row"])

    return run


def write_shards(df: DataFrame, path: str, kind: str, order: list[str], file_bytes: int = 40 << 20) -> DataFrame:
    """An export as Kind.jsonl, or Kind_001.jsonl, Kind_002.jsonl, ... where a kind has several shards, in folder ``path``.

    Gives (kind, shard, file, rows, bytes), a row a file. A shard is written whole by one task.
    """
    shards = saved(sharded(df, kind, order, file_bytes), "lines")
    files = shards.groupBy("kind", "shard").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("line").cast("long")).alias("bytes"))
    several = files.groupBy(F.col("kind").alias("_k")).agg(F.max("shard").alias("_last"))
    stem = F.regexp_replace(F.coalesce("kind", F.lit("null")), r"(?U)[^\p{Alnum}_]", "_")
    number = F.when(F.col("_last") > 1, F.concat(F.lit("_"), F.lpad(F.col("shard").cast("string"), F.greatest(F.lit(3), F.char_length(F.col("shard").cast("string"))), F.lit("0")))).otherwise("")
    named = files.join(several, F.col("kind").eqNullSafe(F.col("_k"))).select("kind", "shard", F.concat(stem, number, F.lit(".jsonl")).alias("file"), "rows", "bytes")
    named = saved(named, "files")
    lines = shards.join(named.select(F.col("kind").alias("_k"), F.col("shard").alias("_s"), "file"), F.col("kind").eqNullSafe(F.col("_k")) & (F.col("shard") == F.col("_s")))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, named.count() // FILES)
    lines = lines.repartition(tasks, "file").sortWithinPartitions("file", "kind", "shard", "row").select("file", "line")
    lines.mapInArrow(_written(_location(df.sparkSession, path)), "files long").agg(F.sum("files")).first()
    return named


def _location(spark: SparkSession, path: str) -> str:
    """The folder, made, as a path (of a local or mounted file system) or an address that tasks can open."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(context._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    whole = store.makeQualified(folder).toUri()
    return whole.getPath() if whole.getScheme() == "file" else whole.toString()


def _written(location: str):
    """(file, line) in order of files -> (files): each file is written under a name of its own and then renamed, so that a repeated task does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(location)
        name, held, n, own = None, [], 0, uuid.uuid4().hex

        def close() -> None:
            with store.open_output_stream(f"{folder}/.{own}") as out:
                out.write("".join(held).encode())
            store.move(f"{folder}/.{own}", f"{folder}/{name}")

        for batch in batches:
            for file, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != name:
                    if held:
                        close()
                    name, held, n = file, [], n + 1
                held.append(line)
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["files"])

    return run


def files_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the digests of an export's files, in order; the driver sees 64 characters a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    found = files.select(F.sha2("content", 256).alias("d")).collect()
    return hashlib.sha256("".join(sorted(r["d"] for r in found)).encode()).hexdigest()


def next_version(version: str | None) -> str:
    """x.y.z with z one higher; 1.0.0 where there is none or it isn't of this form."""
    parts = (version or "").split(".")
    if len(parts) != 3 or not all(p.isdigit() for p in parts):
        return "1.0.0"
    return f"{parts[0]}.{parts[1]}.{int(parts[2]) + 1}"


def export_manifest(df: DataFrame, path: str, by: str, version: str | None = None) -> dict:
    """What describes the export of df at ``path``: version, rows of each kind (a row a kind comes to the driver), digest of its files."""
    counts = {r[by]: r["n"] for r in df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"version": next_version(version), "counts": dict(sorted(counts.items(), key=str)), "digest": files_digest(df.sparkSession, path)}


def verified(spark: SparkSession, path: str, found: dict) -> bool:
    """Are an export's files those that its manifest describes?"""
    return files_digest(spark, path) == found["digest"]


def manifest(df: DataFrame, by: str) -> DataFrame:
    """(by, n, digest): rows of each kind, and a digest that their order doesn't change, to compare exports with."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)])
    total = F.sum(row.cast("decimal(20,0)")).cast("string")
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("|", F.hex(F.bit_xor(row)), total), 256).alias("digest"))


def differing(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """Kinds whose manifests differ, with both counts; empty if an export is whole."""
    a = left.select(by, F.col("n").alias("n_left"), F.col("digest").alias("d_left"))
    b = right.select(by, F.col("n").alias("n_right"), F.col("digest").alias("d_right"))
    return a.join(b, by, "full").where(~F.col("d_left").eqNullSafe(F.col("d_right"))).select(by, "n_left", "n_right")
