"""What several operators share: scratch tables, and words and hashes of texts as numpy arrays.

Texts reach Python as Arrow batches. They are cut into chunks of bounded bytes
and documents, joined by single spaces, and handled as one byte array, so that
no loop runs over words or bytes.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and documents in a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
CHUNK_DOCS = 1024

U64 = np.uint64
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Java and DuckDB pattern of what separates words.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- scratch tables

_OWN_DIR: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is named and all is one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _OWN_DIR.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="lodestone-"))


class Scratch:
    """Intermediate tables, written as Parquet to the shared folder to cut lineage.

    A lost executor costs a re-run of tasks, never of the stages before the
    written table. ``drop`` removes a table that nothing reads any more; the
    rest goes when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._remove(t._scratch_path)
        self.free()

    def free(self) -> None:
        """Has the driver let go of finished steps, so that executors delete their shuffle files."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _remove(self, path: str) -> None:
        try:
            context = self.spark.sparkContext
            if context._jsc is None:
                return
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session is gone, and with it the right to delete
            return


def keyed(docs: DataFrame, *more) -> DataFrame:
    """(k, doc_id, text): k is a row's join key, made of id and text, so that rows
    that repeat an id with another text stay apart."""
    return docs.select(
        F.xxhash64(F.col("doc_id"), F.lit("|"), F.col("text")).alias("k"),
        F.col("doc_id"),
        F.col("text"),
        *more,
    )


def spread_join(many: DataFrame, few: DataFrame, on: list[str], by: Column, scratch: Scratch, how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """many joined with few. sizes (by default few itself, then unique by ``on``) is a saved table that says in ``size`` how
    many of many's rows have a key.

    Rows of a key that would be more than a quarter of a task's share are dealt
    over several tasks by a hash of ``by``, with a copy of few's rows for each.
    Of all rows, at most four keys a task are so large: these are broadcast.
    """
    sizes = few if sizes is None else sizes
    tasks = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    share = max(1, total // (4 * tasks))
    hot = sizes.where(F.col("size") > share).select(*on, F.ceil(F.col("size") / share).cast("int").alias("_deals"))
    hot = F.broadcast(hot)  # 4 * tasks rows at most
    dealt = many.join(hot, on, "left").withColumn("_deal", F.when(F.col("_deals").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_deals")).cast("int")))
    copies = F.when(F.col("_deals").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_deals") - 1))
    copied = few.drop("size").join(hot, on, "left").withColumn("_deal", F.explode(copies))
    return dealt.drop("_deals").join(copied.drop("_deals"), [*on, "_deal"], how).drop("_deal")


def carried(docs: DataFrame, names: list[str]) -> tuple[list, str, list]:
    """Columns that an operator passes through: (as x0, x1, ... ; their schema ; back under their names).

    Inside an operator they can't clash with its own columns.
    """
    inside = [F.col(f"`{n}`").alias(f"x{i}") for i, n in enumerate(names)]
    schema = "".join(f", x{i} {docs.schema[n].dataType.simpleString()}" for i, n in enumerate(names))
    return inside, schema, [F.col(f"x{i}").alias(n) for i, n in enumerate(names)]


# ---------------------------------------------------------------- hashing


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (splitmix64's finalizer)."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Bases of the first and the second digest.
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
BYTE_CODE = splitmix(np.arange(1, 257, dtype=U64) * U64(_BASES[0]))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a rolling base and of its inverse, modulo 2**64."""
    if len(_POWERS.get(f"p{which}", ())) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for name, base in (("p", _BASES[which]), ("q", pow(_BASES[which], -1, 1 << 64))):
            values = np.full(size, U64(base), dtype=U64)
            values[0] = 1
            _POWERS[f"{name}{which}"] = np.cumprod(values, dtype=U64)
    return _POWERS[f"p{which}"][:n], _POWERS[f"q{which}"][:n]


class Rolling:
    """Hashes of any slice of a sequence of 64-bit codes, each in constant time; ``which`` of two, of unlike bases."""

    def __init__(self, codes: np.ndarray, which: int = 0):
        p, self.inverse = powers(len(codes) + 1, which)
        self.sums = np.zeros(len(codes) + 1, dtype=U64)
        np.cumsum(codes * p[:-1], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return splitmix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


# ---------------------------------------------------------------- chunks of texts


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def chunk_ranges(texts: list[bytes | None], limit: int = CHUNK_BYTES, docs: int = CHUNK_DOCS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes and rows together, or one row."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and (size + n > limit or i - begin >= docs):
            yield begin, i
            begin, size = i, 0
        size += n + 1
    if begin < len(texts):
        yield begin, len(texts)


class Chunk:
    """Texts joined by a space, with the words of each: [start, end) in ``buf``.

    ``first[i]:first[i + 1]`` are the words of text i, and ``begin[i]`` is where it begins.
    """

    def __init__(self, texts: list[bytes | None], lower: bool):
        parts = [t or b"" for t in texts]
        self.buf = np.frombuffer(b" ".join(parts), dtype=np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        self.lengths = lengths
        self.begin = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(parts) else np.zeros(0, np.int64)
        space = np.ones(len(self.buf) + 2, dtype=np.int8)
        space[1:-1] = _SPACES[self.buf]
        edge = np.diff(space)
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.first = np.concatenate((np.searchsorted(self.start, self.begin), [len(self.start)]))
        self.n_words = np.diff(self.first)

    def word_codes(self) -> np.ndarray:
        return Rolling(BYTE_CODE[self.buf]).slices(self.start, self.end)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_words)), self.n_words)


_SLOT = [U64(v) for v in splitmix(np.arange(11, 31, dtype=U64)) | U64(1)]


def shingle_sets(chunk: Chunk, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(doc, element), sorted and distinct: each text's set of word shingles as 54-bit hashes.

    A text of fewer than ``width`` words has its whole sequence as its one shingle.
    """
    codes, n = chunk.word_codes(), chunk.n_words
    doc = chunk.doc_of_word()
    whole = np.zeros(len(codes), dtype=U64)
    if len(codes) >= width:
        last = len(codes) - width + 1
        for j in range(width):
            whole[:last] += codes[j : j + last] * _SLOT[j]
    left = np.repeat(chunk.first[1:], n) - np.arange(len(codes))
    keep = left >= width
    docs, values = [doc[keep]], [splitmix(whole[keep])]
    for short in range(1, width):
        rows = np.flatnonzero(n == short)
        if len(rows):
            at = chunk.first[rows]
            h = np.full(len(rows), U64(short), dtype=U64)
            for j in range(short):
                h += codes[at + j] * _SLOT[width + j]
            docs.append(rows)
            values.append(splitmix(h))
    key = (np.concatenate(docs).astype(U64) << U64(54)) | (np.concatenate(values) >> U64(10))
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key >> U64(54)).astype(np.int64), key & U64((1 << 54) - 1)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
