"""Fixed-length windows that occur twice anywhere in a corpus, found through anchors.

1. A scan names each document's anchors by key: a digest of the anchor and of
   half a window beside it. A key that occurs once has only unique windows.
2. A second scan emits the anchors of the other keys, with u: a digest of all
   windows of an anchor together. Equal (key, u) are copies: all their windows
   are repeated, and one of them stands for the rest.
3. Of keys with several classes, each class's windows are digested in blocks
   of neighbours: a block equal as a whole is repeated, one whose common middle
   is unique is not. Only the windows of other blocks, and of those with the
   same middle, are hashed in one more scan and compared singly.
4. Spans of repeated windows go back to their documents.

All counting is by grouped sums of digests with map-side partial sums, so a
passage that a third of all documents share costs each task one row. Where rows
are joined by such a passage's key, they are dealt over tasks (``spread_join``).
Equality is that of two 64-bit digests of unlike bases (key and u, or key and a
window's).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import BYTE_CODE, CHUNK_BYTES, Chunk, Rolling, Scratch, U64, chunk_ranges, keyed, signed, splitmix, spread_join, texts_of
from lodestone.llm.anchors import minimum_anchors, recompression_anchors, runs

#: Elements of a text whose anchors are found at once: their places take 24 bits.
PLACES = 1 << 24
ANCHORS = "k long, key long, u long, a int, s0 int, s1 int"
BLOCKS = "key long, u long, single boolean, t int, size int, core long, whole long"
HASHED = "key long, u long, single boolean, t int, hashes array<long>"


class Sequences:
    """A chunk's texts as one sequence of codes: ``begin`` and ``size`` of each, and slice digests."""

    def __init__(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray):
        self.codes, self.begin, self.size = codes, begin, size
        self.digest = Rolling(codes).slices
        self.second = Rolling(codes, 1).slices  # of another base: what it names differs wherever one of the two does

    def starts(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of every window start."""
        n = np.maximum(self.size - width + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        offset = self.begin - (np.cumsum(n) - n)
        return doc, np.repeat(offset, n) + np.arange(len(doc))


def byte_sequences(texts: list[bytes | None]) -> Sequences:
    parts = [t or b"" for t in texts]
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    buf = np.frombuffer(b"\0".join(parts), dtype=np.uint8)
    return Sequences(BYTE_CODE[buf], np.cumsum(size + 1) - size - 1, size)


def word_sequences(texts: list[bytes | None]) -> Sequences:
    c = Chunk(texts, lower=False)
    return Sequences(c.word_codes(), c.first[:-1], c.n_words)


def byte_anchors(width: int, gram: int) -> Callable:
    """Phrase ends: a place whose rolling hash of ``gram`` bytes is the least of some window."""

    def find(s: Sequences, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(s.codes) < width:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        i = np.arange(len(s.codes) - gram + 1)
        names = s.digest(i, i + gram)
        if len(names) <= PLACES:
            at = minimum_anchors(names, width - gram + 1)[starts]
            return at, names[at]
        at = np.empty(len(starts), np.int64)  # a very long text in overlapping parts
        step = PLACES - width
        for lo in range(0, len(names), step):
            here = (starts >= lo) & (starts < lo + step)
            if not here.any():
                continue
            part = minimum_anchors(names[lo : lo + step + width], width - gram + 1)
            at[here] = part[starts[here] - lo] + lo
        return at, names[at]

    return find


def word_anchors(width: int, rounds: int) -> Callable:
    """Places of grams of two high-level symbols. A very long text is taken in parts that overlap by a window: what
    decides a window's anchor lies inside the window, so any part that holds it finds the same."""

    def find(s: Sequences, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        breaks = np.zeros(len(s.codes) + 1, dtype=bool)
        breaks[s.begin] = True
        step = len(s.codes) + 1 if len(s.codes) <= PLACES else PLACES - width
        at, name = np.empty(len(starts), np.int64), np.empty(len(starts), U64)
        for lo in range(0, len(s.codes), step):
            here = (starts >= lo) & (starts < lo + step)
            if not here.any():
                continue
            hi = min(lo + step + width, len(s.codes))
            found, name[here] = recompression_anchors(s.codes[lo:hi], breaks[lo : hi + 1], width, rounds, starts[here] - lo)
            at[here] = np.where(found < 0, -1, found + lo)
        own = at < 0
        return np.where(own, starts, at), np.where(own, s.digest(starts, starts + width), name)

    return find


def _anchor_rows(sequences: Callable, anchors: Callable, width: int, keys_only: bool = False):
    """Runs of windows with one anchor, split where it passes their middle.

    The key is a digest of what every window of the half holds beside the
    anchor: the stretch after it, or before it for windows that end near it.
    """
    half = (width + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, texts = batch.column(0).to_numpy(), texts_of(batch)
            for lo, hi in chunk_ranges(texts):
                s = sequences(texts[lo:hi])
                doc, start = s.starts(width)
                if not len(start):
                    continue
                at, name = anchors(s, start)
                late = at - start >= half
                first, last = runs(at, doc, late)
                a, s0, s1, d, late = at[first], start[first], start[last], doc[first], late[first]
                beside = s.digest(a - np.where(late, half, 0), a + np.where(late, 0, width - half + 1))
                key = splitmix(name[first] + splitmix(beside + late.astype(U64)))
                if keys_only:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(key))], names=["key"])
                    continue
                u = s.second(s0, s1 + width) + splitmix((a - s0).astype(U64))
                columns = [k[lo:hi][d], signed(key), signed(u), *((x - s.begin[d]).astype(np.int32) for x in (a, s0, s1))]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["k", "key", "u", "a", "s0", "s1"])

    return run


def _block_rows(sequences: Callable, width: int, block: int, hashed: bool):
    """(text, spans) -> blocks of at most ``block`` windows at equal distances from their anchor: their digests, or each window's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = texts_of(batch), batch.column(1)
            for lo, hi in chunk_ranges(texts):
                s = sequences(texts[lo:hi])
                part = lists.slice(lo, hi - lo)
                n = part.value_lengths().to_numpy(zero_copy_only=False)
                span = part.flatten()
                get = lambda name: span.field(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                doc = np.repeat(np.arange(hi - lo), n)
                begin = s.begin[doc]
                a, s0, s1 = (get(x).astype(np.int64) for x in ("a", "s0", "s1"))
                t0 = -((a - s0) // block) * block  # windows' distances from the anchor, in blocks
                first, last = (s0 - a) // block, (s1 - a) // block
                count = last - first + 1
                i = np.repeat(np.arange(len(a)), count)
                b = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
                w0, w1 = np.maximum(s0[i], a[i] + b * block), np.minimum(s1[i], a[i] + b * block + block - 1)
                at = begin[i]
                size = w1 - w0 + 1
                same = [get("key")[i], get("u")[i], get("single").astype(bool)[i], (w0 - a[i]).astype(np.int32)]
                if hashed:
                    j = np.repeat(np.arange(len(i)), size)
                    w = at[j] + w0[j] + np.arange(len(j)) - np.repeat(np.cumsum(size) - size, size)
                    hashes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(signed(s.second(w, w + width))))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, same), hashes], names=["key", "u", "single", "t", "hashes"])
                    continue
                whole = s.second(at + w0, at + w1 + width)
                core0, core1 = a[i] + b * block + block - 1, a[i] + b * block + width
                inside = (core0 <= s1[i] + width) & (core1 <= s.size[doc][i])
                core = s.second(at + np.where(inside, core0, w1), at + np.where(inside, core1, w0 + width))
                columns = [*same, size.astype(np.int32), signed(core), signed(whole)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "u", "single", "t", "size", "core", "whole"])

    return run


def doubled(rows: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(k, size) of rows (k, ...) that repeat another's id and text; None if there are none."""
    found = scratch.save(rows.groupBy("k").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "doubled")
    return None if found.isEmpty() else found


def with_spans(rows: DataFrame, spans: DataFrame, doubles: DataFrame | None, scratch: Scratch) -> DataFrame:
    """rows with the spans of their k, if any. A row that repeats very often is dealt over tasks."""
    if doubles is None:
        return rows.join(spans, "k", "left")
    return spread_join(rows, spans, ["k"], F.struct(F.spark_partition_id(), F.monotonically_increasing_id()), scratch, "left", sizes=doubles)


def repeated_spans(docs: DataFrame, scratch: Scratch, sequences: Callable, anchors: Callable, width: int, block: int, doubles: DataFrame | None = None) -> DataFrame:
    """(k, spans of s0, s1) over ``docs`` (k, doc_id, text): windows s0 to s1 of that document occur elsewhere.

    doubles: see ``doubled``. Of rows that repeat each other one is enough to
    have its windows digested.
    """
    texts = docs.select("k", "text")
    once = lambda lists: texts.join(lists, "k") if doubles is None else texts.join(lists, "k").dropDuplicates(["k"])
    place = F.struct("k", "s0", F.spark_partition_id())  # copies of a row stand in several partitions
    size = F.count(F.lit(1)).alias("size")
    names = texts.mapInArrow(_anchor_rows(sequences, anchors, width, keys_only=True), "key long")
    keys = scratch.save(names.groupBy("key").agg(size).where("size > 1"), "keys")
    found = texts.mapInArrow(_anchor_rows(sequences, anchors, width), ANCHORS)
    again = scratch.save(spread_join(found, keys, ["key"], place, scratch), "again")
    scratch.drop(keys)
    one = F.min(F.struct("k", "a", "s0", "s1")).alias("at")
    classes = scratch.save(again.groupBy("key", "u").agg(F.count(F.lit(1)).alias("n"), one), "classes")
    several = classes.where("n > 1").select("key", "u", F.col("n").alias("size"))
    copies = scratch.save(spread_join(again, several, ["key", "u"], place, scratch, "left_semi").select("k", "s0", "s1"), "copies")
    scratch.drop(again)
    mixed = scratch.save(classes.groupBy("key").agg(size, F.min("n").alias("least")).where("size > 1 and least = 1").select("key", "size"), "mixed")
    rest = spread_join(classes, mixed, ["key"], F.col("u"), scratch).select("at.k", F.struct("key", "u", (F.col("n") == 1).alias("single"), "at.a", "at.s0", "at.s1").alias("span"))
    rest = scratch.save(rest.groupBy("k").agg(F.collect_list("span").alias("spans")), "rest")
    scratch.free()
    blocks = once(rest).select("text", "spans").mapInArrow(_block_rows(sequences, width, block, False), BLOCKS)
    blocks = scratch.save(blocks, "blocks")
    scratch.drop(rest, mixed)

    by_whole = ["key", "t", "width", "whole"]
    sized = blocks.withColumnRenamed("size", "width")
    wholes = scratch.save(sized.groupBy(by_whole).agg(size).where("size > 1"), "wholes")
    places = classes.select("key", "u", "at.k", "at.a")
    equal = spread_join(sized.where("single"), wholes, by_whole, F.col("u"), scratch, "left_semi").select("key", "u", "t", (F.col("t") + F.col("width") - 1).alias("t1"))
    own = lambda rows: rows.join(places, ["key", "u"]).select("k", (F.col("a") + F.col("t")).alias("s0"), (F.col("a") + F.col("t1")).alias("s1"))
    found = copies.union(own(equal))
    done = [copies, classes, blocks, wholes]
    if block > 1:  # a block of one window is settled as a whole
        by_core = ["key", "b", "core"]
        cored = sized.withColumn("b", F.expr(f"cast(floor(t / {block}) as int)"))
        twice = cored.groupBy(by_core).agg(size).where("size > 1")
        unsettled = spread_join(cored.where("single"), wholes, by_whole, F.col("u"), scratch, "left_anti").select(by_core).distinct().join(twice, by_core)
        cores = scratch.save(unsettled, "cores")
        need = spread_join(cored, cores, by_core, F.col("u"), scratch, "left_semi").join(places, ["key", "u"])
        span = F.struct("key", "u", "single", "a", (F.col("a") + F.col("t")).alias("s0"), (F.col("a") + F.col("t") + F.col("width") - 1).alias("s1"))
        need = scratch.save(need.groupBy("k").agg(F.collect_list(span).alias("spans")), "need")
        scratch.free()
        hashed = scratch.save(once(need).select("text", "spans").mapInArrow(_block_rows(sequences, width, block, True), HASHED), "hashed")
        scratch.drop(need)
        single = hashed.select("key", "u", "single", F.posexplode("hashes").alias("i", "h"), "t").select("key", "u", "single", (F.col("t") + F.col("i")).alias("t"), "h")
        windows = scratch.save(single.groupBy("key", "t", "h").agg(size).where("size > 1"), "windows")
        scratch.free()
        lone = spread_join(single.where("single"), windows, ["key", "t", "h"], F.col("u"), scratch, "left_semi").select("key", "u", "t", F.col("t").alias("t1"))
        found = found.union(own(lone))
        done += [hashed, windows, cores]
    spans = scratch.save(merged_spans(found), "spans")
    scratch.drop(*done)
    return spans


def covered(n: int, s0: np.ndarray, s1: np.ndarray, width: int) -> np.ndarray:
    """Which of n elements lie in windows s0 to s1."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, s0, 1)
    np.add.at(edge, s1 + width, -1)
    return np.cumsum(edge)[:-1] > 0


def merged_spans(spans: DataFrame) -> DataFrame:
    """(k, spans) with one array for each document."""
    return spans.distinct().groupBy("k").agg(F.collect_list(F.struct("s0", "s1")).alias("spans"))


__all__ = ["CHUNK_BYTES", "Sequences", "byte_anchors", "byte_sequences", "covered", "doubled", "keyed", "merged_spans", "repeated_spans", "with_spans", "word_anchors", "word_sequences"]
