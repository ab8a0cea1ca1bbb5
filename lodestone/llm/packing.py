"""Best-two-fit packing of token sequences, planned on a histogram of lengths.

1. A scan tokenizes the texts and cuts long documents into pieces.
2. Pieces are counted by length: at most ``size`` numbers, whatever the input.
3. The plan is made on the counts. A bin is filled greedily with the longest
   pieces that fit; then its smallest piece gives way to the two unpacked
   pieces that fill the widened gap best, if they fill it better. The bin so
   found is repeated as often as the counts allow, so a plan has a few thousand
   patterns, however many bins there are.
4. Pieces get a rank among those of their length and take the place of that
   rank in the plan. Ranks come from counts by (length, salt), so no task holds
   all pieces of a common length.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm._common import BYTE_CODE, Rolling, Scratch, chunk_ranges, texts_of

#: Pieces in a group whose ranks one task gives.
RANKED = 100_000
#: Distinct pre-tokens whose ids a task keeps.
KNOWN = 600_000
#: How byte-level BPE of this family cuts a text before it merges (fixed values of the
#: vocabulary): a space joins the letters, digits or other signs after it, and a run of
#: white space leaves its last character to what follows.
LETTER, DIGIT, OTHER, SPACE, BREAK, ODD = 1, 2, 3, 4, 5, 6
_CLASS = np.full(256, ODD, dtype=np.uint8)
_CLASS[0x21:0x7F] = OTHER
_CLASS[ord("0") : ord("9") + 1] = DIGIT
_CLASS[ord("A") : ord("Z") + 1] = _CLASS[ord("a") : ord("z") + 1] = LETTER
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = SPACE
_CLASS[0x80:0xC0] = _CLASS[0xC3:0xC6] = LETTER  # two-byte letters; what else has such bytes is odd
_CLASS[ord("'")] = ODD  # contractions are left to the library
_CLASS[0] = BREAK


#: Texts on which both ways of encoding must agree before the fast one is used.
PROBES = [b" The  quick brown\n\n fox, 12345 jumps\tover--the lazy dog!  ", "Ünïcödé straße él ñandú  x".encode(), b"", b"a" * 50 + b" " * 9 + b"?!" * 9 + b"0" * 20]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fits(path: str) -> bool:
    """Is the file's tokenizer what the cuts and ``piece_encoder`` take it for: byte-level BPE without a normalizer or
    options, whose merges come in the order of their ids?"""
    file = json.loads(open(path, encoding="utf-8").read())
    cut, model = file.get("pre_tokenizer") or {}, file["model"]
    plain = file.get("normalizer") is None and file.get("post_processor") is None and file.get("truncation") is None and file.get("padding") is None
    level = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space", True) and cut.get("use_regex", True)
    bare = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not (plain and level and bare):
        return False
    ids = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    return ids[:1] != [-1] and all(a < b for a, b in zip(ids, ids[1:], strict=False))


def piece_encoder(path: str):
    """bytes of one pre-token -> ids, by the merges of the same file.

    The file's merge order is its id order, which makes ids ranks; the library's
    own call spends most of its time on offsets that nothing here reads.
    """
    import tiktoken

    vocabulary = json.loads(open(path, encoding="utf-8").read())["model"]["vocab"]
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocabulary.items() if all(c in byte_of for c in t)}
    return tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class TokenIds:
    """The library's ids of whole texts, with each distinct pre-token looked up once.

    Texts of ASCII and two-byte Latin letters are cut into pre-tokens as byte
    arrays; a text with any other sign goes to the library whole. So does every
    text if the file isn't of the kind for which the cuts hold (``fits``), or if
    ids of the texts in ``PROBES`` differ from the library's.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.piece = piece_encoder(path) if fits(path) else None
        self._reset()
        if self.piece and any((a != self.whole(t)).any() if len(a := self.encode([t])[0]) == len(self.whole(t)) else True for t in PROBES):
            self.piece = None

    def _reset(self) -> None:
        self.row: dict[int, int] = {}
        self.offset = np.zeros(1 << 16, dtype=np.int64)  # of row i: offset[i] to offset[i + 1]
        self.flat = np.zeros(1 << 18, dtype=np.uint32)

    def _learn(self, hashes: list[int], words: list[bytes]) -> None:
        found = list(map(self.piece, words))
        n = len(self.row)
        ends = self.offset[n] + np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
        while n + len(found) + 1 > len(self.offset):
            self.offset = np.concatenate((self.offset, np.zeros_like(self.offset)))
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.offset[n] : ends[-1]] = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=ends[-1] - self.offset[n])
        self.offset[n + 1 : n + 1 + len(found)] = ends
        self.row.update(zip(hashes, range(n, n + len(found)), strict=True))

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.piece:
            return list(map(self.whole, texts))
        raw = b"\0" + b"\0".join(texts) + b"\0"
        buf = np.frombuffer(raw, dtype=np.uint8)
        kind = _CLASS[buf]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begin = np.cumsum(np.concatenate(([1], lengths[:-1] + 1)))
        after_c3 = np.flatnonzero(buf == 0xC3) + 1
        odd = np.concatenate((np.flatnonzero(kind == ODD), after_c3[(buf[after_c3] == 0x97) | (buf[after_c3] == 0xB7)]))
        odd_texts = set(np.unique(np.searchsorted(begin, odd, side="right") - 1).tolist())
        odd_texts |= {i for i, n in enumerate(lengths.tolist()) if raw.count(b"\0", begin[i], begin[i] + n)} if raw.count(b"\0") != len(texts) + 1 else set()
        odd_texts |= {i for s in self.special if s in raw for i, t in enumerate(texts) if s in t}

        change = np.ones(len(buf), dtype=bool)
        change[1:] = kind[1:] != kind[:-1]
        space = kind == SPACE
        # the last of a run of white space stands alone, or goes with what follows if it is a blank
        last = np.zeros(len(buf), dtype=bool)
        last[:-1] = space[:-1] & ~space[1:] & (kind[1:] != BREAK)
        change |= last
        join = np.zeros(len(buf), dtype=bool)
        join[1:] = last[:-1] & (buf[:-1] == 0x20)
        start = np.flatnonzero((change & ~join) | (kind == BREAK))
        end = np.append(start[1:], len(buf))
        real = kind[start] != BREAK
        start, end = start[real], end[real]
        hashes, first, back = np.unique(Rolling(BYTE_CODE[buf]).slices(start, end), return_index=True, return_inverse=True)
        keys = hashes.tolist()
        if len(self.row) + len(keys) > KNOWN:
            self._reset()
        get = self.row.get
        rows = np.array([get(h, -1) for h in keys], dtype=np.int64)
        new = np.flatnonzero(rows < 0)
        if len(new):
            base = len(self.row)
            self._learn([keys[i] for i in new.tolist()], [raw[start[i] : end[i]] for i in first[new].tolist()])
            rows[new] = base + np.arange(len(new))
        token = rows[back]
        low = self.offset[token]
        count = self.offset[token + 1] - low
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.flat[np.repeat(low - total[:-1], count) + np.arange(total[-1])]
        edges = total[np.searchsorted(start, np.append(begin, len(buf)))]
        return [self.whole(t) if i in odd_texts else ids[edges[i] : edges[i + 1]] for i, t in enumerate(texts)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, size: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenIds(path)
        tail = np.array([end], dtype=np.uint32)
        for batch in batches:
            texts, doc_ids = [t or b"" for t in texts_of(batch)], batch.column(0).to_pylist()
            for a, b in chunk_ranges(texts):
                out: list[list] = [[], [], [], [], [], []]
                for doc_id, found in zip(doc_ids[a:b], tokens.encode(texts[a:b]), strict=True):
                    ids = np.concatenate((found, tail)).astype("<u4")
                    at = piece = 0
                    while at < len(ids):
                        length = (len(ids) % size or size) if piece == 0 else size
                        part = ids[at : at + length].tobytes()
                        for column, value in zip(out, (doc_id, piece, at, length, zlib.crc32(part), part), strict=True):
                            column.append(value)
                        at, piece = at + length, piece + 1
                columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(out[5], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def plan_bins(counts: np.ndarray, size: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) patterns that use up ``counts`` (index: length) by best-two-fit."""
    left = counts.astype(np.int64).copy()
    plan = []
    lengths = np.arange(size + 1)
    longest = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # longest[x]: of the lengths <= x that are left

    def refresh() -> None:
        longest[:] = np.maximum.accumulate(np.where(left > 0, lengths, 0))

    while longest[size]:
        bin_, gap = [], size
        while gap and longest[gap]:
            x = int(longest[gap])
            times = min(int(left[x]), gap // x)
            bin_ += [x] * times
            gap -= x * times
            left[x] -= times
            if not left[x]:
                refresh()
        while gap and len(bin_) > 0:  # the smallest gives way to two that fill more
            s = bin_[-1]
            room = gap + s
            a = np.flatnonzero(left[: room // 2 + 1] > 0)
            if not len(a):
                break
            b = longest[room - a]
            ok = (b >= a) & ((b != a) | (left[a] >= 2))
            total = np.where(ok, a + b, 0)
            i = int(total.argmax()) if len(total) else 0
            if total[i] <= s:
                break
            pair = sorted((int(a[i]), int(b[i])), reverse=True)
            bin_.pop()
            left[s] += 1
            for x in pair:
                left[x] -= 1
            refresh()
            bin_ = sorted(bin_ + pair, reverse=True)
            gap = room - pair[0] - pair[1]
        used = np.bincount(bin_, minlength=size + 1)
        at = np.flatnonzero(used)
        more = int((left[at] // used[at]).min())
        left[at] -= more * used[at]
        refresh()
        plan.append((1 + more, bin_))
    return plan


def _places(plan: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: rank ranges [lo, ...), with the bin of the first rank, the offset in a bin."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    next_rank: dict[int, int] = {}
    bins = 0
    for times, lengths in plan:
        offset = 0
        for x in lengths:
            lo = next_rank.get(x, 0)
            rows.setdefault(x, []).append((lo, bins, offset))
            next_rank[x] = lo + times
            offset += x
        bins += times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for x, r in rows.items()}


def _placed(places: dict[int, tuple[np.ndarray, ...]], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1)) if len(order) else []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                rows = order[i:j]
                lo, bins, offset = places[int(length[rows[0]])]
                at = np.searchsorted(lo, rank[rows], side="right") - 1
                seq[rows], off[rows] = bins[at] + rank[rows] - lo[at], offset[at]
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, size: int = 2048, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and ids, little-endian 32-bit, if asked for).

    A document is its text's ids and ``end_id``; one of more than ``size`` ids
    is cut, its first piece taking what the full ones leave. Pieces of a
    sequence lie at gapless offsets from 0.

    A null or empty text is the end id alone. Repeated rows are packed each.
    A null doc_id is packed like any other. Other columns are ignored. An empty
    table gives none. Ties of length go by salt, doc_id and piece.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    path = tokenizer or tokenizer_path()
    schema = PIECES + ", ids binary" * with_ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = scratch.save(texts.mapInArrow(_pieces(path, size, end_id, with_ids), schema), "pieces")
    counts = np.zeros(size + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``size`` rows
        counts[r["length"]] = r["count"]
    places = _places(plan_bins(counts, size))
    salts = max(1, int(counts.max()) // RANKED + 1, int(counts.sum()) // (4 * RANKED) + 1, 16)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").count().select(
        "length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("r", F.row_number().over(inside)).join(base, ["length", "salt"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = ranked.select(*names, (F.col("base") + F.col("r") - 1).alias("rank"))
    return ranked.mapInArrow(_placed(places, names), schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary) of a packing made with ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
