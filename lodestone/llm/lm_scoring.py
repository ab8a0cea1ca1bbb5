"""Log probability of whole texts by logistic context mixing over the bits of their tokens.

A token is written as its bytes and a blank, the end of a text as a blank
alone; bytes are written in a Huffman code, a node of which names what is known
of the byte. Five predictors give a bit's odds by hashed contexts: place in the
token, the last one, two and three bytes (the last two bytes of the token before
included), and the token so far. Gated weights mix their odds, and a table of
mixed odds by node refines the result.

Before that, one more bit says whether the token is the one that most often
followed the two before it (a match model); its odds come from how long such
guesses have been right and how sure this one is, and from the guess itself.
They are corrected online: by how often guesses were right in the text so far,
against how often they were expected to be. Spelling shares a token's remaining
probability with the token's own count: the share is that of tokens seen once
(the chance of a new token).

What the contexts see of the token before ends with a token's third symbol. So a
token's bits are those of its head (its first three symbols and the two bytes
before, one number) and those of its tail, which the token alone decides: both
are counted and written once for each distinct head and token, not once for each
place.

1. A scan of all training texts counts every token that follows in each slot of
   guesses; only of the counts of all texts the largest is taken.
2. A second scan counts how often guesses are right, each byte (the code is made
   of them), each head, and each task's tokens. Summed over all texts, heads and
   tokens give the bits by slot: every occurrence counts, but is written once.
3. Weights start even. Each of a few passes over the heads and tokens of all
   training texts gives a Newton step of each gate's weights, and the last one,
   with the weights that stay, the refinement, as sums of fixed size. What is
   predicted is left out of the counts. No sample has a part in it.
4. A scan of all texts writes each head and tail of a chunk of texts once, or
   takes it from chunks before. Counts and tails of the ``FREQUENT`` most frequent
   tokens go with it, and as many heads. The other tokens' counts are joined by
   shuffle: of N tokens each has N / FREQUENT copies at most, so none can be hot.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import Chunk, Scratch, U64, chunk_ranges, signed, splitmix, texts_of

#: Slots of each predictor, as powers of two, and slots in a block of the shuffled counts.
BITS = (12, 16, 18, 19, 20)
BLOCK = 4096
#: Bounds of a sample that once started the fit; nothing reads them, and no score depends on them.
SAMPLE_DOCS, SAMPLE_CHARS = 2_000, 3_000
#: Tokens whose counts are sent to every task at most, and heads.
FREQUENT = 1 << 19
#: Bytes of texts whose distinct tokens are scored together, and tokens handled at once.
TOGETHER, SLICE = 1 << 20, 1 << 11
#: Tails that a task keeps from its chunks before, and tokens and heads that it gathers before it sums them, and writes those of many kinds.
KEPT, GATHER_HELD = 1 << 19, 1 << 20
#: Bytes of rows that reach Python as one batch.
BATCH = 4 << 20
GATES, KNOTS = 32, 33
#: Symbols of a token that the bytes before it have a part in; heads by a table up to so many cells.
HEAD, CELLS = 3, 1 << 22
#: Slots of guesses, as a power of two; copies of a guess in all training texts before it counts, and as many as make a difference.
GUESS_BITS, GUESS_COPIES, MOST_COPIES = 22, 2, 255
#: How sure a guess is by its copies, MOST_COPIES at most.
SURE = np.minimum(np.log2(np.maximum(np.arange(MOST_COPIES + 1), 1)).astype(np.int64), 7)
#: Slots in a block of the shuffled guesses, and guesses that a task holds before it writes them.
GUESS_BLOCK, GUESS_HELD = 2048, 1 << 20
#: Newton steps of the weights, a pass over all training heads and tokens each; one more pass gives the refinement.
STEPS = 2
#: Copies that the mixed odds as they are count for in the refinement.
START = 500
#: How far guesses' odds follow what came true of them in the text so far.
FOLLOW = 1.0
BLANK = 0x20
#: Bytes between words.
SEPARATORS = [0x20, *range(0x09, 0x0E)]
#: Hash of the end of a text among those of tokens.
END = np.array([0x1F3D5B79A2C4E680], dtype=U64)

U32 = np.uint32
_LN10 = float(np.log(10))
_OFFSET = np.concatenate(([0], np.cumsum([1 << b for b in BITS])))
SLOTS = int(_OFFSET[-1])
#: Sizes of the tables that a scan for guesses and a round give.
HITS = 64 * 4096 * 2
_SIZES = (GATES * len(BITS), GATES * len(BITS) ** 2, 256 * KNOTS, 256 * KNOTS)


@dataclass
class Code:
    """A Huffman code: byte b has the bits and nodes first[b]:first[b + 1]."""

    first: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def huffman(counts: np.ndarray) -> Code:
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    children, n = {}, 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[n] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], n, n))
        n += 1
    paths: dict[int, list[tuple[int, int]]] = {heap[0][2]: []}
    for x in range(n - 1, 255, -1):
        for bit, child in enumerate(children[x]):
            paths[child] = [*paths[x], (x - 256, bit)]
    size = [len(paths[b]) for b in range(256)]
    flat = [e for b in range(256) for e in paths[b]]
    return Code(np.concatenate(([0], np.cumsum(size))), np.array([x for x, _ in flat], dtype=U32), np.array([b for _, b in flat], dtype=np.uint8))


@dataclass
class Tokens:
    """Tokens of a chunk of texts: ``codes`` by text in order, each text with its end; bytes start:end of ``buf``."""

    buf: np.ndarray
    codes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    last: np.ndarray  # the last two bytes of the token before, as a number; blanks at the start of a text
    first: np.ndarray  # tokens first[i]:first[i + 1] are of text i


BLANKS = BLANK << 8 | BLANK


def tokens_of(texts: list[bytes | None]) -> Tokens:
    parts = []
    base = count = 0
    for lo, hi in chunk_ranges(texts, 1 << 18):
        c = Chunk(texts[lo:hi], lower=True)
        at = c.first[1:] + np.arange(hi - lo)  # ends go after the words of each text
        word = np.ones(len(c.start) + hi - lo, dtype=bool)
        word[at] = False
        codes, start, end, own = (np.full(len(word), fill, dtype=kind) for fill, kind in ((END[0], U64), (0, np.int64), (0, np.int64), (BLANKS, np.uint16)))
        codes[word], start[word], end[word] = c.word_codes(), c.start + base, c.end + base
        one, two = c.buf[c.end - 1].astype(np.uint16), c.buf[np.maximum(c.end - 2, 0)].astype(np.uint16)
        own[word] = one | np.where(c.end - c.start > 1, two, BLANK) << np.uint16(8)
        last = np.concatenate(([BLANKS], own[:-1])).astype(np.uint16)
        begin = np.concatenate(([0], at[:-1] + 1))
        last[begin] = BLANKS
        parts.append((c.buf, codes, start, end, last, begin + count))
        base, count = base + len(c.buf), count + len(codes)
    if not parts:
        return Tokens(*(np.zeros(0, k) for k in (np.uint8, U64, np.int64, np.int64, np.uint16)), np.zeros(1, np.int64))
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    return Tokens(*columns[:5], np.append(columns[5], count))


def pieces_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """(first row, row after the last, texts) of a batch's rows, TOGETHER bytes at most or one row; the others' texts stay in Arrow."""
    size = pc.binary_length(batch.column(batch.schema.get_field_index("text"))).fill_null(0).to_pylist()
    begin = total = 0
    for i, n in enumerate([*size, TOGETHER]):
        if i > begin and (total + n > TOGETHER or i == len(size)):
            yield begin, i, texts_of(batch.slice(begin, i - begin))
            begin, total = i, 0
        total += n + 1


def distinct(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(one index of each distinct token, in order of codes; which of them each token is)."""
    order = np.argsort(t.codes)
    codes = t.codes[order]
    new = np.concatenate((np.ones(min(len(codes), 1), dtype=bool), codes[1:] != codes[:-1]))
    back = np.empty(len(codes), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def heads_of(t: Tokens, rows: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct heads in order, which of them each token has): two bytes before and three symbols, as a number."""
    size = t.end[rows] - t.start[rows]
    front = np.zeros(len(rows), dtype=np.int64)
    for j in range(HEAD):
        front = front << 8 | np.where(size > j, t.buf[np.minimum(t.start[rows] + j, max(len(t.buf) - 1, 0))] if len(t.buf) else 0, BLANK)
    some, which = np.unique(front, return_inverse=True)
    befores = np.flatnonzero(np.bincount(t.last, minlength=1 << 16))
    place = np.zeros(1 << 16, dtype=np.int64)
    place[befores] = np.arange(len(befores))
    cell = place[t.last] * len(some) + which[back]
    if len(some) * len(befores) > CELLS:
        cells, at = np.unique(cell, return_inverse=True)
    else:
        there = np.zeros(len(some) * len(befores), dtype=bool)
        there[cell] = True
        cells = np.flatnonzero(there)
        number = np.zeros(len(there), dtype=np.int32)
        number[cells] = np.arange(len(cells))
        at = number[cell]
    return befores[cells // max(len(some), 1)] << 24 | some[cells % max(len(some), 1)], at


def head_tokens(heads: np.ndarray) -> Tokens:
    """Heads as tokens of their first symbols."""
    buf = np.stack([(heads >> s & 0xFF).astype(np.uint8) for s in (16, 8, 0)], axis=1)
    size = (buf != BLANK).sum(axis=1)
    start = np.arange(len(heads)) * HEAD
    return Tokens(buf.ravel(), np.zeros(len(heads), U64), start, start + size, (heads >> 24).astype(np.uint16), np.zeros(1, np.int64))


def bytes_of(t: Tokens, rows: np.ndarray) -> pa.Array:
    """The bytes of the tokens at ``rows``."""
    size = t.end[rows] - t.start[rows]
    edge = np.concatenate(([0], np.cumsum(size)))
    data = t.buf[np.repeat(t.start[rows] - edge[:-1], size) + np.arange(edge[-1])] if edge[-1] else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def listed(tokens: pa.Array) -> Tokens:
    """Tokens from their bytes; their hashes aren't needed and left out."""
    _, offsets, data = tokens.buffers()
    edge = np.frombuffer(offsets, dtype=np.int32)[tokens.offset : tokens.offset + len(tokens) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Tokens(buf, np.zeros(len(tokens), U64), edge[:-1], edge[1:], np.full(len(tokens), BLANKS, np.uint16), np.zeros(1, np.int64))


def guess_keys(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(slot of the two tokens before, 32-bit name) of each token; names are never 0."""
    n = len(t.codes)
    one, two = np.zeros(n, dtype=U64), np.zeros(n, dtype=U64)
    one[1:], two[2:] = t.codes[:-1], t.codes[:-2]
    begin = t.first[:-1]
    one[begin] = two[begin] = 0
    second = begin[begin + 1 < t.first[1:]] + 1
    two[second] = 0
    slot = splitmix(one * U64(3) + splitmix(two + U64(1))) >> U64(64 - GUESS_BITS)
    return slot.astype(np.int64), ((t.codes >> U64(32)).astype(U32) | U32(1))


def counted(key: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct keys in order, how often each is there or the sum of its times)."""
    if times is None:
        key = np.sort(key)
    else:
        order = np.argsort(key)
        key, times = key[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(key))) if times is None else np.add.reduceat(times, first) if len(key) else times
    return key[first], n.astype(np.int64)


def packed(key: np.ndarray, n: np.ndarray, edge: np.ndarray, codec: pa.Codec) -> list[bytes]:
    """Guesses by slot and name, each block's (``edge[i]`` to ``edge[i + 1]``) as bytes: places in the block, names, counts."""
    place, name, times = ((key >> U64(32)) & U64(GUESS_BLOCK - 1)).astype(np.uint16), key.astype(U32), n.astype(U32)
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        data = b"".join((place[a:b].tobytes(), name[a:b].tobytes(), times[a:b].tobytes()))
        out.append((b - a).to_bytes(4, "little") + codec.compress(data, asbytes=True))
    return out


def unpacked(block: int, data: bytes, codec: pa.Codec) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(data[:4], "little")
    raw = codec.decompress(data[4:], decompressed_size=10 * size, asbytes=True)
    place, name, n = np.frombuffer(raw, np.uint16, size), np.frombuffer(raw, U32, size, 2 * size), np.frombuffer(raw, U32, size, 6 * size)
    return ((place.astype(U64) + U64(block * GUESS_BLOCK)) << U64(32)) | name, n.astype(np.int64)


@dataclass
class Guesses:
    """name (0: none) and count (MOST_COPIES at most) by slot; counts of right guesses by run and sureness, and by name; weights by run."""

    name: np.ndarray
    count: np.ndarray
    by_run: np.ndarray = field(default_factory=lambda: np.ones((64, 2)))
    by_name: np.ndarray = field(default_factory=lambda: np.ones((4096, 2)))
    weights: np.ndarray = field(default_factory=lambda: np.full((2, 8), 0.5))

    def look(self, t: Tokens, own: int = 0) -> tuple[np.ndarray, ...]:
        """(is there a guess, is it right, cell by run and sureness, cell by name); own: copies of each token that don't count."""
        slot, name = guess_keys(t)
        count, guess = self.count.take(slot).astype(np.int32) - own, self.name.take(slot)
        there = (guess != 0) & (count >= GUESS_COPIES)
        hit = there & (guess == name)
        at = np.arange(len(hit))
        before = np.concatenate(([False], hit[:-1]))
        before[t.first[:-1][t.first[:-1] < len(hit)]] = False
        since = at - np.maximum.accumulate(np.where(before, 0, at))
        run = np.minimum(since, 7)
        sure = SURE.take(np.clip(count, 0, MOST_COPIES))
        return there, hit, run * 8 + sure, (guess >> U32(20)).astype(np.int64)

    def chance(self, cell: np.ndarray, guess: np.ndarray) -> np.ndarray:
        x = self.weights[0][cell // 8] * self._odds(self.by_run)[cell] + self.weights[1][cell // 8] * self._odds(self.by_name)[guess]
        return np.clip(1 / (1 + np.exp(-x)), 1e-4, 1 - 1e-4)

    @staticmethod
    def _odds(n: np.ndarray) -> np.ndarray:
        return np.log(n[:, 1] / n[:, 0])

    def online(self, t: Tokens, there: np.ndarray, hit: np.ndarray, cell: np.ndarray, guess: np.ndarray) -> np.ndarray:
        """Chances of right guesses (0: none), corrected by what came true of them in the text before."""
        p = np.where(there, self.chance(cell, guess), 0.0)
        begin = np.repeat(t.first[:-1], np.diff(t.first))
        before = lambda x: (lambda c: c[:-1] - c[begin])(np.concatenate(([0.0], np.cumsum(x))))
        ratio = (before(hit) + 2) / (before(p) + 2)
        odds = p / (1 - p) * ratio**FOLLOW
        return np.where(there, np.clip(odds / (1 + odds), 1e-4, 1 - 1e-4), 0.0)

    def hits(self, t: Tokens) -> np.ndarray:
        """Guesses in these texts by (cell by run and sureness, cell by name, right or not), as one flat table of counts."""
        there, hit, cell, guess = self.look(t, own=1)
        return np.bincount(((cell * 4096 + guess) * 2 + hit)[there], minlength=HITS)

    def fit(self, counts: np.ndarray) -> None:
        """counts: the sum of ``hits`` over the training texts."""
        table = counts.reshape(64, 4096, 2)
        self.by_run += table.sum(axis=1)
        self.by_name += table.sum(axis=0)
        cell, guess = np.nonzero(table.sum(axis=2))
        right, n = table[cell, guess, 1], table[cell, guess].sum(axis=1)
        odds = (self._odds(self.by_run)[cell], self._odds(self.by_name)[guess])
        size = np.bincount(cell // 8, weights=n, minlength=8) + 10
        for _ in range(60):
            error = right - n * self.chance(cell, guess)
            for w, o in zip(self.weights, odds, strict=True):
                w += 0.3 * np.bincount(cell // 8, weights=error * o, minlength=8) / size


@dataclass
class Bits:
    """Coded bits of some tokens: slots of each predictor, with node, bit, gate part by place, and the token's number."""

    slots: list[np.ndarray]
    node: np.ndarray
    bit: np.ndarray
    place: np.ndarray
    token: np.ndarray


def bits_of(t: Tokens, rows: np.ndarray, code: Code, tail: bool) -> Bits:
    """The bits of the tokens' heads, or of their tails."""
    size = t.end[rows] - t.start[rows]
    wide = size + 4  # a blank and the two bytes before, then the token and its blank
    first = np.cumsum(wide) - wide
    text = np.full(int(wide.sum()), BLANK, dtype=np.uint8)
    owner = np.repeat(np.arange(len(rows)), wide)
    at = np.arange(len(text)) - first[owner]
    inside = (at >= 3) & (at < 3 + size[owner])
    text[inside] = t.buf[(t.start[rows][owner] + at - 3)[inside]]
    text[first + 1], text[first + 2] = t.last[rows] >> 8, t.last[rows] & 0xFF
    symbols = np.flatnonzero(at >= 3 + HEAD) if tail else np.flatnonzero((at >= 3) & (at < 3 + HEAD))
    wide_text = text.astype(U32)
    b1, b2, b3 = (wide_text[symbols - j] for j in (1, 2, 3))
    place = np.minimum(at[symbols] - 3, 7).astype(U32)
    # the token so far: sums of its bytes' codes by place, hashed
    term = (wide_text + U32(1)) * U32(0x9E3779B1)
    term ^= term >> U32(15)
    term *= (at.astype(U32) * U32(2) + U32(1)) * U32(0x85EBCA6B)
    term[at < 3] = 0
    total = np.concatenate((np.zeros(1, U32), np.cumsum(term, dtype=U32)))
    so_far = total[symbols] - total[first[owner[symbols]]]
    contexts = [
        place,
        b1 + U32(0x1000),
        b1 + (b2 << U32(8)) + U32(0x2000000),
        b1 + (b2 << U32(8)) + (b3 << U32(16)) + U32(0x4000000),
        so_far + place,
    ]
    value = text[symbols]
    count = (code.first[1:] - code.first[:-1])[value]
    own = np.repeat(np.arange(len(symbols)), count)  # the symbol of each bit
    event = (code.first[value] - (np.cumsum(count) - count)).take(own)
    event += np.arange(len(event))
    node = code.node.take(event)
    mixed = node * U32(0xC2B2AE35)
    slots = []
    for i, (c, b) in enumerate(zip(contexts, BITS, strict=True)):
        c = c * U32(0x9E3779B1)
        c ^= c >> U32(16)
        c *= U32(0x7FEB352D)
        x = c.take(own)
        x += mixed
        x ^= x >> U32(15)
        x *= U32(0x846CA68B)
        x >>= U32(32 - b)
        at = x.astype(np.int64)
        at += _OFFSET[i]
        slots.append(at)
    return Bits(slots, node, code.bit.take(event), place.take(own), owner[symbols].take(own))


@dataclass
class Mixer:
    """Odds by slot, with how well the longest context is known (0 to 3), the weights by gate, and the refinement."""

    code: Code
    odds: np.ndarray
    known: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.full((len(BITS), GATES), 0.3, dtype=np.float32))
    refined: np.ndarray = field(default_factory=lambda: np.tile(1 / (1 + np.exp(-(np.arange(KNOTS) - 16) / 2.0)), (256, 1)).astype(np.float32))

    def gates(self, b: Bits) -> np.ndarray:
        return b.place.astype(np.int64) * 4 + self.known.take(b.slots[-1] - _OFFSET[-2])

    def mixed(self, b: Bits, gate: np.ndarray) -> np.ndarray:
        x = np.zeros(len(gate), dtype=np.float32)
        for w, s in zip(self.weights, b.slots, strict=True):
            x += w.take(gate) * self.odds.take(s)
        return x

    def final(self, node: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Probability of a 1: the mean of the mixed one and the refinement's, interpolated."""
        place, low = _knots(x)
        cell = node.astype(np.int64) * KNOTS + low
        flat = self.refined.ravel()
        part = place - low
        p = flat.take(cell) * (1 - part) + flat.take(cell + 1) * part
        return np.clip((p + 1 / (1 + np.exp(-x))) / 2, 1e-6, 1 - 1e-6)

    def log10(self, t: Tokens, rows: np.ndarray, tail: bool) -> np.ndarray:
        """log10 of the probability of the head, or of the tail, of each token at ``rows``."""
        out = np.zeros(len(rows))
        for i in range(0, len(rows), SLICE):
            b = bits_of(t, rows[i : i + SLICE], self.code, tail)
            p = self.final(b.node, self.mixed(b, self.gates(b)))
            lost = np.log10(np.where(b.bit == 1, p, 1 - p))
            out[i : i + SLICE] = np.bincount(b.token, weights=lost, minlength=len(rows[i : i + SLICE]))
        return out


def _knots(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.clip(x, -7.999, 7.999) * np.float32(2) + np.float32(16)
    return place, place.astype(np.int64)


def _odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.3) / (n0 + 0.3)).astype(np.float32)


def _known(n: np.ndarray) -> np.ndarray:
    return (n > 0).astype(np.uint8) + (n > 3) + (n > 30)


@dataclass
class LeftOut:
    """What the counts say of a bit without the bit itself: odds by slot and bit, and how well the longest context is known."""

    odds: np.ndarray
    known: np.ndarray

    @staticmethod
    def of(n0: np.ndarray, n1: np.ndarray) -> LeftOut:
        odds = np.stack((_odds(np.maximum(n0 - 1, 0), n1), _odds(n0, np.maximum(n1 - 1, 0))), axis=1)
        return LeftOut(odds.ravel(), _known(np.maximum((n0 + n1)[_OFFSET[-2] :] - 1, 0)))

    def look(self, b: Bits) -> tuple[list[np.ndarray], np.ndarray]:
        """(odds of each predictor, gate)."""
        return [self.odds.take(s * 2 + b.bit) for s in b.slots], b.place.astype(np.int64) * 4 + self.known.take(b.slots[-1] - _OFFSET[-2])


def fit(code: Code, counts: np.ndarray, sample: list[bytes] | None = None) -> Mixer:
    """Odds from the counts, (slots, 2), of all training texts; weights and refinement before the first pass. Nothing is learned from ``sample``."""
    n0, n1 = counts[:, 0].astype(np.float32), counts[:, 1].astype(np.float32)
    return Mixer(code, _odds(n0, n1), _known((n0 + n1)[_OFFSET[-2] :]))


def round_sums(t: Tokens, times: np.ndarray, tail: bool, code: Code, counts: LeftOut, weights: np.ndarray, last: bool) -> np.ndarray:
    """Of these heads' or tails' bits, ``times`` each: gates' errors and curvatures by predictor, or in the last round bits and ones by node and knot."""
    k = len(BITS)
    out = [np.zeros(n) for n in _SIZES]
    slope, curve = out[0].reshape(GATES, k), out[1].reshape(GATES, k, k)
    for i in range(0, len(times), SLICE):
        b = bits_of(t, np.arange(i, min(i + SLICE, len(times))), code, tail)
        weight, y = times[i : i + SLICE].astype(np.float32).take(b.token), b.bit.astype(np.float32)
        odds, gate = counts.look(b)
        x = sum(w.take(gate) * o for w, o in zip(weights, odds, strict=True))
        if last:
            cell = b.node.astype(np.int64) * KNOTS + np.rint(_knots(x)[0]).astype(np.int64)
            out[2] += np.bincount(cell, weights=weight, minlength=_SIZES[2])
            out[3] += np.bincount(cell, weights=weight * y, minlength=_SIZES[3])
            continue
        p = 1 / (1 + np.exp(-x))
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        sorted_odds = np.stack([o.take(order) for o in odds])
        error, bend = ((y - p) * weight).take(order), (p * (1 - p) * weight).take(order)
        edge = np.concatenate(([0], np.cumsum(np.bincount(gate, minlength=GATES))))
        for g in np.flatnonzero(np.diff(edge)):
            part = sorted_odds[:, edge[g] : edge[g + 1]]
            slope[g] += part @ error[edge[g] : edge[g + 1]]
            curve[g] += (part * bend[edge[g] : edge[g + 1]]) @ part.T
    return np.concatenate(out)


def stepped(mixer: Mixer, sums: np.ndarray) -> None:
    """A Newton step of each gate's weights."""
    k = len(BITS)
    slope, curve = (x.reshape(GATES, *[k] * d) for d, x in enumerate(np.split(sums, np.cumsum(_SIZES)[:-1])[:2], 1))
    ridge = 10 + 1e-3 * np.trace(curve, axis1=1, axis2=2)
    step = np.linalg.solve(curve + ridge[:, None, None] * np.eye(k), slope[:, :, None])[:, :, 0]
    mixer.weights += np.clip(step.T, -0.5, 0.5).astype(np.float32)


def refine(mixer: Mixer, sums: np.ndarray) -> None:
    size, ones = np.split(sums, np.cumsum(_SIZES)[:-1])[2:]
    mixer.refined[:] = ((ones + START * mixer.refined.ravel()) / (size + START)).reshape(mixer.refined.shape)


def _flat(sums: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(sums)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at].astype(np.float64))], names=["i", "v"])


def _total(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' tables (i, v)."""
    got = parts.groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # size rows at most
    out = np.zeros(size)
    out[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return out


def _round(shared, weights: np.ndarray, tail: bool, last: bool):
    """(n, head or token) -> the sums of a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(sum(_SIZES))
        for batch in batches:
            sums += round_sums(_units(batch.column(1)), batch.column(0).to_numpy(), tail, *shared.value, weights, last)
        yield _flat(sums)

    return run


def _units(x: pa.Array) -> Tokens:
    return listed(x) if pa.types.is_binary(x.type) else head_tokens(x.to_numpy())


def histogram(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(the values of n, how many rows have each): of N copies in all, the root of 2 N values at most."""
    got = counts.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).toArrow()
    return got.column("n").to_numpy(), got.column("rows").to_numpy()


def least_count(n: np.ndarray, rows: np.ndarray, most: int) -> int:
    """The smallest count that ``most`` rows at most reach."""
    order = np.argsort(-n)
    fits = np.count_nonzero(np.cumsum(rows[order]) <= most)
    return int(n[order[fits]]) + 1 if fits < len(n) else 1


#: Kinds of gathered rows: a right or wrong guess's cell, a byte, a head, a token.
HIT, BYTE, HEADS, TOKEN = range(4)
GATHERED = "kind int, key long, n long, token binary"


def _gather(shared):
    """Texts -> (kind, key, n, token): a task's counts of guesses by cell, bytes, heads, and tokens by hash with their bytes."""

    def rows_of(kind: int, key: np.ndarray, n: np.ndarray, token: pa.Array | None = None) -> pa.RecordBatch:
        token = pa.nulls(len(key), pa.binary()) if token is None else token
        columns = [pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64)), token]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "key", "n", "token"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesses = shared.value
        hits, octets = np.zeros(HITS, dtype=np.int64), np.zeros(256, dtype=np.int64)
        tokens: list[tuple] = []
        heads: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def summed() -> int:
            """Makes one list of tokens and one of heads; how many there are."""
            codes, n = (np.concatenate(x) for x in list(zip(*tokens, strict=True))[:2])
            _, first, at = np.unique(codes, return_index=True, return_inverse=True)
            text = pa.concat_arrays([x[2] for x in tokens]).take(pa.array(first))
            tokens[:] = [(codes[first], np.bincount(at, weights=n).astype(np.int64), text)]
            heads[:] = [counted(*(np.concatenate(x) for x in zip(*heads, strict=True)))]
            return len(first) + len(heads[0][0])

        def flush() -> Iterator[pa.RecordBatch]:
            summed()
            yield rows_of(TOKEN, signed(tokens[0][0]), *tokens[0][1:])
            yield rows_of(HEADS, *heads[0])
            tokens.clear()
            heads.clear()

        for batch in batches:
            for _, _, texts in pieces_of(batch):
                t = tokens_of(texts)
                hits += guesses.hits(t)
                octets += np.bincount(t.buf, minlength=256)
                rows, back = distinct(t)
                head, which = heads_of(t, rows, back)
                tokens.append((t.codes[rows], np.bincount(back, minlength=len(rows)), bytes_of(t, rows)))
                heads.append((head, np.bincount(which, minlength=len(head))))
                held += len(rows) + len(head)
                if held > GATHER_HELD:
                    held = summed()
                    if held > GATHER_HELD // 2:
                        yield from flush()
                        held = 0
        if tokens:
            yield from flush()
        for kind, table in ((HIT, hits), (BYTE, octets)):
            yield rows_of(kind, np.flatnonzero(table), table[table > 0])

    return run


def _followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (block, data): every token that follows in each slot, with its count; rows of a block in bounded pieces."""
    codec = pa.Codec("zstd", compression_level=1)
    held: list[np.ndarray] = []
    size = 0

    def blocks() -> Iterator[pa.RecordBatch]:
        key = np.concatenate(held)
        held.clear()
        key, n = counted(key)
        block = (key >> U64(32)).astype(np.int64) // GUESS_BLOCK
        some, first = np.unique(block, return_index=True)
        edge = np.append(first, len(key))
        for i in range(0, len(some), 512):
            data = packed(key, n, edge[i : i + 513], codec)
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 512].astype(np.int32)), pa.array(data, pa.binary())], names=["block", "data"])

    for batch in batches:
        for _, _, texts in pieces_of(batch):
            slot, name = guess_keys(tokens_of(texts))
            held.append((slot.astype(U64) << U64(32)) | name)
            size += len(slot)
            if size > GUESS_HELD:
                yield from blocks()
                size = 0
    if size:
        yield from blocks()


def _best_guesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, data) in order of blocks -> (slot, h, n): of each slot's summed counts the largest, the smaller name at a tie."""
    codec = pa.Codec("zstd")
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now, size = -1, 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        return counted(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def best() -> pa.RecordBatch:
        key, n = summed()
        slot = (key >> U64(32)).astype(np.int32)
        edge = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        most = np.repeat(np.maximum.reduceat(n, edge), np.diff(np.append(edge, len(n))))
        first = np.flatnonzero((n == most) & (n >= GUESS_COPIES))  # names are in order
        first = first[np.concatenate((np.ones(min(len(first), 1), dtype=bool), slot[first][1:] != slot[first][:-1]))]
        name = (key[first] & U64(0xFFFFFFFF)).astype(U32).view(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(slot[first]), pa.array(name), pa.array(np.minimum(n[first], 1 << 30).astype(np.int32))], names=["slot", "h", "n"])

    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if block != now and held:
                yield best()
                held, size = [], 0
            now = block
            held.append(unpacked(block, data, codec))
            size += len(held[-1][0])
            if size > 2 * GUESS_HELD and len(held) > 1:
                held = [summed()]
                size = len(held[0][0]) // 2  # so that sums stay in proportion to what they hold
    if held:
        yield best()


def _bit_counts(code: Code, tail: bool):
    """(n, head or token) -> (block, data): counts of bits by block of slots, of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS * 2, dtype=np.int64)
        for batch in batches:
            t, times = _units(batch.column(1)), batch.column(0).to_numpy()
            for i in range(0, len(times), SLICE):
                b = bits_of(t, np.arange(i, min(i + SLICE, len(times))), code, tail)
                weight = times[i : i + SLICE][b.token]
                for s in b.slots:
                    np.add.at(counts, s * 2 + b.bit, weight)
        codec = pa.Codec("zstd", compression_level=1)
        table = counts.reshape(-1, 2 * BLOCK)
        some = np.flatnonzero(table.any(axis=1))
        for i in range(0, len(some), 64):
            part = some[i : i + 64]
            data = [codec.compress(table[j].tobytes(), asbytes=True) for j in part]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(data, pa.binary())], names=["block", "data"])

    return run


def _written(mixer: Mixer, tail: bool):
    """(key, head or token, n) -> (key, log, n): how the model writes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            log = mixer.log10(_units(batch.column(1)), np.arange(batch.num_rows), tail)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(log), batch.column(2)], names=["key", "log", "n"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each block's counts; a task keeps one array a block, whatever the rows."""
    codec = pa.Codec("zstd")
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[block] = sums.get(block, 0) + np.frombuffer(codec.decompress(data, decompressed_size=BLOCK * 16, asbytes=True), dtype=np.int64)
    for block, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([codec.compress(x.tobytes(), asbytes=True)], pa.binary())], names=["block", "data"])


@dataclass
class Known:
    """Values, or rows of values, by sorted key."""

    key: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(key: np.ndarray, value: np.ndarray) -> Known:
        order = np.argsort(key)
        return Known(key[order], value[order])

    def look(self, wanted: np.ndarray, out: np.ndarray) -> None:
        """Puts what is known of the wanted keys into ``out``."""
        if len(self.key):
            place = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            hit = self.key[place] == wanted
            out[hit] = self.value[place[hit]]

    def add(self, key: np.ndarray, value: np.ndarray, most: int) -> None:
        """Keeps more, in order; what is kept goes if it becomes too much."""
        if len(self.key) + len(key) > most:
            self.key, self.value = self.key[:0], self.value[:0]
        if len(key) <= most:
            place = np.searchsorted(self.key, key)
            self.key, self.value = np.insert(self.key, place, key), np.insert(self.value, place, value)


SCORED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_frequent long, frequent double, score double, "
    "rare array<long>, rest array<float>, share array<float>"
)


def _score(shared, frequent, total: int, base: float, new: float):
    """new: the share of spelling in a token's probability; of the others, the count's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (mixer, guesses), (words, heads) = shared.value, frequent.value
        own_tails, own_heads = Known(np.zeros(0, U64), np.zeros(0)), Known(np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            for lo, hi, texts in pieces_of(batch):
                t = tokens_of(texts)
                rows, back = distinct(t)
                head, which = heads_of(t, rows, back)
                codes = t.codes[rows]
                found, front = np.tile([np.nan, 0.0], (len(rows), 1)), np.full(len(head), np.nan)
                words.look(codes, found)
                tail, n = found[:, 0].copy(), found[:, 1].astype(np.int64)
                for known, wanted, out in ((own_tails, codes, tail), (heads, head, front), (own_heads, head, front)):
                    known.look(wanted, out)
                other = np.flatnonzero(np.isnan(tail))
                tail[other] = mixer.log10(t, rows[other], True)
                own_tails.add(codes[other], tail[other], KEPT)
                other = np.flatnonzero(np.isnan(front))
                front[other] = mixer.log10(head_tokens(head[other]), np.arange(len(other)), False)
                own_heads.add(head[other], front[other], KEPT)
                spelt = tail[back] + front[which]
                log = np.log10((n + 0.1) / base)[back]
                n = n[back]
                there, hit, cell, guess = guesses.look(t)
                p = guesses.online(t, there, hit, cell, guess)
                # of a token: log10(10**rest + share * n), rest being a right guess or what it leaves to spelling
                rest = np.where(hit, np.log10(np.where(hit, p, 1.0)), np.log10((1 - p) * new) + spelt)
                share = np.where(hit, 0.0, (1 - p) * (1 - new) / max(total, 1))
                found = np.where(n > 0, np.logaddexp(rest * _LN10, np.log(np.maximum(share * n, 1e-300))) / _LN10, rest)
                doc = np.repeat(np.arange(hi - lo), np.diff(t.first))
                rare = n == 0
                edge = np.concatenate(([0], np.cumsum(np.bincount(doc[rare], minlength=hi - lo)))).astype(np.int32)
                sums = lambda w: np.bincount(doc, weights=w, minlength=hi - lo)  # noqa: B023, E731
                lists = lambda x: pa.ListArray.from_arrays(pa.array(edge), pa.array(x))  # noqa: B023, E731
                size = np.array([len(x or b"") for x in texts], dtype=np.int64)
                columns = [pa.array(np.diff(t.first)), pa.array(size), pa.array(sums(~rare).astype(np.int64)), pa.array(sums(np.where(rare, 0.0, log))), pa.array(sums(found))]
                tail = [lists(signed(t.codes[rare])), lists(rest[rare].astype(np.float32)), lists(share[rare].astype(np.float32))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(3)), *columns, *tail], names=[x.split()[0] for x in SCORED.split(", ")])

    return run


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Until its end, rows reach Python in batches of some BATCH bytes: else 10,000 texts are one, in the executor and in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def score_texts(docs: DataFrame, held_out: str = "pmod(crc32(cast(doc_id as string)), 10) = 0") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Tokens are lower-cased (A-Z) runs of other than ASCII white space, and an
    end. base_score sums log10((c + 0.1) / (N + 0.1 (V + 1))) over them, with
    counts of all texts that aren't held out; score is the mixing model's log10
    probability of the same tokens, and bits_per_byte its length in bits over
    the text's bytes (and one for the end).

    A null or empty text has its end alone. A text with a null
    doc_id is trained on, and not held out. Repeated rows are scored each, and counted each. Without training texts
    every slot is unknown, N and V are 0. Other columns are ignored. An empty
    table gives none.
    """
    with small_batches(docs.sparkSession):  # all steps in Python run in here, and their results are saved
        return _score_texts(docs, held_out)


def _score_texts(docs: DataFrame, held_out: str) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-scoring")
    held = F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    train = rows.where(~held)
    followers = train.select("text").mapInArrow(_followers, "block int, data binary").repartition("block").sortWithinPartitions("block")
    chosen = followers.mapInArrow(_best_guesses, "slot int, h int, n int").toArrow()
    guesses = Guesses(np.zeros(1 << GUESS_BITS, dtype=U32), np.zeros(1 << GUESS_BITS, dtype=np.uint8))  # so many rows at most
    place = chosen.column("slot").to_numpy()
    guesses.name[place], guesses.count[place] = chosen.column("h").to_numpy().view(U32), np.minimum(chosen.column("n").to_numpy(), MOST_COPIES)
    sent = spark.sparkContext.broadcast(guesses)
    del followers, chosen
    scratch.free()
    got = scratch.save(train.select("text").mapInArrow(_gather(sent), GATHERED), "gathered")
    sent.destroy()
    guesses.fit(_total(got.where(F.col("kind") == HIT).select(F.col("key").alias("i"), F.col("n").alias("v")), HITS))
    of = lambda kind: got.where(F.col("kind") == kind)
    words = scratch.save(of(TOKEN).groupBy(F.col("key").alias("h"), "token").agg(F.sum("n").alias("n")), "words")
    heads = scratch.save(of(HEADS).groupBy(F.col("key").alias("head")).agg(F.sum("n").alias("n")), "heads")
    counts = words.select("h", "n")
    copies, kinds = histogram(counts)
    total, size, once = int((copies * kinds).sum()), int(kinds.sum()), int(kinds[copies == 1].sum())
    octets = _total(of(BYTE).select(F.col("key").alias("i"), F.col("n").alias("v")), 256)
    octets[SEPARATORS] = 0
    octets[BLANK] = total
    code = huffman(octets)
    scratch.drop(got)
    few = max(4, spark.sparkContext.defaultParallelism)  # tasks of a pass over words: each gives whole tables
    parts = [(heads.select("n", "head").coalesce(few), False), (words.select("n", "token").coalesce(few), True)]
    both = lambda f, schema: parts[0][0].mapInArrow(f(False), schema).union(parts[1][0].mapInArrow(f(True), schema))
    written = both(lambda tail: _bit_counts(code, tail), "block int, data binary")
    bits = np.zeros((SLOTS // BLOCK, 2 * BLOCK), dtype=np.int64)
    for r in written.repartition("block").mapInArrow(_summed, "block int, data binary").collect():  # SLOTS of 16 bytes at most
        bits[r["block"]] = np.frombuffer(pa.Codec("zstd").decompress(bytes(r["data"]), decompressed_size=BLOCK * 16, asbytes=True), dtype=np.int64)
    mixer = fit(code, bits.reshape(-1, 2))
    if total:
        n0, n1 = (np.ascontiguousarray(bits.reshape(-1, 2)[:, i], dtype=np.float32) for i in (0, 1))
        sent = spark.sparkContext.broadcast((code, LeftOut.of(n0, n1)))
        del n0, n1
        for turn in range(STEPS + 1):
            sums = _total(both(lambda tail: _round(sent, mixer.weights.copy(), tail, turn == STEPS), "i int, v double"), sum(_SIZES))
            if turn < STEPS:
                stepped(mixer, sums)
        refine(mixer, sums)
        sent.destroy()
    del bits

    base = total + 0.1 * (size + 1)
    least, least_head = least_count(copies, kinds, FREQUENT), least_count(*histogram(heads), FREQUENT)
    new = min(0.5, max(1e-4, once / total)) if total else 1.0
    table = lambda df, tail: df.mapInArrow(_written(mixer, tail), "key long, log double, n long").toArrow()
    often = table(words.where(F.col("n") >= least).select("h", "token", "n"), True)
    fronts = table(heads.where(F.col("n") >= least_head).select("head", F.col("head").alias("same"), "n"), False)
    column = lambda x, name: x.column(name).to_numpy()
    shared = spark.sparkContext.broadcast((mixer, guesses))
    frequent = spark.sparkContext.broadcast((
        Known.of(column(often, "key").view(U64), np.stack((column(often, "log"), column(often, "n")), axis=1)), Known.of(column(fronts, "key"), column(fronts, "log")),
    ))
    scratch.drop(heads)
    unseen = float(np.log10(0.1 / base))

    keyed = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", held, "text")
    scored = scratch.save(keyed.mapInArrow(_score(shared, frequent, total, base, new), SCORED), "scored")
    shared.destroy()
    frequent.destroy()
    tail = scored.select("row", F.explode(F.arrays_zip("rare", "rest", "share")).alias("e")).select("row", F.col("e.rare").alias("h"), "e.rest", "e.share")
    tail = tail.join(counts.where(F.col("n") < least), "h")
    more = F.col("share").cast("double") * F.col("n")
    # log10(10**rest + more) - rest, for a rest of any size
    gain = F.when(more <= 0, 0.0).when(F.col("rest") < -250, F.log10(more) - F.col("rest")).otherwise(F.log10(1 + more * F.pow(F.lit(10.0), -F.col("rest").cast("double"))))
    rare = tail.groupBy("row").agg(F.count(F.lit(1)).alias("m"), F.sum(F.log10((F.col("n") + 0.1) / base)).alias("s"), F.sum(gain).alias("g"))
    known = F.coalesce("m", F.lit(0))
    score = F.col("score") + F.coalesce("g", F.lit(0.0))
    lost = (F.size("rare") - known) * unseen
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_frequent") + known).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("frequent") + F.coalesce("s", F.lit(0.0)) + lost).alias("base_score"),
        score.alias("score"),
        (-score / np.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))

