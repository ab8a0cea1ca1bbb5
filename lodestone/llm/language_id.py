"""Language of whole texts by a bidirectional gated recurrent network over bytes.

1. A bounded sample of labelled documents is drawn by hash, spread over the
   languages, and an excerpt of each goes to the driver.
2. The driver trains the network in numpy by backpropagation through time.
3. A scan cuts every text into windows, labels each of their bytes with both
   directions' states, and pools the bytes' probabilities over the document.

The cell has one gate: z = sigmoid(A x + U h), c = tanh(B x + V h),
h' = h + z (c - h). Arrays are feature-major, so all numpy loops are long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import CHUNK_BYTES, carried, chunk_ranges, texts_of

UNKNOWN = "und"
#: Bytes in a window; states start anew at its ends.
WINDOW = 64
#: States in each direction.
HIDDEN = 8
#: Training sample: documents a language, and of all, and characters of each, at most. Every language has one at least.
SAMPLE_DOCS, SAMPLE_ALL, SAMPLE_CHARS = 512, 65_536, 640
EPOCHS, STEPS, BATCH, RATE, SEED = 10, 400, 256, 0.02, 11
#: Windows handled together when scoring: arrays stay in a core's cache.
TOGETHER = 2048

F32 = np.float32


@dataclass
class Network:
    """x: (2, 2H, 256) input tables, u: (2, 2H, H), o: (L, 2H), b: (L). Gate rows come first.

    Gate rows hold half the pre-activation, as sigmoid(a) = (1 + tanh(a / 2)) / 2.
    """

    labels: list[str]
    x: np.ndarray
    u: np.ndarray
    o: np.ndarray
    b: np.ndarray

    def states(self, way: int, codes: np.ndarray) -> np.ndarray:
        """codes (T, W) -> states (T, H, W) of one direction; way 1 reads from the end."""
        steps, width = codes.shape
        h = self.u.shape[2]
        out = np.zeros((steps, h, width), dtype=F32)
        before = np.zeros((h, width), dtype=F32)
        a = np.empty((2 * h, width), dtype=F32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            np.matmul(self.u[way], before, out=a)
            a += np.take(self.x[way], codes[t], axis=1)
            np.tanh(a, out=a)
            z, c = a[:h], a[h:]
            z += F32(1)
            z *= F32(0.5)
            c -= before
            c *= z
            np.add(before, c, out=out[t])
            before = out[t]
        return out

    def probabilities(self, codes: np.ndarray, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """(T, L, W): each byte's distribution over the labels."""
        h = self.u.shape[2]
        p = np.matmul(self.o[:, :h], forward) + np.matmul(self.o[:, h:], backward) + self.b[:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def pooled(self, codes: np.ndarray, real: np.ndarray) -> np.ndarray:
        """(W, L): sums of the distributions of each window's real bytes."""
        sums = np.empty((codes.shape[1], len(self.labels)), dtype=F32)
        together = max(16, TOGETHER * 8 // max(8, len(self.labels)))  # probabilities take a number a label and byte
        for i in range(0, codes.shape[1], together):
            part = np.ascontiguousarray(codes[:, i : i + together])
            p = self.probabilities(part, self.states(0, part), self.states(1, part))
            p *= real[:, None, i : i + together]
            sums[i : i + together] = p.sum(axis=0).T
        return sums


def windows(texts: list[bytes], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes (T, W), real (T, W), text of each window); an empty text has none."""
    n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    buf = np.frombuffer(b"".join(texts) + b"\0" * width, dtype=np.uint8)
    count = -(-n // width)
    doc = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(np.cumsum(n) - n, count) + nth * width
    size = np.minimum(n[doc] - nth * width, width)
    step = np.arange(width)[:, None]
    real = step < size
    codes = np.where(real, buf[begin + step], 0).astype(np.intp)
    return codes, real, doc


def train(texts: list[bytes], target: np.ndarray, labels: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fits the network by Adam on the windows' bytes, each carrying its document's label.

    Labels weigh alike, however many bytes each has.
    """
    rng = np.random.default_rng(seed)
    k = len(labels)
    net = Network(
        labels,
        (rng.standard_normal((2, 2 * hidden, 256)) * 0.3).astype(F32),
        (rng.standard_normal((2, 2 * hidden, hidden)) * 0.3).astype(F32),
        (rng.standard_normal((k, 2 * hidden)) * 0.3).astype(F32),
        np.zeros(k, dtype=F32),
    )
    if k < 2:
        return net
    codes, real, doc = windows(texts)
    y = target[doc]
    share = np.bincount(y, weights=real.sum(axis=0), minlength=k)
    weight = (share.sum() / np.maximum(share, 1) / k).astype(F32)
    params = [net.x, net.u, net.o, net.b]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    batch = int(np.clip(len(y) // 40, 16, BATCH))  # small samples need steps more than large batches
    each = max(1, -(-len(y) // batch))
    epochs = epochs and max(epochs, -(-STEPS // each))
    turn, total = 0, epochs * each
    for _ in range(epochs if len(y) else 0):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            grads = _gradients(net, np.ascontiguousarray(codes[:, rows]), real[:, rows], y[rows], weight[y[rows]])
            turn += 1
            rate = RATE * (1 - (turn - 1) / total)
            for p, g, m_, v_ in zip(params, grads, m, v, strict=True):
                m_ += 0.1 * (g - m_)
                v_ += 0.001 * (g * g - v_)
                p -= (rate / (1 - 0.9**turn) * m_ / (np.sqrt(v_ / (1 - 0.999**turn)) + 1e-8)).astype(F32)
    return net


def _gradients(net: Network, codes: np.ndarray, real: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean weighted cross-entropy of the real bytes, through time in both directions."""
    h = net.u.shape[2]
    states = [net.states(way, codes) for way in (0, 1)]
    d = net.probabilities(codes, *states)
    d[:, y, np.arange(len(y))] -= 1
    d *= (real * weight / max(1, real.sum()))[:, None, :]
    gx, gu, go = np.zeros_like(net.x), np.zeros_like(net.u), np.zeros_like(net.o)
    for way in (0, 1):
        s, cols = states[way], slice(way * h, (way + 1) * h)
        go[:, cols] = np.tensordot(d, s, axes=((0, 2), (0, 2)))
        above = np.matmul(net.o[:, cols].T, d)  # (T, H, W)
        carry = np.zeros(s.shape[1:], dtype=F32)
        steps = range(len(codes) - 1, -1, -1) if way == 0 else range(len(codes))
        back = -1 if way == 0 else 1
        for t in steps:
            before = s[t + back] if 0 <= t + back < len(codes) else np.zeros_like(carry)
            a = np.tanh(net.u[way] @ before + net.x[way][:, codes[t]])
            z, c = (a[:h] + 1) / 2, a[h:]
            carry += above[t]
            da = np.empty_like(a)
            da[:h] = carry * (c - before) * z * (1 - z) * 2  # the row holds half the pre-activation
            da[h:] = carry * z * (1 - c * c)
            gu[way] += da @ before.T
            flat = np.add.reduceat(da[:, (o := np.argsort(codes[t], kind="stable"))], (first := np.flatnonzero(np.diff(codes[t][o], prepend=-1))), axis=1)
            gx[way][:, codes[t][o][first]] += flat
            carry = carry * (1 - z) + net.u[way].T @ da
    return [gx, gu, go, d.sum(axis=(0, 2))]


def _add(net: Network, part: list[tuple[int, bytes]], sums: np.ndarray) -> None:
    codes, real, doc = windows([t for _, t in part])
    np.add.at(sums, np.array([n for n, _ in part], dtype=np.int64)[doc], net.pooled(codes, real))


def _predict(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letter, texts = batch.column(2).to_pylist(), texts_of(batch)
            for lo, hi in chunk_ranges(texts):
                known = [i for i in range(lo, hi) if letter[i]] if net.labels else []
                names, score = [UNKNOWN] * (hi - lo), np.zeros(hi - lo)
                if known:
                    sums = np.zeros((len(known), len(net.labels)))
                    part, size = [], 0  # a very long text comes in parts of whole windows
                    for n, i in enumerate(known):
                        for at in range(0, len(texts[i]), CHUNK_BYTES):
                            if size > CHUNK_BYTES:
                                _add(net, part, sums)
                                part, size = [], 0
                            part.append((n, texts[i][at : at + CHUNK_BYTES]))
                            size += len(part[-1][1])
                    _add(net, part, sums)
                    p = sums / sums.sum(axis=1, keepdims=True)
                    for i, best in zip(known, p.argmax(axis=1).tolist(), strict=True):
                        names[i - lo] = net.labels[best]
                    score[np.array(known) - lo] = np.clip(p.max(axis=1), 0, 1)
                same = [batch.column(i).slice(lo, hi - lo) for i in (0, 1, *range(4, batch.num_columns))]
                yield pa.RecordBatch.from_arrays(
                    [*same[:2], pa.array(names, pa.string()), pa.array(score), *same[2:]],
                    names=["doc_id", "held_out", "lang_pred", "score", *batch.schema.names[4:]],
                )

    return run


def fitted(labelled: DataFrame, per_language: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Network:
    """The network, trained on at most ``per_language`` documents of each of the languages, fewer if these are very many.

    labelled: doc_id, text, lang. The documents are those of the least hash in
    each of ``per_language`` hash classes of a language, so that counting them
    needs no text; an excerpt starts at a hashed place.
    """
    h = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    rows = labelled.where("lang is not null and text is not null").withColumn("h", h)
    labels = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # the model holds a row for each
    number = {x: i for i, x in enumerate(labels)}
    each = max(1, min(per_language, SAMPLE_ALL // max(1, len(labels))))
    least = rows.groupBy("lang", F.pmod("h", F.lit(each)).alias("c")).agg(F.min("h").alias("h"))
    span = F.greatest(F.char_length("text") - chars, F.lit(0)) + 1
    excerpt = F.substring(F.col("text"), (F.pmod(F.xxhash64("h"), span) + 1).cast("int"), F.lit(chars))
    got = rows.join(F.broadcast(least.select("lang", "h")), ["lang", "h"]).select("lang", "h", excerpt.alias("text")).dropDuplicates(["lang", "h"]).orderBy("lang", "h").collect()
    texts = [r["text"].encode() for r in got]
    return train(texts, np.array([number[r["lang"]] for r in got], dtype=np.int64), labels)


def identify_languages(
    docs: DataFrame, labelled: DataFrame | None = None, held_out: str = "pmod(crc32(cast(doc_id as string)), 3) = 1", carry: list[str] | None = None
) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, and the columns named in ``carry``.

    The network learns from the rows of ``labelled`` (by default: of docs that
    aren't held out) with a non-null lang, and reads nothing but texts when it
    predicts. score is the mean over the text's bytes of the predicted
    language's probability.

    A null text, and one without a letter, is ``und`` with score 0; so is every
    text if nothing is labelled. Repeated rows get the same answer each. A null
    doc_id counts as an empty one. Other columns are ignored. An empty table
    gives none.
    """
    held = F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out")
    learn = docs.where(~held) if labelled is None else labelled
    net = fitted(learn.select("doc_id", "text", "lang"))
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    inside, schema, back = carried(docs, carry or [])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, letter.alias("letter"), F.col("text").alias("text"), *inside)
    out = rows.mapInArrow(_predict(net), "doc_id long, held_out boolean, lang_pred string, score double" + schema)
    return out.select("doc_id", "held_out", "lang_pred", "score", *back)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
