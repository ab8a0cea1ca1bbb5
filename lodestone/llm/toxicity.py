"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)) over the
distinct terms of a text: beside each term's own weight, each pair of terms has
the product of their factors, so a pair can weigh what neither does alone.

1. A bounded sample of labelled documents, drawn by hash, is turned into term
   sets on the executors and goes to the driver.
2. The driver fits weights and factors in numpy: AdaGrad on the log loss, with
   shrinkage of the weights, from seeds that are fixed. A part of the sample
   decides between two priors: that terms tell by themselves (a term counts by
   its own association with the label), or that pairs may tell what no term
   does (all count alike).
3. A scan scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import BYTE_CODE, LOWER, Rolling, chunk_ranges, texts_of

#: Hash classes of terms, and factors of each.
TERMS, FACTORS = 1 << 16, 4
#: Labelled documents in the training sample at most; each goes with all its terms.
SAMPLE_DOCS = 16_384
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.4, 5
#: Shrinkage of weights and factors towards 0 at each of their steps.
SHRINK_W, SHRINK_V = 1e-3, 2e-3
THRESHOLD = 0.3
#: A toxic document counts as so many in training.
POSITIVE = 3.0
#: A term counts in full from this many standard deviations between its label rate and the common one.
Z_FULL = 8.0


@dataclass(frozen=True)
class Prior:
    """What is believed of terms before the fit: how much one counts at least, whatever it tells by itself; and how factors start and step."""

    least: float
    start: float
    step: float


#: Terms tell by themselves; or pairs of them tell what neither does (as one of two words without the other does).
PRIORS = (Prior(0.02, 0.01, 0.1), Prior(1.0, 0.05, 1.0))
#: Terms in fewer of the sample's texts take no part: they would learn texts by heart.
LEAST_TEXTS = 2

#: Bytes that stand in terms: letters, digits and what non-ASCII letters are made of.
_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def term_sets(texts: list[bytes | None], terms: int = TERMS) -> tuple[np.ndarray, np.ndarray]:
    """(text, term), sorted and distinct: the hash classes of each text's lower-cased terms."""
    parts = [t or b"" for t in texts]
    buf = LOWER[np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)]
    edge = np.diff(np.concatenate(([0], _IN_TERM[buf].astype(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    term = Rolling(BYTE_CODE[buf]).slices(start, end) % np.uint64(terms)
    last = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    key = np.searchsorted(last, start, side="right").astype(np.int64) * terms + term.astype(np.int64)
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return key // terms, key % terms


def _sums(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of x[edge[i] : edge[i + 1]]."""
    total = np.zeros((len(x) + 1, *x.shape[1:]))
    np.cumsum(x, axis=0, out=total[1:])
    return total[edge[1:]] - total[edge[:-1]]


def _scale(doc: np.ndarray, term: np.ndarray, y: np.ndarray, terms: int) -> np.ndarray:
    """How much a term counts: its association with the label, as the signed root of chi square over what chance gives."""
    n, pos = len(y), y.sum()
    df, hit = np.bincount(term, minlength=terms), np.bincount(term, weights=y[doc], minlength=terms)
    expected = df * (pos / max(n, 1))
    z = np.abs(hit - expected) / np.sqrt(np.maximum(expected * (1 - pos / max(n, 1)) * (1 - df / max(n, 1)), 1e-9))
    return np.clip(z / Z_FULL, 0, 1)


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray  # (terms, factors)

    def scores(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Log odds of n texts from their (text, term) pairs, sorted by text."""
        edge = np.searchsorted(doc, np.arange(n + 1))
        v = self.v[term]
        return self.w0 + _sums(self.w[term], edge) + 0.5 * (_sums(v, edge) ** 2 - _sums((v * v).sum(axis=1), edge)[:, None] / self.v.shape[1]).sum(axis=1)


def _gradients(fm: Machine, d: np.ndarray, t: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(of w0; the distinct terms; of their weights; of their factors): slopes of the texts' log loss, toxic ones counting ``POSITIVE`` times."""
    error = (1 / (1 + np.exp(-np.clip(fm.scores(d, t, len(y)), -30, 30))) - y) * np.where(y > 0, POSITIVE, 1.0)
    v = fm.v[t]
    total = _sums(v, np.searchsorted(d, np.arange(len(y) + 1)))
    used, back = np.unique(t, return_inverse=True)
    dw = np.bincount(back, weights=error[d], minlength=len(used))
    each = error[d][:, None] * (total[d] - v)
    return error.sum(), used, dw, np.stack([np.bincount(back, weights=each[:, f], minlength=len(used)) for f in range(v.shape[1])], axis=1)


def _fit(doc: np.ndarray, term: np.ndarray, y: np.ndarray, terms: int, factors: int, epochs: int, seed: int, prior: Prior) -> Machine:
    rng = np.random.default_rng(seed)
    rate = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    common = np.bincount(term, minlength=terms) >= LEAST_TEXTS
    doc, term = doc[common[term]], term[common[term]]
    scale = np.where(common, np.maximum(_scale(doc, term, y, terms), prior.least), 0)
    fm = Machine(float(np.log(rate / (1 - rate))), np.zeros(terms), rng.standard_normal((terms, factors)) * prior.start * common[:, None])
    gw, gv, g0 = np.full(terms, 1e-2), np.full((terms, factors), 1e-2), 1.0
    edge = np.searchsorted(doc, np.arange(len(y) + 1))
    for _ in range(epochs if len(y) and 0 < y.sum() < len(y) else 0):
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            size = edge[rows + 1] - edge[rows]
            at = np.repeat(edge[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            here = Machine(fm.w0, fm.w * scale, fm.v * scale[:, None])
            d0, used, dw, dv = _gradients(here, np.repeat(np.arange(len(rows)), size), term[at], y[rows])
            x = scale[used]
            dw = dw * x + SHRINK_W * len(rows) * fm.w[used]
            dv = dv * x[:, None] + SHRINK_V * len(rows) * fm.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            g0 += d0**2
            fm.w[used] -= RATE * dw / np.sqrt(gw[used])
            fm.v[used] -= prior.step * RATE * dv / np.sqrt(gv[used])
            fm.w0 -= RATE * d0 / np.sqrt(g0)
    return Machine(fm.w0, fm.w * scale, fm.v * scale[:, None])


def train(doc: np.ndarray, term: np.ndarray, y: np.ndarray, terms: int = TERMS, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = SEED) -> Machine:
    """Fits a machine to the (text, term) pairs, sorted by text, and the texts' labels (0 or 1).

    Which of ``PRIORS`` holds is tried on every fourth text, after a fit on the
    others: the one of least log loss is taken for the fit on all.
    """
    test = np.arange(len(y)) % 4 == 3
    number = np.cumsum(~test) - 1, np.cumsum(test) - 1

    def loss(prior: Prior) -> float:
        own, other = ~test[doc], test[doc]
        fm = _fit(number[0][doc[own]], term[own], y[~test], terms, factors, epochs, seed, prior)
        odds = np.clip(fm.scores(number[1][doc[other]], term[other], int(test.sum())), -30, 30)
        return float((np.logaddexp(0, odds) - y[test] * odds).mean())

    best = min(PRIORS, key=loss) if 0 < y[~test].sum() < (~test).sum() and test.any() else PRIORS[0]
    return _fit(doc, term, y, terms, factors, epochs, seed, best)


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch)
        for lo, hi in chunk_ranges(texts):
            doc, term = term_sets(texts[lo:hi])
            edge = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(edge), pa.array(term.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), found], names=["h", "y", "terms"])


def fitted(labelled: DataFrame, sample: int = SAMPLE_DOCS) -> Machine:
    """The machine, trained on the ``sample`` rows (text, y) of the least hash."""
    rows = labelled.select(F.xxhash64(F.col("doc_id"), F.lit("sample")).alias("h"), F.col("y").cast("int").alias("y"), "text")
    total = rows.count()
    if total > 2 * sample:  # a share by hash, so that few texts go on; the limit makes it exact
        low, high = -(1 << 63), (1 << 63) - 1
        rows = rows.where(F.col("h") < F.lit(min(high, low + int(2.0**64 * 1.3 * sample / total))))
    found = rows.mapInArrow(_terms_of, "h long, y int, terms array<int>").orderBy("h", "y").limit(sample).toArrow()
    sets = found.column("terms").combine_chunks()
    doc = np.repeat(np.arange(len(sets)), sets.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return train(doc, sets.flatten().to_numpy().astype(np.int64), found.column("y").to_numpy().astype(np.float64))


def _score(fm: Machine, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for lo, hi in chunk_ranges(texts):
                odds = fm.scores(*term_sets(texts[lo:hi]), hi - lo)
                p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: str = "pmod(crc32(cast(doc_id as string)), 4) = 2", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Learns from documents that aren't held out and have a non-null toxic in
    ``labels`` (doc_id, toxic); of an id's several labels the largest counts.
    Terms are maximal runs of letters, digits and non-ASCII bytes, A-Z
    lower-cased; a text's distinct terms count once each.

    A null or empty text scores as no terms do. Repeated rows get the same
    score each. A null doc_id has no label and counts as an empty id. Without
    labels of both kinds every score is the prior. Other columns are ignored.
    An empty table gives none.
    """
    held = F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = labels.where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    learn = _labelled(rows.where(~held), marks)
    return rows.select("doc_id", held, "text").mapInArrow(_score(fitted(learn), threshold), "doc_id long, held_out boolean, score double, predicted int")


def _labelled(rows: DataFrame, marks: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled rows; of many labels only a share by hash, some times the sample, is joined (and so broadcast)."""
    h = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    total = marks.count()
    if total > 4 * sample:
        marks = marks.where(h < F.lit(min((1 << 63) - 1, -(1 << 63) + int(2.0**64 * 4 * sample / total))))
    return rows.join(F.broadcast(marks), "doc_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
