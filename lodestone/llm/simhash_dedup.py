"""Near-duplicate documents by SimHash fingerprints, compared under the pigeonring filter.

1. A scan gives each text its fingerprint; documents of equal fingerprints form
   a class, and only classes go on: a group of copies costs one row.
2. Segments of a fingerprint stand in a ring. If two fingerprints differ in t
   bits at most, some segment begins a chain whose first l of m segments differ
   in l * t / m bits at most, for every l (the pigeonring principle; one
   segment alone, the pigeonhole, says less). The head of such a chain is the
   join key: one side as it is, the other with the few differences that the
   budgets of the head allow. A difference is undone by the side that has the
   bit set, so a pair meets once a chain.
3. Within a key all members are tested against one pivot first. Where they are
   one component then, nothing is left to do. Others are tested with each other
   but for the main component's members among themselves: in large keys block
   by block, where what comes out is a forest, not pairs, so that a dense group
   of n fingerprints gives about n rows. The budgets of longer and longer chains
   prune pairs before the full distance.
4. Components of the links are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import Scratch, U64, signed, splitmix, spread_join, texts_of
from lodestone.llm.graph_components import components

SEED = 42
#: Shingles that are hashed at once, and members of a key in a block.
SLICE, BLOCK = 1 << 16, 2048
#: Up to so many members of a key are tested each with each, as rows.
SMALL = 32
#: Segments of the head of a chain that is the key.
HEAD = 2

#: The key's low four bits say where its chain begins.
ROWS = "key long, fp long, plain boolean"
#: Of each byte value its eight bits, highest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """64 bits, each set if it is in over half the hashes of the text's shingles, repeats included; 0 without words."""
    words = (text or b"").lower().split()  # of bytes: A-Z alone, and the six blanks of ASCII
    if not words:
        return 0
    joined = b" ".join(words)
    blanks = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    start = np.concatenate(([0], blanks + 1))
    end = np.concatenate((blanks, [len(joined)]))
    n = max(1, len(start) - width + 1)
    end = end[-n:]
    votes = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, SLICE):
        ends = zip(start[lo : min(n, lo + SLICE)].tolist(), end[lo : lo + SLICE].tolist(), strict=True)
        h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in ends), dtype=">u8", count=min(SLICE, n - lo))
        each = h.view(np.uint8).reshape(-1, 8)
        for i in range(8):
            votes[8 * i : 8 * i + 8] += np.bincount(each[:, i], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, width) for t in texts_of(batch)), dtype=U64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(found)), pa.array(np.arange(batch.num_rows))], names=["doc_id", "fp", "place"])

    return run


# ---------------------------------------------------------------- the ring


class Ring:
    """A fingerprint's segments, and what chains of them may differ in."""

    def __init__(self, most: int):
        if not 0 <= most <= 15:
            raise ValueError("0 <= most <= 15")
        self.most, self.m = most, most + 1
        edges = [64 * i // self.m for i in range(self.m + 1)]
        bits = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
        #: masks[i][l]: the l + 1 segments from i on.
        self.masks = [[sum(bits[(i + j) % self.m] for j in range(length + 1)) for length in range(self.m)] for i in range(self.m)]
        self.budget = [(length + 1) * most // self.m for length in range(self.m)]
        self.head = min(HEAD, self.m)

    def errors(self, start: int) -> list[int]:
        """The differences that the head of the chain from ``start`` may have, none among them."""
        places = [b for b in range(64) if self.masks[start][self.head - 1] >> b & 1]
        found = []
        for n in range(self.budget[self.head - 1] + 1):
            for some in combinations(places, n):
                e = sum(1 << b for b in some)
                if all((e & self.masks[start][j]).bit_count() <= self.budget[j] for j in range(self.head)):
                    found.append(e)
        return found

    def linked(self, x: np.ndarray, start: int) -> np.ndarray:
        """Which differences x keep every budget of the chain from ``start``: short chains prune before the whole is counted."""
        ok = np.ones(x.shape, dtype=bool)
        for j in range(self.head - 1, self.m):
            at = np.flatnonzero(ok)
            ok.ravel()[at] = np.bitwise_count(x.ravel()[at] & U64(self.masks[start][j])) <= self.budget[j]
        return ok


def _chain_keys(most: int):
    """(fp) -> a row for each chain's head as it is (plain), and for each allowed difference from it that this side undoes."""
    ring = Ring(most)
    errors = [np.array(ring.errors(i), dtype=U64) for i in range(ring.m)]
    salt = splitmix(np.arange(1, ring.m + 1, dtype=U64))
    tops = [np.array([1 << max(e.bit_length() - 1, 0) if e else 0 for e in x.tolist()], dtype=U64) for x in errors]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(U64)
            for lo in range(0, len(fps), 4096):
                fp = fps[lo : lo + 4096]
                for i in range(ring.m):
                    e, top = errors[i], tops[i]
                    row, which = np.nonzero((fp[:, None] & top[None, :]) == top[None, :])
                    head = (fp[row] ^ e[which]) & U64(ring.masks[i][ring.head - 1])
                    key = splitmix(head + salt[i]) & ~U64(15) | U64(i)
                    plain = e[which] == 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(key)), pa.array(signed(fp[row])), pa.array(plain)],
                        names=["key", "fp", "plain"],
                    )

    return run


# ---------------------------------------------------------------- links


def fingerprint_links(classes: DataFrame, most: int, scratch: Scratch) -> DataFrame | None:
    """(node, component) of classes (fp, n; saved) that some other class is within ``most`` bits of; None if there are none."""
    rows = classes.select("fp").mapInArrow(_chain_keys(most), ROWS)
    met = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("plain").alias("plain")).where("size > 1 and plain")
    met = scratch.save(met.select("key", "size"), "met")
    here = spread_join(rows, met, ["key"], F.col("fp"), scratch).withColumn("start", F.col("key").bitwiseAND(15).cast("int"))
    here = scratch.save(here.join(classes.select("fp", "n"), "fp"), "members")
    pivots = here.groupBy("key").agg(F.max_by("fp", F.struct("n", "fp")).alias("p"), F.count(F.lit(1)).alias("size"))
    tested = spread_join(here, scratch.save(pivots, "pivots"), ["key"], F.col("fp"), scratch).where("fp <> p")
    near = tested.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("p"))) <= most).select(F.col("fp").alias("a"), F.col("p").alias("b"))
    label = _more(None, near, scratch)
    known = here.select("fp", F.col("fp").alias("comp")).distinct() if label is None else label.select(F.col("node").alias("fp"), F.col("component").alias("comp"))
    here = scratch.save(here.join(known, "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), "labelled")
    ends = [F.min("comp").alias("c0"), F.max("comp").alias("c1")]
    mixed = here.groupBy("key").agg(F.max_by("comp", F.struct("n", "fp")).alias("main"), F.count(F.lit(1)).alias("size"), *ends)
    mixed = scratch.save(mixed.where("c0 <> c1").select("key", "main", "size", F.col("size").alias("members")), "mixed")
    few = here.join(mixed.where(F.col("members") <= SMALL).select("key"), "key")
    many = spread_join(here, mixed.where(F.col("members") > SMALL), ["key"], F.col("fp"), scratch)
    return _more(label, _pair_links(few, most).union(_block_links(many, most, scratch)), scratch)


def _more(label: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame | None:
    links = scratch.save(links.distinct(), "links")
    if links.isEmpty():
        return label
    known = links if label is None else links.union(label.where("node <> component").select("node", "component"))
    return scratch.save(components(known, scratch), "labels")


def _pair_links(few: DataFrame, most: int) -> DataFrame:
    """Links between components among the members of small keys, each with each."""
    ring = Ring(most)
    one, two = (few.select("key", "start", *(F.col(c).alias(c + end) for c in ("fp", "comp", "plain"))) for end in "xy")
    met = one.join(two, ["key", "start"]).where("fpx < fpy and compx <> compy and (plainx or plainy)")
    x = F.col("fpx").bitwiseXOR(F.col("fpy"))
    for j in range(ring.head - 1, ring.m):
        mask = F.get(F.array(*(F.lit(int(np.uint64(ring.masks[i][j]).view(np.int64))) for i in range(ring.m))), F.col("start"))
        met = met.where(F.bit_count(x.bitwiseAND(mask)) <= ring.budget[j])
    return met.select(F.col("fpx").alias("a"), F.col("fpy").alias("b"))


def _block_links(many: DataFrame, most: int, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Links between the components of large keys: all members, in blocks, beside those outside the main component, in blocks."""
    rest = many.where("comp <> main")
    counted = scratch.save(rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"), F.count(F.lit(1)).alias("size")), "parts")
    wide = spread_join(many, counted, ["key"], F.col("fp"), scratch).withColumn("blocks", F.ceil(F.col("members") / block))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("fp", "key"), F.col(n))
    cols = ["key", "start", "i", "j", "side", "fp", "comp", "plain"]
    every = wide.withColumns({"i": own("blocks"), "side": F.lit(0)}).withColumn("j", each("parts")).select(cols)
    outside = wide.where("comp <> main").withColumns({"j": own("parts"), "side": F.lit(1)}).withColumn("i", each("blocks")).select(cols)
    return every.union(outside).groupBy("key", "start", "i", "j").applyInArrow(lambda t: _cell_links(t, most), "a long, b long")


def _cell_links(cell: pa.Table, most: int, slab: int = 256) -> pa.Table:
    """A forest of the links between unlike components of two blocks."""
    get = lambda name: cell.column(name).to_numpy()
    start = cell.column("start")[0].as_py()
    ring, side = Ring(most), get("side")
    fp, plain = get("fp").view(U64), get("plain")
    name, comp = np.unique(get("comp"), return_inverse=True)
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    ends = ([], [])
    for lo in range(0, len(b), slab):
        some = b[lo : lo + slab]
        fits = (plain[a][None, :] | plain[some][:, None]) & (comp[a][None, :] != comp[some][:, None])
        r, c = np.nonzero(fits)
        x = fp[some][r] ^ fp[a][c]
        r, c = r[at := ring.linked(x, start)], c[at]
        # one link for each two components that meet here
        pair = np.unique(comp[some[r]].astype(np.int64) * len(name) + comp[a[c]])
        for end, values in zip(ends, (pair // len(name), pair % len(name)), strict=True):
            end.append(values)
    u, v = (np.concatenate(e) if e else np.zeros(0, np.int64) for e in ends)
    root = _roots(len(name), u, v)
    moved = np.flatnonzero(root != np.arange(len(name)))
    return pa.table({"a": pa.array(name[moved], pa.int64()), "b": pa.array(name[root[moved]], pa.int64())})


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each of n nodes' components under links u to v."""
    root = np.arange(n)
    while len(u):
        least = root.copy()
        np.minimum.at(least, root[u], root[v])
        np.minimum.at(least, root[v], root[u])
        least = least[least[root]]
        if (least == root).all():
            break
        root = least
    return root


# ---------------------------------------------------------------- the operator


def simhash_duplicates(docs: DataFrame, most: int = 4, width: int = 4) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hexadecimal digits), component_id, n_alike.

    A text's fingerprint has a bit where over half the XXH64 hashes (seed 42) of
    its shingles of ``width`` lower-cased words have it; repeats count. A text of
    fewer words has its whole sequence as its one shingle. Documents whose
    fingerprints differ in ``most`` bits or fewer are linked; component_id is the
    smallest doc_id reachable, the document's own included. n_alike counts the
    rows of the same fingerprint.

    Null, empty and blank texts have the fingerprint zero, which is linked like
    any other. Rows that repeat an id are nodes of their own with their own
    texts' links. A row with a null doc_id takes part, as any row, but names no
    component: component_id is null where no row of the component has an id.
    Other columns are ignored. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = scratch.save(texts.mapInArrow(_fingerprints(width), "doc_id long, fp long, place long"), "prints")
    classes = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    label = fingerprint_links(classes, most, scratch)
    named = classes.select("fp", "least", F.col("n").alias("size"), F.col("n").alias("n_alike"))
    if label is None:
        named = named.withColumn("component_id", F.col("least"))
    else:
        grouped = named.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
        grouped = scratch.save(grouped, "grouped")
        least = scratch.save(grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size")), "least")
        named = spread_join(grouped.withColumnRenamed("size", "held"), least, ["root"], F.col("fp"), scratch).withColumnRenamed("held", "size")
    named = scratch.save(named.select("fp", "component_id", "n_alike", "size"), "named")
    out = spread_join(prints, named, ["fp"], F.struct("doc_id", "place"), scratch)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", hexed.alias("fingerprint"), "component_id", "n_alike")


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
