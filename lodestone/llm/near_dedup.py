"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, components.

1. A scan turns each text into its set of word shingles, a digest of the set
   and a SuperMinHash signature, folded into band keys.
2. Documents of equal sets form a class; only that of its smallest id goes on,
   so a group of thousands of copies costs one row.
3. Classes that share a band key are compared with one pivot of that key. If
   these comparisons don't join a pivot's classes to one component, two of them
   can still be linked in two ways: their shares of the pivot alone are large
   enough, which their counts tell, or they share shingles that the pivot
   lacks, and these shingles are the keys of the next round. So a group of n
   variants costs about n comparisons a round, not n * n.
4. Links hold if the full sets meet the threshold; components are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import Chunk, Scratch, U64, chunk_ranges, shingle_sets, signed, splitmix, spread_join, texts_of
from lodestone.llm.graph_components import components

#: Up to so many candidate ids (8 bytes each) are broadcast to the second scan; more are shuffled.
BROADCAST_IDS = 2_000_000

#: The rounds end once the pairs within keys are no more than so many for each row of the bands, linear work: these
#: are counted by matrix products, in blocks of about so many shingles and classes, and only links become rows.
DIRECT, BLOCK_ITEMS, BLOCK_CLASSES = 64, 1 << 19, 1024

SIGNATURE = "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, bands array<long>"
SETS = "doc_id long, s1 long, s2 long, items array<long>"
#: What tells a class, a set of shingles, from all others.
CLASS = ["s1", "s2", "n_shingles"]


def superminhash(element: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """SuperMinHash signatures (n_docs x m) of sets given as distinct (doc, element).

    Step j of an element's permutation puts j + r into one slot. All elements
    take step j together. A value of step j is never below one of an earlier
    step, so a document whose slots are all filled stops: the early stop of the
    published algorithm, exact for each document. Empty sets stay infinite.
    """
    h = np.full(n_docs * m, np.inf)
    base = doc * m
    perm = None
    for j in range(m):
        if not len(element):
            break
        x = splitmix(element + U64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        r = (x >> U64(11)).astype(np.float64) * 2.0**-53
        k = j + (splitmix(x ^ U64(0x5851F42D4C957F2D)) % U64(m - j)).astype(np.int64)
        row = np.arange(len(element))
        if perm is None:
            slot, first = k, k
        else:
            slot = perm[row, k]
            perm[row, k] = perm[row, j]
            perm[row, j] = slot
        np.minimum.at(h, base + slot, j + r)
        open_docs = np.isinf(h.reshape(n_docs, m).max(axis=1))
        going = open_docs[base // m]
        if perm is None:
            element, base, first = element[going], base[going], first[going]
            perm = np.tile(np.arange(m, dtype=np.int64 if m > 255 else np.uint8), (len(element), 1))
            row = np.arange(len(element))
            perm[row, first] = perm[row, 0]
            perm[row, 0] = first
        elif not going.all():
            element, base, perm = element[going], base[going], perm[going]
    return h.reshape(n_docs, m)


def _digests(item: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Two digests of each set; item: all sets' elements in a row, ``count`` of each."""
    edge = np.concatenate(([0], np.cumsum(count)))
    sums = []
    for c in (0x1234567, 0x89ABCDE):
        total = np.zeros(len(item) + 1, dtype=U64)
        np.cumsum(splitmix(item + U64(c)), out=total[1:])
        sums.append(total[edge[1:]] - total[edge[:-1]])
    return sums


def _signatures(width: int, bands: int, rows: int):
    odd = splitmix(np.arange(100, 100 + rows, dtype=U64)) | U64(1)
    salt = splitmix(np.arange(500, 500 + bands, dtype=U64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts = batch.column(0), batch.column(1), texts_of(batch)
            for a, b in chunk_ranges(texts):
                n = b - a
                doc, item = shingle_sets(Chunk(texts[a:b], lower=True), width)
                count = np.bincount(doc, minlength=n)
                h = superminhash(item, doc, n, bands * rows)
                keys = splitmix((h.view(U64).reshape(n, bands, rows) * odd).sum(axis=2, dtype=U64) + salt)
                sums = _digests(item, count)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(signed(keys.ravel())))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, n), hashes.slice(a, n), pa.array(count.astype(np.int64)), pa.array(signed(sums[0])), pa.array(signed(sums[1])), lists],
                    names=["doc_id", "text_hash", "n_shingles", "s1", "s2", "bands"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch)
            for a, b in chunk_ranges(texts):
                doc, item = shingle_sets(Chunk(texts[a:b], lower=True), width)
                count = np.bincount(doc, minlength=b - a)
                edge = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                sums = [pa.array(signed(x)) for x in _digests(item, count)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *sums, pa.ListArray.from_arrays(pa.array(edge), pa.array(signed(item)))], names=["doc_id", "s1", "s2", "items"])

    return run


def near_duplicates(
    docs: DataFrame, percent: int = 75, width: int = 5, bands: int = 32, rows: int = 4
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, group_id, text_hash.

    Documents are linked if 100 * shared >= percent * united distinct shingles
    of ``width`` lower-cased words; a pair at 75 % shares none of 32 bands of 4
    with a chance of 5 in a million. component_id is the smallest doc_id
    reachable by links, the document's own id included; kept marks that one.
    group_id names the component itself, and text_hash is xxhash64 of the text.

    Null, empty and blank texts have no shingles, no links and no group.
    Repeated rows are copies of each other. Rows that repeat an id with another
    text are documents of their own: each has its text's links, and components
    of unlike texts may share a component_id, not a group_id. A null doc_id
    takes no part: its component_id is null and it is kept. Other columns are
    ignored. An empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    sig = scratch.save(texts.mapInArrow(_signatures(width, bands, rows), SIGNATURE), "signatures")
    some = sig.where("n_shingles > 0 and doc_id is not null")
    counted = scratch.save(sig.groupBy(CLASS).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("size")), "counted")
    classes = counted.where("n_shingles > 0 and doc_id is not null")
    # a class goes by its smallest id; where several classes have the same, all but the first go by a hash of theirs
    first = classes.groupBy("doc_id").agg(F.min(F.struct(CLASS)).alias("first"))
    own = F.when(F.struct(CLASS) == F.col("first"), F.col("doc_id")).otherwise(F.xxhash64("doc_id", *CLASS))
    classes = scratch.save(classes.join(first, "doc_id").select(*CLASS, "doc_id", own.alias("rep")), "classes")
    reps = some.join(classes, [*CLASS, "doc_id"]).select("rep", "n_shingles", "bands")
    rows_of = reps.select(F.explode("bands").alias("key"), "rep", "n_shingles")
    shared = rows_of.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
    shared = scratch.save(shared.select("key", "size"), "shared")
    banded = scratch.save(spread_join(rows_of, shared, ["key"], F.col("rep"), scratch).distinct(), "bands")

    wanted = scratch.save(classes.join(banded.select("rep").distinct(), "rep", "left_semi"), "wanted")
    ids = wanted.select("doc_id").distinct()
    many = ids.count() > BROADCAST_IDS
    held = texts.select("doc_id", "text").join(ids if many else F.broadcast(ids), "doc_id", "left_semi").mapInArrow(_sets(width), SETS)
    held = held.withColumn("n_shingles", F.size("items").cast("long")).join(wanted, [*CLASS, "doc_id"]).select(F.col("rep").alias("doc_id"), "items")
    sets = scratch.save(held.dropDuplicates(["doc_id"]), "sets")
    label, here, turn = None, banded, 0
    limit = DIRECT * banded.count()
    while not here.isEmpty():
        if turn and _pairs_within(here) <= limit:
            label = _joined(label, _all_links(here, sets, percent), scratch)
            break
        tested = scratch.save(_compared(_pivot_pairs(here, turn, scratch), sets, scratch), "tested")
        label = _joined(label, tested.where(_linked(percent)).select("a", "b"), scratch)
        rest = scratch.save(_undecided(tested, label, scratch), "rest")
        near = _compared(scratch.save(_near_pivot(rest, percent, scratch), "near"), sets, scratch).where(_linked(percent)).select("a", "b")
        following = scratch.save(_next_keys(rest, sets, percent, turn, scratch), "keys")
        label = _joined(label, near, scratch)
        scratch.drop(tested, rest, *([here] if turn else []))
        here, turn = following, turn + 1
    named = classes.withColumnRenamed("doc_id", "least")
    if label is None:
        named = named.withColumns({"group": F.lit(None).cast("long"), "component": F.lit(None).cast("long")})
    else:  # a row a class, however many copies it has
        named = named.join(_named(label, classes, scratch), named.rep == F.col("node"), "left").drop("node")
    row = F.struct(F.spark_partition_id(), F.monotonically_increasing_id())
    out = spread_join(sig.drop("bands"), named, CLASS, row, scratch, "left", sizes=counted)
    there = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "least")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        F.when(there, F.coalesce("group", "rep")).alias("group_id"),
        "text_hash",
    )


def _named(label: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, group, component): group as labelled, component the smallest doc_id of the group's classes."""
    named = label.select("node", F.col("component").alias("group"))
    if classes.where("rep <> doc_id").isEmpty():  # classes go by their ids: the smallest is the label
        return named.withColumn("component", F.col("group"))
    ids = named.join(classes.select(F.col("rep").alias("node"), "doc_id"), "node")
    least = scratch.save(ids.groupBy("group").agg(F.min("doc_id").alias("component"), F.count(F.lit(1)).alias("size")), "least")
    return spread_join(named, least, ["group"], F.col("node"), scratch)


def _pairs_within(here: DataFrame) -> int:
    return here.groupBy("key").agg(F.count(F.lit(1)).alias("m")).agg(F.coalesce(F.expr("sum(m * (m - 1) div 2)"), F.lit(0))).first()[0]


def _all_links(here: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of a key in different components, all compared.

    A key's classes are dealt to blocks of bounded size, and pairs of blocks to tasks.
    """
    blocks = here.groupBy("key").agg(F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_ITEMS), F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES)).alias("blocks"))
    dealt = here.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")))
    cells = dealt.select("key", "rep", "comp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "comp")
    held = cells.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select("key", "i", "j", "rep", "comp", "items")
    return held.groupBy("key", "i", "j").applyInArrow(lambda t: _cell_links(t, percent), "a long, b long").distinct()


def _cell_links(cell: pa.Table, percent: int, slab: int = 4096) -> pa.Table:
    rep, comp = (cell.column(c).to_numpy() for c in ("rep", "comp"))
    lists = cell.column("items").combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(rep)), size)
    _, item, often = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    order = np.argsort(item, kind="stable")
    order = order[often[item[order]] > 1]
    number = np.cumsum(np.diff(item[order], prepend=-1) > 0) - 1  # of the items that several classes have
    shared = np.zeros((len(rep), len(rep)), dtype=np.float32)
    last = int(number[-1]) + 1 if len(number) else 0
    for lo in range(0, last, slab):
        x, y = np.searchsorted(number, (lo, min(lo + slab, last)))
        part = np.zeros((len(rep), min(slab, last - lo)), dtype=np.float32)
        part[row[order[x:y]], number[x:y] - lo] = 1
        shared += part @ part.T
    linked = (100 + percent) * shared.astype(np.float64) >= percent * (size[:, None] + size[None, :])
    a, b = np.nonzero(linked & (rep[:, None] < rep[None, :]) & (comp[:, None] != comp[None, :]))
    return pa.table({"a": pa.array(rep[a], pa.int64()), "b": pa.array(rep[b], pa.int64())})


def _joined(label: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) after more links (a, b)."""
    links = scratch.save(links, "links")
    if label is not None and links.isEmpty():
        return label
    known = links if label is None else links.union(label.where("node <> component").select("node", "component"))
    return scratch.save(components(known, scratch), "labels")


def _pivot_pairs(here: DataFrame, turn: int, scratch: Scratch) -> DataFrame:
    """(a, b, na, nb): each key's classes b with its pivot a. here: key, rep, n_shingles."""
    order = F.col("rep") if turn == 0 else F.xxhash64(F.col("rep"), F.lit(turn))
    pivots = here.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("rep").alias("a"), F.col("n_shingles").alias("na"))).alias("x"), F.count(F.lit(1)).alias("size"))
    pivots = scratch.save(pivots.select("key", "x.a", "x.na", "size"), "pivots")
    both = spread_join(here, pivots, ["key"], F.col("rep"), scratch).where("rep <> a")
    return scratch.save(both.select("a", F.col("rep").alias("b"), "na", F.col("n_shingles").alias("nb")).distinct(), "pairs")


def _compared(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """pairs (a, b, na, nb; saved) with i, the number of shingles they share. A set that many pairs need is copied to several tasks."""
    one = scratch.save(_sized(sets, pairs, "a", "x"), "sets")
    two = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    return spread_join(pairs, one, ["a"], F.col("b"), scratch).join(two, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("i"))


def _sized(sets: DataFrame, rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name: items, size) of the sets that rows need, with the number of rows that do."""
    need = rows.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    return sets.select(F.col("doc_id").alias(key), F.col("items").alias(name)).join(need, key)


def _linked(percent: int) -> Column:
    return F.expr(f"{100 + percent} * i >= {percent} * (na + nb)")


def _undecided(tested: DataFrame, label: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, na, nb, i, comp, least) of pivots a, themselves among b, whose classes b aren't one component yet.

    least: the smallest set size of the pivot's classes.
    """
    own = tested.select("a", F.col("a").alias("b"), "na", F.col("na").alias("nb"), F.col("na").cast("int").alias("i")).distinct()
    named = tested.union(own).join(label, F.col("b") == F.col("node"), "left").select("a", "b", "na", "nb", "i", F.coalesce("component", "b").alias("comp"))
    open_ = named.groupBy("a").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("size"), F.min("nb").alias("least"))
    return spread_join(named, scratch.save(open_.where("c0 <> c1 and size > 2").select("a", "least", "size"), "open"), ["a"], F.col("b"), scratch)


def _near_pivot(rest: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs whose shingles shared with their pivot would do for a link, if all of the lesser share were common.

    One of the two isn't linked to the pivot itself, or both would be in its component.
    """
    q, w = percent, 100 + percent
    fits = F.expr(f"{w} * i >= {q} * (nb + least)")
    some = scratch.save(rest.where("a <> b").where(fits).withColumn("most", F.when(~_linked(percent), F.expr(f"floor(({w} * i - {q} * nb) / {q})"))), "fitting")
    top = scratch.save(some.groupBy("a").agg(F.max("most").alias("top"), F.count(F.lit(1)).alias("size")).where("top is not null"), "top")
    far = some.where("most is not null")
    near = spread_join(some, top, ["a"], F.col("b"), scratch).where("nb <= top")
    near = near.select("a", F.col("b").alias("d"), F.col("nb").alias("nd"), F.col("i").alias("j"), F.col("comp").alias("other"))
    both = spread_join(far, near, ["a"], F.col("b"), scratch, sizes=top).where(f"comp <> other and nd <= most and {w} * least(i, j) >= {q} * (nb + nd)")
    return both.select(
        F.least("b", "d").alias("a"), F.greatest("b", "d").alias("b"),
        F.when(F.col("b") < F.col("d"), F.col("nb")).otherwise(F.col("nd")).alias("na"),
        F.when(F.col("b") < F.col("d"), F.col("nd")).otherwise(F.col("nb")).alias("nb"),
    ).distinct()


def _next_keys(rest: DataFrame, sets: DataFrame, percent: int, turn: int, scratch: Scratch) -> DataFrame:
    """(key, rep, n_shingles): classes of a pivot by shingles that they have and it lacks, where these aren't one component.

    A class must share a number of such shingles with another to be linked to
    it; so all but that number less one, the rarest, are keys enough. What only
    one class has is the rarest, and no key.
    """
    q, w = percent, 100 + percent
    others = rest.where("a <> b")
    one = scratch.save(_sized(sets, others, "a", "x"), "sets")
    two = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    need = F.expr(f"greatest(1, cast(ceil({q} * (nb + least) / {w}) as int) - i)")
    more = spread_join(others, one, ["a"], F.col("b"), scratch).join(two, "b").select("a", "b", "nb", "comp", (F.col("nb") - F.col("i") - need + 1).cast("int").alias("most"), F.array_except("y", "x").alias("s"))
    single = more.where("most > 0").select("a", "b", "nb", "comp", "most", F.explode("s").alias("s"))
    often = single.groupBy("s", "b").agg(F.count(F.lit(1)).alias("n")).groupBy("s").agg(F.count(F.lit(1)).alias("f"), F.sum("n").alias("size")).where("f > 1")
    shared = spread_join(single, scratch.save(often, "often"), ["s"], F.col("b"), scratch, "left").select("a", "b", "nb", "comp", "most", "s", F.coalesce("f", F.lit(1)).alias("f"))
    listed = shared.groupBy("a", "b", "nb", "comp", "most").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("x"))
    chosen = listed.select("a", "b", "nb", "comp", F.explode(F.slice("x", F.lit(1), F.col("most"))).alias("e")).where("e.f > 1")
    keyed = chosen.select(F.xxhash64("a", "e.s", F.lit(turn)).alias("key"), "b", "nb", "comp")
    members = [F.bit_xor(F.xxhash64("b", F.lit(j))).alias(f"m{j}") for j in (0, 1)]
    mixed = keyed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("m"), *members).where("c0 <> c1")
    once = mixed.groupBy("m", "m0", "m1").agg(F.min("key").alias("key")).select("key", F.col("m").alias("size"))  # keys of the same classes do the same work
    return spread_join(keyed, scratch.save(once, "once"), ["key"], F.col("b"), scratch).select("key", F.col("b").alias("rep"), F.col("nb").alias("n_shingles"), "comp")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")


OP7_SQL = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from d),
items as materialized (select doc_id, len(s) as n, unnest(s) as x from sets),
shared as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k
  from items a join items b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
links as materialized (select a, b from shared where 100 * k >= 75 * (na + nb - k)),
ways as materialized (select a, b from links union all select b, a from links),
reach as (select doc_id as node, doc_id as root from d union select ways.b, reach.root from reach join ways on ways.a = reach.node)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from sets s join (select node, min(root) as component_id from reach group by 1) c on c.node = s.doc_id
"""
