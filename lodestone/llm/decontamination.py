"""Test items inside documents, by size-partitioned MinHash containment search.

All steps are DataFrame expressions; nothing runs Python on the executors.

1. Items are split into partitions by the size of their shingle sets, from one
   power of two to the next. A partition's sketch length follows from its upper
   size u: of each item it keeps the floor(u (100 - percent) / 100) + 1 least
   shingle hashes, its bottom-k MinHash values (all, if it has fewer). Hashes of
   shingles that more items have come later, by powers of two, so that a phrase
   of a template doesn't lead from each of its items to each document with it.
2. A document that holds ``percent`` of an item's shingles misses at most
   floor(n (100 - percent) / 100) of them, so it holds at least one of the kept
   values: the probe of the documents' hashes finds every such pair.
3. The pairs so found are verified on the shingles themselves, as words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm._common import LOW, SPACE_CLASS, UPPER, Scratch, keyed, spread_join

#: Rows of the items' sketches, ids of candidate documents, and bytes of the items' shingles that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 128 << 20


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) runs of other than ASCII white space; none for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOW), SPACE_CLASS)
    return F.filter(parts, lambda x: x != "")


def _starts(width: int) -> Column:
    last = F.greatest(F.size("words") - width, F.lit(0))
    return F.when(F.size("words") > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(width: int) -> Column:
    """Of column words: a hash of each shingle; fewer words than ``width`` are one shingle."""
    return F.transform(_starts(width), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(width)]))


def shingle_texts(width: int) -> Column:
    return F.transform(_starts(width), lambda i: F.array_join(F.slice("words", i + 1, width), " "))


def _pairs(docs: DataFrame, items: DataFrame, percent: int, width: int) -> DataFrame:
    """(k, doc_id, item_id, n_item, n_shared) of rows, by key, and items that they contain."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    texts = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    parts = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    parts = parts.select("item_id", F.xxhash64("item_id", "text").alias("item"), words_of(F.col("text")).alias("words"))
    sets = parts.select("item_id", "item", F.array_distinct(shingle_texts(width)).alias("shingles"), F.array_sort(F.array_distinct(shingle_hashes(width))).alias("hashes"))
    sets = scratch.save(sets.where(F.size("shingles") > 0).withColumn("n_item", F.size("shingles").cast("long")), "items")

    sketch = scratch.save(_sketches(sets, percent, scratch), "sketches")
    hashes = texts.select("k", words_of(F.col("text")).alias("words")).select("k", F.explode(shingle_hashes(width)).alias("h"))
    if sketch.count() <= BROADCAST_ROWS:
        met = hashes.join(F.broadcast(sketch), "h")
    else:  # a shingle that very many documents have is dealt over tasks
        probed = sketch.groupBy("h").agg(F.count(F.lit(1)).alias("items"))
        sizes = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("size")).join(probed, "h").select("h", "size")
        met = spread_join(hashes, sketch, ["h"], F.col("k"), scratch, sizes=scratch.save(sizes, "sizes"))
    pairs = scratch.save(met.select("k", "item").distinct(), "pairs")

    held = pairs.select("k").distinct()
    few = held.count() <= BROADCAST_ROWS
    here = texts.join(F.broadcast(held) if few else held, "k", "left_semi").dropDuplicates(["k"])
    sizes = here.select("k", "doc_id", words_of(F.col("text")).alias("words")).select("k", "doc_id", F.array_distinct(shingle_texts(width)).alias("found"))
    length = F.aggregate("shingles", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16)
    if (sets.agg(F.sum(length)).first()[0] or 0) <= BROADCAST_BYTES:
        both = pairs.join(sizes, "k").join(F.broadcast(sets), "item")
    else:  # items go to their pairs first: they are the smaller sets
        needed = {c: scratch.save(pairs.groupBy(c).agg(F.count(F.lit(1)).alias("size")), "needed") for c in ("item", "k")}
        both = spread_join(pairs, sets, ["item"], F.col("k"), scratch, sizes=needed["item"])
        both = spread_join(both, sizes, ["k"], F.col("item"), scratch, sizes=needed["k"])
    shared = F.size(F.array_intersect("shingles", "found")).cast("long")
    return both.select("k", "doc_id", "item_id", "n_item", shared.alias("n_shared")).where(f"100 * n_shared >= {percent} * n_item")


def _sketches(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(item, h): of each item as many hashes as a document that holds ``percent`` of it can't all miss, in whichever order;
    here by how many items have them (in powers of two), then by hash. sets: item, n_item, hashes."""
    upper = F.pow(F.lit(2), F.floor(F.log2("n_item")) + 1) - 1  # of the item's size partition
    kept = (F.floor(upper * (100 - percent) / 100) + 1).cast("int")
    rows = sets.select("item", kept.alias("kept"), F.explode("hashes").alias("h"))
    common = scratch.save(rows.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("often", F.floor(F.log2("size"))), "common")
    rows = spread_join(rows, common, ["h"], F.col("item"), scratch, "left")
    place = Window.partitionBy("item").orderBy(F.coalesce("often", F.lit(0)), "h")  # an item's own hashes
    return rows.withColumn("place", F.row_number().over(place)).where("place <= kept").select("item", "h")


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """One row per pair found: doc_id, item_id, n_item, n_shared, containment.

    A pair is found if the document's set of ``width``-word shingles, words
    lower-cased, holds ``percent`` or more of the item's. A text of fewer words
    is one shingle, its whole sequence.

    Null, empty and blank texts have no shingles and are in no pair. Of rows
    that repeat a doc_id or an item_id the pair with most shared shingles
    counts, at a tie that of the shorter item. Null ids pair like others.
    Other columns are ignored. Empty tables give no pairs.
    """
    out = _pairs(docs, items, percent, width)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", (-F.col("n_item")).alias("m"))).alias("b"))
    n = -F.col("b.m")
    return best.select("doc_id", "item_id", n.alias("n_item"), F.col("b.n_shared").alias("n_shared"), F.round(F.col("b.n_shared") / n, 6).alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """The rows of ``docs`` that contain no item: a row goes by its own text, whatever others have its id, or none."""
    found = _pairs(docs, items, percent, width).select(F.col("k").alias("_k"), F.col("doc_id").alias("_id")).distinct()
    key = F.xxhash64(docs.doc_id.cast("long"), F.lit("|"), docs.text)
    return docs.join(found, (key == found["_k"]) & docs.doc_id.cast("long").eqNullSafe(found["_id"]), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
with texts as (
  select 0 as side, doc_id as id, text from documents union all select 1, item_id, text from benchmark),
w as (select side, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from texts),
s as materialized (select side, id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as x from w),
n as (select id, count(*) as n from s where side = 1 group by id),
shared as (select d.id as doc_id, i.id as item_id, count(*) as k from s d join s i on d.x = i.x and d.side = 0 and i.side = 1 group by 1, 2)
select doc_id, item_id, n as n_item, k as n_shared, round(k / n, 6) as containment
from shared join n on n.id = item_id where 100 * k >= 75 * n
"""
