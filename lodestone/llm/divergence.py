"""How the sources of a language differ from each other and from the language, by smoothed term probabilities.

1. A scan counts terms and documents by (lang, source, term), with sums in each
   task first. Terms in enough documents of their language are kept.
2. A group's postings are its kept terms with counts. Pairs of sources are
   computed from postings alone: terms that neither source has add the same
   constant each, so what is summed is the difference to it. Cells of a bounded
   number of sources and terms are dense arrays; only their sums are shuffled.
3. A group's most divergent terms are found by a bounded search. Its postings
   fall into buckets of like counts; the largest probability of a bucket less
   the smallest that the language gives any of its terms bounds them all.
   Buckets are evaluated best first, in growing batches, until every unseen
   bound is strictly below the k-th value found.

Probabilities are whole billionths, and all sums are of integers, so results
don't depend on the order of additions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm._common import Scratch, spread_join, texts_of

UNIT, PRIOR = 1_000_000_000, 5
#: Distinct (source, term) that a task holds before it sends on its sums; bytes of a text that are cut at once.
HELD, PIECE = 1_000_000, 1 << 20
#: A document in a sum that holds occurrences too: a task has fewer occurrences of a term.
DOC = 1 << 40
#: Sources in a block of a cell, and terms of a cell.
SOURCES, TERMS = 256, 4096
#: Each batch of the search may evaluate so many times the postings of the one before.
GROWTH = 8

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")
COUNTS = "lang string, source string, term string, n long, docs long"
CELL = "lang string, source string, item string, more long"


# ---------------------------------------------------------------- counts


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that cut no term, short of one longer than a piece."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch), strict=True):
            sums = held.setdefault((lang, source), {b"": 0})
            size -= len(sums)
            here: Counter = Counter()
            for part in _pieces((text or b"").lower()):  # of bytes: A-Z alone
                here.update(_TERM.findall(part))
            for term, n in here.items():
                sums[term] = sums.get(term, 0) + n + DOC
            size += len(sums)
            if size > HELD:
                yield from _sums(held)
                held, size = {}, 0
    yield from _sums(held)


def _sums(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), sums in held.items():
        both = np.fromiter(sums.values(), dtype=np.int64, count=len(sums))
        terms = pa.array(list(sums), pa.binary()).cast(pa.string())
        same = [pa.repeat(pa.scalar(x, pa.string()), len(sums)) for x in (lang, source)]
        yield pa.RecordBatch.from_arrays([*same, terms, pa.array(both % DOC), pa.array(both // DOC)], names=re.findall(r"(\w+) \w+", COUNTS))


def _share(n: str | Column, total: str, terms: str) -> Column:
    """Billionths of a term with count n among ``total`` of ``terms`` terms; decimals, as products exceed 64 bits."""
    n = n if isinstance(n, Column) else F.col(n)
    top = (n.cast("decimal(20,0)") + PRIOR) * F.lit(UNIT).cast("decimal(10,0)")
    below = F.col(total).cast("decimal(20,0)") + F.col(terms).cast("decimal(18,0)") * PRIOR
    return F.lit(1) + F.call_function("div", top, below).cast("long")


# ---------------------------------------------------------------- pairs of sources


def _cell_sums(cell: pa.Table) -> pa.Table:
    """Of two blocks of sources and some terms: for each pair, its differences less those of two unseen terms."""
    col = lambda name: cell.column(name).combine_chunks()
    term, source = col("term"), col("source")
    head = term.is_null().to_numpy(zero_copy_only=False)
    names = source.filter(pa.array(head)).to_pylist()
    block = col("block").to_numpy()[head]
    base = col("p").to_numpy()[head]
    at = {s: i for i, s in enumerate(names)}
    row = np.fromiter((at[s] for s in source.filter(pa.array(~head)).to_pylist()), dtype=np.int64)
    column = term.filter(pa.array(~head)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    p = col("p").to_numpy()[~head]
    total = np.zeros((len(names), len(names)), dtype=np.int64)
    apart = np.abs(base[:, None] - base[None, :])
    order = np.argsort(column, kind="stable")
    n_terms = int(column.max()) + 1 if len(column) else 0
    for lo in range(0, n_terms, TERMS):
        hi = min(n_terms, lo + TERMS)
        some = order[np.searchsorted(column[order], lo) : np.searchsorted(column[order], hi)]
        dense = np.repeat(base[:, None], hi - lo, axis=1)
        dense[row[some], column[some] - lo] = p[some]
        for i in range(len(names) - 1):
            total[i, i + 1 :] += np.abs(dense[i + 1 :] - dense[i]).sum(axis=1) - (hi - lo) * apart[i, i + 1 :]
    total += total.T
    i, j = np.triu_indices(len(names), 1)
    if len(set(block.tolist())) > 1:  # a cell of two blocks: their own pairs are summed in their own cells
        i, j = (x[block[i] != block[j]] for x in (i, j))
    lang = col("lang")[0].as_py() if len(cell) else None
    take = lambda x: pa.array([names[k] for k in x], pa.string())
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "source": take(i), "item": take(j), "more": pa.array(total[i, j])})


def _pairs(groups: DataFrame, postings: DataFrame, parts: int) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, both ways."""
    both = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = groups.withColumn("x", both).select("lang", "source", "block", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "unseen")
    heads = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("lang", "i", "j", "part", "source", "block", F.lit(None).cast("string").alias("term"), F.col("unseen").alias("p"))
    seen = postings.withColumn("x", both).select(
        "lang", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"), "source", "block", "term", "p"
    )
    sums = heads.union(seen).groupBy("lang", "i", "j", "part").applyInArrow(_cell_sums, CELL)
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("more").alias("more"))
    ends = [groups.select("lang", F.col("source").alias(name), F.col("unseen").alias(u), "terms") for name, u in (("source", "u"), ("item", "v"))]
    one = sums.join(ends[0], ["lang", "source"]).join(ends[1].drop("terms"), ["lang", "item"])
    one = one.select("lang", "source", "item", (F.col("more") + F.col("terms") * F.abs(F.col("u") - F.col("v"))).alias("value"))
    return one.union(one.select("lang", F.col("item"), F.col("source"), "value"))


# ---------------------------------------------------------------- terms


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _top_terms(postings: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(lang, source, item, value, rank): each group's k terms whose probability exceeds the language's most.

    postings: lang, source, term, n, p, q. Every round joins the postings of the
    batch's buckets alone with what the rounds before left.
    """
    like = F.when(F.col("n") < 16, F.col("n")).otherwise(16 + F.floor(F.log2("n") * 4))
    rows = postings.select("lang", "source", "term", like.alias("bucket"), "p", "q")
    bounds = rows.groupBy("lang", "source", "bucket").agg(F.count(F.lit(1)).alias("size"), (F.max("p") - F.min("q")).alias("bound"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(first), F.lit(0))
    turn = F.ceil(F.log(float(GROWTH), F.greatest(F.lit(1.0), (before + 1) / k))).cast("int")
    bounds = scratch.save(bounds.where("bound > 0").withColumn("turn", turn), "bounds")
    best, here = None, 0
    while True:
        left = bounds.where(F.col("turn") >= here)
        if best is not None:
            kth = best.where(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
            left = left.join(kth, ["lang", "source"], "left").where("kth is null or bound >= kth").drop("kth")
        here = left.agg(F.min("turn")).first()[0]  # a batch that no group needs is passed over
        if here is None:
            break
        chosen = scratch.save(left.where(F.col("turn") == here).select("lang", "source", "bucket", "size"), "chosen")
        found = spread_join(rows, chosen, ["lang", "source", "bucket"], F.col("term"), scratch, "left_semi")
        found = found.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).where("value > 0")
        best = scratch.save(_ranked(found if best is None else found.union(best.drop("rank"))).where(F.col("rank") <= k), "best")
        here += 1
    return _ranked(rows.select("lang", "source", F.col("term").alias("item"), F.col("p").alias("value")).where("false")) if best is None else best


# ---------------------------------------------------------------- the operator


def source_divergence(docs: DataFrame, least_docs: int = 30, k: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source).

    Terms are maximal runs of ASCII letters and characters beyond ASCII, A-Z
    lower-cased. A language keeps those in at least ``least_docs`` of its
    documents. In a group (lang, source) and in a language a kept term of count
    c has p = 1 + floor(10^9 (c + 5) / (N + 5 V)): V kept terms, N their
    occurrences. Part ``pair``: each other source of the language, with the sum
    of |p - p'| over all kept terms. Part ``term``: the k terms of the group
    whose p exceeds the language's most, with the difference. Ranks count from
    1, largest value first, then the item's UTF-8 order.

    Null texts, languages and sources count as empty ones. Groups without terms
    have pairs. A language of one source has none, one without kept terms pairs
    of value 0. Repeated rows count repeatedly. Other columns, ids among them,
    are ignored. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    found = docs.select(blank("lang"), blank("source"), "text").mapInArrow(_count_terms, COUNTS)
    counts = scratch.save(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs"))
    kept = scratch.save(kept.where(F.col("docs") >= least_docs).drop("docs"), "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n_lang").alias("all"))
    held = scratch.save(counts.where("term <> ''").drop("docs").join(kept, ["lang", "term"]), "held")
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count(F.lit(1)).alias("size"))
    groups = counts.where("term = ''").select("lang", "source").join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = groups.na.fill(0, ["terms", "all", "own", "size"])
    unseen = F.when(F.col("terms") > 0, _share(F.lit(0), "own", "terms")).otherwise(0)
    numbered = groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    size = F.count(F.lit(1)).over(Window.partitionBy("lang"))
    groups = numbered.select("*", unseen.alias("unseen"), F.floor(F.col("no") / SOURCES).cast("int").alias("block"), F.ceil(size / SOURCES).cast("int").alias("blocks"))
    groups = scratch.save(groups, "groups")
    postings = spread_join(held, groups, ["lang", "source"], F.col("term"), scratch)
    postings = postings.select("lang", "source", "term", "n", _share("n", "own", "terms").alias("p"), _share("n_lang", "all", "terms").alias("q"), "block", "blocks")
    postings = scratch.save(postings, "postings")
    scratch.drop(counts, held)

    parts = max(1, -(-kept.count() // TERMS))
    label = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return label(_ranked(_pairs(groups, postings, parts)), "pair").union(label(_top_terms(postings, k, scratch), "term"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
with d as (
  select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
occ as (select i, lang, source, unnest(w) as term from d),
per_doc as materialized (select i, lang, source, term, count(*) as n from occ group by all),
kept as materialized (select lang, term, cast(sum(n) as bigint) as n_lang from per_doc group by lang, term having count(*) >= 30),
langs as (select lang, count(*) as v, cast(sum(n_lang) as bigint) as n_all from kept group by lang),
held as materialized (select lang, source, term, cast(sum(n) as bigint) as n from per_doc semi join kept using (lang, term) group by all),
sums as (select lang, source, cast(sum(n) as bigint) as own from held group by all),
groups as materialized (select g.lang, g.source, coalesce(v, 0) as v, coalesce(n_all, 0) as n_all, coalesce(own, 0) as own
  from (select distinct lang, source from d) g left join langs using (lang) left join sums using (lang, source)),
full_ as materialized (select g.lang, g.source, k.term, coalesce(h.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(h.n, 0) + 5)) // (g.own + 5 * g.v) as p, 1 + (1000000000::hugeint * (k.n_lang + 5)) // (g.n_all + 5 * g.v) as q
  from groups g join kept k using (lang) left join held h using (lang, source, term)),
diff as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from full_ a join full_ b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join diff on diff.lang = a.lang and diff.source = a.source and diff.item = b.source),
terms as (select lang, source, 'term' as part, term as item, cast(p - q as bigint) as value from full_ where n > 0 and p > q)
select * from (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from (select * from pairs union all select * from terms))
where part = 'pair' or rank <= 50
"""
