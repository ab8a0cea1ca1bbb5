"""Spelling variants: words one insertion, deletion or replacement apart, found by Aho-Corasick automata over halves.

1. A scan cuts texts into words and counts them, with sums in each task first.
2. Every word has two halves, a head and a tail. One change leaves one of them
   whole, at the head or tail of the other word. So automata over halves, in
   shards of bounded size, are run over all words; a match counts at the
   word's edge that the half is from, if lengths fit.
3. Of two words with the half in common, what is left over differs by the one
   change. A shard holds its words' rests with each letter left out, so that
   distance is verified by looking up the rest of the scanned word likewise: a
   half that many words share costs time in proportion to them.
4. A half of more words than a shard may hold is dealt over several shards, and
   the words that are run against it over blocks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import Scratch, texts_of

#: Distinct words that a task holds before it sends on its sums; characters of a text that are cut at once.
HELD, PIECE = 400_000, 1 << 20
#: Halves in a shard, and words that are run against one shard's share of a hot half.
SHARD, BLOCK = 20_000, 100_000

_GAP = re.compile(r"[^a-zÀ-ÿ]")
NEAR = "word string, n_near long, best_n long, best string"


# ---------------------------------------------------------------- words


def _runs(text: str, least: int) -> Iterator[str]:
    """Maximal runs of letters, of ``least`` letters or more; the text is taken in pieces that cut no run."""
    run = re.compile(f"[a-zÀ-ÿ]{{{least},}}")
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.end() if gap else len(text)
        yield from run.findall(text, at, end)
        at = end


def altered(doc_id: int | None, run: str, one_in: int) -> str:
    """The run, without a letter if the CRC-32 of doc_id:run is divisible by ``one_in``."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count_words(least: int, one_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                text = (text or b"").lower().decode()  # of bytes: A-Z alone
                for word, n in Counter(_runs(text, least)).items():
                    word = altered(doc_id, word, one_in)
                    if len(word) >= least:
                        held[word] += n
                if len(held) > HELD:
                    yield _sums(held)
                    held = Counter()
        if held:
            yield _sums(held)

    return run


def _sums(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


# ---------------------------------------------------------------- near words


def _holes(rest: str) -> Iterator[tuple[int, str]]:
    return ((i, rest[:i] + rest[i + 1 :]) for i in range(len(rest)))


class _Rests:
    """What words that share a half have beside it, to be asked for those at distance one."""

    def __init__(self):
        self.whole: dict[str, tuple[str, int]] = {}
        self.holes: dict[str, list[tuple[int, str]]] = defaultdict(list)

    def add(self, rest: str, word: str, n: int) -> None:
        self.whole[rest] = (word, n)
        for i, d in _holes(rest):
            self.holes[d].append((i, rest))

    def near(self, rest: str) -> set[str]:
        found = {r for _, r in self.holes.get(rest, ())}  # a letter more
        for i, d in _holes(rest):
            if d in self.whole:  # a letter less
                found.add(d)
            found.update(r for j, r in self.holes.get(d, ()) if j == i and r != rest)  # another letter
        return found


def _shard_links(cell: pa.Table) -> pa.Table:
    """For each word that is run against the shard: how many of the shard's words are near, and the most frequent of them.

    A pair with both halves in place (its change is at the seam) counts by its heads alone.
    """
    rows = zip(*(cell.column(c).to_pylist() for c in ("half", "tail", "word", "n")), strict=True)
    sides: dict[str, tuple[_Rests, _Rests]] = {}
    words = set()
    for half, tail, word, n in rows:
        if half is None:
            words.add(word)
            continue
        rests = sides.setdefault(half, (_Rests(), _Rests()))[tail]
        rests.add(word[: len(word) - len(half)] if tail else word[len(half) :], word, n)
    automaton = ahocorasick.Automaton()
    for half, rests in sides.items():
        automaton.add_word(half, (half, *rests))
    out = []
    if sides:
        automaton.make_automaton()
        for word in words:
            count, best_n, best = 0, 0, ""
            for end, (half, heads, tails) in automaton.iter(word):
                found = []
                if end + 1 == len(half):
                    found = [heads.whole[r] for r in heads.near(word[end + 1 :])]
                if end + 1 == len(word):
                    found += [(w, n) for w, n in (tails.whole[r] for r in tails.near(word[: end + 1 - len(half)])) if not word.startswith(w[: len(w) // 2])]
                for w, n in found:
                    count += 1
                    if n > best_n or n == best_n and w < best:
                        best_n, best = n, w
            if count:
                out.append((word, count, best_n, best))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table({name: pa.array(x, k) for name, x, k in zip(("word", "n_near", "best_n", "best"), columns, kinds, strict=True)})


def _half(tail: bool, length: Column, word: Column) -> Column:
    """(half, tail) that a word of so many letters would share with ``word``."""
    head = F.floor(length / 2).cast("int")
    part = F.right(word, length.cast("int") - head) if tail else F.left(word, head)
    return F.struct(part.alias("half"), F.lit(int(tail)).alias("tail"))


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n_near, best_n, best) of those of words (word, n; saved) that have a near one. best: the most frequent, the first of equals."""
    length, word = F.char_length("word"), F.col("word")
    halves = words.select("word", "n", F.inline(F.array(_half(False, length, word), _half(True, length, word))))
    asked = F.array_distinct(F.array(*(_half(tail, length + d, word) for tail in (False, True) for d in (-1, 0, 1))))
    asked = words.select("word", F.inline(asked))
    # a hot half has over SHARD words, so there are at most 2 / SHARD of them a word
    hot = halves.groupBy("half", "tail").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > SHARD)
    hot = scratch.save(hot.select("half", "tail", F.ceil(F.col("m") / SHARD).alias("shares"), F.ceil(F.col("m") / BLOCK).alias("blocks")), "hot")
    shards = max(1, -(-2 * words.count() // SHARD))
    small = hot.count() <= 100_000
    hash_ = F.xxhash64("half", "tail")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1).cast("long")) - 1))
    deal = lambda n: F.coalesce(F.pmod(F.xxhash64("word"), n), F.lit(0).cast("long"))

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(hot) if small else hot, ["half", "tail"], "left")
        return rows.withColumn("shard", F.when(F.col("shares").isNull(), F.pmod(hash_, F.lit(shards))).otherwise(hash_))

    held = placed(halves).withColumn("i", deal(F.col("shares"))).withColumn("j", each(F.col("blocks"))).select("shard", "i", "j", "half", "tail", "word", "n")
    none = [F.lit(None).cast("string").alias("half"), F.lit(None).cast("int").alias("tail"), "word", F.lit(None).cast("long").alias("n")]
    run = placed(asked).withColumn("j", deal(F.col("blocks"))).withColumn("i", each(F.col("shares"))).select("shard", "i", "j", *none)
    found = held.union(run).groupBy("shard", "i", "j").applyInArrow(_shard_links, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best"))


# ---------------------------------------------------------------- the operator


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of forms (word, form; saved): each word's last form. A form is ten times as frequent, so chains are
    short and have no circles; every round doubles what is followed."""
    roots = scratch.save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = scratch.save(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, least: int = 7, least_n: int = 2, factor: int = 10, one_in: int = 31) -> DataFrame:
    """One row a word of docs (doc_id, text): word, form, root, n, n_near, form_n.

    Words are maximal runs of ASCII letters and U+00C0 to U+00FF, A-Z
    lower-cased, one in ``one_in`` with a letter deleted (see ``altered``), that
    have ``least`` letters and ``least_n`` occurrences at least. Words are near if
    they differ by exactly one inserted, deleted or replaced letter; n_near
    counts near words. A word's form is its near word of most occurrences (of
    equals the first in code-point order), if these are ``factor`` times its own
    or more, else null; form_n its occurrences. root is the last form of forms,
    the word itself without any.

    Null and empty texts have no words. Repeated rows count repeatedly. A null
    doc_id counts as an empty one where letters are deleted. Other columns are
    ignored. An empty table gives none.
    """
    if least < 2:
        raise ValueError("words need two letters at least")
    scratch = Scratch(docs.sparkSession, "spelling")
    found = docs.select("doc_id", "text").mapInArrow(_count_words(least, one_in), "word string, n long")
    words = scratch.save(found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n), "words")
    near = words.join(near_words(words, scratch), "word", "left")
    has = F.col("best_n") >= factor * F.col("n")
    named = scratch.save(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "named")
    roots = _roots(named.where("form is not null").select("word", "form"), scratch)
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
with recursive t as materialized (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as crc),
runs as materialized (select doc_id, run, count(*) as n from (select doc_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents)
  where length(run) >= 7 group by all),
bytes as (select doc_id, run, n, list_concat([4294967295], flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || run, ''),
    lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195, unicode(x)::bigint - 64] end))) as b from runs),
hashed as (select doc_id, run, n, xor(list_reduce(b, lambda c, x: xor(c // 256, crc[cast(xor(c, x) % 256 as bigint) + 1])), 4294967295) as h from bytes, t),
words as materialized (select word, cast(sum(n) as bigint) as n from (
    select case when h % 31 = 0 then left(run, cast(h % length(run) as bigint)) || substring(run, cast(h % length(run) as bigint) + 2) else run end as word, n from hashed)
  where length(word) >= 7 group by word having sum(n) >= 2),
holes as materialized (select word, n, i, left(word, i) || substring(word, i + 2) as d from (select word, n, unnest(range(length(word))) as i from words)),
near as (select a.word, b.word as other, b.n from holes a join holes b on a.d = b.d and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from holes a join words b on a.d = b.word
  union select b.word, a.word, a.n from holes a join words b on a.d = b.word),
best as (select word, count(*) as n_near, arg_min(other, struct_pack(x := -n, y := other)) as form, max(n) as form_n from near group by word),
named as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= 10 * w.n then form end as form, case when form_n >= 10 * w.n then form_n end as form_n from words w left join best using (word)),
chain as (select word, word as root from named union all select c.word, n.form from chain c join named n on n.word = c.root where n.form is not null)
select word, form, root, n, n_near, form_n from named join (select word, arg_max(root, n) as root from (select c.word, c.root, n.n from chain c join named n on n.word = c.root) group by word) using (word)
"""
