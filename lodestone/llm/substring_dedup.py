"""Removal of passages of words that a corpus repeats, by recompression.

Rounds name runs of one symbol, then pairs dealt by a global rule; a name is a
64-bit digest of what it stands for, the same in every task, so rounds need no
shuffle to agree. Each symbol carries the stretch of words that decides it:
inside it, copies of a passage have the same symbols. Windows are tied to the
smallest-named gram of two high-level symbols decided inside them, and compared
where that name occurs twice (see ``repeats``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import Chunk, Scratch, carried, chunk_ranges, keyed, texts_of
from lodestone.llm.repeats import covered, doubled, repeated_spans, with_spans, word_anchors, word_sequences

RESULT = "doc_id long, n_words long, n_removed long, kept string"


def _removal(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, spans = batch.column(0), texts_of(batch), batch.column(2)
            for lo, hi in chunk_ranges(texts):
                c = Chunk(texts[lo:hi], lower=False)
                removed, out = [], []
                for i, found in enumerate(spans.slice(lo, hi - lo)):
                    n, begin = int(c.n_words[i]), c.first[i]
                    gone = np.zeros(n, dtype=bool)
                    if found.is_valid:
                        s = found.values
                        gone = covered(n, *(s.field(x).to_numpy().astype(np.int64) for x in ("s0", "s1")), window)
                    removed.append(int(gone.sum()))
                    text, at = texts[lo + i] or b"", c.begin[i]
                    if digest or gone.any():
                        keep = np.flatnonzero(~gone) + begin
                        kept = b" ".join([text[x:y] for x, y in zip((c.start[keep] - at).tolist(), (c.end[keep] - at).tolist(), strict=True)])
                        out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "replace"))
                    else:
                        out.append(text.decode("utf-8", "replace") if texts[lo + i] is not None else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(c.n_words.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(out, pa.string()),
                        *(batch.column(i).slice(lo, hi - lo) for i in range(3, batch.num_columns)),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept", *batch.schema.names[3:]],
                )

    return run


def drop_repeated_passages(docs: DataFrame, window: int = 35, rounds: int = 3, digest: bool = False, carry: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept, and the columns named in ``carry``.

    Words are maximal runs of other than ASCII white space. Removed is each word
    covered by a window of ``window`` words that also starts anywhere else in
    the table, the same document included, as judged on the input. kept is the
    rest joined by single spaces (the text itself where nothing goes), or, with
    ``digest``, the SHA-256 of the rest so joined.

    A null text has no words (kept null, or the digest of nothing); so has an
    empty or blank one. Repeated rows, ids included, are separate documents and
    repeat each other. Other columns are ignored. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    inside, schema, back = carried(docs, carry or [])
    rows = keyed(docs, *inside)
    doubles = doubled(rows, scratch)
    spans = repeated_spans(rows, scratch, word_sequences, word_anchors(window, rounds), window, 1, doubles)
    joined = with_spans(rows, spans, doubles, scratch).select("doc_id", "text", "spans", *(f"x{i}" for i in range(len(inside))))
    return joined.mapInArrow(_removal(window, digest), RESULT + schema).select("doc_id", "n_words", "n_removed", "kept", *back)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


OP10_SQL = r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
starts as (select doc_id, unnest(range(1, greatest(len(w) - 33, 1))) as s, w from d),
windows as materialized (select doc_id, s, sha256(array_to_string(w[s:s + 34], ' ')) as h from starts),
again as (select h from windows group by h having count(*) > 1),
gone as (select distinct doc_id, s + o as i from windows join again using (h), (select unnest(range(0, 35)) as o)),
words as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from d),
kept as (select doc_id, string_agg(x, ' ' order by i) as k, count(*) as n from words anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(len(d.w) - coalesce(n, 0) as bigint) as n_removed,
  sha256(coalesce(k, '')) as kept_sha256
from d left join kept using (doc_id)
"""
