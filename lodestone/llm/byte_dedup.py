"""Removal of byte strings that a corpus repeats, on a prefix-free parse.

Rolling-hash triggers cut the texts into phrases: a phrase ends at a place
whose hash is the least of some window of the sought length, so every window
holds an end, and equal windows hold it at the same distance. The parse, one
row a phrase end, is what Spark shuffles; strings are compared only where a
phrase end with its surroundings occurs twice (see ``repeats``).

A suffix array of dictionary and parse would order every byte of the corpus to
answer a question that equality answers; README.md has the figures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import Scratch, chunk_ranges, keyed, texts_of
from lodestone.llm.repeats import byte_anchors, byte_sequences, covered, doubled, repeated_spans, with_spans

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept "
#: Bytes in a trigger, and windows whose digests stand in one row while copies' surroundings are compared.
GRAM, BLOCK = 16, 32


def _removal(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, spans = batch.column(0), texts_of(batch), batch.column(2)
            for lo, hi in chunk_ranges(texts):
                sizes, removed, runs, out = [], [], [], []
                for text, found in zip(texts[lo:hi], spans.slice(lo, hi - lo), strict=True):
                    text = text or b""
                    gone = 0
                    edges = np.zeros(0)
                    if found.is_valid:
                        s = found.values
                        inside = covered(len(text), *(s.field(x).to_numpy().astype(np.int64) for x in ("s0", "s1")), window)
                        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
                        gone = int(inside.sum())
                        text = np.frombuffer(text, dtype=np.uint8)[~inside].tobytes()
                    sizes.append(len(text) + gone)
                    removed.append(gone)
                    runs.append(len(edges) // 2)
                    out.append(hashlib.sha256(text).hexdigest() if digest else text)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(out, pa.string() if digest else pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return run


def drop_repeated_bytes(docs: DataFrame, window: int = 200, digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept.

    Removed is each byte of a text's UTF-8 that is covered by a string of
    ``window`` bytes which also starts anywhere else in the table, the same
    document included; overlaps count, and strings are judged on the input.
    n_spans counts the maximal removed runs. kept is the rest, as bytes (a cut
    may fall inside a character), or, with ``digest``, its SHA-256.

    A null text counts as an empty one. Repeated rows, ids included, are
    separate documents and repeat each other. Null ids are kept. Other columns
    are ignored. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "byte-dedup")
    rows = keyed(docs)
    doubles = doubled(rows, scratch)
    spans = repeated_spans(rows, scratch, byte_sequences, byte_anchors(window, GRAM), window, BLOCK, doubles)
    joined = with_spans(rows, spans, doubles, scratch).select("doc_id", "text", "spans")
    return joined.mapInArrow(_removal(window, digest), RESULT + ("string" if digest else "binary"))


def op5_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


OP5_SQL = r"""
with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
starts as (select doc_id, unnest(range(1, greatest(octet_length(b) - 198, 1))) as s, b from d),
windows as materialized (select doc_id, s, hash(b[s:s + 199]) as h, md5_number(b[s:s + 199]) as h2 from starts),
again as (select h, h2 from windows group by h, h2 having count(*) > 1),
spans as (select doc_id, s, lag(s) over (partition by doc_id order by s) as before from windows join again using (h, h2)),
runs as (select doc_id, min(s) as s0, max(s) + 200 as s1 from (select doc_id, s, sum(case when s <= before + 200 then 0 else 1 end) over (partition by doc_id order by s) as r from spans) group by doc_id, r),
parts as (select doc_id, s0, s1, coalesce(lag(s1) over (partition by doc_id order by s0), 1) as k0 from runs),
gone as (select doc_id, count(*) as n_spans, sum(s1 - s0) as n_removed, max(s1) as last from runs group by doc_id),
kept as (select doc_id, string_agg(hex(b[k0:s0 - 1]), '' order by s0) as head from parts join d using (doc_id) group by doc_id)
select d.doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(case when n_spans is null then b else unhex(head || hex(b[last:octet_length(b)])) end) as kept_sha256
from d left join gone using (doc_id) left join kept using (doc_id)
"""
