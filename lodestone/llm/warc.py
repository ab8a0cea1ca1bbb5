"""WARC archives of pages, written and read back by Spark, with verified record boundaries.

Writing: a record is one row of Spark's text writer, whose row separator is the
empty lines that end a record. Of equal payloads one record is the response and
the others are revisits of it, without the payload.

Reading: archives are split at the magic line ``WARC/1.0``, wherever it stands.
1. Tasks take splits of any size, sum the bytes of what they read, and emit for
   each magic a candidate: its place and, by its Content-Length, its successor's.
2. Sums of the splits before give places in the file.
3. Pointer jumping from each file's start marks the candidates that a chain of
   successors reaches. A magic inside a payload is on no such chain.
4. A reached record's payload is its segment, or, if it holds magics, the
   segments up to its successor, joined in a second scan.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm._common import Scratch

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
#: Records in a file at most, and rows of revisits that are broadcast at most.
FILE_RECORDS, BROADCAST_ROWS = 20_000, 300_000
DATE = "1970-01-01T00:00:00Z"
PAGE = "urn:page:"

CANDIDATES = (
    "path string, block long, at long, size long, header int, length long, page string, type string, refers string, "
    "claimed string, claimed_bytes long, digest string"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, four signs from each five hexadecimal ones."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, scratch: Scratch, date: str = DATE) -> None:
    """Writes a record per row of pages (page_id, url, html) to WARC files under ``path``."""
    row = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    full = row.withColumn("digest", base32_sha1(F.col("html"))).withColumn("bytes", F.octet_length("html"))
    meta = scratch.save(full.select("page_id", "digest"), "digests")
    classes = scratch.save(meta.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("latest")).where("n > 1 and latest is not null").select("digest", "latest"), "classes")
    revisits = meta.join(classes, "digest").where("page_id is null or page_id < latest").select(_key().alias("k"), "latest").distinct()
    revisits = scratch.save(revisits, "revisits")
    few = revisits.count() <= BROADCAST_ROWS
    marked = full.withColumn("k", _key()).join(F.broadcast(revisits) if few else revisits, "k", "left")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    page = lambda x: F.concat(F.lit(f"<{PAGE}"), F.coalesce(F.col(x).cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("latest").isNotNull()
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", page("page_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), line("WARC-Refers-To", page("latest")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("html")),
    )
    marked.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _key() -> Column:
    return F.xxhash64(F.col("page_id"), F.col("digest"))


def header_of(segment: bytes) -> tuple[int, dict[str, str]] | None:
    """Length of the header lines after a magic, with the empty line, and the fields; None if they can't be one."""
    end = segment.find(END.encode())
    if end < 0:
        return None
    fields = {}
    for text in segment[:end].split(b"\r\n"):
        name, colon, value = text.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isascii() or not fields.get("content-length", "").isdigit() or len(fields["content-length"]) > 15:
        return None
    return end + len(END), fields


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(path, block, place of the segment in the block, segment) in reading order."""
    here, at = None, 0
    for batch in batches:
        values, paths, blocks = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for i, (path, block) in enumerate(zip(paths, blocks, strict=True)):
            if here != (path, block):
                here, at = (path, block), 0
            value = values[i].as_py()
            yield path, block, at, value
            at += len(value) + len(MAGIC)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CANDIDATES.split(", ")]
    rows: list[tuple] = []
    for path, block, at, s in _segments(batches):
        found = header_of(s)
        if found:
            header, f = found
            length = int(f["content-length"])
            own = base64.b32encode(hashlib.sha1(s[header : header + length]).digest()).decode() if header + length <= len(s) else None
            size = f.get("warc-payload-length", "")
            rows.append((path, block, at, len(s), header, length, f.get("warc-record-id"), f.get("warc-type"), f.get("warc-refers-to"), f.get("warc-payload-digest"), int(size) if size.isdigit() else None, own))
        else:
            rows.append((path, block, at, len(s), None, *[None] * 7))
        if len(rows) >= 10_000:
            yield _table(rows, names)
            rows = []
    if rows:
        yield _table(rows, names)


_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string()]


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=names)


def _raw(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
    return lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def reachable(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(f, off) that a chain of links (f, off, next) reaches from each file's offset 0, by pointer jumping.

    Round i knows what is within 2**i - 1 steps, and each link then spans 2**i.
    """
    known = scratch.save(links.where("off = 0").select("f", "off"), "reached")
    jump = scratch.save(links.select("f", "off", "next"), "jump")
    count = known.count()
    while True:
        to = known.join(jump, ["f", "off"]).select("f", F.col("next").alias("off"))
        grown = scratch.save(known.union(to).distinct(), "reached")
        further = jump.select("f", F.col("off").alias("mid"), F.col("next").alias("after"))
        longer = jump.withColumnRenamed("next", "mid").join(further, ["f", "mid"]).select("f", "off", F.col("after").alias("next"))
        longer = scratch.save(longer, "jump")
        scratch.drop(known, jump)
        known, jump, before, count = grown, longer, count, grown.count()
        if count == before:
            return known


def read_archives(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """One row per verified record: page, type, refers (page of the response), payload_bytes, payload_digest.

    Of revisits, size and digest are those of the payload that they stand for.
    """
    found = scratch.save(_raw(spark, path).mapInArrow(_candidates, CANDIDATES).withColumn("f", F.xxhash64("path")), "segments")
    before = Window.partitionBy("f").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = found.groupBy("f", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes")).select("f", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    base = scratch.save(base, "bases")
    start = F.col("base") + F.col("at") - len(MAGIC)  # a segment begins after its magic
    placed = found.join(F.broadcast(base) if base.count() <= BROADCAST_ROWS else base, ["f", "block"]).withColumn("off", start)
    nxt = F.col("off") + len(MAGIC) + F.col("header") + F.col("length") + len(END)
    placed = scratch.save(placed.withColumn("next", nxt), "places")
    real = reachable(placed.where("header is not null and off >= 0"), scratch)
    records = scratch.save(placed.where("header is not null").join(real, ["f", "off"]), "records")

    whole = records.where("digest is not null").select("page", "type", "refers", "claimed", "claimed_bytes", "length", "digest")
    long = records.where("digest is null")
    if not long.isEmpty():
        whole = whole.union(_joined(spark, path, placed, long, scratch))
    revisit = F.col("type") == "revisit"
    return whole.select(
        "page", "type", "refers",
        F.when(revisit, F.col("claimed_bytes")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("claimed", "^sha1:", "")).otherwise(F.col("digest")).alias("payload_digest"),
    )


def _joined(spark: SparkSession, path: str, placed: DataFrame, records: DataFrame, scratch: Scratch) -> DataFrame:
    """Records whose payload holds magics: their segments are read again and joined."""
    spans = records.select("f", F.col("off").alias("record"), F.col("next").alias("until"))
    inner = placed.select("f", "path", "block", "at", "off").join(spans, "f").where("off >= record and off < until")
    wanted = scratch.save(inner.select("path", "block", "at", "record", "off"), "inner")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for p, block, at, s in _segments(batches):
            rows.append((p, block, at, s))
            size += len(s)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "block", "at", "s"])
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "block", "at", "s"])

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
    parts = _raw(spark, path).mapInArrow(again, "path string, block long, at long, s binary")
    small = wanted.count() <= BROADCAST_ROWS
    parts = parts.join(F.broadcast(wanted) if small else wanted, ["path", "block", "at"])
    put = parts.groupBy("path", "record").agg(F.array_sort(F.collect_list(F.struct("off", "s"))).alias("x"))
    text = F.expr(f"aggregate(x, cast('' as binary), (a, e) -> concat(a, cast('{MAGIC[:-2]}\\r\\n' as binary), e.s))")
    data = put.select(F.xxhash64("path").alias("f"), F.col("record").alias("off"), text.alias("t"))
    body = records.join(data, ["f", "off"]).withColumn("body", F.expr(f"substring(t, {len(MAGIC)} + header + 1, cast(length as int))"))
    return body.select("page", "type", "refers", "claimed", "claimed_bytes", "length", base32_sha1(F.col("body")).alias("digest"))


def archived(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as WARC files, reads them back, and returns a row per record:
    page_id, payload_bytes, payload_digest, record_type, refers_to.

    The payload is the html in UTF-8. Of equal payloads, that of the largest
    page_id is a response and those of smaller ones are revisits of it.

    A null html is an empty payload. Repeated rows give a record each; those of
    the largest page_id are all responses. A null page_id is smaller than all,
    and stays a response where no row with an id has its payload. A null url is
    empty. Other columns are ignored. An empty table gives no rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    path = f"{scratch.root}/archives"
    write_archives(pages, path, scratch)
    page = lambda c: F.regexp_extract(c, f"^<{PAGE}(-?[0-9]+)>$", 1).try_cast("long")
    return read_archives(spark, path, scratch).select(page("page").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers").alias("refers_to"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP8_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h) as n, sha1(h) as x, max(page_id) over (partition by h) as latest from p)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((cast('0x' || substr(x, 1 + 5 * (i // 4), 5) as integer) >> (15 - 5 * (i % 4))) & 31), 1)), '') as payload_digest,
  case when page_id = latest then 'response' else 'revisit' end as record_type,
  case when page_id < latest then latest end as refers_to
from d
"""
