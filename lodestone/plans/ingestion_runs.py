"""Queries on vectors made of chunks and on files that pass through the stages of ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import embedding, vector
from lodestone.plans.model_sql import with_tables
from lodestone.plans.registry import query
from lodestone.sources.scratch import shared_folder
from lodestone.sources.tables import Model
from lodestone.streaming import staged

# ---------------------------------------------------------------- vectors

#: What the search over embedded chunks looks for; how many attempts at a chunk's batch fail.
ASKED = "the license of this and that"
_FAILS = "case when regexp_extract(document_id, '[0-9]+', 0)::bigint % 17 = 0 and chunk_index // 10 = 0 then 3 when regexp_extract(document_id, '[0-9]+', 0)::bigint % 5 = 0 then chunk_index % 3 else 0 end"
_CODES = "list_transform(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda t: ('0x' || left(md5(t), 8))::bigint), lambda c: case when c // 64 % 2 = 0 then c % 64 + 1 else -(c % 64) - 1 end)"
_SUMS = "list_transform(range(1, 65), lambda d: (len(list_filter({0}, lambda c: c = d)) - len(list_filter({0}, lambda c: c = -d)))::double)"
_VECTORS = f""", outcome as (select document_id, chunk_index // 10 as batch, count(*) as chunks, cast(least(max({_FAILS}), 3) as integer) as fails from pieces group by all),
failed as (select document_id, count(*) as failed_batches, min(batch) as first from outcome where fails >= 3 group by 1),
coded as materialized (select document_id, chunk_index, {_CODES.format('content')} as codes from pieces where document_id not in (select document_id from failed)),
summed as materialized (select document_id, chunk_index, {_SUMS.format('codes')} as v from coded),
asked as (select {_SUMS.format('codes')} as q from (select {_CODES.format(f"'{ASKED}'")} as codes))"""


def _failing() -> F.Column:
    i = F.regexp_extract("document_id", "[0-9]+", 0).cast("long")
    return F.when((i % 17 == 0) & (F.floor(F.col("chunk_index") / 10) == 0), 3).when(i % 5 == 0, F.col("chunk_index") % 3).otherwise(0)


def _embedded(m: Model) -> tuple[DataFrame, DataFrame]:
    return embedding.embedded(m.chunks(), _failing(), batch=10)


@query("embedding_batches", with_tables("pieces", sql=_VECTORS + " select document_id, cast(batch as integer) as batch, chunks, cast(least(fails + 1, 3) as integer) as attempts, cast(2 ** (least(fails + 1, 3) - 1) - 1 as bigint) as wait_seconds, fails >= 3 as failed from outcome"))
def _(m):
    return embedding.batch_outcomes(m.chunks(), _failing(), batch=10)


@query("embedding_failures", with_tables("pieces", sql=_VECTORS + " select document_id, failed_batches, 'Failed to embed chunks: batch ' || first || ' after 3 attempts' as error from failed"))
def _(m):
    return _embedded(m)[1]


@query("embedded_chunks", with_tables("pieces", sql=_VECTORS + """ select document_id, chunk_index, array_to_string(list_transform(v, lambda x: case when x > 0 then '+' when x < 0 then '-' else '0' end), '') as signs,
cast(len(list_filter(v, lambda x: abs(x) = list_max(list_transform(v, lambda y: abs(y))))) as integer) as largest from summed"""))
def _(m):
    size = F.transform("embedding", F.abs)
    sign = F.transform("embedding", lambda x: F.when(x > 0, "+").when(x < 0, "-").otherwise("0"))
    return _embedded(m)[0].select("document_id", "chunk_index", F.array_join(sign, "").alias("signs"), F.size(F.filter(size, lambda x: x == F.array_max(size))).alias("largest"))


@query("embedded_search", with_tables("pieces", sql=_VECTORS + """, s as (select document_id || ':' || chunk_index as chunk_id, list_cosine_similarity(v, q) as similarity from summed, asked where list_dot_product(v, v) > 0)
select chunk_id, round(similarity, 5) as similarity from s order by round(s.similarity, 5) desc, chunk_id limit 10"""))
def _(m):
    v = _embedded(m)[0].select(F.concat("document_id", F.lit(":"), "chunk_index").alias("chunk_id"), "document_id", "embedding")
    q = embedding.query_vector(m.spark, ASKED)
    near = v.select("chunk_id", F.round(vector.cosine(F.col("embedding"), q), 5).alias("similarity"))
    return near.where("similarity is not null").orderBy(F.desc("similarity"), "chunk_id").limit(10)


# ---------------------------------------------------------------- stages

_FAULTS = ["403: exportSizeLimitExceeded", "timeout"]


def _files(m: Model) -> DataFrame:
    """Pending files, a row a document; downloads of some report a fault, others have no text."""
    d, i = m.read("documents"), F.col("doc_id")
    fault = F.when(i % 11 == 0, _FAULTS[0]).when(i % 13 == 0, _FAULTS[1])
    return d.select(i, F.when(i % 7 != 0, F.col("text")).alias("text"), (F.col("n_chars") * 1000).alias("size_bytes"), fault.alias("fault"), F.lit("pending").alias("stage"), F.lit(None).cast("string").alias("error"))


def _count(spark: SparkSession, path: str) -> int:
    """How many files a folder of Parquet has."""
    return len(spark.read.parquet(path).inputFiles())


def _ran(m: Model) -> staged.Pipeline:
    """The stages over all files, which come as a stream of four batches."""
    root = shared_folder(m.spark, "ingestion")
    tasks = m.spark.sparkContext.defaultParallelism  # a file each, so that a batch's stages have as many
    _files(m).repartition(4 * tasks, "doc_id").write.parquet(f"{root}/incoming")
    some = max(1, -(-_count(m.spark, f"{root}/incoming") // 4))
    stream = m.spark.readStream.schema(staged.FILES).option("maxFilesPerTrigger", some).parquet(f"{root}/incoming")
    failing = F.when(F.col("document_id").cast("long") % 17 == 0, 3)
    pipeline = staged.ingestion(m.spark, f"{root}/stages", most_mb=10, failing=failing)
    pipeline.run(stream)
    return pipeline


_STATES = f"""with f as (select doc_id, case when doc_id % 7 <> 0 then text end as text, n_chars * 1000 as size, case when doc_id % 11 = 0 then '{_FAULTS[0]}' when doc_id % 13 = 0 then '{_FAULTS[1]}' end as fault from documents),
x as (select doc_id, case when size > 10 * 1048576 then 'skipped' when doc_id % 11 = 0 then 'skipped' when fault is not null then 'failed' when trim(coalesce(text, '')) = '' then 'failed' when doc_id % 17 = 0 then 'embed_failed' else 'kg_done' end as stage,
  case when size > 10 * 1048576 then 'larger than 10 MB' when fault is not null then fault when trim(coalesce(text, '')) = '' then 'no text' when doc_id % 17 = 0 then 'Failed to embed chunks: batch 0 after 3 attempts' end as error from f)"""


@query("staged_ingestion", _STATES + " select * from x")
def _(m):
    return _ran(m).states(staged.FILES).select("doc_id", "stage", "error")


@query("staged_outputs", _STATES + """ select stage, count(*) as files, cast(sum(case when stage in ('embed_failed', 'kg_done') then 1 else 0 end) as bigint) as with_chunks, cast(sum(case when stage = 'kg_done' then 1 else 0 end) as bigint) as with_vectors from x group by stage""")
def _(m):
    p = _ran(m)
    of = lambda name: p.table(name).select(F.col("document_id").cast("long").alias("doc_id")).distinct().withColumn(name, F.lit(1))
    rows = p.states(staged.FILES).select("doc_id", "stage").join(of("chunks"), "doc_id", "left").join(of("vectors"), "doc_id", "left")
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("files"), F.count("chunks").alias("with_chunks"), F.count("vectors").alias("with_vectors"))
