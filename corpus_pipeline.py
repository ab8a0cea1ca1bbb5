"""A training corpus from documents: five operators, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import Scratch
from lodestone.llm.decontamination import decontaminated
from lodestone.llm.language_id import UNKNOWN, identify_languages
from lodestone.llm.near_dedup import near_duplicates
from lodestone.llm.packing import pack_documents
from lodestone.llm.substring_dedup import drop_repeated_passages

#: A document whose mean probability of a language is less than so many times that of chance is rejected.
LEAST_OVER_CHANCE = 1.2

#: Language identification has no SQL form, so neither has the pipeline.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; null texts, those without letters, and those hardly above chance go."""
    found = identify_languages(docs, carry=docs.columns)
    languages = max(1, docs.where("lang is not null").select("lang").distinct().count())
    least = min(0.9, LEAST_OVER_CHANCE / languages)  # of one language all is certain
    kept = found.toDF(*(f"c{i}" for i in range(len(found.columns)))).where((F.col("c2") != UNKNOWN) & (F.col("c3") >= least))
    return kept.select(*(F.col(f"c{i + 4}").alias(n) for i, n in enumerate(docs.columns)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document of its least doc_id stays, the one of the least set and text hash.

    Documents that repeat an id with an unlike text are in groups of their own
    and stay; repeated rows are one document. Texts without words, and rows
    without an id, have no duplicates and stay all.
    """
    scratch = Scratch(spark, "kept")
    found = near_duplicates(docs)
    of = found.where("kept and group_id is not null").groupBy("group_id", "doc_id").agg(F.min(F.struct("n_shingles", "text_hash")).alias("x"), F.count(F.lit(1)).alias("rows"))
    ids = scratch.save(of.select("doc_id", F.col("x.text_hash").alias("text_hash"), (F.col("rows") > 1).alias("several")), "ids")
    inside = docs.toDF(*(f"x{i}" for i in range(len(docs.columns))))  # so that names can't clash
    key, text = (F.col(f"x{docs.columns.index(c)}") for c in ("doc_id", "text"))
    hashed = inside.withColumns({"doc_id": key.cast("long"), "text_hash": F.xxhash64(text)})
    once = hashed.join(ids, ["doc_id", "text_hash"])
    same = once.where("several").dropDuplicates(["doc_id", "text_hash"])  # a row may be there several times
    wordless = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = once.where("not several").select(inside.columns).union(same.select(inside.columns)).union(inside.where(key.isNull() | wordless))
    return kept.toDF(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that others, or they themselves, repeat; those left without a word go."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = drop_repeated_passages(docs, carry=others)
    found = found.toDF("doc_id", "n_words", "n_removed", "text", *(f"x{i}" for i in range(len(others)))).where("n_removed < n_words or n_removed = 0")
    columns = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text")} | {c: F.col(f"x{i}") for i, c in enumerate(others)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return found.select(*(columns[c].alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, each with its sequence and place."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them the rows are written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
