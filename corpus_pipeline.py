"""Training-data pipeline over ``documents``: five stages, each written and reread."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from needscope.llm import decontaminate, language, line_dedup, mixing, ngram_join
from needscope.sources.readers import scan
from needscope.sources.scratch import scratch_dir, settle


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier claims; it learns from its own input."""
    return language.in_known_language(docs, language.fit_languages(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; n_chars follows the text. Near copies stay whole for the next stage."""
    return line_dedup.drop_recurring_lines(docs, leave_similar=80).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, ties by the hash of the text.

    Rows go by id and text, so other texts under a removed id stay. Null ids
    come last. Of repeated rows one stays. Documents without words all stay.
    """
    found = settle(ngram_join.jaccard_components(docs).where("n_shingles > 0").select("doc_id", "text_hash", "cluster"), "near-duplicates")
    row = ["doc_id", "text_hash"]
    first = found.groupBy("cluster").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), *row)).alias("kept"))
    kept = settle(first.select(*[F.col(f"kept.{x}").alias(x) for x in row]), "kept")
    rows = found.groupBy(*row).agg(F.count("*").alias("n"))
    gone = settle(rows.join(kept, _same(rows, kept), "left_anti").select(*row), "gone")
    again = settle(rows.where("n > 1").join(kept, _same(rows, kept), "left_semi").select(*row), "repeated")

    left = docs.withColumn("text_hash", F.xxhash64("text"))
    left = left.join(gone, _same(left, gone), "left_anti")
    repeated = left.join(again, _same(left, again), "left_semi").dropDuplicates(row)
    return left.join(again, _same(left, again), "left_anti").unionByName(repeated).select(*docs.columns)


def _same(one: DataFrame, other: DataFrame) -> Column:
    return one["doc_id"].eqNullSafe(other["doc_id"]) & (one["text_hash"] == other["text_hash"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.without_items(docs, scan(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken of each."""
    return mixing.mix_sources(docs, carry=tuple(docs.columns)).where(F.col("taken") > 0)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix),
]
# language, line and n-gram stages need trained models, hashing and components
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/pipeline-{name}-{uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
