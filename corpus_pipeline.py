"""A corpus pipeline of five stages, each of them one operator of ``meridian.llm`` over all that the stage before kept.

language_id  keeps documents whose language the model finds with a posterior of 0.5 or more
toxicity     keeps documents that score under 0.5
exact_dedup  keeps one document of each group of equal texts
near_dedup   keeps one document of each component of near-duplicates (shingles of five words, similarity 0.8)
packing      packs what is left into sequences of 1024 tokens and returns the pieces

A null or empty text, or one without a letter, has no language and goes in the first stage; very long texts are read as a
whole. Fully repeated rows, and equal texts under different ids, leave one row in exact_dedup; of ties in length the smallest
doc_id stays. Rows of one id with different texts are one document to near_dedup: they stay or go together. Rows without an
id are judged like others but are never near-duplicates. Columns beyond those of documents are carried to the last stage,
whatever their names. An empty table gives no pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridian.llm import exact_dedup, langid, near_dedup, packing, toxicity
from meridian.llm.common import materialize, small_batches


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.keep_identified(docs, langid.train(docs))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs, exact_dedup.DigestIndex(spark))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.keep_one(docs, near_dedup.Forest())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, packing.Packing.public())


STAGES = [("language_id", language_id), ("toxicity", toxicity_filter), ("exact_dedup", exact), ("near_dedup", near), ("packing", pack)]

#: Trained models, linking by components and tokenization have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
