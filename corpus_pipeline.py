"""Training-data pipeline over ``documents``: language, quality, near-duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again before the next one. All but the
last return the columns of ``documents``; their decisions show in the rows. Empty tables give empty tables of the same columns;
rows without text are rejected by the first stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from silvergrain.llm import compression_quality, language_id, mixing, near_duplicates, packing
from silvergrain.session import cut_lineage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or without a clear language."""
    return language_id.accepted(docs, language_id.train(docs))


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality score rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return compression_quality.accepted(docs, compression_quality.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    return near_duplicates.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that each source comes near its share."""
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in windows; a document that the mix repeats is packed as often."""
    return packing.pack(docs).drop("ids")


STAGES = [
    ("language", identify_language),
    ("quality", judge_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_windows),
]

#: Classifiers, MinHash and a tokenizer are not SQL; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
