"""The registered queries of this folder: each applies one operator to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvergrain.llm import (
    adaptive_scan,
    compression_quality,
    hyperplane_tree,
    language_id,
    mixing,
    near_duplicates,
    packing,
    prefix_counts,
    repetition,
    shared_passages,
    sharding,
    spelling_variants,
    token_files,
)
from silvergrain.llm.common import table
from silvergrain.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder)
    return token_files.read_documents(spark, folder)


@query
def op2_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


@query
def op3_suffix_array_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


@query
def op4_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op5_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op6_extendible_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


ORACLES["op6_extendible_hash_shards"] = sharding.ORACLE


@query
def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = compression_quality.train(docs, table(spark, sf_dir, "labels"))
    scores = compression_quality.quality_scores(docs, model)
    return scores.select("doc_id", compression_quality.held_out().alias("held_out"), "score", "predicted")


@query
def op9_marginal_unigram_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.languages(docs, language_id.train(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query
def op10_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_scan.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op11_gnat_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hyperplane_tree.whole_components(table(spark, sf_dir, "embeddings"))
    return hyperplane_tree.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


ORACLES["op11_gnat_hard_negatives"] = hyperplane_tree.ORACLE


@query
def op12_deep_shallow_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages.digests(shared_passages.without_repeats(table(spark, sf_dir, "documents")))



@query
def op13_bloom_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(spelling_variants.occurrences(table(spark, sf_dir, "documents")))


ORACLES["op13_bloom_spelling_variants"] = spelling_variants.ORACLE
