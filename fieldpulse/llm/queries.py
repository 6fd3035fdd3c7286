"""The registered queries of the pipeline operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldpulse.llm import bpe, collocations, fingerprints, hadamard, hash_forest, html_blocks, jaccard, packing, pii, quality, sharding, suffixes, token_files
from fieldpulse.llm.common import table


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(table(spark, sf_dir, "documents")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, sf_dir, "documents"))


def op4_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op5_scaled_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op11_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.search(table(spark, sf_dir, "embeddings"), every=20)


def op12_hadamard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hadamard.cluster(table(spark, sf_dir, "embeddings"))


def op13_stripe_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_personal_data, op2_jaccard_join, op3_suffix_dedup, op4_hash_tree_sharding, op5_scaled_fingerprints, op9_quality_rules,
                                   op6_html_blocks, op7_token_files, op8_best_fit_packing, op10_byte_bpe, op11_hash_forest, op12_hadamard_clusters, op13_stripe_collocations)}
ORACLE: dict[str, str] = {"op12_hadamard_clusters": hadamard.SQL, "op13_stripe_collocations": collocations.SQL}
