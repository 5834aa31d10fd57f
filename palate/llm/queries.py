"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palate.llm import divergence, embeddings, licences, packing, paragraphs, pieces, pii, quality, runs, sharding, simhash, toxicity
from palate.llm.common import table


def op1_sign_hash_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4, seed=42)


def op3_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_minhash_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.substring_dedup(table(spark, sf_dir, "documents"))


def op6_jump_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


def op7_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op8_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.search(table(spark, sf_dir, "embeddings"), every=50, nearest=5)


def op9_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_and_check(table(spark, sf_dir, "documents"))


def op10_suffix_automaton_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licenses(table(spark, sf_dir, "documents"))


def op11_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_synchronised_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), least=24, tails=True)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=10, top=10)


QUERIES = {
    f.__name__: f
    for f in (
        op1_sign_hash_embedding_dedup, op2_simhash_bk_trees, op3_counterfactual_toxicity, op4_cutting_stock_packing, op5_minhash_paragraphs,
        op6_jump_hash_sharding, op7_deobfuscated_pii, op8_inverted_multi_index, op9_sampled_pieces, op10_suffix_automaton_licenses,
        op11_compression_quality, op12_synchronised_runs, op13_source_divergence,
    )
}

ORACLE_SQL = {
    "op1_sign_hash_embedding_dedup": embeddings.ORACLE_SQL, "op6_jump_hash_sharding": sharding.ORACLE_SQL, "op13_source_divergence": divergence.ORACLE_SQL,
}
