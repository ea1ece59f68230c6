"""The queries of the corpus operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, language_id, near_dup, packing, quality_pu, quality_rules, sharding, suffix_dedup, toxicity
from .common import table


def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup(table(spark, sf_dir, "documents")))


def op5_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).selectExpr("id as doc_id", "class_id", "class_size")


def op7_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.concat_and_cut(table(spark, sf_dir, "documents"), packing.tokenizer_path()))


def op10_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_pu, op2_html_templates, op3_isolation_rules, op4_bwt_dedup, op5_string_kernel_toxicity,
        op6_dart_minhash, op7_hash_tree_shards, op8_template_leaks, op9_concat_and_cut, op10_kneser_ney_language,
    )
}

#: none of the ten is expressible in SQL within reason (models, hashes and tokenizers that DuckDB has not); see tests/llm
ORACLE_SQL: dict[str, str] = {}
