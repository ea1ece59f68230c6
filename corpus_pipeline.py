"""A corpus pipeline of five stages: toxicity, near-duplicates, repeated substrings, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradus.llm import decontaminate, near_dup, packing, suffix_dedup, toxicity
from gradus.llm.common import discard, saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dup.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur elsewhere too are cut from the texts; n_chars is counted anew."""
    from pyspark.sql import functions as F

    out = suffix_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in windows of 2048 tokens."""
    return packing.digest(packing.concat_and_cut(docs, packing.tokenizer_path()))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("suffix_dedup", cut_repeats), ("decontamination", drop_leaks), ("packing", pack)]

#: models and tokenizers are not expressible in SQL; tests/llm holds the pipeline against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)  # what the stage read; the input table is none of ours
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
