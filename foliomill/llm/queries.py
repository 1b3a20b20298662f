"""Registered queries of the training-data operators and of the pipeline, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from .ann import knn_join, knn_sql
from .licenses import license_scan, license_sql
from .lm import score_documents
from .mixing import curriculum, curriculum_sql
from .neardup import near_duplicates, near_duplicates_sql
from .packing import pack_documents
from .repetition import repetition_rule
from .sharding import shard_documents
from .substring import repeated_passages, repeated_passages_sql

from .toxicity import toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_docs(spark, sf_dir))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_docs(spark, sf_dir))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_docs(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_docs(spark, sf_dir))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_docs(spark, sf_dir))


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rule(_docs(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum(_docs(spark, sf_dir))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_docs(spark, sf_dir)).drop("rid")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring": op1_substring,
        "op2_ann": op2_ann,
        "op3_sharding": op3_sharding,
        "op4_licenses": op4_licenses,
        "op5_packing": op5_packing,
        "op6_lm": op6_lm,
        "op7_repetition": op7_repetition,
        "op8_mixing": op8_mixing,
        "op9_toxicity": op9_toxicity,
        "op10_neardup": op10_neardup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return pipeline | {
        "op1_substring": repeated_passages_sql(),
        "op2_ann": knn_sql(),
        "op4_licenses": license_sql(),
        "op8_mixing": curriculum_sql(),
        "op10_neardup": near_duplicates_sql(),
    }
