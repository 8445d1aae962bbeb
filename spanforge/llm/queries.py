"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import chat_format, decontaminate, license_scan, packing, pii, quality_lm, simhash, substring_dedup, token_count, weighted_minhash
from spanforge.llm.common import documents


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.op1(documents(spark, sf_dir))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op2(documents(spark, sf_dir), pii.session_key(spark))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op3(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op4(documents(spark, sf_dir))


def op5_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.op5(documents(spark, sf_dir))


def op6_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op7(documents(spark, sf_dir))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.collapse_and_render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.op9(documents(spark, sf_dir))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op10(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = (op1_license_scan, op2_pii_surrogates, op3_best_fit_packing, op4_substring_dedup, op5_weighted_minhash, op6_quality_lm, op7_simhash, op8_chat_format, op9_token_count, op10_decontaminate)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": substring_dedup.ORACLE_SQL, "op8_chat_format": chat_format.ORACLE_SQL, "op10_decontaminate": decontaminate.ORACLE_SQL}
