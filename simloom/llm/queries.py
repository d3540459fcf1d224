"""Thin queries over the driver's tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from simloom.llm import bpe, chunk_dedup, decontaminate, html_extract, license_scan, line_dedup, lm_score, minhash, quality, suffix_dedup

#: Rank file of the query; the operator takes any path.
RANKS = "byte_bpe_multi_50k.tiktoken"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_docs(spark, sf_dir), width=3, num=85, den=100)


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(_docs(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_docs(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judged(_docs(spark, sf_dir)).select(*columns)


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.chunk_dedup(_docs(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_docs(spark, sf_dir))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encoded(_docs(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_docs(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (
    op1_minhash_near_dedup, op2_lm_scores, op3_license_scan, op4_quality_rules, op5_chunk_dedup, op6_line_dedup,
    op7_html_extraction, op8_byte_bpe, op9_suffix_dedup, op10_decontamination, pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": minhash.oracle_sql(), "op3_license_scan": license_scan.oracle_sql(), "op4_quality_rules": quality.ORACLE,
        "op6_line_dedup": line_dedup.ORACLE, "op9_suffix_dedup": suffix_dedup.ORACLE, "op10_decontamination": decontaminate.ORACLE,
    }
