"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.covertree import top_k
from gridloom.llm.decontaminate import contaminated
from gridloom.llm.html_text import extract_text
from gridloom.llm.idfile import id_file_round_trip
from gridloom.llm.linededup import dedup_lines
from gridloom.llm.packing import pack_documents
from gridloom.llm.quality import score_quality
from gridloom.llm.sharding import shard_documents
from gridloom.llm.simhash import near_duplicates
from gridloom.llm.suffix import repeated_passages
from gridloom.llm.tokens import public_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_token_id_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_file_round_trip(_table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_quality_classifier,
        op3_token_id_file,
        op4_html_extraction,
        op5_suffix_array_dedup,
        op6_simhash_near_dedup,
        op7_exact_top_k,
        op8_benchmark_decontamination,
        op9_rendezvous_sharding,
        op10_line_dedup,
    )
}

#: Only what SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {}
