"""One query for each operator of the training-data subpackage, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .common import table
from .decontaminate import decontaminate
from .langid import language_id
from .licenses import license_scan
from .mixture import taken
from .neardup import near_duplicates
from .packing import best_fit_packing
from .periodic import periodic_runs, run_digests, with_loops
from .quality import quality_rules
from .suffixdedup import suffix_dedup
from .tokenfile import token_files
from .toxicity import toxicity
from .urls import url_filter
from .whitening import whiten


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_loops(table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_best_fit_packing, op3_quality_rules, op4_url_filters, op5_suffix_array_dedup, op6_token_files, op7_decontamination, op8_license_scan, op9_minhash_near_dedup, op10_toxicity, op11_source_mix, op12_embedding_whitening, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    """The others rest on learned models or tokenizers; their tests hold them to plain versions."""
    return {
        "op4_url_filters": sql.url_filter(),
        "op5_suffix_array_dedup": sql.suffix_dedup(),
        "op7_decontamination": sql.decontamination(),
        "op8_license_scan": sql.license_scan(),
        "op9_minhash_near_dedup": sql.near_duplicates(),
        "op11_source_mix": sql.source_mix(),
        "op13_periodic_runs": sql.periodic_runs(),
    }
