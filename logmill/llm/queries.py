"""The thin queries of this subpackage, as __spark_entry__.py registers them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import licenses, ngram_join, quality, secret_scan, substring_dedup
from .common import small_batches, table, tokenizer_path

BYTE_BPE = "byte_bpe_50k.json"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import round_trip

    return round_trip(spark, table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge_documents

    return judge_documents(table(spark, sf_dir, "documents")).drop("cleaned")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import duplicated_words

    return duplicated_words(table(spark, sf_dir, "documents")).drop("kept")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similarity_components

    return similarity_components(table(spark, sf_dir, "documents"))


def _application(f: Callable) -> Callable:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: _application(f) for f in (op1_license_scan, op2_decontamination, op3_packing, op4_html_extraction, op5_token_files, op6_secret_scan, op7_quality_rules, op8_token_counts, op9_substring_dedup, op10_ngram_join)}
#: What SQL can express and answers in time on whole tables. The others rest on a tokenizer's file (3, 5, 8), a longest common
#: subsequence (2) or a parser (4); their tests have plain versions.
ORACLES: dict[str, str] = {
    "op1_license_scan": licenses.oracle(),
    "op6_secret_scan": secret_scan.oracle(),
    "op7_quality_rules": quality.oracle(),
    "op9_substring_dedup": substring_dedup.oracle(),
    "op10_ngram_join": ngram_join.oracle(),
}
