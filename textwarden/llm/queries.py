"""One registered query per corpus operator, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontaminate, exact_dedup, host_quality, licenses, ngram_join, packing, periodic_runs, shards, tokenids, toxicity, url_rules, warc
from .common import prepare, read


def op1_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.token_digest(read(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"), 4, Fraction(85, 100)).drop("class_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality.judge(read(spark, sf_dir, "documents"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(read(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digest(periodic_runs.detect_runs(periodic_runs.planted(read(spark, sf_dir, "documents"))))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_balanced_shards,
        op2_license_scan,
        op3_token_files,
        op4_ngram_jaccard_join,
        op5_toxicity,
        op6_benchmark_decontamination,
        op7_url_filter,
        op8_best_fit_packing,
        op9_host_quality,
        op10_warc_revisits,
        op11_periodic_runs,
        op12_exact_dedup,
        op13_collocations,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: f(prepare(spark), sf_dir)

    return {name: bound(f) for name, f in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_benchmark_decontamination": decontaminate.ORACLE,
        "op7_url_filter": url_rules.ORACLE,
        "op9_host_quality": host_quality.ORACLE,
        "op10_warc_revisits": warc.ORACLE,
        "op12_exact_dedup": exact_dedup.ORACLE,
        "op13_collocations": collocations.ORACLE,
    }
