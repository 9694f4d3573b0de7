"""The registered queries of this subpackage; each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import alignment, decontaminate, digest, language, lmscore, minhash, mixing, search, secrets, simhash, suffixes, warc, webtext

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.report(documents(spark, sf_dir))


def op2_exact_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.report(documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(documents(spark, sf_dir))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(documents(spark, sf_dir))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(documents(spark, sf_dir))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(documents(spark, sf_dir))


def op13_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    found = (
        op1_lm_score, op2_exact_fingerprint, op3_secret_scan, op4_warc_bundles, op5_suffix_array_dedup, op6_simhash_near_dedup, op7_source_mix, op8_language_id,
        op9_benchmark_decontamination, op10_html_main_text, op11_ranked_search, op12_tokenizer_alignment, op13_bbit_minhash,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_bundles": warc.SQL, "op7_source_mix": mixing.SQL, "op11_ranked_search": search.SQL}
