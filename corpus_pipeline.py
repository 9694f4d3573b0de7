"""A training-data pipeline over ``documents``; each stage works on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``documents``; the last one adds
what the mix takes of each document. Empty tables and null texts pass through every stage as
its operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import scratch
from weftgraph.llm import decontaminate, jaccard, language, mixing, secrets, simhash
from weftgraph.llm.textcols import fresh

#: A document of at least so many characters is rejected if its best language holds a smaller share of its n-grams.
LEAST_LANGUAGE_SHARE, LEAST_JUDGED_CHARS = 0.15, 200
#: Near-duplicates: words in a shingle, fingerprint bits that may differ, and the Jaccard similarity from which texts go that fingerprints leave.
SHINGLE, THRESHOLD, LEAST_SIMILARITY = 5, 4, 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language: without a letter, or long and with hardly an n-gram of any; corrects ``lang``."""
    filters = language.train(docs.where(F.col("text").isNotNull()))
    lang, score = fresh(docs.columns, "_lang"), fresh(docs.columns, "_score")
    found = language.identify(docs, filters, lang_as=lang, score_as=score)
    foreign = (F.length("text") >= LEAST_JUDGED_CHARS) & (F.col(score) < LEAST_LANGUAGE_SHARE)
    kept = found.where((F.col(lang) != language.UNDECIDED) & ~foreign)
    return kept.withColumn("lang", F.col(lang)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of close fingerprints, and then of each group of similar texts among the rest, the smallest identifier stays."""
    return simhash.keep_first(docs, shingle=SHINGLE, threshold=THRESHOLD, then=lambda rows: jaccard.later_rows(rows, SHINGLE, LEAST_SIMILARITY))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or most of one."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are masked and ``n_chars`` follows the new text."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as it is, with its size, its source's size and target, and the words that the mix takes of it.

    The mix is worked out without texts; these move once, to meet its result.
    """
    row = fresh(docs.columns, "_row")
    sized = mixing.with_sizes(docs, keep_text=True).withColumn(row, F.monotonically_increasing_id())
    sized = scratch.written(sized, "sizes", "zstd")
    mixed = mixing.mix(sized.select(row, "doc_id", "source", "size"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain = sized.drop("source_size", "target", "taken")
    return plain.join(mixed.select(row, "source_size", "target", "taken"), row).drop(row)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("secret scans", redact_secrets),
    ("source mixing", mix_sources),
]

#: Most stages are beyond SQL (trained filters, fingerprints); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.written(docs, name.replace(" ", "-").lower())
    return docs
