"""Postings that are kept: which texts hold which three-letter pieces, so that a search reads the buckets of its own pieces.

A folder has ``texts`` (id, text without accents and case) and ``pieces`` (piece, id) in folders by a hash of the piece, in order of the piece. A search
looks up the pieces of its query, keeps the texts that hold all of them, and compares these with the query itself; no
text is cut anew and none is shuffled. A query shorter than a piece is held against all texts.

Cases: null and empty texts are never found; an empty query finds nothing; repeated identifiers are found once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import scratch
from weftgraph.functions.text import no_accents, without_accents

PIECE, BUCKETS = 3, 64
#: Candidates whose identifiers are broadcast to the texts; more are joined.
MOST_BROADCAST = 200_000


def _bucket(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")


def cut(text: str) -> list[str]:
    """The distinct pieces of a text, in order."""
    return sorted({text[i : i + PIECE] for i in range(len(text) - PIECE + 1)})


class Postings:
    """The postings of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, rows: DataFrame) -> Postings:
        """Writes the postings of (id, text). A piece that most texts have is written by several tasks, each with a range of identifiers."""
        texts = rows.select("id", no_accents(F.col("text")).alias("text")).where(F.length("text") > 0)
        texts.write.parquet(f"{self.folder}/texts")
        stored = self.spark.read.parquet(f"{self.folder}/texts")
        found = F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{PIECE}}}))"), F.lit(1))
        pieces = stored.select("id", F.explode(F.array_distinct(found)).alias("piece")).distinct().withColumn("_b", _bucket(F.col("piece")))
        ranged = pieces.repartitionByRange("_b", "piece", "id").sortWithinPartitions("_b", "piece", "id")
        ranged.write.partitionBy("_b").parquet(f"{self.folder}/pieces")
        return self

    def holding(self, pieces: list[str]) -> DataFrame:
        """(id) of the texts that have all of some pieces; only the buckets of these are read."""
        asked = self.spark.range(1).select(F.explode(F.array(*map(F.lit, pieces))).alias("piece"))
        buckets = [r.b for r in asked.select(_bucket(F.col("piece")).alias("b")).distinct().collect()]  # one for each piece at most
        rows = self.spark.read.parquet(f"{self.folder}/pieces").where(F.col("_b").isin(buckets) & F.col("piece").isin(pieces))
        return rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(pieces)).select("id")

    def search(self, query: str) -> DataFrame:
        """(id) of the texts that hold the query, accents and case aside."""
        wanted = without_accents(query) or ""
        texts = self.spark.read.parquet(f"{self.folder}/texts")
        if not wanted:
            return texts.select("id").limit(0)
        if len(wanted) >= PIECE:
            candidates, n = scratch.counted(self.holding(cut(wanted)), "candidates")
            texts = texts.join(F.broadcast(candidates) if n <= MOST_BROADCAST else candidates, "id", "left_semi")
        return texts.where(F.contains("text", F.lit(wanted))).select("id").distinct()
