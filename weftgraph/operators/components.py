"""Connected components of a large graph, by alternating star contraction.

Each round first links every node's larger neighbours to its smallest neighbour (large star), then its
smaller neighbours likewise (small star). The edge set shrinks to one star for each component in
a number of rounds that grows with the logarithm of the longest path. Rounds are written to shared
storage, so lineage stays short and lost executors cost one round. A hub's edges are reduced by
partial aggregates; no group is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import scratch

MOST_ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    linked = down.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return linked.unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Loops and repeated edges are ignored, edges with a null end too; no edges give no rows.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = scratch.written(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(MOST_ROUNDS):
        # Stars: every larger end has one smaller end, which is no one's larger end.
        facts = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if facts.n == 0 or tuple(facts) == state:
            break
        state = tuple(facts)
        now = scratch.written(_small(_large(now)), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
