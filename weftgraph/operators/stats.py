"""Counts, roots, and structural findings of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Containment follows these; order in which roots are shown, and how many.
CONTAINMENT = ("hasPart", "hasChild")
ROOT_RANK = ("Course", "TeachingLearningMaterial", "StandardsFramework", "LessonGrouping")
MOST_ROOTS = 50


def primary_label(labels: str = "labels") -> Column:
    return F.coalesce(F.get(F.col(labels), 0), F.lit("(unlabeled)"))


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(primary_label().alias("label")).agg(F.count("*").alias("n"))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n"))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label, labels): nodes that nothing contains."""
    inside = edges.where(F.col("type").isin(*CONTAINMENT)).select(F.col("dst").alias("id"))
    return nodes.join(inside, "id", "left_anti").select("id", primary_label().alias("label"), "labels")


def shown_roots(nodes: DataFrame, edges: DataFrame, most: int = MOST_ROOTS) -> DataFrame:
    """The first roots by the best rank of their labels and by id, with the total."""
    found = roots(nodes, edges)
    one = lambda label: F.coalesce(*(F.when(label == x, i) for i, x in enumerate(ROOT_RANK)), F.lit(99))
    rank = F.coalesce(F.array_min(F.transform("labels", one)), F.lit(99))
    total = found.agg(F.count("*").alias("roots_total"))
    return found.withColumn("rank", rank).orderBy("rank", "id").limit(most).crossJoin(F.broadcast(total))  # one row


def flags(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(flag, id): no course, no root, and each framework without children."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(name).alias("flag"), F.lit(None).cast("string").alias("id"))
    parents = edges.where(F.col("type").isin(*CONTAINMENT)).select(F.col("src").alias("id"))
    empty = nodes.where(F.array_contains("labels", "StandardsFramework")).join(parents, "id", "left_anti").select(F.lit("empty framework").alias("flag"), "id")
    courses = nodes.where(F.array_contains("labels", "Course"))
    return one(courses, "no course").unionByName(one(roots(nodes, edges), "no root")).unionByName(empty)


def child_histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, type, edge_type, child_type, n, assessments): what each container holds, by stored type."""
    kids = nodes.select(F.col("id").alias("dst"), F.col("type").alias("child_type"), F.coalesce(F.get_json_object("props", "$.educationalUse") == "Assessment", F.lit(False)).alias("assessed"))
    held = edges.where(F.col("type").isin(*CONTAINMENT)).select(F.col("type").alias("edge_type"), F.col("src").alias("id"), "dst")
    counted = held.join(kids, "dst").groupBy("id", "edge_type", "child_type").agg(F.count("*").alias("n"), F.count_if("assessed").alias("assessments"))
    return counted.join(nodes.select("id", "type"), "id")


def many_parents(edges: DataFrame) -> DataFrame:
    """(id, parents): nodes with more than one container."""
    held = edges.where(F.col("type").isin(*CONTAINMENT)).select("src", F.col("dst").alias("id")).distinct()
    return held.groupBy("id").agg(F.count("*").alias("parents")).where("parents > 1")
