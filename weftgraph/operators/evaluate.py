"""Rubrics of documents: what a reader needs to judge a document, for all documents as tables or for one as a nested value.

A rubric hangs below a document, its sections below it and criteria below these. Sections and criteria are in order of their position,
then their id; places come from numbered ranges, so a rubric of any size is not one task. What a document covers is the first node of
its ``covers`` edges, and its record in the history is that of what it covers, else its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import scope, traverse
from weftgraph.operators.ordering import placed

DOCUMENT, RUBRIC, SECTION, CRITERION = "TeachingLearningMaterial", "Rubric", "RubricSection", "RubricCriterion"


def _prop(path: str) -> Column:
    return F.get_json_object("props", f"$.{path}")


def order_of(props: str = "props") -> Column:
    """The position of a node, that of its metadata, or 0."""
    return F.coalesce(F.get_json_object(props, "$.position").cast("double"), F.get_json_object(props, "$.metadata.order").cast("double"), F.lit(0.0))


def _labelled(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.where((F.col("type") == label) | F.array_contains("labels", label))


def _held(nodes: DataFrame, edges: DataFrame, label: str, parent: str, child: str, **columns: Column) -> DataFrame:
    kids = _labelled(nodes, label).select(F.col("id").alias(child), *(c.alias(k) for k, c in columns.items()))
    return edges.where("type = 'hasPart'").select(F.col("src").alias(parent), F.col("dst").alias(child)).join(kids, child)


def _sections(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows = _held(nodes, edges, SECTION, "rubric", "section", section_name=_prop("description"), weight=_prop("metadata.weight"), _at=order_of())
    return placed(rows, "rubric", "_at", "section", name="section_place").drop("_at")


def _criteria(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows = _held(nodes, edges, CRITERION, "section", "criterion", criterion_name=_prop("description"), indicator=_prop("content"), _at=order_of())
    return placed(rows, "section", "_at", "criterion", name="criterion_place").drop("_at")


def attached(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(document, rubric, name, summary, scale) of every rubric below a document."""
    rows = _held(nodes, edges, RUBRIC, "document", "rubric", name=_prop("description"), summary=_prop("metadata.summary"), scale=_prop("metadata.scale"))
    documents = _labelled(nodes, DOCUMENT).select(F.col("id").alias("document"))
    return rows.join(documents, "document", "left_semi").select("document", "rubric", "name", "summary", "scale")


def described(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each criterion: (rubric, section, section_place, section_name, weight, criterion, criterion_place, criterion_name, indicator).

    Rubrics without sections and sections without criteria have one row with nulls.
    """
    rubrics = _labelled(nodes, RUBRIC).select(F.col("id").alias("rubric"))
    return rubrics.join(_sections(nodes, edges), "rubric", "left").join(_criteria(nodes, edges), "section", "left").select(
        "rubric", "section", "section_place", "section_name", "weight", "criterion", "criterion_place", "criterion_name", "indicator"
    )


def evaluations(nodes: DataFrame, edges: DataFrame, history: DataFrame) -> DataFrame:
    """(document, name, covers, relPath, rubrics, criteria_count) of every document that has a rubric; ``history`` is (nodeId, relPath)."""
    links = edges.where("type = 'hasPart'").select("src", "dst")
    sections = links.join(_labelled(nodes, SECTION).select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("rubric"), F.col("dst").alias("section"))
    criteria = links.join(_labelled(nodes, CRITERION).select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("section"))
    counts = sections.join(criteria.groupBy("section").agg(F.count("*").alias("n")), "section").groupBy("rubric").agg(F.sum("n").alias("n"))
    graded = attached(nodes, edges).join(counts, "rubric", "left").groupBy("document").agg(F.count("*").alias("rubrics"), F.coalesce(F.sum("n"), F.lit(0)).alias("criteria_count"))
    covered = edges.where("type = 'covers'").groupBy(F.col("src").alias("document")).agg(F.min("dst").alias("covers"))
    recorded = history.groupBy("nodeId").agg(F.min("relPath").alias("relPath"))
    rows = graded.join(nodes.select(F.col("id").alias("document"), _prop("description").alias("name")), "document").join(covered, "document", "left")
    rows = rows.join(recorded.select(F.col("nodeId").alias("covers"), F.col("relPath").alias("_of")), "covers", "left")
    rows = rows.join(recorded.select(F.col("nodeId").alias("document"), F.col("relPath").alias("_own")), "document", "left")
    return rows.select("document", "name", "covers", F.coalesce("_of", "_own").alias("relPath"), "rubrics", "criteria_count")


def evaluation(nodes: DataFrame, edges: DataFrame, history: DataFrame, target: str, rubric: str | None = None) -> dict:
    """What is needed to judge one document, or that of a course: its record and its rubrics, nested; or why there is nothing to judge by.

    Only the rubrics of this document come to the driver.
    """
    found = scope.documents_of(nodes, edges).where(F.col("id") == target).first()
    if found is None:
        return {"error": f"{target!r} is no document and has none"}
    document = found.document
    own = attached(nodes, edges).where(F.col("document") == document)
    own = own if rubric is None else own.where(F.col("rubric") == rubric)
    heads = own.orderBy("rubric").collect()
    if not heads:
        return {"error": f"no rubric is attached to {document!r}" if rubric is None else f"rubric {rubric!r} is not attached to {document!r}"}
    ids = traverse.closure(own.select(F.col("rubric").alias("id")), traverse.steps(edges, "out", ["hasPart"]), 2).select("id").distinct()
    part = nodes.join(ids, "id", "left_semi")
    rows = described(part, edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")).orderBy("rubric", "section_place", "criterion_place").collect()
    rubrics = []
    for head in heads:
        sections: dict[str, dict] = {}
        for r in (x for x in rows if x.rubric == head.rubric and x.section is not None):
            section = sections.setdefault(r.section, {"id": r.section, "name": r.section_name, "weight": r.weight, "criteria": []})
            if r.criterion is not None:
                section["criteria"].append({"id": r.criterion, "name": r.criterion_name, "indicator": r.indicator})
        rubrics.append({"id": head.rubric, "name": head.name, "summary": head.summary, "scale": head.scale, "sections": list(sections.values())})
    about = evaluations(nodes, edges.where((F.col("type") != "covers") | (F.col("src") == document)), history).where(F.col("document") == document).first()
    return {
        "document": {"id": document, "name": about.name, "covers": about.covers, "relPath": about.relPath}, "rubrics": rubrics,
        "criteria_count": sum(len(s["criteria"]) for r in rubrics for s in r["sections"]),
    }
