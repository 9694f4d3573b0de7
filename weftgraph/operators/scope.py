"""Readers of one part of a graph: a course, its standards, a document, a section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.traverse import ancestors, closure, induced, nearest, steps

CONTAINMENT = ["hasPart", "hasChild"]
FORMATTER_LABELS = ("Formatter",)


def courses(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.array_contains("labels", "Course"))


def course_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, id, depth) of all that each course contains, itself included."""
    return closure(courses(nodes).select("id"), steps(edges, "out", CONTAINMENT))


def course_subgraph(nodes: DataFrame, edges: DataFrame, course: str) -> tuple[DataFrame, DataFrame] | None:
    """Members of one course and all edges among them, of any type; None if it is not a course."""
    start = courses(nodes).where(F.col("id") == course).select("id")
    if not start.take(1):
        return None
    ids = closure(start, steps(edges, "out", CONTAINMENT)).select("id")
    return nodes.join(ids, "id", "left_semi"), induced(edges, ids)


def standards_for(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(root, id): the standards that each start is aligned with, and their one-step surroundings.

    Surroundings: children and parents, what supports them, and what builds towards or from them.
    """
    items = nodes.where(F.array_contains("labels", "StandardsFrameworkItem")).select("id")
    mine = edges.where(F.col("type") == "hasEducationalAlignment").join(starts.select(F.col("id").alias("src")), "src", "left_semi")
    aligned = mine.select(F.col("src").alias("root"), F.col("dst").alias("id")).join(items, "id", "left_semi").select("root", "id").distinct()
    near = edges.where(F.col("type").isin("hasChild", "supports", "buildsTowards"))
    both = near.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(near.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    around = aligned.join(both, "id").select("root", F.col("other").alias("id"))
    return aligned.unionByName(around.join(nodes.select("id"), "id", "left_semi").select("root", "id")).distinct()


def documents_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, document): the document that a target stands for. A document is its own; a course has the first by id of those that cover it.

    Other nodes, and courses that no document covers, have none.
    """
    documents = nodes.where(F.array_contains("labels", "TeachingLearningMaterial")).select(F.col("id").alias("document"))
    covering = edges.where(F.col("type") == "covers").select(F.col("src").alias("document"), F.col("dst").alias("id")).join(documents, "document", "left_semi")
    targets = courses(nodes).select("id").join(documents.select(F.col("document").alias("id")), "id", "left_anti")
    first = covering.groupBy("id").agg(F.min("document").alias("document")).join(targets, "id", "left_semi")
    return first.unionByName(documents.select(F.col("document").alias("id"), "document"))


def document_sections(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(document, section, position, covers): the sections of every document, in order of position and id."""
    sections = nodes.where(F.array_contains("labels", "DocumentSection")).select(F.col("id").alias("section"), F.coalesce(F.get_json_object("props", "$.position").cast("double"), F.get_json_object("props", "$.metadata.order").cast("double"), F.lit(0.0)).alias("position"))
    held = edges.where(F.col("type") == "hasPart").select(F.col("src").alias("document"), F.col("dst").alias("section"))
    documents = nodes.where(F.array_contains("labels", "TeachingLearningMaterial")).select(F.col("id").alias("document"))
    covers = edges.where(F.col("type") == "covers").groupBy(F.col("src").alias("section")).agg(F.sort_array(F.collect_list("dst")).alias("covers"))
    return held.join(documents, "document", "left_semi").join(sections, "section").join(covers, "section", "left")


def document_curriculum(nodes: DataFrame, edges: DataFrame, document: str) -> tuple[str, DataFrame]:
    """What a document is about: by its sections' targets, else by the course it covers, else nothing; and the ids."""
    own = closure(nodes.where(F.col("id") == document).select("id"), steps(edges, "out", ["hasPart"])).select("id")
    targets = edges.where(F.col("type") == "covers").join(own.select(F.col("id").alias("src")), "src", "left_semi").select("src", F.col("dst").alias("id"))
    by_section = targets.where(F.col("src") != document).select("id").distinct()
    if by_section.take(1):
        return "sections", closure(by_section, steps(edges, "out", CONTAINMENT), together=True).select("id")
    of_course = targets.select("id").join(courses(nodes).select("id"), "id", "left_semi")
    if of_course.take(1):
        return "course", closure(of_course, steps(edges, "out", CONTAINMENT), together=True).select("id")
    return "none", of_course


def owning_document(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(root, id, depth): the nearest document above each start by hasPart."""
    return nearest(ancestors(starts, edges, ["hasPart"]), nodes, "TeachingLearningMaterial")


def document_formatters(nodes: DataFrame, edges: DataFrame, document: str) -> DataFrame:
    """Formatters of the document itself: the search does not pass through sections."""
    open_ = nodes.where(~F.array_contains("labels", "DocumentSection")).select("id")
    found = closure(nodes.where(F.col("id") == document).select("id"), steps(edges, "out", ["hasPart"]), through=open_)
    return _formatters(nodes, found.where("depth > 0").select("id"))


def own_formatters(nodes: DataFrame, edges: DataFrame, section: str) -> DataFrame:
    found = closure(nodes.where(F.col("id") == section).select("id"), steps(edges, "out", ["hasPart"]))
    return _formatters(nodes, found.where("depth > 0").select("id"))


def _formatters(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.where(F.arrays_overlap("labels", F.array(*map(F.lit, FORMATTER_LABELS)))).join(ids, "id", "left_semi").select("id").distinct()


def section_routine(nodes: DataFrame, edges: DataFrame, section: str) -> DataFrame:
    """(id): the routine of a section and all it holds: its own, else its document's, else the nearest of what it covers."""
    me = nodes.where(F.col("id") == section).select("id")
    own = me.select("id", F.lit(0).alias("rank"), F.lit(0).alias("depth"))
    tlm = owning_document(nodes, edges, me).select("id", F.lit(1).alias("rank"), "depth")
    covered = edges.where((F.col("type") == "covers") & (F.col("src") == section)).select(F.col("dst").alias("id"))
    above = closure(covered, steps(edges, "in", CONTAINMENT), together=True).select("id", F.lit(2).alias("rank"), "depth")
    uses = edges.where(F.col("type") == "usesRoutine").select(F.col("src").alias("id"), "dst", F.col("id").alias("edge"))
    first = own.unionByName(tlm).unionByName(above).join(uses, "id").agg(F.min_by("dst", F.struct("rank", "depth", "id", "edge")).alias("id")).where("id IS NOT NULL")
    return closure(first, steps(edges, "out", ["hasPart"]), together=True).select("id")


def section_subgraph(nodes: DataFrame, edges: DataFrame, section: str) -> dict[str, DataFrame]:
    """A section with its covered curriculum (containment edges only), routine and formatters."""
    me = nodes.where(F.col("id") == section).select("id")
    covered = edges.where((F.col("type") == "covers") & (F.col("src") == section)).select(F.col("dst").alias("id"))
    curriculum = closure(covered, steps(edges, "out", CONTAINMENT), together=True).select("id")
    document = owning_document(nodes, edges, me).select("id")
    first = document.take(1)
    formatters = own_formatters(nodes, edges, section)
    if first:
        formatters = formatters.unionByName(document_formatters(nodes, edges, first[0].id)).distinct()
    return {"document": document, "curriculum": curriculum, "curriculum_edges": induced(edges, curriculum, CONTAINMENT), "routine": section_routine(nodes, edges, section), "formatters": formatters}
