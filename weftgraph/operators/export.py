"""Exports for display: a whole graph or a subtree, bounded by the size of its JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import display

#: Largest subtree and largest response, in bytes of indented JSON.
SUBTREE_BYTES, RESPONSE_BYTES = 80 * 1024, 100 * 1024
# The labels of a legend in its order, in two languages.
LEGEND = {
    "StandardsFramework": ("Cadre de référence", "Standards framework"),
    "StandardsFrameworkItem": ("Élément du cadre", "Framework item"),
    "Course": ("Cours", "Course"),
    "LessonGrouping": ("Regroupement", "Lesson grouping"),
    "Lesson": ("Leçon", "Lesson"),
    "Activity": ("Activité", "Activity"),
    "Material": ("Matériel", "Material"),
    "LearningComponent": ("Composant", "Learning component"),
    "TeachingLearningMaterial": ("Document", "Document (TLM)"),
    "DocumentSection": ("Section", "Document section"),
    "Formatter": ("Formateur", "Formatter"),
    "FormatterSpec": ("Règle de format", "Formatter spec"),
}
#: The layers that views are offered for.
STANDARDS = ("StandardsFramework", "StandardsFrameworkItem")
CONTENT = ("Course", "LessonGrouping", "Lesson", "Activity", "Material", "InstructionalRoutine")
DOCUMENTS = ("TeachingLearningMaterial", "DocumentSection", "Formatter", "FormatterSpec")


def size_of(value) -> int:
    """Bytes of the indented JSON that a reader would get."""
    return len(json.dumps(value, indent=2, ensure_ascii=False).encode())


def shape_of(value):
    """What a value is, one level deep, without its content."""
    def named(v) -> str:
        if isinstance(v, (list, tuple)):
            return f"array({len(v)})"
        if isinstance(v, str):
            return f"string({len(v)} chars)"
        if isinstance(v, dict):
            return f"object({len(v)} keys)"
        return "null" if v is None else "boolean" if isinstance(v, bool) else "number"

    return {k: named(v) for k, v in value.items()} if isinstance(value, dict) else named(value)


def response(value, most: int = RESPONSE_BYTES) -> dict:
    """The value, or its shape and size if it is too large to be sent."""
    if (n := size_of(value)) <= most:
        return {"ok": True, "value": value}
    return {"ok": False, "code": "RESPONSE_TOO_LARGE", "bytes": n, "cap": most, "shape": shape_of(value)}


def summary(shown: DataFrame, drawn: DataFrame) -> dict[str, DataFrame]:
    """Counts by label, legend, sources, and the views for which there is data."""
    present = shown.groupBy("label").agg(F.count("*").alias("n"))
    has = lambda labels: F.max(F.col("label").isin(*labels))
    layers = present.agg(has(STANDARDS).alias("standards"), has(("LearningComponent",)).alias("components"), has(CONTENT).alias("curriculum"), has(DOCUMENTS).alias("documents"))
    ahead = drawn.agg(F.coalesce(F.max(F.col("rel") == "buildsTowards"), F.lit(False)).alias("progression"))
    return {"legend": display.taxonomy(shown, tuple(LEGEND)), "sources": display.sources(shown), "views": layers.join(F.broadcast(ahead), F.lit(True))}  # one row each


def subtree(nodes: DataFrame, edges: DataFrame, start: str, most_depth: int = 4, detail: bool = False, most_bytes: int = SUBTREE_BYTES) -> dict:
    """The display graph below a start, without details if these make it too large; else only its counts.

    Nodes and edges come to the driver no further than the size allows: they are measured where they are first.
    """
    if not nodes.where(F.col("id") == start).take(1):
        raise ValueError(f"start node {start!r} not found")
    drawn = display.display_edges(nodes, edges)
    ids = display.scoped_subtree(drawn, nodes.where(F.col("id") == start).select("id"), most_depth).select("id")
    shown = display.display_nodes(nodes).join(ids, "id", "left_semi").join(display.flat_props(nodes), "id", "left")
    links = drawn.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    n_nodes, text = shown.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("id") + F.octet_length("text")), F.lit(0))).first()
    n_edges = links.count()
    if text + 40 * n_nodes + 40 * n_edges > most_bytes:  # less than its JSON takes
        return {"too_large": True, "nodes": n_nodes, "edges": n_edges}
    cards = [r.asDict(True) for r in shown.orderBy("id").collect()]
    lines = [r.asDict() for r in links.orderBy("src", "dst", "type").collect()]
    for keep in (True, False) if detail else (False,):
        value = {"nodes": [c | {"props": c["props"] if keep else {}} for c in cards], "edges": lines}
        if size_of(value) <= most_bytes:
            return value
    return {"too_large": True, "nodes": n_nodes, "edges": n_edges}


def document(base: dict, nodes: DataFrame, edges: DataFrame, most_bytes: int = SUBTREE_BYTES) -> dict:
    """A document's parts with its nodes and edges, or with a marker of their number and size if they are too large to be inlined.

    Their JSON is measured where it is, so no more than fits comes to the driver.
    """
    size = lambda rows: rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns)))), F.lit(0))).first()
    (n_nodes, node_bytes), (n_edges, edge_bytes) = size(nodes), size(edges)
    if node_bytes + edge_bytes <= most_bytes:  # compact JSON takes less than the indented one of the answer
        value = base | {"curriculum": {"nodes": [r.asDict(True) for r in nodes.orderBy("id").collect()], "edges": [r.asDict(True) for r in edges.orderBy(*edges.columns).collect()]}}
        if size_of(value) <= most_bytes:
            return value
    return base | {"curriculum": {"too_large": True, "nodes": n_nodes, "edges": n_edges, "bytes": node_bytes + edge_bytes, "cap": most_bytes}}


def whole(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """A namespace's display nodes with flat properties, drawn edges and summary, all as tables."""
    shown, drawn = display.display_nodes(nodes), display.display_edges(nodes, edges)
    return shown.join(display.flat_props(nodes), "id", "left"), drawn, summary(shown, drawn)
