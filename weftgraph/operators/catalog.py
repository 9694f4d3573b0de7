"""The catalog of routines, formatters and rubrics: assembling it, rendering an entry, relabelling a copy."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftgraph.functions.jsontext import dumps
from weftgraph.operators.mutate import Graph, Rejected, edge_rows, edge_table, node_rows
from weftgraph.operators.ordering import in_order, placed
from weftgraph.operators.rewrite import edge_id
from weftgraph.operators.traverse import closure, induced, steps

ROUTINE = "InstructionalRoutine"
ROOT = ("catalog-root", ROUTINE, [ROUTINE], {"description": "Routine library", "metadata": {"role": "instructional-routine"}})


def entries(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(id, kind): routines that no routine holds; kinds by the metadata's tag, else plain routines."""
    routines = nodes.where(F.array_contains("labels", ROUTINE)).select("id", F.coalesce(F.get_json_object("props", "$.metadata.catalogKind"), F.lit("routine")).alias("kind"))
    inner = edges.where("type = 'hasPart'").join(routines.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    tops = routines.join(inner, "id", "left_anti")
    return tops if kinds is None else tops.where(F.col("kind").isin(*kinds))


def card_order(rows: DataFrame) -> DataFrame:
    """(id, kind, name) with ``place``, from 1: routines first, then by name and id."""
    return in_order(rows, F.col("kind") != "routine", "name", "id", name="place")


def assembled(sources: list[tuple[DataFrame, DataFrame]], authored: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """One root with the routines of the sources and every entry of the authored graphs, subtrees and ids as they are."""
    spark = (sources + authored)[0][0].sparkSession
    nodes, edges = node_rows(spark, [ROOT]), None
    for graphs, kinds in ((sources, ("routine",)), (authored, None)):
        for n, e in graphs:
            tops = entries(n, e, kinds)
            ids = closure(tops.select("id"), steps(e, "out", ["hasPart"]), together=True).select("id")
            below = tops.select(F.lit("hasPart").alias("type"), F.lit(ROOT[0]).alias("src"), F.col("id").alias("dst")).withColumn("id", edge_id()).select("id", "type", "src", "dst")
            links = edge_table(induced(e, ids, ["hasPart"])).unionByName(edge_table(below))
            nodes = nodes.unionByName(n.join(ids, "id", "left_semi").select("id", "type", "labels", "props"))
            edges = links if edges is None else edges.unionByName(links)
    return nodes, edges if edges is not None else edge_rows(spark, [("", "", "")]).limit(0)


def root_of(nodes: DataFrame, edges: DataFrame) -> str | None:
    """The container of a catalog: the node of the fixed id, else the first routine by id that no routine holds."""
    if nodes.where(F.col("id") == ROOT[0]).take(1):
        return ROOT[0]
    return entries(nodes, edges).agg(F.min("id").alias("id")).first().id


def filed(g: Graph, clone: Graph, root: str) -> Graph:
    """Adds a copied entry below the catalog's container; refused without one, without the entry, or if an id is taken."""
    container = root_of(*g)
    errors = [] if container else ["the catalog has no container"]
    if not clone.nodes.where(F.col("id") == root).take(1):
        errors.append(f"{root!r} is not among the copied nodes")
    taken = clone.nodes.select("id").join(g.nodes.select("id"), "id", "left_semi").orderBy("id").limit(20)
    errors += [f"node {r.id!r} exists" for r in taken.collect()]
    if errors:
        raise Rejected(*errors)
    edges = edge_table(g.edges).unionByName(edge_table(clone.edges))
    link = edge_rows(g.nodes.sparkSession, [("hasPart", container, root)])
    return Graph(g.nodes.select("id", "type", "labels", "props").unionByName(clone.nodes.select("id", "type", "labels", "props")), edges.unionByName(link))


def _entry(nodes: DataFrame, edges: DataFrame, entry: str) -> dict[str, dict]:
    """The nodes of one entry, with their children in order; an entry is a few dozen nodes."""
    ids = closure(nodes.where(F.col("id") == entry).select("id"), steps(edges, "out", ["hasPart"]), 3).select("id")
    found = {r.id: {"id": r.id, "labels": list(r.labels), "props": json.loads(r.props or "{}"), "children": []} for r in nodes.join(ids, "id", "left_semi").collect()}
    for r in induced(edges, ids, ["hasPart"]).orderBy("id").collect():
        if r.src in found and r.dst in found:
            found[r.src]["children"].append(found[r.dst])
    order = lambda n: (n["props"].get("position") or (n["props"].get("metadata") or {}).get("order") or 0, n["id"])
    for n in found.values():
        n["children"].sort(key=order)
    return found


def rendered(nodes: DataFrame, edges: DataFrame, entry: str, scope: str = "shared") -> str | None:
    """An entry as markdown, each text under the id of the node that holds it; None if it is no entry."""
    found = _entry(nodes, edges, entry)
    top = found.get(entry)
    if top is None or ROUTINE not in top["labels"]:
        return None
    meta = lambda n: n["props"].get("metadata") or {}
    material = lambda n: "Material" in n["labels"]
    kind = meta(top).get("catalogKind") or "routine"
    out = [f"# {top['props'].get('description') or entry}", "", f"*{kind}, {scope} catalog*", ""]
    if meta(top).get("summary"):
        out += [meta(top)["summary"], ""]

    def body(n: dict) -> None:
        if text := n["props"].get("content"):
            out.extend([f"node `{n['id']}`", "", text, ""])

    if kind == "formatter":
        for n in filter(material, top["children"]):
            body(n)
    elif kind == "rubric":
        if meta(top).get("scale"):
            out += [f"**{meta(top)['scale']}**", ""]
        for section in (c for c in top["children"] if ROUTINE in c["labels"]):
            weight = meta(section).get("weight")
            out += [f"## {section['props'].get('description', '')}" + (f" ({weight})" if weight else ""), ""]
            for criterion in filter(material, section["children"]):
                out += [f"### {criterion['props'].get('description', '')}", ""]
                body(criterion)
    else:
        for step in (c for c in top["children"] if material(c) or ROUTINE in c["labels"]):
            time = step["props"].get("timeRequired")
            out += [f"## {step['props'].get('description', '')}" + (f" ({time})" if time else ""), ""]
            for n in [step] if material(step) else list(filter(material, step["children"])):
                body(n)
    return "\n".join(out).rstrip() + "\n"


def pages(nodes: DataFrame, edges: DataFrame, scope: str = "shared") -> DataFrame:
    """(entry, line, text): the lines that ``rendered`` has, blank ones left out, of every entry, as a table. A text of several lines is one row.

    An entry of any size is no task of its own: its lines are numbered by ranges.
    """
    prop = lambda path: F.nullif(F.get_json_object("props", f"$.{path}"), F.lit(""))
    at = F.coalesce(F.nullif(prop("position").cast("double"), F.lit(0.0)), F.nullif(prop("metadata.order").cast("double"), F.lit(0.0)), F.lit(0.0))
    told = lambda text, extra: F.concat(F.coalesce(text, F.lit("")), F.coalesce(F.concat(F.lit(" ("), extra, F.lit(")")), F.lit("")))
    n = nodes.select(
        "id", at.alias("at"), F.array_contains("labels", "Material").alias("material"), F.array_contains("labels", ROUTINE).alias("routine"), prop("description").alias("name"), prop("content").alias("body"),
        prop("timeRequired").alias("time"), prop("metadata.weight").alias("weight"), prop("metadata.summary").alias("summary"), prop("metadata.scale").alias("scale"),
    )
    held = edges.where("type = 'hasPart'").select("src", "dst")
    top = entries(nodes, edges).join(n.select("id", "name", "summary", "scale"), "id").withColumnRenamed("id", "entry")
    none = F.lit(None)

    def lines(rows: DataFrame, *texts: Column, below: bool = False, inner: bool = False) -> DataFrame:
        """Rows of text in order; they stand at their node's place below the entry, ``inner`` at a place below that one."""
        spot = [F.col("at1") if below else none.cast("double"), F.col("id1") if below else none.cast("string"), F.col("at2") if inner else none.cast("double"), F.col("id2") if inner else none.cast("string")]
        cells = F.posexplode(F.array(*texts)).alias("part", "text")
        return rows.select("entry", *(c.alias(k) for k, c in zip(("o1", "k1", "o2", "k2"), spot, strict=True)), cells).where("text IS NOT NULL")

    kind = F.col("kind")
    first = held.join(top.select(F.col("entry").alias("src"), "entry", "kind"), "src").drop("src").join(n, F.col("dst") == F.col("id")).withColumnsRenamed({"id": "id1", "at": "at1"}).drop("dst")
    first = first.where(F.when(kind == "formatter", F.col("material")).when(kind == "rubric", F.col("routine")).otherwise(F.col("material") | F.col("routine")))
    shown = F.when(kind == "rubric", F.concat(F.lit("## "), told(F.col("name"), F.col("weight")))).when(kind != "formatter", F.concat(F.lit("## "), told(F.col("name"), F.col("time"))))
    node = lambda i: F.when(F.col("body").isNotNull(), F.concat(F.lit("node `"), F.col(i), F.lit("`")))
    own = F.col("material") & (kind != "rubric")
    parents = first.where((kind != "formatter") & (~F.col("material") | (kind == "rubric"))).select("entry", "kind", "id1", "at1")
    second = held.join(parents, F.col("src") == F.col("id1")).drop("src").join(n.where("material"), F.col("dst") == F.col("id")).withColumnsRenamed({"id": "id2", "at": "at2"}).drop("dst")
    criterion = F.when(kind == "rubric", F.concat(F.lit("### "), F.coalesce("name", F.lit(""))))
    head = lines(
        top, F.concat(F.lit("# "), F.coalesce("name", "entry")), F.concat(F.lit("*"), kind, F.lit(f", {scope} catalog*")), F.col("summary"), F.when(kind == "rubric", F.concat(F.lit("**"), F.col("scale"), F.lit("**")))
    )
    body = lines(first, shown, F.when(own, node("id1")), F.when(own, F.col("body")), below=True)
    inner = lines(second, criterion, node("id2"), F.col("body"), below=True, inner=True)
    rows = placed(head.unionByName(body).unionByName(inner), "entry", "o1", "k1", "o2", "k2", "part", name="line")
    return rows.select("entry", (F.col("line") + 1).alias("line"), "text")


def relabelled(nodes: DataFrame, edges: DataFrame, root: str, labels: tuple[str, ...]) -> DataFrame:
    """A cloned subtree with a label for each level below its root, without the tags of the catalog.

    ("Formatter", "FormatterSpec") or ("Rubric", "RubricSection", "RubricCriterion"); deeper levels stay.
    """
    depth = closure(nodes.where(F.col("id") == root).select("id"), steps(edges, "out", ["hasPart"]), len(labels) - 1).groupBy("id").agg(F.min("depth").alias("depth"))
    label = F.get(F.array(*map(F.lit, labels)), F.col("depth"))

    def untagged(text: str | None) -> str | None:
        value = json.loads(text) if text else {}
        meta = {k: v for k, v in (value.get("metadata") or {}).items() if k not in ("catalogKind", "role")}
        value = {k: v for k, v in value.items() if k != "metadata"} | ({"metadata": meta} if meta else {})
        return dumps(value)

    @F.pandas_udf(StringType())
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(untagged)

    rows = nodes.join(depth, "id", "left")
    hit = F.col("depth").isNotNull()
    return rows.select("id", F.when(hit, label).otherwise(F.col("type")).alias("type"), F.when(hit, F.array(label)).otherwise(F.col("labels")).alias("labels"), F.when(hit, clean("props")).otherwise(F.col("props")).alias("props"))
