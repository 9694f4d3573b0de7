"""Primitives for migrating graphs: relabel, re-point, mint, collapse, canonicalise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.ordering import placed
from weftgraph.operators.traverse import ancestors, nearest


def edge_id() -> Column:
    return F.concat("type", F.lit(":"), "src", F.lit("->"), "dst")


def derived_id(seed: Column) -> Column:
    """A stable identifier in the form of a version-5 UUID from the SHA-1 of a seed."""
    h = F.sha1(seed)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def relabel(nodes: DataFrame, where: Column, label: str) -> DataFrame:
    """New type and sole label for the nodes that match."""
    hit = F.coalesce(where, F.lit(False))
    return nodes.withColumn("labels", F.when(hit, F.array(F.lit(label))).otherwise(F.col("labels"))).withColumn("type", F.when(hit, F.lit(label)).otherwise(F.col("type")))


def repoint(edges: DataFrame, moves: DataFrame, end: str = "dst") -> DataFrame:
    """Edges whose ``end`` is in moves (old_id, new_id) point to the new id; ids follow; repeats become one."""
    moved = edges.join(moves.select(F.col("old_id").alias(end), "new_id"), end, "left").withColumn(end, F.coalesce("new_id", end)).drop("new_id")
    return moved.withColumn("id", edge_id()).select("id", "type", "src", "dst").dropDuplicates(["id"])


def mint(seeds: DataFrame, seed: Column, label: str, props: Column) -> DataFrame:
    """One derived node for each distinct seed."""
    made = seeds.select(derived_id(seed).alias("id"), props.alias("props")).dropDuplicates(["id"])
    return made.select("id", F.lit(label).alias("type"), F.array(F.lit(label)).alias("labels"), "props")


def collapsed(edges: DataFrame, up: DataFrame, kind: str) -> DataFrame:
    """Edges of a kind, moved from their sources to the sources' ancestors (root, id), repeats as one."""
    chosen = edges.where(F.col("type") == kind).join(up.select(F.col("root").alias("src"), F.col("id").alias("above")), "src").select(F.lit(kind).alias("type"), F.col("above").alias("src"), "dst").distinct()
    return chosen.withColumn("id", edge_id()).select("id", "type", "src", "dst")


def nearest_course(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    return nearest(ancestors(starts, edges), nodes, "Course")


def aligned_to_single_parent(edges: DataFrame, components: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges onto a component that has one parent only go to that parent; ``running`` counts them for each component from 0.

    ``components`` and ``parents`` have a column id. Order: by seq if there is one, else by id.
    """
    up = edges.where(F.col("type") == "supports").join(components.select(F.col("id").alias("src")), "src", "left_semi").join(parents.select(F.col("id").alias("dst")), "dst", "left_semi")
    single = up.groupBy("src").agg(F.min("dst").alias("parent"), F.countDistinct("dst").alias("n")).where("n = 1").select(F.col("src").alias("component"), "parent")
    order = "seq" if "seq" in edges.columns else "id"
    onto = edges.where(F.col("type") == "hasEducationalAlignment").join(single, F.col("dst") == F.col("component"))
    onto = placed(onto, "component", order, name="running").withColumn("running", F.col("running").cast("int"))
    return onto.select(F.concat(F.lit("hasEducationalAlignment:"), "src", F.lit("->"), "parent").alias("id"), "src", F.col("parent").alias("dst"), "component", "running")


def canonical_edges(edges: DataFrame, content: DataFrame) -> DataFrame:
    """hasChild between content nodes becomes hasPart; supports from a content node becomes an alignment."""
    inside = content.select(F.col("id").alias("src"), F.lit(True).alias("from_content"))
    to = content.select(F.col("id").alias("dst"), F.lit(True).alias("to_content"))
    both = edges.join(inside, "src", "left").join(to, "dst", "left")
    kind = F.when((F.col("type") == "hasChild") & F.col("from_content") & F.col("to_content"), "hasPart").when((F.col("type") == "supports") & F.col("from_content"), "hasEducationalAlignment").otherwise(F.col("type"))
    return both.withColumn("type", kind).withColumn("id", edge_id()).select("id", "type", "src", "dst")


def derived_components(nodes: DataFrame, edges: DataFrame, groupings: DataFrame, leaves: DataFrame, label: str, gone: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Hangs what groupings hold below the leaves that their keys name, and removes the groupings with every edge that touches them.

    ``groupings`` and ``leaves`` are (id, key) with a composite text as key, ``gone`` (id) more nodes to remove. Children of the given label move, by ``hasChild``
    edges with derived ids. ValueError if a grouping has no leaf or several.
    """
    matched = groupings.join(leaves.groupBy("key").agg(F.min("id").alias("leaf"), F.count("*").alias("n")), "key", "left")
    if bad := matched.where("n IS NULL OR n > 1").select("id").orderBy("id").limit(20).collect():
        raise ValueError("no single leaf for " + ", ".join(r.id for r in bad))
    below = edges.where(F.col("type") == "hasPart").join(matched.select(F.col("id").alias("src"), "leaf"), "src")
    moved = below.join(nodes.where(F.array_contains("labels", label)).select(F.col("id").alias("dst")), "dst", "left_semi")
    fresh = moved.select(derived_id(F.concat("leaf", F.lit(":hasChild:"), "dst")).alias("id"), F.lit("hasChild").alias("type"), F.col("leaf").alias("src"), "dst").distinct()
    removed = groupings.select("id") if gone is None else groupings.select("id").unionByName(gone.select("id"))
    kept = edges.join(removed.select(F.col("id").alias("src")), "src", "left_anti").select("id", "type", "src", "dst").unionByName(fresh)
    return nodes.join(removed, "id", "left_anti"), kept.join(removed.select(F.col("id").alias("dst")), "dst", "left_anti").select("id", "type", "src", "dst")


def flagged_last(children: DataFrame, pattern: str = "(?i)bilan") -> DataFrame:
    """(parent, id): of each parent the last child whose text matches, else the last child. Needs parent, id, ord, text."""
    last = F.struct(F.coalesce(F.col("text").rlike(pattern), F.lit(False)), "ord", "id")  # a null order is the lowest
    return children.groupBy("parent").agg(F.max_by("id", last).alias("id"))


def grouped_between(edges: DataFrame, groups: DataFrame, label: str = "LessonGrouping") -> tuple[DataFrame, DataFrame]:
    """Puts a minted node between parents and children: groups (parent, child, name). Returns new nodes, and all edges."""
    seed = F.concat_ws("/", "parent", "name")
    named = groups.withColumn("group_id", derived_id(seed))
    nodes = named.select(F.col("group_id").alias("id"), F.lit(label).alias("type"), F.array(F.lit(label)).alias("labels"), F.to_json(F.struct(F.col("name").alias("description"))).alias("props")).dropDuplicates(["id"])
    replaced = edges.join(groups.select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit("hasPart").alias("type")), ["src", "dst", "type"], "left_anti").select("type", "src", "dst")
    above = named.select(F.lit("hasPart").alias("type"), F.col("parent").alias("src"), F.col("group_id").alias("dst")).distinct()
    below = named.select(F.lit("hasPart").alias("type"), F.col("group_id").alias("src"), F.col("child").alias("dst")).distinct()
    links = replaced.unionByName(above).unionByName(below)
    return nodes, links.withColumn("id", edge_id()).select("id", "type", "src", "dst")


#: Sessions of a week.
MOST_SESSIONS = 1000


def expanded(weeks: DataFrame, sessions: DataFrame, standards: DataFrame, fallback: str) -> DataFrame:
    """(week, session, standard): each week with each session of a fixed list, its standard by (week, type), else by (fallback, type).

    ``sessions`` is a short list (session, type): more than ``MOST_SESSIONS`` are an error. Each week is exploded by it.
    """
    plan = sessions.select("session", "type").limit(MOST_SESSIONS + 1).collect()
    if len(plan) > MOST_SESSIONS:
        raise ValueError(f"more than {MOST_SESSIONS} sessions")
    listed = F.array(*(F.struct(F.lit(r.session).alias("session"), F.lit(r.type).alias("type")) for r in plan))
    both = weeks.select("week", F.inline(listed)) if plan else weeks.select("week").join(sessions.limit(0), F.lit(True))
    exact = standards.select(F.col("week"), "type", F.col("standard").alias("exact"))
    other = standards.where(F.col("week") == fallback).select("type", F.col("standard").alias("other"))
    return both.join(exact, ["week", "type"], "left").join(other, "type", "left").select("week", "session", F.coalesce("exact", "other").alias("standard"))


def edited(nodes: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies (id, field, value) edits to props; returns the nodes and the counts applied, skipped and failed.

    A field is set as text; an edit that says what stands there is skipped; one for an unknown node fails.
    """
    from weftgraph.functions.jsontext import set_paths

    now = edits.join(nodes.select("id", "props"), "id", "left")
    state = F.when(F.col("props").isNull(), "failed").when(F.expr("get_json_object(props, concat('$.', field)) <=> value"), "skipped").otherwise("applied")
    counts = now.withColumn("state", state).groupBy("state").agg(F.count("*").alias("n"))
    wanted = edits.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_set"))
    return nodes.join(wanted, "id", "left").withColumn("props", F.when(F.col("_set").isNull(), F.col("props")).otherwise(set_paths("props", "_set"))).drop("_set"), counts
