"""From a raw envelope to normalised units and back.

Raw nodes are (id, labels, props) and raw edges (id, type, src, dst, seq); ``seq`` is the place in
the envelope and settles every tie. A descriptor says which edges contain, support, and order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators import traverse
from weftgraph.operators.ordering import placed

#: Labels of the document layer, which is not part of the units.
DOCUMENT_LABELS = ("TeachingLearningMaterial", "DocumentSection", "Formatter", "FormatterSpec")
#: Labels whose description is a title rather than a text.
GROUPING_LABELS = ("Course", "LessonGrouping", "StandardsFramework")


@dataclass(frozen=True)
class Descriptor:
    """How a subject's graph is read."""

    number_from: str = "position"  # or "order", or "description"
    container: tuple[str, ...] = ("hasChild", "hasPart")
    support: tuple[str, ...] = ("supports", "hasEducationalAlignment")
    progression: str = "buildsTowards"
    dependency: str = "hasDependency"
    document_labels: tuple[str, ...] = DOCUMENT_LABELS


def prop(name: str) -> Column:
    return F.get_json_object("props", f"$.{name}")


def kind_of() -> Column:
    """Group name, else first label; a standards item goes by its statement type."""
    first = F.get(F.col("labels"), 0)
    statement = F.coalesce(prop("statementType"), prop("normalizedStatementType"), F.lit("Standard"))
    return F.coalesce(F.nullif(prop("groupName"), F.lit("")), F.when(first == "StandardsFrameworkItem", statement).otherwise(first))


def order_of(d: Descriptor) -> Column:
    """The unit's number: a JSON number, or an all-digit description; standards have none."""
    if d.number_from == "description":
        text = prop("description")
        found = F.when(text.rlike(r"^\d+$"), text.cast("double"))
    else:
        value = F.regexp_extract("props", rf'"{d.number_from}":(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[,}}]', 1)
        found = F.nullif(value, F.lit("")).cast("double")
    return F.when(~F.array_contains("labels", "StandardsFrameworkItem"), found)


def units(nodes: DataFrame, d: Descriptor = Descriptor()) -> DataFrame:
    """(id, kind, title, text, ord, is_assessment) of every node that is a unit."""
    kept = nodes.where(~F.arrays_overlap("labels", F.array(*map(F.lit, d.document_labels)))).withColumn("kind", kind_of()).where("kind IS NOT NULL")
    titled = F.get(F.col("labels"), 0).isin(*GROUPING_LABELS) | (F.coalesce(prop("normalizedStatementType"), F.lit("")) == "Standard Grouping")
    text = F.coalesce(prop("description"), F.lit(""))
    return kept.select(
        "id", "kind", F.when(titled, text).otherwise("").alias("title"), F.when(titled, "").otherwise(text).alias("text"),
        order_of(d).alias("ord"), (F.coalesce(prop("educationalUse"), F.lit("")) == "Assessment").alias("is_assessment"),
    )


def _both_ends(edges: DataFrame, unit_rows: DataFrame) -> DataFrame:
    ids = unit_rows.select("id")
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def containment(edges: DataFrame, unit_rows: DataFrame, d: Descriptor = Descriptor()) -> DataFrame:
    """(parent, child, phase, seq): containers first, then supports with their ends exchanged."""
    inner = _both_ends(edges, unit_rows)
    held = inner.where(F.col("type").isin(*d.container)).select(F.col("src").alias("parent"), F.col("dst").alias("child"), F.lit(1).alias("phase"), "seq")
    hung = inner.where(F.col("type").isin(*d.support)).select(F.col("dst").alias("parent"), F.col("src").alias("child"), F.lit(2).alias("phase"), "seq")
    return held.unionByName(hung)


def parents(links: DataFrame) -> DataFrame:
    """(id, parent_id): the last link of each child wins."""
    return links.groupBy(F.col("child").alias("id")).agg(F.max_by("parent", F.struct("phase", "seq")).alias("parent_id"))


def children(links: DataFrame) -> DataFrame:
    """(id, child_ids): in order of the links; a repeated link repeats its child."""
    ordered = F.array_sort(F.collect_list(F.struct("phase", "seq", "child")))
    return links.groupBy(F.col("parent").alias("id")).agg(F.transform(ordered, lambda x: x["child"]).alias("child_ids"))


def placed_children(links: DataFrame) -> DataFrame:
    """(id, place, child): the children as rows, counted from 0, which a parent of any size can have."""
    found = placed(links.select(F.col("parent").alias("id"), "phase", "seq", "child"), "id", "phase", "seq")
    return found.select("id", F.col("place").cast("int").alias("place"), "child")


def progression(edges: DataFrame, unit_rows: DataFrame, d: Descriptor = Descriptor()) -> DataFrame:
    """(src, dst, seq) of what builds towards what; a dependency counts backwards."""
    inner = _both_ends(edges, unit_rows)
    ahead = inner.where(F.col("type") == d.progression).select("src", "dst", "seq")
    return ahead.unionByName(inner.where(F.col("type") == d.dependency).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "seq"))


def parsed(nodes: DataFrame, edges: DataFrame, d: Descriptor = Descriptor(), after: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Units with parent_id, child_ids, builds_towards and builds_from.

    ``after`` gets the units and the raw nodes and returns the units to keep, as those of ``PRUNES`` do.
    """
    rows = units(nodes, d)
    links, ahead = containment(edges, rows, d), progression(edges, rows, d)
    listed = lambda by, item, name: ahead.groupBy(F.col(by).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", item))), lambda x: x[item]).alias(name))
    out = rows.join(parents(links), "id", "left").join(children(links), "id", "left").join(listed("src", "dst", "builds_towards"), "id", "left").join(listed("dst", "src", "builds_from"), "id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("child_ids", "builds_towards", "builds_from")})
    return out if after is None else after(out, nodes)


def model_roots(unit_rows: DataFrame) -> DataFrame:
    """Units whose parent is none or not a unit."""
    known = unit_rows.select(F.col("id").alias("parent_id"))
    return unit_rows.join(known, "parent_id", "left_anti")


def pruned(unit_rows: DataFrame, root_kinds: list[str], leaf_kinds: list[str], content_kinds: list[str], component_kind: str, links: DataFrame | None = None) -> DataFrame:
    """Units that matter below the roots.

    Kept: what the roots reach through children, not below leaf kinds; leaves with a kept content child;
    components whose parent is kept. Components of components are judged by what was kept before them.
    ``links`` (parent, child) are the units' children as rows; without them the units' own lists are taken.
    """
    held = unit_rows.select("id", F.explode("child_ids").alias("c")) if links is None else links.select(F.col("parent").alias("id"), F.col("child").alias("c"))
    ways = held.select(F.col("id").alias("a"), F.col("c").alias("b"))
    inner = unit_rows.where(~F.col("kind").isin(*leaf_kinds)).select("id")
    starts = unit_rows.where(F.col("kind").isin(*root_kinds)).select("id")
    kept = traverse.closure(starts, ways, through=inner, together=True).select("id")
    content = unit_rows.where(F.col("kind").isin(*content_kinds)).select("id").join(kept, "id", "left_semi")
    leaves = held.join(unit_rows.where(F.col("kind").isin(*leaf_kinds)).select("id"), "id", "left_semi").join(content.select(F.col("id").alias("c")), "c", "left_semi").select("id")
    kept = kept.unionByName(leaves).distinct()
    parts = unit_rows.where(F.col("kind") == component_kind).join(kept.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id")
    return unit_rows.join(kept.unionByName(parts).distinct(), "id", "left_semi")


#: Kinds that a profile's rule is about.
LEAF_KINDS, CONTENT_KINDS, COMPONENT_KIND = ["Standard"], ["Lesson", "Activity"], "LearningComponent"


def _below_roots(rule: dict) -> Callable[[DataFrame, DataFrame], DataFrame]:
    roots = rule.get("rootKinds")
    if not isinstance(roots, list) or not roots or not all(isinstance(k, str) and k for k in roots):
        raise ValueError("rootKinds: a list of kinds is needed")
    return lambda unit_rows, nodes: pruned(unit_rows, roots, LEAF_KINDS, CONTENT_KINDS, COMPONENT_KIND)


#: Rules that a profile may name; others can be added. Each makes a step after parsing of its parameters.
PRUNES = {"content-reachable-from-roots": _below_roots}


def prune_of(rule: dict | None) -> Callable[[DataFrame, DataFrame], DataFrame] | None:
    """The step that a profile's ``prune`` names; ValueError for an unknown one or wrong parameters."""
    if rule is None:
        return None
    if rule.get("strategy") not in PRUNES:
        raise ValueError(f"strategy: one of {', '.join(PRUNES)}")
    return PRUNES[rule["strategy"]](rule)


def serialised(nodes: DataFrame, edges: DataFrame, unit_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored rows: nodes with ``spine`` (is a unit), edges with deterministic ids, repeated ones suffixed by their place."""
    spine = unit_rows.select("id", F.lit(True).alias("spine"))
    stored = nodes.join(spine, "id", "left").withColumn("spine", F.coalesce("spine", F.lit(False)))
    again = F.row_number().over(Window.partitionBy("type", "src", "dst").orderBy("seq"))
    base = F.concat("type", F.lit(":"), "src", F.lit("->"), "dst")
    # seq counts from 1; the suffix is the place from 0.
    links = edges.withColumn("identifier", F.col("id")).withColumn("id", F.when(again > 1, F.concat(base, F.lit("#"), (F.col("seq") - 1).cast("string"))).otherwise(base))
    return stored, links


def spine_edges(unit_rows: DataFrame) -> DataFrame:
    """Edges made of the units' own lists, with their places."""
    def listed(column: str, kind: str) -> DataFrame:
        return unit_rows.select(F.col("id").alias("src"), F.posexplode(column).alias("place", "dst")).select(
            F.concat(F.lit(f"{kind}:"), "src", F.lit("->"), "dst").alias("id"), F.lit(kind).alias("type"), "src", "dst", "place"
        )

    return listed("child_ids", "hasChild").unionByName(listed("builds_towards", "buildsTowards"))


def spine_rows(links: DataFrame, ahead: DataFrame) -> DataFrame:
    """As ``spine_edges``, from links and progression as rows, which a unit of any size can have."""
    def listed(rows: DataFrame, kind: str, *order: str) -> DataFrame:
        at = placed(rows, "src", *order).withColumn("place", F.col("place").cast("int"))
        return at.select(F.concat(F.lit(f"{kind}:"), "src", F.lit("->"), "dst").alias("id"), F.lit(kind).alias("type"), "src", "dst", "place")

    below = links.select(F.col("parent").alias("src"), F.col("child").alias("dst"), "phase", "seq")
    return listed(below, "hasChild", "phase", "seq").unionByName(listed(ahead.select("src", "dst", "seq"), "buildsTowards", "seq"))


def raw_envelope(stored: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inverse of ``serialised``: raw nodes, and raw edges under their own ids, in order of seq, nulls last."""
    own = F.coalesce("identifier", "id") if "identifier" in links.columns else F.col("id")
    return stored.select("id", "labels", "props"), links.withColumn("id", own).select("id", "type", "src", "dst", "seq").orderBy(F.col("seq").asc_nulls_last())


def placed_stored_children(links: DataFrame, place: str = "place") -> DataFrame:
    """As ``ordered_children``, as rows (id, place, child) counted from 0."""
    at = F.coalesce(F.col(place).cast("double"), F.col("seq").cast("double"))
    found = placed(links.select(F.col("src").alias("id"), at.alias("at"), "seq", F.col("dst").alias("child")), "id", "at", "seq")
    return found.select("id", F.col("place").cast("int").alias("place"), "child")


def ordered_children(links: DataFrame, place: str = "place") -> DataFrame:
    """(id, child_ids) from stored edges: by their place, else by arrival."""
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(place).cast("double"), F.col("seq").cast("double")).alias("p"), "seq", "dst")))
    return links.groupBy(F.col("src").alias("id")).agg(F.transform(ordered, lambda x: x["dst"]).alias("child_ids"))
