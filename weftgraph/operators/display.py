"""Display projection of a graph and the views derived from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.ordering import chains, placed
from weftgraph.operators.traverse import closure

#: Edge types drawn on another axis than their own, and whether they are drawn from target to source.
DRAWN = {
    "hasPart": ("hasChild", False), "usesRoutine": ("hasChild", False), "supports": ("hasChild", True), "hasEducationalAlignment": ("hasChild", True),
    "hasDependency": ("buildsTowards", True),
}
# The label of a node that has none, by its kind.
LABEL_OF_KIND = {
    "domaine": "StandardsFrameworkItem", "chapter": "StandardsFrameworkItem", "lesson": "StandardsFrameworkItem", "standard": "StandardsFrameworkItem",
    "week": "StandardsFrameworkItem", "component": "LearningComponent", "task": "Activity",
}
#: Alignment is followed from content to what it is aligned with; support from a standard to its components.
ALIGNMENTS, SUPPORT = ("hasEducationalAlignment", "illustrates"), "supports"


def display_nodes(nodes: DataFrame) -> DataFrame:
    """What a card shows: id, label, code, ord, text and text_en, nt (normalised type), st and st_en (statement type), source.

    The first property that is there counts, also an empty one. Only JSON numbers are an order.
    """
    first = lambda *keys: F.coalesce(*(F.get_json_object("props", f"$.{k}") for k in keys), F.lit(""))
    kind = F.coalesce(*(F.when(F.col("type") == k, v) for k, v in LABEL_OF_KIND.items()), F.col("type"))
    number = lambda text: F.from_json(text, "order double")["order"]
    return nodes.select(
        "id", F.coalesce(F.nullif(F.get(F.col("labels"), 0), F.lit("")), kind).alias("label"), first("code", "statementCode", "identifier").alias("code"),
        F.coalesce(number(F.col("props")), number(F.get_json_object("props", "$.metadata"))).alias("ord"),
        first("text", "title", "description", "osTexte").alias("text"), first("metadata.en.description", "metadata.en.os_texte").alias("text_en"),
        first("normalizedType", "normalizedStatementType", "contentType").alias("nt"), first("statementType").alias("st"),
        first("metadata.en.statement_type").alias("st_en"), first("sourceKey").alias("source"),
    )


def edge_order(edges: DataFrame) -> Column:
    """An edge's place: its own order in the parent, else in the sequence, else ``seq``, else 0. ``props`` and ``seq`` may be missing."""
    found = [F.from_json("props", f"{k} double")[k] for k in ("orderInParent", "sequenceInFrom")] if "props" in edges.columns else []
    return F.coalesce(*found, *([F.col("seq").cast("double")] if "seq" in edges.columns else []), F.lit(0.0))


def flat_props(nodes: DataFrame) -> DataFrame:
    """(id, props map): top-level properties without metadata, then metadata without its translation; the latter wins."""
    whole = F.from_json("props", "map<string,string>")
    meta = F.from_json(F.get_json_object("props", "$.metadata"), "map<string,string>")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    inner = F.coalesce(F.map_filter(meta, lambda k, v: (k != "en") & v.isNotNull()), empty)
    outer = F.map_filter(F.coalesce(whole, empty), lambda k, v: (k != "metadata") & v.isNotNull() & ~F.map_contains_key(inner, k))
    return nodes.select("id", F.map_concat(outer, inner).alias("props"))


def display_edges(nodes: DataFrame, edges: DataFrame, illustrates: DataFrame | None = None) -> DataFrame:
    """(src, dst, rel, type, ord): edges as drawn between shown nodes, on the axis ``rel``; ``type`` is what they are, ``ord`` where.

    ``illustrates`` (activity, component, and ord if known): such an activity hangs below its component instead of below what it is
    aligned with, and is no longer drawn below its frame; a component that is not shown changes nothing.
    """
    ids = nodes.select("id")
    rows = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    axis = F.coalesce(*(F.when(F.col("type") == k, r) for k, (r, _) in DRAWN.items()), F.col("type"))
    turned = F.col("type").isin(*(k for k, (_, back) in DRAWN.items() if back))
    a, b = F.when(turned, F.col("dst")).otherwise(F.col("src")), F.when(turned, F.col("src")).otherwise(F.col("dst"))
    kind = F.when(F.col("type") == "hasDependency", "buildsTowards").otherwise(F.col("type"))
    drawn = rows.select(a.alias("src"), b.alias("dst"), axis.alias("rel"), kind.alias("type"), edge_order(edges).alias("ord"))
    if illustrates is None:
        return drawn
    known = illustrates.join(ids.select(F.col("id").alias("component")), "component", "left_semi").select(F.col("activity").alias("dst"), "component", (F.col("ord").cast("double") if "ord" in illustrates.columns else F.lit(0.0)).alias("own"))
    moved = drawn.join(known, "dst", "left")
    hung, framed = F.col("component").isNotNull() & (F.col("type") == "hasEducationalAlignment"), F.col("component").isNotNull() & (F.col("type") == "hasChild")
    return moved.where(~framed).select(F.when(hung, F.col("component")).otherwise(F.col("src")).alias("src"), "dst", "rel", F.when(hung, "illustrates").otherwise(F.col("type")).alias("type"), F.when(hung, F.col("own")).otherwise(F.col("ord")).alias("ord"))


def scoped_subtree(drawn: DataFrame, start: DataFrame, most_depth: int = 4) -> DataFrame:
    """(id, depth): what is drawn below a start to a depth, then, without one, what that is aligned with and its components."""
    ways = drawn.where("rel = 'hasChild'")
    held = closure(start, ways.select(F.col("src").alias("a"), F.col("dst").alias("b")), min(max(most_depth, 1), 12), together=True).select("id", "depth")
    up = ways.where(F.col("type").isin(*ALIGNMENTS)).select(F.col("dst").alias("a"), F.col("src").alias("b"))
    down = ways.where(F.col("type") == SUPPORT).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    beyond = closure(held.select("id"), up.unionByName(down), together=True).select("id").join(held, "id", "left_anti")
    return held.unionByName(beyond.withColumn("depth", F.lit(None).cast("int")))


def grafted(drawn: DataFrame, shown: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(parent, child): the extra children by rules (label, type, "out" or "in"); each node is expanded once, below however many it hangs.

    The first rule of a label applies to every node of it, so targets that match another rule are expanded in turn.
    """
    parts, first = [], {}
    for rule in rules:
        first.setdefault(rule[0], rule)
    for label, kind, way in first.values():
        a, b = ("src", "dst") if way == "out" else ("dst", "src")
        of = shown.where(F.col("label") == label).select(F.col("id").alias(a))
        parts.append(drawn.where(F.col("type") == kind).join(of, a, "left_semi").select(F.col(a).alias("parent"), F.col(b).alias("child")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def taxonomy(shown: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(label, n, place): counts by label, the fixed order first, unknown labels after it by name."""
    place = F.coalesce(*(F.when(F.col("label") == x, i) for i, x in enumerate(order)), F.lit(len(order)))
    return shown.groupBy("label").agg(F.count("*").alias("n")).withColumn("place", place)


def chips(shown: DataFrame, drawn: DataFrame, order: tuple[str, ...], allowed: list[str] | None = None) -> DataFrame:
    """(chip, n, place): nodes of the allowed sources, their number by label in a fixed order, and the edges among them."""
    seen = shown if allowed is None else shown.where(source_allowed(allowed) | (F.col("source") == ""))
    ids = seen.select("id")
    links = drawn.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    by_label = taxonomy(seen, order).where(F.col("place") < len(order)).select(F.col("label").alias("chip"), "n", (F.col("place") + 1).alias("place"))
    total = lambda rows, name, place: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("chip"), "n", F.lit(place).alias("place"))
    return total(seen, "nodes", 0).unionByName(by_label).unionByName(total(links, "edges", len(order) + 1))


def sources(shown: DataFrame) -> DataFrame:
    return shown.where("source IS NOT NULL AND source <> ''").select("source").distinct()


def source_allowed(allowed: list[str]) -> Column:
    """Nodes without a source always pass."""
    return F.col("source").isNull() | F.col("source").isin(*allowed)


def grouped(rows: DataFrame, levels: list[str], anchor: str = "id") -> DataFrame:
    """Nested buckets: one row for each combination of levels, with the count and the first anchor."""
    return rows.groupBy(*levels).agg(F.count("*").alias("n"), F.min(anchor).alias("first"))


def bucket_order(name: Column, fixed: tuple[str, ...] = ()) -> list[Column]:
    """Sort keys of bucket names: a fixed order first, then numbers by value, then other names."""
    place = F.coalesce(*(F.when(name == x, i) for i, x in enumerate(fixed)), F.lit(len(fixed)))
    number = F.when(name.rlike(r"^-?\d+(\.\d+)?$"), name.cast("double"))
    return [place, number.asc_nulls_last(), name]


def card_order(shown: DataFrame) -> DataFrame:
    """Nodes by number, then by code with its digits read as numbers."""
    from weftgraph.functions.text import natural_key

    return shown.orderBy(F.coalesce("ord", F.lit(0.0)), natural_key(F.col("code")), "id")


def kind_rows(shown: DataFrame) -> DataFrame:
    """(label, place, id): the nodes of each kind in order of number and code, counted from 0, as the view by kind lists them."""
    from weftgraph.functions.text import natural_key

    rows = shown.select("label", "id", F.coalesce("ord", F.lit(0.0)).alias("_ord"), natural_key(F.coalesce("code", F.lit(""))).alias("_code"))
    return placed(rows, "label", "_ord", "_code", "id").select("label", "place", "id")


def nested(rows: DataFrame, levels: list[str], *order: str | Column) -> DataFrame:
    """(depth, parent, bucket, n, anchor, place): nested buckets as rows, and below the innermost the anchors in their order.

    A bucket's name is the path of its levels' values, an absent value the empty text; ``parent`` is the bucket around it, null at the top.
    """
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    path = lambda k: F.concat_ws("/", *(value(c) for c in levels[:k])) if k else F.lit(None).cast("string")
    parts = [
        rows.groupBy(path(k).alias("parent"), path(k + 1).alias("bucket")).agg(F.count("*").alias("n")).select(F.lit(k).alias("depth"), "parent", "bucket", "n", F.lit(None).cast("string").alias("anchor"), F.lit(None).cast("bigint").alias("place"))
        for k in range(len(levels))
    ]
    anchors = placed(rows.withColumn("_bucket", path(len(levels))), "_bucket", *(order or ("id",)))
    parts.append(anchors.select(F.lit(len(levels)).alias("depth"), F.col("_bucket").alias("parent"), F.lit(None).cast("string").alias("bucket"), F.lit(1).cast("bigint").alias("n"), F.col("id").alias("anchor"), "place"))
    return reduce(DataFrame.unionByName, parts)


def by_kind(shown: DataFrame) -> DataFrame:
    return shown.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def label_tree(shown: DataFrame, drawn: DataFrame, labels: list[str], reverse: bool = False, root_kinds: list[str] | None = None, prune_to: str | None = None) -> DataFrame:
    """(root, id, depth): the tree over nodes with some labels; roots have no parent in it."""
    kept = shown.where(F.col("label").isin(*labels)).select("id", "label")
    a, b = ("dst", "src") if reverse else ("src", "dst")
    ways = drawn.where("rel = 'hasChild'").select(F.col(a).alias("a"), F.col(b).alias("b"))
    ways = ways.join(kept.select(F.col("id").alias("a")), "a", "left_semi").join(kept.select(F.col("id").alias("b")), "b", "left_semi")
    if prune_to is not None:
        wanted = kept.where(F.col("label") == prune_to).select("id")
        holding = closure(wanted, ways.select(F.col("b").alias("a"), F.col("a").alias("b")), together=True).select("id")
        kept = kept.join(holding, "id", "left_semi")
        ways = ways.join(holding.select(F.col("id").alias("b")), "b", "left_semi")
    roots = kept.join(ways.select(F.col("b").alias("id")), "id", "left_anti")
    if root_kinds:
        roots = roots.where(F.col("label").isin(*root_kinds))
    return closure(roots.select("id"), ways)


def progression(drawn: DataFrame) -> DataFrame:
    """(id): starts of progressions, that is, sources of buildsTowards that nothing builds towards."""
    ahead = drawn.where("rel = 'buildsTowards'")
    return ahead.select(F.col("src").alias("id")).distinct().join(ahead.select(F.col("dst").alias("id")), "id", "left_anti")


def search(shown: DataFrame, drawn: DataFrame, query: str, view_parents: DataFrame | None = None) -> DataFrame:
    """(id, matched): nodes of which a text in either language or the code holds the query, and those above them; none for an empty one.

    ``view_parents`` (id, parent_id): the one parent that a view hangs each node below, as ``ordering.last_parents`` finds it; without it all parents count.
    """
    q = query.lower().strip()
    hits = shown.where(F.lit(bool(q)) & F.greatest(*(F.contains(F.lower(c), F.lit(q)) for c in ("text", "text_en", "code")))).select("id")
    if view_parents is not None:
        return chains(hits, view_parents.select("id", F.col("parent_id").alias("parent"))).groupBy("id").agg((F.min("depth") == 0).alias("matched"))
    ways = drawn.where("rel = 'hasChild'").select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return closure(hits, ways, together=True).select("id", (F.col("depth") == 0).alias("matched"))


def detail(drawn: DataFrame, node: str) -> DataFrame:
    """(way, id): parents, children, and what one node builds towards and from."""
    way = F.when((F.col("rel") == "hasChild") & (F.col("dst") == node), "parent").when((F.col("rel") == "hasChild") & (F.col("src") == node), "child").when((F.col("rel") == "buildsTowards") & (F.col("src") == node), "builds_to").when((F.col("rel") == "buildsTowards") & (F.col("dst") == node), "built_from")
    return drawn.withColumn("way", way).where("way IS NOT NULL").select("way", F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("id")).distinct()


def between(drawn: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, rel, forward): how two nodes are related, and whether the edge runs from a to b."""
    ahead = drawn.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel", F.lit(True).alias("forward"))
    back = drawn.select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel", F.lit(False).alias("forward"))
    return pairs.join(ahead.unionByName(back), ["a", "b"])


def reveal(drawn: DataFrame, node: str, most: int = 50) -> DataFrame:
    """(id, depth): the chain of last parents, in the order of the edges, from a node to its root; at most so many levels."""
    parent = drawn.where("rel = 'hasChild'").groupBy(F.col("dst").alias("id")).agg(F.max_by("src", F.struct("ord", "src")).alias("parent"))
    start = drawn.sparkSession.createDataFrame([(node,)], "id string")
    return chains(start, parent).where(F.col("depth") <= most).select("id", F.col("depth").cast("int").alias("depth"))
