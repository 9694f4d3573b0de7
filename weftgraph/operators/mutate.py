"""Mutations of a graph: pure changes of node and edge tables, and the two steps around them.

A mutation checks its arguments against the base and the result, and returns the new tables; nothing is
written. ``Workflow`` adds the dry run that returns a token, and the confirmation that holds the token
against name, arguments, time, repetition, and the hash of the base.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import scratch
from weftgraph.functions.jsontext import dumps, set_paths, touches
from weftgraph.operators import overlay, traverse
from weftgraph.operators.ordering import placed
from weftgraph.operators.pending import Pending

#: Edge types that are known without being observed.
EDGE_TYPES = ("hasChild", "hasPart", "supports", "buildsTowards", "hasDependency", "hasEducationalAlignment", "relatesTo", "usesRoutine", "covers")
# Paths that a free edit must not touch, as they say what a node is or have an argument of their own.
PROTECTED = ("normalizedType", "normalizedStatementType", "metadata.role", "identifier", "position", "metadata.order", "description", "content")
#: Where a node's position is kept; each place that it has is written.
POSITION_PATHS = ("position", "metadata.order")
GROUPING_LABELS = ("Course", "LessonGrouping", "StandardsFramework")
ROUTINE_USERS = ("Lesson", "Course", "Activity")
TOKEN_SECONDS, REPLAY_SECONDS = 15 * 60, 24 * 3600


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


class Rejected(ValueError):
    """A mutation that may not be applied; ``errors`` says why."""

    def __init__(self, *errors: str):
        super().__init__("; ".join(errors))
        self.errors = list(errors)


def _spark(g: Graph) -> SparkSession:
    return g.nodes.sparkSession


def _missing(g: Graph, ids: Sequence[str]) -> list[str]:
    there = {r.id for r in g.nodes.where(F.col("id").isin(list(ids))).select("id").collect()}
    return [i for i in dict.fromkeys(ids) if i not in there]


def node_rows(spark: SparkSession, rows: Sequence[tuple[str, str, Sequence[str], dict]]) -> DataFrame:
    """Node table of (id, type, labels, properties)."""
    return spark.createDataFrame([(i, t, list(ls), dumps(p)) for i, t, ls, p in rows], "id string, type string, labels array<string>, props string")


def is_protected(path: Column) -> Column:
    """Whether a free edit of a dotted path would touch a protected one: the path itself, what is inside it, or what holds it."""
    held = F.array(*map(F.lit, PROTECTED))
    return F.exists(held, lambda p: (path == p) | F.startswith(path, F.concat(p, F.lit("."))) | F.startswith(p, F.concat(path, F.lit("."))))


def edge_table(edges: DataFrame) -> DataFrame:
    """The edges' columns, properties among them; null where the input has none."""
    return overlay.filled(edges, overlay.EDGE_CONTENT).select("id", *overlay.EDGE_CONTENT)


def edge_rows(spark: SparkSession, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Edge table of (type, src, dst), without properties."""
    return spark.createDataFrame([(f"{t}:{a}->{b}", t, a, b, None) for t, a, b in rows], "id string, type string, src string, dst string, props string")


def create_node(g: Graph, node_id: str, kind: str, props: dict) -> Graph:
    """Adds a node of a kind that the graph has."""
    errors = [] if g.nodes.where(F.col("type") == kind).take(1) else [f"unknown kind {kind!r}"]
    if not _missing(g, [node_id]):
        errors.append(f"node {node_id!r} exists")
    if errors:
        raise Rejected(*errors)
    return Graph(g.nodes.select("id", "type", "labels", "props").unionByName(node_rows(_spark(g), [(node_id, kind, [kind], props)])), g.edges)


def create_edges(g: Graph, wanted: Sequence[tuple[str, str, str]]) -> Graph:
    """Adds edges (type, src, dst), all or none: ends exist, types are known, no loops, none twice."""
    errors = ["no edges given"] if not wanted else []
    observed = {r.type for r in g.edges.select("type").distinct().collect()} | set(EDGE_TYPES)
    errors += [f"node {i!r} not found" for i in _missing(g, [i for _, a, b in wanted for i in (a, b)])]
    errors += [f"unknown edge type {t!r}" for t in dict.fromkeys(t for t, _, _ in wanted) if t not in observed]
    errors += [f"loop on {a!r}" for _, a, b in wanted if a == b]
    errors += [f"edge {x} given twice" for x in {w for w in wanted if list(wanted).count(w) > 1}]
    new = edge_rows(_spark(g), list(dict.fromkeys(wanted)) or [("", "", "")])
    errors += [f"edge {r.id!r} exists" for r in g.edges.join(new.select("id"), "id", "left_semi").select("id").collect()]
    if errors:
        raise Rejected(*errors)
    return Graph(g.nodes, edge_table(g.edges).unionByName(new))


def delete_edges(g: Graph, ids: Sequence[str]) -> Graph:
    """Removes edges, all or none."""
    there = {r.id for r in g.edges.where(F.col("id").isin(list(ids))).select("id").collect()}
    errors = ["no edges given"] if not ids else []
    errors += [f"edge {i!r} not found" for i in dict.fromkeys(ids) if i not in there] + [f"edge {i!r} given twice" for i in {i for i in ids if list(ids).count(i) > 1}]
    if errors:
        raise Rejected(*errors)
    return Graph(g.nodes, g.edges.where(~F.col("id").isin(list(ids))))


def delete_nodes(g: Graph, ids: Sequence[str]) -> Graph:
    """Removes nodes, what only they contain, and every edge that touches a removed node."""
    errors = ["no nodes given"] if not ids else [f"node {i!r} not found" for i in _missing(g, ids)]
    if errors:
        raise Rejected(*errors)
    gone = traverse.cascade(g.nodes.where(F.col("id").isin(list(ids))), g.edges)
    edges = g.edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return Graph(g.nodes.join(gone, "id", "left_anti"), edge_table(edges))


def cascade_warnings(g: Graph, ids: Sequence[str], shown: int = 8) -> list[str]:
    """What a deletion takes along, if that is more than was named: how many nodes and edges, and the first of the nodes."""
    gone = scratch.written(traverse.cascade(g.nodes.where(F.col("id").isin(list(ids))), g.edges), "gone")
    n = gone.count()
    touched = g.edges.join(gone.select(F.col("id").alias("src")), "src", "left_semi").select("id").unionByName(
        g.edges.join(gone.select(F.col("id").alias("dst")), "dst", "left_semi").select("id")
    )
    edges = touched.distinct().count()
    if n <= len(set(ids)) and not edges:
        return []
    named = [r.id for r in gone.orderBy(~F.col("id").isin(list(ids)), "id").limit(shown).collect()]
    return [f"removes {n} node(s) and {edges} edge(s): {', '.join(named)}{', …' if n > shown else ''}"]


def add_nodes(g: Graph, items: Sequence[dict]) -> Graph:
    """Adds nodes {id, label, props, parent?, edge?, align_to?} below existing parents, all or none.

    Positions follow the largest one among the parent's children, in the order given; ``supports`` hangs a
    node by an edge from it to its parent.
    """
    errors = ["no nodes given"] if not items else []
    labels = {x for r in g.nodes.select(F.explode("labels").alias("x")).distinct().collect() for x in (r.x,)}
    ids = [i["id"] for i in items]
    taken = set(ids) - set(_missing(g, ids))
    errors += [f"node {i!r} exists" for i in ids if i in taken or ids.count(i) > 1]
    errors += [f"unknown label {i['label']!r}" for i in items if i["label"] not in labels]
    errors += [f"node {i!r} not found" for i in _missing(g, [x for i in items for x in (i.get("parent"), i.get("align_to")) if x])]
    if errors:
        raise Rejected(*errors)
    below = g.edges.where(F.col("src").isin([i["parent"] for i in items if i.get("parent")]) & F.col("type").isin("hasPart", "hasChild")).select(F.col("src").alias("parent"), F.col("dst").alias("id"))
    last = next_positions(g.nodes, below)
    after = {r.parent: r.next_position for r in last.collect()}
    rows, links = [], []
    for i in items:
        props, parent, kind = dict(i.get("props") or {}), i.get("parent"), i.get("edge", "hasPart")
        if parent:
            at = after.get(parent, 1)
            after[parent] = at + 1
            props.setdefault("position", at)
            links.append((kind, i["id"], parent) if kind == "supports" else (kind, parent, i["id"]))
        if i.get("align_to"):
            links.append(("hasEducationalAlignment", i["id"], i["align_to"]))
        rows.append((i["id"], i["label"], [i["label"]], props))
    spark = _spark(g)
    nodes = g.nodes.select("id", "type", "labels", "props").unionByName(node_rows(spark, rows))
    edges = edge_table(g.edges)
    return Graph(nodes, edges.unionByName(edge_rows(spark, links)) if links else edges)


def created_props(template: dict, name: str | None, position: float, identifier: str | None = None, name_en: str | None = None, assessment: bool = False, extra: dict | None = None) -> dict:
    """Properties of a new node in the stored form: normalised fields beside the raw ones, from which a parser makes them again. Absent values leave no key.

    ``template``: grouping (whether the label groups lessons), boilerplate (raw fields that all nodes of the label share), order_paths (dotted paths that
    hold the position), type, statement_type and role. ``extra`` has the last word on raw fields.
    """
    raw = dict(template.get("boilerplate") or {})
    props: dict = {"title" if template.get("grouping") else "text": name, "position": position, "isAssessment": True if assessment else None}
    raw |= {k: v for k, v in {"identifier": identifier, "description": name}.items() if v is not None}
    props["raw"] = raw
    meta = {"raw.metadata.en.description": name_en, **dict.fromkeys(template.get("order_paths") or (), position)}
    meta |= {"raw.normalizedType": template.get("type"), "raw.normalizedStatementType": template.get("statement_type"), "raw.metadata.role": template.get("role")}
    for path, value in (meta | {f"raw.{k}": v for k, v in (extra or {}).items()}).items():
        if value is None:
            continue
        *above, last = path.split(".")
        at = props
        for k in above:
            at[k] = dict(at[k]) if isinstance(at.get(k), dict) else {}
            at = at[k]
        at[last] = value
    return {k: v for k, v in props.items() if v is not None}


def next_positions(nodes: DataFrame, below: DataFrame) -> DataFrame:
    """(parent, next_position): one more than the largest position of its children, at least 1. ``below``: (parent, id)."""
    at = F.get_json_object("props", "$.position").cast("double")
    held = below.join(nodes.select("id", at.alias("at")), "id")
    return held.groupBy("parent").agg((F.greatest(F.coalesce(F.max("at"), F.lit(0.0)), F.lit(0.0)) + 1).alias("next_position"))


def move_node(g: Graph, node: str, parent: str, kind: str = "hasPart", position: float | None = None) -> Graph:
    """Takes a node off all containers and puts it below another one."""
    if errors := [f"node {i!r} not found" for i in _missing(g, [node, parent])]:
        raise Rejected(*errors)
    inside = traverse.closure(g.nodes.where(F.col("id") == node).select("id"), traverse.steps(g.edges, "out", ["hasPart", "hasChild"]))
    if inside.where(F.col("id") == parent).take(1):
        raise Rejected(f"{parent!r} is inside {node!r}")
    kept = edge_table(g.edges.where(~((F.col("dst") == node) & F.col("type").isin("hasPart", "hasChild"))))
    moved = Graph(g.nodes, kept.unionByName(edge_rows(_spark(g), [(kind, parent, node)])))
    return moved if position is None else edit_node(moved, node, position=position)


def edit_node(
    g: Graph, node: str, properties: dict[str, object] | None = None, *, content: str | None = None, position: float | None = None, title: str | None = None,
    title_en: str | None = None, summary: str | None = None,
) -> Graph:
    """Edits a node: values at dotted paths of its properties, protected ones refused, and fields with an argument of their own.

    These are written to every place that mirrors them: a position to each ordinal that the node has, a title to its
    description and to the title or text that is kept beside it.
    """
    from weftgraph.functions.jsontext import read_path, write_path

    bag = dict(properties or {})
    fields = {"content": content, "title": title, "summary": summary}
    errors = [f"node {i!r} not found" for i in _missing(g, [node])]
    if not bag and position is None and title_en is None and all(v is None for v in fields.values()):
        errors.append("no changes given")
    errors += ["empty key" for k in bag if not k] + [f"{p!r} is protected" for p in bag if any(touches(p, q) for q in PROTECTED)]
    errors += [f"{k} must be a text that is not empty" for k, v in fields.items() if v is not None and (not isinstance(v, str) or not v)]
    if position is not None and (isinstance(position, bool) or not isinstance(position, (int, float)) or position != position or abs(position) == float("inf")):
        errors.append("position must be a number")
    if errors:
        raise Rejected(*errors)
    row = g.nodes.where(F.col("id") == node).first()
    value = json.loads(row.props or "{}")
    if position is not None:
        for path in [p for p in POSITION_PATHS if read_path(value, p) is not None] or POSITION_PATHS[:1]:
            value = write_path(value, path, position)
        if "order" in value:
            value = write_path(value, "order", position)
    if content is not None:
        value = write_path(value, "content", content)
    if title is not None:
        value = write_path(value, "description", title)
        beside = "title" if set(row.labels or []) & set(GROUPING_LABELS) else "text"
        value = write_path(value, beside, title) if beside in value else value
    if title_en is not None:
        value = write_path(value, "metadata.en.description", title_en)
    if summary is not None:
        value = write_path(value, "metadata.summary", summary)
    for path, new in bag.items():
        value = write_path(value, path, new)
    fixed = F.when(F.col("id") == node, F.lit(dumps(value))).otherwise(F.col("props"))
    return Graph(g.nodes.withColumn("props", fixed), g.edges)


def edit_many(g: Graph, changes: DataFrame) -> Graph:
    """Text edits (id, changes map of path to text) of any number of nodes in one plan."""
    rows = g.nodes.join(changes.withColumnRenamed("changes", "_set"), "id", "left")
    return Graph(rows.withColumn("props", F.when(F.col("_set").isNull(), F.col("props")).otherwise(set_paths("props", "_set"))).drop("_set"), g.edges)


def use_routine(g: Graph, target: str, clone: Graph, root: str) -> Graph:
    """Appends a cloned routine and the edge by which a lesson, course or activity uses it."""
    found = g.nodes.where(F.col("id") == target).select("labels").take(1)
    if not found:
        raise Rejected(f"node {target!r} not found")
    if not set(found[0].labels) & set(ROUTINE_USERS):
        raise Rejected(f"{target!r} cannot use a routine")
    return _appended(g, clone, ("usesRoutine", target, root))


def use_in_document(g: Graph, document: str, clone: Graph, root: str) -> Graph:
    """Appends a cloned formatter or rubric below a document."""
    if not g.nodes.where((F.col("id") == document) & F.array_contains("labels", "TeachingLearningMaterial")).take(1):
        raise Rejected(f"{document!r} is not a document")
    return _appended(g, clone, ("hasPart", document, root))


def _appended(g: Graph, clone: Graph, link: tuple[str, str, str]) -> Graph:
    edges = edge_table(g.edges).unionByName(edge_table(clone.edges)).unionByName(edge_rows(_spark(g), [link]))
    return Graph(g.nodes.select("id", "type", "labels", "props").unionByName(clone.nodes), edges)


def structural_errors(published: Graph, after: Graph) -> list[str]:
    """Disguised renames against the published graph, and edges that point nowhere."""
    errors = [f"{r.removed_id!r} comes back as {r.added_id!r}" for r in overlay.renamed(published.nodes, after.nodes).limit(20).collect()]
    errors += [f"edge {r.removed_id!r} comes back as {r.added_id!r}" for r in overlay.renamed(published.edges, after.edges, overlay.EDGE_CONTENT).limit(20).collect()]
    return errors + [f"edge {r.id!r} points to {r.missing!r}" for r in overlay.dangling(after.edges, after.nodes).limit(20).collect()]


def templates(nodes: DataFrame) -> DataFrame:
    """(label, example, keys): for each label its first node by id, and the property names that a new one would have."""
    first = nodes.select(F.explode("labels").alias("label"), "id", "props").groupBy("label").agg(F.min(F.struct("id", "props")).alias("m"))
    keys = F.sort_array(F.coalesce(F.json_object_keys("m.props"), F.array().cast("array<string>")))
    return first.select("label", F.col("m.id").alias("example"), keys.alias("keys"))


def containment_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, edge_type): by which edge nodes of a label hang below their container; of several the commonest.

    A component hangs by ``supports``, from itself to what it supports.
    """
    down = edges.where(F.col("type").isin("hasPart", "hasChild")).select(F.col("dst").alias("id"), F.col("type").alias("edge_type"))
    up = edges.where(F.col("type") == "supports").select(F.col("src").alias("id"), F.col("type").alias("edge_type"))
    labels = nodes.select("id", F.explode("labels").alias("label"))
    counted = down.unionByName(up).join(labels, "id").groupBy("label", "edge_type").agg(F.count("*").alias("n"))
    return counted.groupBy("label").agg(F.min_by("edge_type", F.struct(-F.col("n"), "edge_type")).alias("edge_type"))


def running_positions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, place): children in order of position and id, counted from 1."""
    at = F.coalesce(F.get_json_object("props", "$.position").cast("double"), F.lit(0.0))
    rows = edges.where(F.col("type") == "hasPart").join(nodes.select(F.col("id").alias("dst"), at.alias("at")), "dst")
    found = placed(rows.select("src", "dst", "at"), "src", "at", "dst")
    return found.select("src", "dst", (F.col("place") + 1).cast("int").alias("place"))


class Workflow:
    """Dry run and confirmation. ``clock`` returns seconds.

    Previewed arguments, used tokens and replies are in the folder ``root``, where they expire (see ``pending``), so they hold in every process and after a
    restart; without a folder a passing one of the session is taken.
    """

    def __init__(self, clock: Callable[[], float], root: str | None = None):
        self.clock, self.root = clock, root

    def _pending(self, g: Graph) -> Pending:
        if self.root is None:
            self.root = scratch.new_path(_spark(g), "workflow")
        return Pending(_spark(g), self.root, self.clock)

    def preview(
        self, name: str, base: Graph, published: Graph, args: dict, apply: Callable[[Graph, dict], Graph], full: bool = False,
        warn: Callable[[Graph, dict], list[str]] | None = None,
    ) -> dict:
        """What a mutation would change, and a token to confirm it; blocked without one if it breaks the graph.

        ``full``: with the difference itself, a table, beside its counts. ``warn`` finds what a reader should know before confirming.
        """
        try:
            after = apply(base, args)
        except Rejected as e:
            return {"status": "blocked", "errors": e.errors}
        if errors := structural_errors(published, after):
            return {"status": "blocked", "errors": errors}
        version = overlay.graph_hash(*base).first().hash
        token = {"m": name, "a": _digest(args), "v": version, "n": uuid.uuid4().hex, "exp": self.clock() + TOKEN_SECONDS}
        self._pending(base).claim("arguments", token["n"], args, TOKEN_SECONDS)
        diff = overlay.whole_difference(base, after)
        shown = {"status": "preview", "counts": overlay.counts_of(diff).first().asDict(), "token": base64.urlsafe_b64encode(dumps(token).encode()).decode()}
        return shown | {"warnings": warn(base, args) if warn else []} | ({"difference": diff} if full else {})

    def confirm(self, name: str, base: Graph, args: dict | None, token: str, apply: Callable[[Graph, dict], Graph], key: str | None = None) -> tuple[str, Graph | None]:
        """("applied", graph), or why not. A changed base is told before an old token. Without arguments those of the preview are taken.

        ``key``: a repeated call with the same key and arguments gets the same graph again, for a day.
        """
        try:
            t = json.loads(base64.urlsafe_b64decode(token))
            named, digest, version, nonce, until = t["m"], t["a"], t["v"], t["n"], t["exp"]
        except (ValueError, KeyError, TypeError):
            return "malformed token", None
        pending = self._pending(base)
        if named != name:
            return "token of another mutation", None
        if args is None and (args := pending.get("arguments", nonce)) is None:
            return "expired", None
        if digest != _digest(args):
            return "arguments differ", None
        if key is not None and (reply := pending.get("replies", key)) is not None:
            return ("applied", self._stored(base, reply["folder"])) if reply["arguments"] == digest else ("key of other arguments", None)
        if pending.get("nonces", nonce) is not None:
            return "token used before", None
        if overlay.graph_hash(*base).first().hash != version:
            return "stale", None
        if self.clock() > until:
            return "expired", None
        after = apply(base, args)
        if not pending.claim("nonces", nonce, {}, TOKEN_SECONDS):
            return "token used before", None
        pending.drop("arguments", nonce)
        if key is not None:
            folder = f"{self.root}/reply-{uuid.uuid4().hex}"
            after.nodes.write.parquet(f"{folder}/nodes")
            edge_table(after.edges).write.parquet(f"{folder}/edges")
            pending.claim("replies", key, {"arguments": digest, "folder": folder}, REPLAY_SECONDS)
        return "applied", after

    def sweep(self, spark: SparkSession) -> int:
        """Removes what has expired, replies with their tables; how many values went."""
        if self.root is None:
            return 0
        gone = Pending(spark, self.root, self.clock).sweep()
        for value in gone:
            if "folder" in value:
                scratch.remove(spark, value["folder"])
        return len(gone)

    @staticmethod
    def _stored(g: Graph, folder: str) -> Graph:
        return Graph(*(_spark(g).read.parquet(f"{folder}/{side}") for side in ("nodes", "edges")))


def _digest(args: dict) -> str:
    return hashlib.sha256(dumps(args).encode()).hexdigest()
