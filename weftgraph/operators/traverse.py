"""Traversal of node and edge tables, level by level.

Nodes are (id, type, labels, props), edges (id, type, src, dst). All results are DataFrames with
the shortest depth of each node. A level is one join of the frontier with the edges; nodes seen
before are dropped by an anti join, so cycles end. Levels are written to shared storage, which
keeps lineage short on deep graphs. Edges with an end that is not a node are never an
error: such ends are dropped where nodes are joined.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import scratch

MOST_LEVELS = 10_000
#: Rows of a frontier that are broadcast; more are shuffled.
MOST_BROADCAST = 200_000
#: Tables of levels that become one, so that a plan reads few tables however deep the graph is.
FAN = 16
#: Defaults and bounds of a walk.
DEPTH, MOST_DEPTH, LIMIT, MOST_LIMIT, PAGE_BYTES = 3, 10, 50, 500, 40 * 1024


def steps(edges: DataFrame, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """(edge_id, a, b): one row for each way an edge may be followed."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    if types:
        edges = edges.where(F.col("type").isin(types))
    out = edges.select(F.col("id").alias("edge_id"), F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.select(F.col("id").alias("edge_id"), F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"out": out, "in": back}.get(direction) if direction != "both" else out.unionByName(back)


def _together(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, (table for _, table in parts))


def _add(parts: list[tuple[int, DataFrame]], table: DataFrame) -> None:
    """Adds a level. ``FAN`` tables of one rank are written as one of the next rank, so a row is rewritten a logarithmic number of times."""
    parts.append((0, table))
    while len(parts) >= FAN and parts[-FAN][0] == parts[-1][0]:
        parts[-FAN:] = [(parts[-1][0] + 1, scratch.written(_together(parts[-FAN:]), "levels"))]


def _sent(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= MOST_BROADCAST else rows


def closure(starts: DataFrame, ways: DataFrame, most_depth: int | None = None, through: DataFrame | None = None, together: bool = False) -> DataFrame:
    """(root, id, depth) of all that each start reaches, itself at depth 0.

    ``starts`` has a column id. ``through``: only nodes in it (a column id) are walked on from;
    others are reached but are walls. ``together``: all starts are one root, the empty text, so each node is one row however many starts reach it.
    """
    ways = ways.select("a", "b")
    if through is not None:
        ways = ways.join(through.select(F.col("id").alias("a")), "a", "left_semi")
    frontier, n = scratch.counted(starts.select((F.lit("") if together else F.col("id")).alias("root"), "id").distinct().withColumn("depth", F.lit(0)), "level")
    parts = [(0, frontier)]
    for depth in range(MOST_LEVELS if most_depth is None else most_depth):
        if depth == 1 and (most_depth is None or most_depth > 4) and through is not None:
            ways = scratch.written(ways, "ways")  # joined once, read for each level
        # A small frontier goes to the edges where they lie; of a large one both sides are shuffled. Repeated edges end in ``distinct``.
        found = ways.join(_sent(frontier, n), F.col("id") == F.col("a")).select("root", F.col("b").alias("id")).distinct()
        seen = _together(parts).select("root", "id")
        frontier, n = scratch.counted(found.join(seen, ["root", "id"], "left_anti").withColumn("depth", F.lit(depth + 1)), "level")
        if not n:
            return _together(parts)
        _add(parts, frontier)
    if most_depth is None:
        raise RuntimeError(f"more than {MOST_LEVELS} levels")
    return _together(parts)


def reached(edges: DataFrame, from_id: str, direction: str = "out", types: list[str] | None = None, most_depth: int = DEPTH) -> DataFrame:
    """(id, depth) from one start; the depth is kept within 1 to MOST_DEPTH."""
    start = edges.sparkSession.range(1).select(F.lit(from_id).alias("id"))
    return closure(start, steps(edges, direction, types), min(max(most_depth, 1), MOST_DEPTH)).select("id", "depth")


def traversed(edges: DataFrame, depths: DataFrame, direction: str = "out", types: list[str] | None = None, most_depth: int = DEPTH) -> DataFrame:
    """The edges examined: all that leave a node above the last level, also to nodes seen before."""
    from_nodes = depths.where(F.col("depth") < min(max(most_depth, 1), MOST_DEPTH)).select(F.col("id").alias("a"))
    used = steps(edges, direction, types).join(from_nodes, "a", "left_semi").select(F.col("edge_id").alias("id")).distinct()
    return edges.join(used, "id", "left_semi")


def cut_short(edges: DataFrame, depths: DataFrame, direction: str = "out", types: list[str] | None = None, most_depth: int = DEPTH) -> DataFrame:
    """One row (truncated): whether a node of the last level leads to one that was not reached."""
    last = depths.where(F.col("depth") == min(max(most_depth, 1), MOST_DEPTH)).select(F.col("id").alias("a"))
    onward = steps(edges, direction, types).join(last, "a", "left_semi").select(F.col("b").alias("id"))
    return onward.join(depths, "id", "left_anti").agg((F.count("*") > 0).alias("truncated"))


def with_label(nodes: DataFrame, wanted: list[str] | None) -> DataFrame:
    return nodes.where(F.arrays_overlap("labels", F.array(*map(F.lit, wanted)))) if wanted else nodes


def encode_cursor(depth: int, node_id: str) -> str:
    return base64.b64encode(json.dumps({"depth": depth, "id": node_id}, separators=(",", ":"), ensure_ascii=False).encode()).decode()


def cursor_of(depth: Column, node_id: Column) -> Column:
    """As ``encode_cursor``, for a table."""
    named = F.to_json(F.struct(depth.alias("depth"), node_id.alias("id")))
    return F.base64(F.encode(named, "utf-8"))


def decode_cursor(cursor: str) -> tuple[int, str] | None:
    """Depth and id of a cursor; None for anything else than a cursor."""
    try:
        found = json.loads(base64.b64decode(cursor, validate=True))
        depth, node_id = found["depth"], found["id"]
    except (ValueError, KeyError, TypeError):
        return None
    good = isinstance(node_id, str) and isinstance(depth, (int, float)) and not isinstance(depth, bool)
    return (depth, node_id) if good else None


def after(cursor: tuple[int, str], id_col: Column | None = None) -> Column:
    """Strictly after a cursor in the order (depth, id)."""
    node_id = F.col("id") if id_col is None else id_col
    return (F.col("depth") > cursor[0]) | ((F.col("depth") == cursor[0]) & (node_id > cursor[1]))


#: Ties of identifiers on a page are in the order of a dictionary: a before B.
COLLATION = "UNICODE"


@dataclass
class Page:
    """One page of a walk and why it ends where it does."""

    nodes: list[dict]
    edges: list[dict] | None
    truncated: bool
    truncated_by_limit: bool
    truncated_by_size: bool
    next_cursor: str | None


def _size(nodes: list[dict], edges: list[dict] | None) -> int:
    return len(json.dumps({"nodes": nodes} | ({} if edges is None else {"edges": edges}), indent=2, ensure_ascii=False).encode())


def walk(
    nodes: DataFrame, edges: DataFrame, from_id: str, direction: str = "out", edge_types: list[str] | None = None, labels: list[str] | None = None,
    most_depth: int = DEPTH, include_edges: bool = True, limit: int = LIMIT, cursor: str | None = None, page_bytes: int = PAGE_BYTES, collation: str | None = COLLATION,
) -> Page:
    """One page of the nodes around a start, in order of (depth, id). Only the page comes to the driver.

    ``collation``: a Spark collation for ties, by default that of no language; None is binary order. Raises ValueError for an unknown start
    or a cursor that is none.
    """
    at = decode_cursor(cursor) if cursor else None
    if cursor and at is None:
        raise ValueError("not a cursor of an earlier page")
    if not nodes.where(F.col("id") == from_id).take(1):
        raise ValueError(f"start node {from_id!r} not found")
    limit = min(max(limit, 1), MOST_LIMIT)
    depths = scratch.written(reached(edges, from_id, direction, edge_types, most_depth), "walk")
    order_id = F.col("id") if collation is None else F.collate("id", collation)
    rows = with_label(nodes, labels).join(depths, "id")
    if at:
        rows = rows.where(after(at, order_id))
    window = [r.asDict(True) for r in rows.orderBy("depth", order_id).limit(limit + 1).select("id", "labels", "props", "depth").collect()]
    more, window = len(window) > limit, window[:limit]
    shown = [{"id": r["id"], "labels": r["labels"] or [], "properties": json.loads(r["props"] or "{}")} for r in window]
    links: list[dict] = []
    if include_edges and window:
        ids = [r["id"] for r in window]
        used = traversed(edges, depths, direction, edge_types, most_depth).where(F.col("src").isin(ids) | F.col("dst").isin(ids)).orderBy("id")
        # No edge takes less than this in a page, so a hub's others could not be shown anyway.
        links = [{"id": e.id, "type": e.type, "start": e.src, "end": e.dst} for e in used.limit(page_bytes // 40 + 1).collect()]

    def page(n: int) -> tuple[list[dict], list[dict] | None]:
        held = {x["id"] for x in shown[:n]}
        return shown[:n], [e for e in links if e["start"] in held or e["end"] in held] if include_edges else None

    low, high = min(1, len(shown)), len(shown)
    while low < high:  # the longest prefix that fits; its size only grows
        middle = (low + high + 1) // 2
        low, high = (middle, high) if _size(*page(middle)) <= page_bytes else (low, middle - 1)
    kept_nodes, kept_edges = page(low)
    more = more or low < len(shown)
    truncated = cut_short(edges, depths, direction, edge_types, most_depth).first().truncated
    next_cursor = encode_cursor(window[low - 1]["depth"], window[low - 1]["id"]) if more and low else None
    return Page(kept_nodes, kept_edges, truncated, more, low < len(shown), next_cursor)


def induced(edges: DataFrame, ids: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Edges with both ends among ``ids``."""
    if types:
        edges = edges.where(F.col("type").isin(types))
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("id", "type", "src", "dst", *(["props"] if "props" in edges.columns else []))


def ancestors(starts: DataFrame, edges: DataFrame, types: list[str] = ["hasPart", "hasChild"], most_depth: int | None = None) -> DataFrame:  # noqa: B006
    """(root, id, depth) upward from each start, nearest first by depth; the start itself is left out."""
    return closure(starts, steps(edges, "in", types), most_depth).where("depth > 0")


def nearest(found: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    """For each root the nearest node with a label, ties by id: (root, id, depth)."""
    wanted = nodes.where(F.array_contains("labels", label)).select("id")
    return found.join(wanted, "id", "left_semi").groupBy("root").agg(F.min(F.struct("depth", "id")).alias("m")).select("root", "m.id", "m.depth")


def cascade(seeds: DataFrame, edges: DataFrame, types: list[str] = ["hasPart", "hasChild"]) -> DataFrame:  # noqa: B006
    """(id) of the seeds and of every node all of whose containers are removed, to a fixed point."""
    links = edges.where(F.col("type").isin(types)).select("src", "dst")
    fresh, n = scratch.counted(seeds.select("id").distinct(), "removed")
    parts, lost = [(0, fresh)], None
    by = lambda rows, name: rows.distinct().groupBy("dst").agg(F.count("*").alias(name))  # noqa: E731  containers of each, by whatever edges
    for _ in range(MOST_LEVELS):
        newly, m = scratch.counted(by(links.join(_sent(fresh.select(F.col("id").alias("src")), n), "src", "left_semi"), "k"), "newly")
        lost = scratch.written(newly if lost is None else lost.unionByName(newly).groupBy("dst").agg(F.sum("k").alias("k")), "lost")
        # Only what has just lost a container can go now, so only its containers are counted.
        asked = _sent(newly.select("dst"), m)
        gone = by(links.join(asked, "dst", "left_semi"), "n").join(lost, "dst").where("k = n").select(F.col("dst").alias("id"))
        fresh, n = scratch.counted(gone.join(_together(parts), "id", "left_anti"), "removed")
        if not n:
            return _together(parts)
        _add(parts, fresh)
    raise RuntimeError(f"more than {MOST_LEVELS} levels")


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, way, other, type): every node's edges seen from it."""
    out = edges.select(F.col("src").alias("id"), F.lit("out").alias("way"), F.col("dst").alias("other"), "type")
    back = edges.select(F.col("dst").alias("id"), F.lit("in").alias("way"), F.col("src").alias("other"), "type")
    return out.unionByName(back).join(nodes.select("id"), "id", "left_semi")
