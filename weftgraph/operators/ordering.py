"""Orders of large tables and trees, without a task that holds a whole group, and in rounds that grow with the logarithm of the depth.

* ``in_order`` numbers all rows in a given order by ranges; ``placed`` numbers them within groups, so that a hub's children
  are never sorted in one task.
* ``first_seen`` makes a forest of a graph without cycles: each node below the parent from which a depth-first walk sees it first.
* ``preorder`` gives each node of a forest its place in a depth-first walk, its depth and the size of what is below it. The walk is a list of two
  steps for each node, down to it and up again; each step knows its next one, and ranks come by pointer jumping, which halves the list in every round.
* ``chains`` follows each start's parents to the top by tables of jumps over 1, 2, 4, ... levels.

Trees are (id, parent, place): a null parent is the top of a tree, children are in order of place and id. Nodes on a cycle
have no way to the top, which is an error once more doublings were made than the longest chain could need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import scratch

#: Levels of a graph that becomes a forest.
MOST_LEVELS = 10_000


def in_order(rows: DataFrame, *order: str | Column, name: str = "seq") -> DataFrame:
    """The rows with their number, from 1, in the given order.

    Ranges of the order are sorted apart and numbered within; the numbers of rows before each range, one for each task, are added.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")
    ranged = scratch.written(ranged, "ordered", packed=True)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_place") + 1).drop("_part", "_place", "_start")


def placed(rows: DataFrame, group: str, *order: str | Column, name: str = "place") -> DataFrame:
    """The rows with their number within their group, from 0, in the given order; a group of any size is numbered by ranges."""
    numbered = scratch.settled(rows.sparkSession, "numbered", lambda: in_order(rows, group, *order, name="_seq"), packed=True)
    first = numbered.groupBy(F.col(group).alias("_g")).agg(F.min("_seq").alias("_first"))
    return numbered.join(first, F.col(group).eqNullSafe(F.col("_g"))).withColumn(name, F.col("_seq") - F.col("_first")).drop("_seq", "_first", "_g")


def with_previous(rows: DataFrame, group: str, *order: str | Column, value: str, name: str) -> DataFrame:
    """The rows with a value of the row before, in the order of their group; null for the first. Neighbours meet by number, so no group is in one task."""
    numbered = scratch.settled(rows.sparkSession, "numbered", lambda: in_order(rows, group, *order, name="_seq"), packed=True)
    before = numbered.select((F.col("_seq") + 1).alias("_seq"), F.col(group).alias("_g"), F.col(value).alias(name))
    return numbered.join(before, (numbered["_seq"] == before["_seq"]) & numbered[group].eqNullSafe(F.col("_g")), "left").drop("_seq", "_g")


def first_seen(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, parent, place, path) of all nodes below the roots (id, place): each under the parent from which a depth-first walk sees it first.

    ``edges`` are (parent, id, place), children in order of place, without cycles. Without cycles a walk sees a node first on the
    smallest path that leads to it, by place step after step. Levels are those of the longest path, so that all parents of a node are known before it.
    """
    edges = scratch.written(edges.select("parent", "id", "place").join(roots.select("id"), "id", "left_anti"), "links", packed=True)
    level = scratch.written(roots.select("id", F.lit(None).cast("string").alias("parent"), F.array(F.col("place").cast("bigint")).alias("path")), "level", packed=True)
    waiting = _within(roots, edges).groupBy("id").agg(F.count("*").alias("n"))
    waiting = scratch.written(waiting, "waiting", packed=True)
    reached, joined, parts = None, None, [level]
    for _ in range(MOST_LEVELS):
        onward = level.select(F.col("id").alias("parent"), "path").join(edges, "parent")
        found = onward.groupBy("id").agg(F.count("*").alias("k"), F.min(F.struct(F.concat("path", F.array(F.col("place").cast("bigint"))).alias("path"), "parent")).alias("best"))
        if reached is not None:
            found = reached.unionByName(found).groupBy("id").agg(F.sum("k").alias("k"), F.min("best").alias("best"))
        before, joined = joined, scratch.written(found.join(waiting, "id"), "seen", packed=True)
        if before is not None:
            scratch.forget(before)
        level = scratch.written(joined.where("k = n").select("id", F.col("best.parent").alias("parent"), F.col("best.path").alias("path")), "level", packed=True)
        if not level.take(1):
            if joined.take(1):
                raise ValueError(f"a cycle holds {joined.first()['id']!r}")
            break
        reached = joined.where("k < n").select("id", "k", "best")
        parts.append(level)
        if len(parts) >= 16:
            parts = [scratch.written(_union(parts), "levels", packed=True)]
    else:
        raise RuntimeError(f"more than {MOST_LEVELS} levels")
    return _union(parts).select("id", "parent", F.element_at("path", -1).alias("place"), "path")


def last_parents(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, parent_id): of each node below the roots (id, place) the parent whose edge a depth-first walk looks at last.

    The walk enters each node once, but looks at all edges of each; edges are looked at in the order of their paths.
    """
    seen = scratch.written(first_seen(roots, edges).select(F.col("id").alias("parent"), "path"), "seen", packed=True)
    looked = edges.join(seen, "parent").select("id", "parent", F.concat("path", F.array(F.col("place").cast("bigint"))).alias("path"))
    return looked.groupBy("id").agg(F.max_by("parent", "path").alias("parent_id"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _within(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges whose parents are below the roots."""
    from weftgraph.operators.traverse import closure

    below = closure(roots.select("id"), edges.select(F.col("parent").alias("a"), F.col("id").alias("b")), together=True)
    return edges.join(below.select(F.col("id").alias("parent")), "parent", "left_semi")


def preorder(tree: DataFrame) -> DataFrame:
    """(id, parent, preorder, size, depth): place in a depth-first walk of all trees, from 0, how many nodes are below, itself included, and the depth.

    What is below a node has places from its own on, ``size`` of them, so containment is a range test. Trees follow one another by place and id of their tops.
    """
    rows = tree.select("id", "parent", F.col("place").cast("bigint").alias("place"))
    numbered = scratch.settled(rows.sparkSession, "siblings", lambda: in_order(rows, F.col("parent").asc_nulls_first(), F.col("place").asc_nulls_first(), "id"), packed=True)
    after = numbered.select((F.col("seq") - 1).alias("seq"), F.col("parent").alias("_p"), F.col("id").alias("next"))
    linked = numbered.join(after, (numbered["seq"] == after["seq"]) & numbered["parent"].eqNullSafe(F.col("_p")), "left").select("id", "parent", "next")
    child = numbered.where("parent IS NOT NULL").groupBy(F.col("parent").alias("_c")).agg(F.min_by("id", "seq").alias("first"))
    linked = scratch.written(linked.join(child, F.col("id") == F.col("_c"), "left").select("id", "parent", "next", "first"), "linked", packed=True)
    step = lambda way, node: F.concat(F.lit(way), node)
    down = linked.select(step("d", F.col("id")).alias("step"), F.coalesce(step("d", F.col("first")), step("u", F.col("id"))).alias("to"), F.lit(1).alias("n"), F.lit(1).alias("up"))
    up = linked.select(step("u", F.col("id")).alias("step"), F.coalesce(step("d", F.col("next")), step("u", F.col("parent"))).alias("to"), F.lit(0).alias("n"), F.lit(-1).alias("up"))
    walk = scratch.written(down.unionByName(up).select("step", "to", F.col("n").cast("bigint").alias("n"), F.col("up").cast("bigint").alias("up")), "walk", packed=True)
    for _ in range(walk.count().bit_length() + 1):  # a list of n steps needs so many doublings
        if not walk.where("to IS NOT NULL").take(1):
            break
        ahead = walk.select(F.col("step").alias("_s"), F.col("to").alias("_to"), F.col("n").alias("_n"), F.col("up").alias("_up"))
        jumped = walk.join(ahead, F.col("to") == F.col("_s"), "left")
        before, walk = walk, scratch.written(jumped.select("step", F.col("_to").alias("to"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), (F.col("up") + F.coalesce("_up", F.lit(0))).alias("up")), "walk", packed=True)
        scratch.forget(before)
    else:
        raise ValueError(f"a cycle holds {walk.where('to IS NOT NULL').first()['step'][1:]!r}")
    # ``n`` counts the nodes from a step to the end of the walk, ``up`` is 1 less than nothing for each level that the walk still has to climb.
    total = walk.agg(F.max("n").alias("all"))
    of = lambda way: walk.where(F.col("step").startswith(way)).select(F.substring("step", 2, 1 << 30).alias("id"), F.col("n").alias(f"{way}_n"), F.col("up").alias(f"{way}_up"))
    both = of("d").join(of("u"), "id").join(F.broadcast(total))
    return linked.select("id", "parent").join(both, "id").select("id", "parent", (F.col("all") - F.col("d_n")).alias("preorder"), (F.col("d_n") - F.col("u_n")).alias("size"), (-F.col("u_up") - 1).alias("depth"))


def chains(starts: DataFrame, parents: DataFrame) -> DataFrame:
    """(root, id, depth): each start (id), its parent, that one's parent, ... to the top; ``parents`` are (id, parent), one for each node.

    Each round doubles what is known: the ancestors found so far, and the table of jumps, which is over twice as many levels then.
    """
    found = scratch.written(starts.select(F.col("id").alias("root"), "id", F.lit(0).cast("bigint").alias("depth")).distinct(), "chains")
    jumps = scratch.written(parents.where("parent IS NOT NULL").select(F.col("id").alias("_from"), F.col("parent").alias("_to")), "jumps")
    for i in range(jumps.count().bit_length() + 1):
        more = found.join(jumps, F.col("id") == F.col("_from")).select("root", F.col("_to").alias("id"), (F.col("depth") + (1 << i)).alias("depth"))
        more = scratch.written(more, "chains")
        if not more.take(1):
            return found
        found = found.unionByName(more)
        ahead = jumps.select(F.col("_from").alias("_b"), F.col("_to").alias("_c"))
        jumps = scratch.written(jumps.join(ahead, F.col("_to") == F.col("_b")).select("_from", F.col("_c").alias("_to")), "jumps")
    raise ValueError("parents have a cycle")


def inside(intervals: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, depth) of all below each root (id), by labels: a node is inside if its place lies in the root's range.

    Roots that lie in no other root have ranges apart, so each place belongs to at most one: the last root that begins before it. It is found
    by one ordering of places and roots' beginnings together, in which each row takes the last beginning before it. No closure is made.
    """
    mine = intervals.join(roots.select("id"), "id", "left_semi").select(F.col("id").alias("root"), "preorder", "size", "depth")
    marked = mine.select("preorder", F.lit(0).alias("kind"), "root", "size", F.col("depth").alias("top"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("bigint").alias("depth"))
    every = intervals.select("preorder", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("root"), F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("top"), "id", "depth")
    n = int(intervals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = marked.unionByName(every).repartitionByRange(n, "preorder", "kind").sortWithinPartitions("preorder", "kind").withColumn("_at", F.monotonically_increasing_id())
    ordered = scratch.written(ordered.withColumn("_part", F.shiftright("_at", 33)), "ranges")
    held = F.last(F.when(F.col("kind") == 0, F.struct("root", "preorder", "size", "top")), ignorenulls=True)
    own = ordered.withColumn("_own", held.over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    last = ordered.where("kind = 0").groupBy("_part").agg(F.max_by(F.struct("root", "preorder", "size", "top"), "_at").alias("_last"))  # one for each task
    so_far = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.select("_part").distinct().join(last, "_part", "left").select("_part", F.last("_last", ignorenulls=True).over(so_far).alias("_before"))  # one row for each task
    found = own.where("kind = 1").join(F.broadcast(parts), "_part", "left").withColumn("_in", F.coalesce("_own", "_before"))
    return found.where("preorder < _in.preorder + _in.size").select(F.col("_in.root").alias("root"), "id", (F.col("depth") - F.col("_in.top")).alias("depth"))
