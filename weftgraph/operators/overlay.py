"""Drafts as overlays on a published graph: merging, comparing, hashing and checking.

An overlay row replaces the row with its id, or removes it if ``_tombstone``. Rows are compared by a digest
of their content columns, so one equi join by id answers every question about two versions.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE_CONTENT = ("type", "labels", "props")
EDGE_CONTENT = ("type", "src", "dst", "props")
#: Caps of a reported difference, per side and kind of change.
DIFF_CAP, MOST_DIFF = 200, 1000
#: Identifiers that are sent to all tasks as they are, and those whose hashes are; of more both sides are shuffled.
MOST_IDS, MOST_HASHES = 200_000, 4_000_000


def content(columns: tuple[str, ...] = NODE_CONTENT) -> Column:
    """Digest of the content columns, lists as JSON; null and empty differ."""
    text = lambda c: F.to_json(c) if c == "labels" else F.col(c).cast("string")
    parts = [F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), text(c))) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def filled(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The rows with a null in each content column that they lack, as edges without properties do."""
    return rows.withColumns({c: F.lit(None).cast("string") for c in columns if c not in rows.columns})


def _near(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows whose id has the hash of one of the ids, or those whose has not."""
    hashes = F.broadcast(ids.select(F.xxhash64("id").alias("_h")).distinct())
    return rows.withColumn("_h", F.xxhash64("id")).join(hashes, "_h", how).drop("_h")


def named(rows: DataFrame, ids: DataFrame, n: int | None = None) -> DataFrame:
    """The rows whose id is among the ids, of which there are n. The rows stay where they are, but for those that are likely to be named, or if there are too many ids."""
    n = ids.count() if n is None else n
    if n <= MOST_IDS:
        return rows.join(F.broadcast(ids.select("id")), "id", "left_semi")
    return (_near(rows, ids, "left_semi") if n <= MOST_HASHES else rows).join(ids.select("id"), "id", "left_semi")


def without(rows: DataFrame, ids: DataFrame, n: int | None = None) -> DataFrame:
    """The rows whose id is not among the ids; as in ``named``, few rows are shuffled."""
    n = ids.count() if n is None else n
    if n <= MOST_IDS:
        return rows.join(F.broadcast(ids.select("id")), "id", "left_anti")
    if n > MOST_HASHES:
        return rows.join(ids.select("id"), "id", "left_anti")
    return _near(rows, ids, "left_anti").unionByName(_near(rows, ids, "left_semi").join(ids.select("id"), "id", "left_anti"))


def merged(canon: DataFrame, over: DataFrame, n: int | None = None) -> DataFrame:
    """The draft: published rows that the overlay does not name, and its living rows. ``n``: the overlay's rows, which are counted otherwise."""
    kept = without(canon, over, n)
    return kept.unionByName(over.where(~F.col("_tombstone")).drop("_tombstone"), allowMissingColumns=True)


def difference(before: DataFrame, after: DataFrame, columns: tuple[str, ...] = NODE_CONTENT) -> DataFrame:
    """(id, op): added, removed and changed rows."""
    a = filled(before, columns).select("id", content(columns).alias("was"))
    b = filled(after, columns).select("id", content(columns).alias("now"))
    op = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return a.join(b, "id", "full_outer").select("id", op.alias("op")).where("op IS NOT NULL")


def named_difference(canon: DataFrame, over: DataFrame, columns: tuple[str, ...] = NODE_CONTENT, n: int | None = None) -> DataFrame:
    """(id, op) as ``difference`` has it between what is published and its draft: only rows that the overlay names can differ."""
    was = named(filled(canon, columns), over, n).select("id", content(columns).alias("was"))
    rows = filled(over, columns).select("id", F.when(~F.col("_tombstone"), content(columns)).alias("now")).join(was, "id", "left")
    op = F.when(F.col("was").isNull() & F.col("now").isNotNull(), "added").when(F.col("now").isNull() & F.col("was").isNotNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return rows.select("id", op.alias("op")).where("op IS NOT NULL")


def delta(before: DataFrame, after: DataFrame, columns: tuple[str, ...] = NODE_CONTENT) -> tuple[DataFrame, DataFrame]:
    """(rows to write, ids to remove) that turn ``before`` into ``after``."""
    same = filled(before, columns).select("id", content(columns).alias("_d"))
    writes = filled(after, columns).withColumn("_d", content(columns)).join(same, ["id", "_d"], "left_anti").drop("_d")
    return writes, before.select("id").join(after.select("id"), "id", "left_anti")


def applied(before: DataFrame, writes: DataFrame, removals: DataFrame) -> DataFrame:
    gone = writes.select("id").unionByName(removals)
    return before.join(gone, "id", "left_anti").unionByName(writes)


def _lanes(digest: str = "d") -> list[Column]:
    """The four sums of SHA-256 digests that are read as four numbers of 64 bits each, as sums of their halves: whole numbers that no 2**31 rows overflow."""
    half = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
    return [F.coalesce(F.sum(half(i)), F.lit(0).cast("bigint")).alias(f"h{i}") for i in range(8)]


def _of_lanes() -> Column:
    wide = lambda i: F.col(f"h{i}").cast("decimal(20,0)")
    parts = [F.pmod((wide(2 * i) * F.lit(str(2**32)).cast("decimal(11,0)") + wide(2 * i + 1)).cast("decimal(38,0)"), F.lit(str(2**64)).cast("decimal(38,0)")).cast("decimal(20,0)").cast("string") for i in range(4)]
    return F.sha2(F.concat_ws("/", F.col("n").cast("string"), *parts), 256)


def _digests(rows: DataFrame, side: str, columns: tuple[str, ...]) -> DataFrame:
    return filled(rows, columns).select("id", F.sha2(F.concat_ws("\x1e", F.lit(side), "id", content(columns)), 256).alias("d"))


def graph_hash(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (hash): the same for any order of rows, different for any other content.

    Each row's SHA-256 is read as four numbers of 64 bits. They are added up, modulo 2**64, by partial aggregates, and the
    sums and the number of rows are hashed; so no list of digests is ever gathered.
    """
    rows = _digests(nodes, "node", NODE_CONTENT).unionByName(_digests(edges, "edge", EDGE_CONTENT))
    return rows.agg(F.count("*").alias("n"), *_lanes()).select(_of_lanes().alias("hash"))


def in_range(ranges: int, id_col: str = "id") -> Column:
    """Which of so many ranges (at most 65536) of the space of identifiers' hashes a row lies in."""
    return F.pmod(F.conv(F.substring(F.md5(id_col), 1, 4), 16, 10).cast("int"), F.lit(ranges))


def range_sums(rows: DataFrame, ranges: int, side: str = "node") -> DataFrame:
    """(range, n, digest, sums): ``range_digests`` with the sums from which the digests are made. Those of ranges can be added up to those of a graph (``hash_of``)."""
    columns = NODE_CONTENT if side == "node" else EDGE_CONTENT
    each = _digests(rows, side, columns).groupBy(in_range(ranges).alias("range")).agg(F.count("*").alias("n"), *_lanes())
    return each.select("range", "n", _of_lanes().alias("digest"), F.array("n", *(f"h{i}" for i in range(8))).alias("sums"))


def hash_of(*sums: list[int]) -> str:
    """The ``graph_hash`` of all rows of which these are the sums, without reading one."""
    n, *h = map(sum, zip([0] * 9, *sums, strict=True))
    return hashlib.sha256("/".join(map(str, [n, *(((h[i] << 32) + h[i + 1]) % 2**64 for i in range(0, 8, 2))])).encode()).hexdigest()


def range_digests(rows: DataFrame, ranges: int, side: str = "node") -> DataFrame:
    """(range, n, digest): the leaves of a Merkle tree over one side of a graph. Equal digests mean equal rows.

    Partial aggregates make one row for each range and task.
    """
    return range_sums(rows, ranges, side).drop("sums")


def merkle_root(leaves: DataFrame, fan: int = 256) -> DataFrame:
    """One row (hash) of the leaves of a tree: the digests of neighbouring ranges are hashed in their order, ``fan`` at a time."""
    level = leaves.select(F.col("range").alias("at"), "digest")
    for _ in range(2):  # at most 65536 ranges
        listed = F.array_sort(F.collect_list(F.struct("at", "digest")))
        joined = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["at"].cast("string"), x["digest"])), "/")
        level = level.groupBy(F.floor(F.col("at") / fan).cast("int").alias("above")).agg(F.sha2(joined, 256).alias("digest")).withColumnRenamed("above", "at")
    return level.select(F.col("digest").alias("hash"))


def unequal_ranges(before: DataFrame, after: DataFrame) -> DataFrame:
    """(range) where two trees' leaves differ, also where one has no rows."""
    a, b = before.select("range", F.col("digest").alias("was")), after.select("range", F.col("digest").alias("now"))
    return a.join(b, "range", "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select("range")


def difference_by_ranges(before: DataFrame, after: DataFrame, ranges: int, side: str = "node") -> DataFrame:
    """(id, op) as ``difference`` has it, comparing only rows of ranges whose digests differ."""
    unequal = F.broadcast(unequal_ranges(range_digests(before, ranges, side), range_digests(after, ranges, side)))  # at most ``ranges`` rows
    within = lambda rows: rows.withColumn("range", in_range(ranges)).join(unequal, "range", "left_semi")
    return difference(within(before), within(after), NODE_CONTENT if side == "node" else EDGE_CONTENT)


def capped(diff: DataFrame, cap: int = DIFF_CAP, by: tuple[str, ...] = ("side", "op")) -> DataFrame:
    """The first ``cap`` ids of each side and kind, with the true count of their kind."""
    cap = min(max(cap, 1), MOST_DIFF)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    counts = diff.groupBy(*by).agg(F.count("*").alias("total"))
    return diff.withColumn("_k", place).where(F.col("_k") <= cap).drop("_k").join(F.broadcast(counts), list(by)).withColumn("truncated", F.col("total") > cap)


def counts_of(diff: DataFrame) -> DataFrame:
    """One row of the counters that a response shows; changed edges are not among them."""
    n = lambda side, op: F.count_if((F.col("side") == side) & (F.col("op") == op))
    return diff.agg(
        n("node", "added").alias("nodes_added"), n("node", "removed").alias("nodes_removed"), n("node", "changed").alias("nodes_changed"),
        n("edge", "added").alias("edges_added"), n("edge", "removed").alias("edges_removed"),
    )


def whole_difference(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(side, id, op) of nodes and edges together."""
    parts = [difference(b, a, c).withColumn("side", F.lit(s)) for b, a, c, s in zip(before, after, (NODE_CONTENT, EDGE_CONTENT), ("node", "edge"), strict=True)]
    return parts[0].unionByName(parts[1]).select("side", "id", "op")


def renamed(published: DataFrame, after: DataFrame, columns: tuple[str, ...] = NODE_CONTENT) -> DataFrame:
    """(removed_id, added_id): a removed and an added row with the same content are a disguised rename; of several added ones the first by id."""
    gone = filled(published, columns).join(after.select("id"), "id", "left_anti").select(F.col("id").alias("removed_id"), content(columns).alias("d"))
    new = filled(after, columns).join(published.select("id"), "id", "left_anti").groupBy(content(columns).alias("d")).agg(F.min("id").alias("added_id"))
    return gone.join(new, "d").drop("d")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, missing): edges with an end that is not a node; an edge without either is named for both."""
    ends = edges.select("id", F.explode(F.array("src", "dst")).alias("missing"))
    return ends.join(nodes.select(F.col("id").alias("missing")), "missing", "left_anti").select("id", "missing").distinct()
