"""A versioned store of graphs in Parquet: immutable bucket folders and a small pointer for each namespace.

Rows lie in buckets by a hash of their identifier. A pointer is a numbered file (see ``sources.numbered``) that names each
bucket's folder with its number of rows, digest and sums and, if a draft is open, its overlay; so what a version's or a draft's hash is
is known without reading rows. Edges whose id follows from their type and ends are kept without it. Publishing writes anew only the buckets that the overlay touches and
then adds the next pointer, so readers see the old or the new graph, never a mixture, and of two writers
that began with the same pointer one is refused. Replaced folders stay until the next publishing, for those who still read them. Two versions differ at most where their buckets' digests do.
Files are reached through Hadoop's file system, so any store that Spark knows will do.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import scratch
from weftgraph.operators import audit as log_of
from weftgraph.operators import overlay, parse, profile
from weftgraph.operators.mutate import Graph
from weftgraph.sources.numbered import Conflict, Numbered

_NODES = "id string, type string, labels array<string>, props string"
_EDGES = "id string, type string, src string, dst string, props string"
_SIDES = {"nodes": ("node", _NODES, overlay.NODE_CONTENT), "edges": ("edge", _EDGES, overlay.EDGE_CONTENT)}
RESERVED = ("_catalog", "_glossary")
#: Buckets of a new namespace; a bucket should have some million rows at most.
BUCKETS = 16


def _follows() -> Column:
    """The id of an edge that has none of its own."""
    return F.concat("type", F.lit(":"), "src", F.lit("->"), "dst")


class Store:
    """Namespaces below a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._pointers = Numbered(spark, self.root)

    # --- pointers -------------------------------------------------------------------------------
    def _folder(self, namespace: str) -> str:
        return f"{self.root}/{namespace.replace('/', '__')}"

    def _latest(self, namespace: str) -> tuple[int, dict | None]:
        return self._pointers.latest(f"{self._folder(namespace)}/pointer")

    def _seeded(self, namespace: str) -> tuple[int, dict]:
        at, p = self._latest(namespace)
        if p is None:
            raise ValueError(f"{namespace!r} is not seeded")
        return at, p

    def pointer(self, namespace: str) -> dict | None:
        """Where a namespace stands; None if it was never seeded."""
        return self._latest(namespace)[1]

    def _point(self, namespace: str, pointer: dict, seen: int, mine: list[str]) -> None:
        """Adds the pointer after the one that was seen; if another writer was faster, the folders that were written for it go."""
        try:
            self._pointers.add(f"{self._folder(namespace)}/pointer", seen, pointer)
        except Conflict:
            for folder in mine:
                self._remove(folder)
            raise

    def namespaces(self, reserved: bool = True) -> list[str]:
        """Every seeded namespace, by name."""
        root = self._path(self.root)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root) if s.isDirectory() and self._fs.exists(self._path(f"{s.getPath().toString()}/pointer"))]
        return sorted(n for n in (x.replace("__", "/") for x in names) if reserved or not any(part in RESERVED for part in n.split("/")))

    # --- graphs ---------------------------------------------------------------------------------
    def _write(self, g: Graph, folder: str) -> None:
        with scratch.passing(self.spark):
            for side, rows in zip(_SIDES, g, strict=True):
                rows.write.parquet(f"{folder}/{side}")

    def _overlay(self, folder: str) -> Graph:
        return Graph(*(self.spark.read.schema(f"{s[1]}, _tombstone boolean").parquet(f"{folder}/{side}") for side, s in _SIDES.items()))

    def _fresh(self, namespace: str, kind: str) -> str:
        return f"{self._folder(namespace)}/{kind}-{uuid.uuid4().hex}"

    def _put(self, rows: DataFrame, side: str, folder: str, buckets: int) -> dict[str, dict]:
        """Writes rows of one side, in a folder for each bucket; (path, n, digest, sums) of each by its number. Each task writes its rows to all buckets, so none moves."""
        name, schema, columns = _SIDES[side]
        names = [c.split()[0] for c in schema.split(", ")]
        dealt = overlay.filled(rows, columns).select(*names).withColumn("_b", overlay.in_range(buckets))
        if side == "edges":
            dealt = dealt.withColumn("id", F.when(~F.col("id").eqNullSafe(_follows()), F.col("id")))
        with scratch.passing(self.spark), scratch.set_to(self.spark, "spark.sql.maxConcurrentOutputFileWriters", str(buckets)):
            dealt.write.options(**scratch.PACKED).partitionBy("_b").parquet(folder)
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]
        entries = [{"path": f"{folder}/{x}"} for x in found if re.fullmatch(r"_b=\d+", x)]
        if not entries:
            return {}
        leaves = overlay.range_sums(self._table(side, entries), buckets, name).collect()  # a row for each bucket
        return {str(r["range"]): {"path": f"{folder}/_b={r['range']}", "n": r["n"], "digest": r["digest"], "sums": r["sums"]} for r in leaves}

    def _table(self, side: str, entries: list[dict]) -> DataFrame:
        schema = _SIDES[side][1]
        if not entries:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*(e["path"] for e in entries))
        return rows.withColumn("id", F.coalesce("id", _follows())) if side == "edges" else rows

    def _canon(self, version: dict) -> Graph:
        return Graph(*(self._table(side, list(version[side].values())) for side in _SIDES))

    def write(self, namespace: str, g: Graph, config: dict | None = None, buckets: int = BUCKETS) -> None:
        """Replaces what is published; refused while a draft is open."""
        at, now = self._latest(namespace)
        if now and now["draft"]:
            raise ValueError("a draft is open")
        folder = self._fresh(namespace, "v")
        version = {"buckets": buckets} | {side: self._put(rows, side, f"{folder}/{side}", buckets) for side, rows in zip(_SIDES, g, strict=True)}
        stale = [e["path"] for side in _SIDES for e in now["published"][side].values()] if now else []
        self._point(namespace, {"published": version, "draft": None, "config": config if config is not None else (now or {}).get("config"), "draft_config": None, "stale": stale}, at, [folder])
        self._let_go(now)

    def _let_go(self, before: dict | None) -> None:
        """Removes what the version before the last one alone had; those who still read the last one go on."""
        for path in (before or {}).get("stale", []):
            self._remove(path)

    def seed(self, namespace: str, g: Graph, config: dict | None = None, buckets: int = BUCKETS) -> bool:
        """Publishes a first graph where there is none; whether it did. Nothing happens to a seeded namespace, also if another writer seeds it meanwhile."""
        if self.pointer(namespace) is not None:
            return False
        try:
            self.write(namespace, g, config, buckets)
        except Conflict:
            return False
        return True

    def published(self, namespace: str) -> Graph | None:
        p = self.pointer(namespace)
        return self._canon(p["published"]) if p else None

    def active(self, namespace: str) -> tuple[Graph, str] | None:
        """The draft if one is open, else what is published, and which."""
        p = self.pointer(namespace)
        if p is None:
            return None
        canon = self._canon(p["published"])
        if not p["draft"]:
            return canon, "published"
        over = self._overlay(p["draft"])
        return Graph(*(overlay.merged(rows, changes) for rows, changes in zip(canon, over, strict=True))), "draft"

    def version(self, namespace: str, published: bool = False) -> str:
        """The hash (``overlay.graph_hash``) of the draft if one is open, else of what is published, from sums that the pointer has."""
        _, p = self._seeded(namespace)
        return overlay.hash_of(*(p["draft_sums"] if p["draft"] and not published else self._sums(p["published"])))

    def _sums(self, version: dict) -> list[list[int]]:
        """Of nodes and of edges: the number of rows and the sums of their digests."""
        return [[sum(x) for x in zip([0] * 9, *(e["sums"] for e in version[side].values()), strict=True)] for side in _SIDES]

    def activated(self, namespace: str) -> dict:
        """{ok, graph, units, profile} of what is published, or why it cannot be used, with the namespaces that can be asked for.

        A version whose buckets are gone is corrupt; a stored profile that is not valid would be parsed wrongly, so it is refused.
        """
        p, available = self.pointer(namespace), self.namespaces(reserved=False)
        refused = lambda reason: {"ok": False, "reason": reason, "available": available}
        if p is None:
            return refused(f"no graph in namespace {namespace!r}")
        lost = [e["path"] for side in _SIDES for e in p["published"][side].values() if not self._fs.exists(self._path(e["path"]))]
        if lost:
            return refused(f"the published version of {namespace!r} lacks {len(lost)} bucket(s)")
        try:
            rules = profile.checked(p["config"]) if p["config"] is not None else None
        except ValueError as e:
            return refused(f"the profile of {namespace!r} is invalid: {e}")
        g = self._canon(p["published"])
        return {"ok": True, "graph": g, "units": parse.units(g.nodes), "profile": rules}

    def create_draft(self, namespace: str) -> None:
        """Opens an empty overlay, at no cost in the graph's size; nothing happens if one is open."""
        self._open(namespace, *self._seeded(namespace))

    def seen(self, namespace: str) -> int:
        """The number of the pointer: what was read at it is still so while the number is the same."""
        return self._latest(namespace)[0]

    def _open(self, namespace: str, at: int, p: dict) -> None:
        if p["draft"]:
            return
        folder = self._fresh(namespace, "draft")
        self._write(Graph(*(self.spark.createDataFrame([], f"{s[1]}, _tombstone boolean") for s in _SIDES.values())), folder)
        self._point(namespace, p | {"draft": folder, "draft_config": p["config"], "draft_sums": self._sums(p["published"])}, at, [folder])

    def apply(self, namespace: str, after: Graph, seen: int | None = None) -> None:
        """Records in the draft what makes it ``after``: its difference from the published graph, with tombstones.

        Only buckets whose digests differ are compared by row. ``seen``: the pointer's number when ``after`` was begun; Conflict if it has moved since.
        """
        at, p = self._seeded(namespace)
        if seen is not None and at != seen:
            raise Conflict(namespace)
        self._open(namespace, at, p)
        at, p = self._seeded(namespace)
        sides, sums, version = [], [], p["published"]
        for side, rows in zip(_SIDES, after, strict=True):
            name, schema, columns = _SIDES[side]
            names = [c.split()[0] for c in schema.split(", ")]
            now = overlay.filled(rows, columns).select(*names)
            found = overlay.range_sums(now, version["buckets"], name).collect()
            leaves = {str(r["range"]): r["digest"] for r in found}
            sums.append([sum(x) for x in zip([0] * 9, *(r["sums"] for r in found), strict=True)])
            unequal = [b for b in {*leaves, *version[side]} if leaves.get(b) != version[side].get(b, {}).get("digest")]
            before = self._table(side, [version[side][b] for b in unequal if b in version[side]])
            writes, gone = overlay.delta(before, now.where(overlay.in_range(version["buckets"]).isin([int(b) for b in unequal])), columns)
            dead = before.join(gone, "id", "left_semi").withColumn("_tombstone", F.lit(True))
            sides.append(writes.select(*names).withColumn("_tombstone", F.lit(False)).unionByName(dead))
        folder = self._fresh(namespace, "draft")
        self._write(Graph(*sides), folder)
        self._point(namespace, p | {"draft": folder, "draft_sums": sums}, at, [folder])
        self._remove(p["draft"])

    def stage(self, namespace: str, changes: Graph, seen: int | None = None) -> None:
        """Records changes in the draft that are given as an overlay, rows with ``_tombstone``, each id once: they replace earlier ones of the same id.

        Of the published graph only the rows that they name are compared; what leaves these as they are is not recorded. ``seen``: as in ``apply``.
        """
        at, p = self._seeded(namespace)
        if seen is not None and at != seen:
            raise Conflict(namespace)
        self._open(namespace, at, p)
        at, p = self._seeded(namespace)
        sides, sums = [], []
        for side, rows, earlier, canon, total in zip(_SIDES, changes, self._overlay(p["draft"]), self._canon(p["published"]), self._sums(p["published"]), strict=True):
            name, schema, columns = _SIDES[side]
            names = [c.split()[0] for c in schema.split(", ")]
            rows = overlay.filled(rows, columns).select(*names, "_tombstone")
            rows, n = scratch.counted(overlay.without(earlier, rows).unionByName(rows), "changes")
            there = scratch.written(overlay.named(canon, rows, n), "named")
            was = rows.join(there.select("id", overlay.content(columns).alias("_was")), "id", "left")
            moved = F.when(F.col("_tombstone"), F.col("_was").isNotNull()).otherwise(F.col("_was").isNull() | (F.col("_was") != overlay.content(columns)))
            moved = scratch.written(was.where(moved).drop("_was"), "moved")
            sides.append(moved)
            add = lambda df: [sum(x) for x in zip([0] * 9, *(r["sums"] for r in overlay.range_sums(df, 1, name).collect()), strict=True)]  # noqa: B023, E731
            gone, new = add(there.join(moved.select("id"), "id", "left_semi")), add(moved.where(~F.col("_tombstone")))
            sums.append([t - g + x for t, g, x in zip(total, gone, new, strict=True)])
        folder = self._fresh(namespace, "draft")
        self._write(Graph(*sides), folder)
        self._point(namespace, p | {"draft": folder, "draft_sums": sums}, at, [folder])
        self._remove(p["draft"])

    def config(self, namespace: str) -> dict | None:
        """The configuration of the draft if one is open, else the published one."""
        _, p = self._seeded(namespace)
        return p["draft_config" if p["draft"] else "config"]

    def write_config(self, namespace: str, config: dict, seen: int | None = None) -> None:
        """Replaces the configuration of the draft if one is open, else the published one; never merges. ``seen``: as in ``apply``."""
        at, p = self._seeded(namespace)
        if seen is not None and at != seen:
            raise Conflict(namespace)
        self._point(namespace, p | {"draft_config" if p["draft"] else "config": config}, at, [])

    def publish(self, namespace: str) -> list[str]:
        """Makes the draft a new version: buckets that it touches are written anew, the others stay. Returns what was written, as (side, bucket) names."""
        at, p = self._latest(namespace)
        if p is None or not p["draft"]:
            raise ValueError("no draft is open")
        over, folder = self._overlay(p["draft"]), self._fresh(namespace, "v")
        version, old, written = dict(p["published"]), [], []
        for side, changes in zip(_SIDES, over, strict=True):
            touched = [str(r.b) for r in changes.select(overlay.in_range(version["buckets"]).alias("b")).distinct().collect()]
            before = [version[side][b] for b in touched if b in version[side]]
            old += [e["path"] for e in before]
            fresh = self._put(overlay.merged(self._table(side, before), changes), side, f"{folder}/{side}", version["buckets"]) if touched else {}
            version[side] = {b: e for b, e in version[side].items() if b not in touched} | fresh
            written += [f"{side}/{b}" for b in fresh]
        config = p["draft_config"] if p["draft_config"] is not None else p["config"]
        self._point(namespace, {"published": version, "draft": None, "config": config, "draft_config": None, "stale": [p["draft"], *old]}, at, [folder])
        self._let_go(p)
        return sorted(written)

    def stage_and_publish(self, namespace: str, change: Callable[[Graph], Graph]) -> None:
        """Applies a change and publishes it at once; whatever fails, no draft of it is left. Refused while one is open."""
        at, p = self._seeded(namespace)
        if p["draft"]:
            raise ValueError("a draft is open")
        after = change(self._canon(p["published"]))
        self._open(namespace, at, p)
        try:
            self.apply(namespace, after)
            self.publish(namespace)
        except Conflict:  # the draft that is open now is another writer's
            raise
        except Exception:
            self.discard(namespace)
            raise

    def discard(self, namespace: str) -> None:
        """Drops the draft; nothing happens without one."""
        at, p = self._latest(namespace)
        if p and p["draft"]:
            self._point(namespace, p | {"draft": None, "draft_config": None}, at, [])
            self._remove(p["draft"])

    def delete(self, namespace: str) -> None:
        """Removes a namespace; its audit log lies elsewhere and stays."""
        self._remove(self._folder(namespace))

    def difference(self, namespace: str) -> DataFrame:
        """(side, id, op) between what is published and the draft."""
        p = self.pointer(namespace)
        if not p["draft"]:
            return self.spark.createDataFrame([], "side string, id string, op string")
        sides = zip(_SIDES.values(), self._canon(p["published"]), self._overlay(p["draft"]), strict=True)
        parts = [overlay.named_difference(canon, over, columns).select(F.lit(name).alias("side"), "id", "op") for (name, _, columns), canon, over in sides]
        return parts[0].unionByName(parts[1])

    def _remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    # --- audit ----------------------------------------------------------------------------------
    def append_audit(self, records: DataFrame) -> None:
        """Adds records, in folders by namespace and day; there is no way to change or remove one."""
        of = F.col("namespace") if "namespace" in records.columns else F.lit(None).cast("string")
        dealt = records.withColumn("_ns", F.coalesce(F.replace(of, F.lit("/"), F.lit("__")), F.lit("-"))).withColumn("_day", F.coalesce(F.substring("ts", 1, 10), F.lit("-")))
        dealt.write.mode("append").partitionBy("_ns", "_day").parquet(f"{self.root}/_audit")

    def audit(self, schema: str | None = None, namespace: str | None = None) -> DataFrame:
        """The log, of one namespace if asked for; with a schema, columns that older records lack are null, and a log that was never written is empty."""
        path = f"{self.root}/_audit" + ("" if namespace is None else f"/_ns={namespace.replace('/', '__')}")
        if schema is None:
            return self.spark.read.parquet(path).drop("_ns", "_day")
        if not self._fs.exists(self._path(path)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def audit_page(
        self, namespace: str, schema: str, limit: int = log_of.DEFAULT_PAGE, cursor: tuple[str, str] | None = None, since: str | None = None, until: str | None = None,
        keep: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    ) -> list:
        """The newest records that ``keep`` leaves, as ``audit.page`` has them. Days are read from the last one on, twice as many each time, until the page is full."""
        folder, limit = self._path(f"{self.root}/_audit/_ns={namespace.replace('/', '__')}"), min(max(1, int(limit)), log_of.MOST_PAGE)
        if not self._fs.exists(folder):
            return []
        upper = min([x[:10] for x in (until, cursor and cursor[0]) if x], default="~")
        days = sorted((s.getPath().getName()[5:], s.getPath().toString()) for s in self._fs.listStatus(folder) if s.isDirectory() and s.getPath().getName().startswith("_day="))
        days = [path for day, path in reversed(days) if (since or "")[:10] <= day <= upper]
        found, step = [], 1
        while days and len(found) < limit:
            rows = log_of.matching(self.spark.read.schema(schema).parquet(*days[:step]), since=since, until=until)
            found += log_of.page(keep(rows), limit - len(found), cursor).collect()
            days, step = days[step:], 2 * step
        return found
