"""Reading an append-only audit log: (id, ts text, actor, eventType, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.ordering import with_previous

DEFAULT_PAGE, MOST_PAGE = 25, 100


def matching(log: DataFrame, namespace: str | None = None, event_type: str | None = None, actor: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Records that meet all given conditions; times are ISO text, both bounds inclusive."""
    for column, value in (("namespace", namespace), ("eventType", event_type), ("actor", actor)):
        if value is not None:
            log = log.where(F.col(column) == value)
    if since is not None:
        log = log.where(F.col("ts") >= since)
    return log if until is None else log.where(F.col("ts") <= until)


def page(log: DataFrame, limit: int = DEFAULT_PAGE, cursor: tuple[str, str] | None = None) -> DataFrame:
    """Newest first by (ts, id); after a cursor (ts, id) only what is strictly older."""
    if cursor is not None:
        log = log.where((F.col("ts") < cursor[0]) | ((F.col("ts") == cursor[0]) & (F.col("id") < cursor[1])))
    return log.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(min(max(1, int(limit)), MOST_PAGE))


def outcome(log: DataFrame) -> DataFrame:
    return log.withColumn("outcome", F.when(F.col("eventType") == "blocked", "blocked").otherwise("applied"))


def touching(log: DataFrame, node: str) -> DataFrame:
    """Applies whose difference names a node: in its nodes, or as an end of its edges, given or in the edge's id.

    ``diff`` is JSON: {nodes: {added, removed, changed: [{id}]}, edges: {...: [{id, from, to}]}}.
    """
    shape = "struct<nodes:struct<added:array<struct<id:string>>,removed:array<struct<id:string>>,changed:array<struct<id:string>>>,edges:struct<added:array<struct<id:string,from:string,to:string>>,removed:array<struct<id:string,from:string,to:string>>,changed:array<struct<id:string,from:string,to:string>>>>"
    diff = F.from_json("diff", shape)
    listed = lambda side: F.flatten(F.array(*(F.coalesce(diff[side][op], F.array()) for op in ("added", "removed", "changed"))))
    by_node = F.exists(listed("nodes"), lambda n: n["id"] == node)
    ends = lambda e: (e["from"] == node) | (e["to"] == node) | (F.regexp_extract(e["id"], r"^[^:]*:(.*)->.*$", 1) == node) | (F.regexp_extract(e["id"], r"^[^:]*:.*->(.*)$", 1) == node)
    by_edge = F.exists(listed("edges"), lambda e: F.coalesce(ends(e), F.lit(False)))
    return log.where((F.col("eventType") == "apply") & (F.coalesce(by_node, F.lit(False)) | F.coalesce(by_edge, F.lit(False))))


def draft_applies(log: DataFrame) -> DataFrame:
    """Applies since the latest createDraft."""
    opened = log.where("eventType = 'createDraft'").agg(F.max("ts").alias("opened"))
    return log.where("eventType = 'apply'").join(F.broadcast(opened), F.col("ts") >= F.col("opened")).drop("opened")  # one row


def draft_owner(log: DataFrame) -> DataFrame:
    return log.where("eventType = 'createDraft'").agg(F.max_by("actor", F.struct("ts", "id")).alias("owner"))


def self_authored(log: DataFrame, actor: str) -> DataFrame:
    return draft_applies(log).agg(F.coalesce(F.max(F.col("actor") == actor), F.lit(False)).alias("self_authored"))


def read_counters(log: DataFrame) -> DataFrame:
    """(actor, reads, records, longest): how often each actor read, and how many records that returned together and at most."""
    n = F.coalesce(F.col("readCount"), F.lit(0))
    return log.where("eventType = 'read'").groupBy("actor").agg(F.count("*").alias("reads"), F.sum(n).alias("records"), F.max(n).alias("longest"))


def broken_chain(log: DataFrame, by: str = "namespace") -> DataFrame:
    """Applies whose base version is not the result of the one before."""
    found = with_previous(log.where("eventType = 'apply'"), by, "ts", "id", value="resultingVersion", name="before")
    return found.where("before IS NOT NULL AND NOT (before <=> baseVersion)")


def summary(log: DataFrame) -> DataFrame:
    """(id, summary): one line on what each record touched, by its kind. Columns that a log lacks count as null."""
    from weftgraph.functions.text import truncated

    has = lambda name, kind="string": F.col(name) if name in log.columns else F.lit(None).cast(kind)
    joined = lambda sep, *parts: F.concat_ws(sep, *(F.nullif(p, F.lit("")) for p in parts))
    n = lambda value: F.coalesce(value, F.lit(0)).cast("string")
    side = lambda what, name: F.when(
        F.aggregate(F.array(*(F.coalesce(has(f"{what}_{op}", "bigint"), F.lit(0).cast("bigint")) for op in ("added", "changed", "removed"))), F.lit(0).cast("bigint"), lambda x, y: x + y) > 0,
        F.concat(n(has(f"{what}_added", "bigint")), F.lit(" added / "), n(has(f"{what}_changed", "bigint")), F.lit(" changed / "), n(has(f"{what}_removed", "bigint")), F.lit(f" removed {name}(s)")),
    )
    counts = joined("; ", side("nodes", "node"), side("edges", "edge"))
    # The wording of each kind.
    by_kind = {
        "apply": truncated(joined(" — ", has("mutation"), counts), 140),
        "createDraft": F.lit("draft created from published"),
        "publish": joined(" · ", F.concat(F.lit("promoted "), n(has("promoted", "bigint")), F.lit(" apply(ies)")), F.when(has("selfAuthored", "boolean"), "self-approved")),
        "discard": F.concat(F.lit("discarded "), n(has("discarded", "bigint")), F.lit(" apply(ies)")),
        "blocked": truncated(joined(": ", has("mutation"), has("reason")), 140),
        "preview": truncated(F.coalesce(has("reason"), F.lit("preview")), 140),
        "read": truncated(joined(" · ", F.concat(F.lit("returned "), n(has("readCount", "bigint")), F.lit(" record(s)")), has("readQuery")), 140),
        "membership": truncated(F.coalesce(has("reason"), F.col("eventType")), 140),
        "workspace": truncated(F.coalesce(has("reason"), F.col("eventType")), 140),
    }
    return log.select("id", F.coalesce(*(F.when(F.col("eventType") == k, text) for k, text in by_kind.items())).alias("summary"))


def per_window(log: DataFrame, minutes: int = 60) -> DataFrame:
    """Counts by tumbling windows and type. An extension: the log itself has no windows."""
    start = F.window(F.to_timestamp("ts"), f"{minutes} minutes")
    return log.groupBy(start.alias("w"), "eventType").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "eventType", "n")
