"""Projects the star-schema tables into a property graph with side tables.

Node rows are (id, type, labels, props) and edge rows (id, type, src, dst, seq). ``props`` is
canonical JSON text: keys in order, no nulls, whole numbers without a fraction. The rules are fixed
by key arithmetic, so every run and both engines agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph import scratch
from weftgraph.sources import files


#: Identifiers of documents that are numbered together.
RANGE = 100_000
TABLES = "region nation supplier customer orders lineitem part documents".split()
_stored: dict[tuple, dict[str, str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, column: str | Column, width: int) -> Column:
    """A fixed-width text identifier, so that binary and natural order agree."""
    return F.concat(F.lit(prefix), F.lpad(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), width, "0"))


def canonical(**fields: Column) -> Column:
    """Canonical JSON of the fields: keys in order, nulls left out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def _node(df: DataFrame, node_id: Column, label: str, **fields: Column) -> DataFrame:
    return df.select(node_id.alias("id"), F.lit(label).alias("type"), F.array(F.lit(label)).alias("labels"), canonical(**fields).alias("props"))


def orders_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their position and predecessor among their customer's orders, written once."""
    return _once(spark, sf_dir, "turns", lambda: _orders_in_turn(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (order, line): the one with the lowest part, ties by the lowest flag; written once."""
    return _once(spark, sf_dir, "lines", lambda: _lines(spark, sf_dir))


def _orders_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return orders.withColumn("position", F.row_number().over(turn)).withColumn("before", F.lag("o_orderkey").over(turn))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.min(F.struct("l_partkey", "l_returnflag")).alias("best")
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(best)
    return found.select("l_orderkey", "l_linenumber", F.col("best.l_partkey").alias("l_partkey"), F.col("best.l_returnflag").alias("l_returnflag"))


def _with_position(docs: DataFrame) -> DataFrame:
    """Documents with their place in their source.

    A source may hold a third of all documents: rows are only numbered within ranges of identifiers, and the
    ranges' sizes are added up before.
    """
    ranged = docs.withColumn("_range", F.floor(F.col("doc_id") / RANGE))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("source", "_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("source", "_range").orderBy("doc_id"))
    return ranged.join(starts, ["source", "_range"]).withColumn("position", place + F.col("_start")).drop("_range", "_start")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the published graph."""
    read = lambda name: table(spark, sf_dir, name)
    line_id = F.concat(key("L", "l_orderkey", 9), F.lit("-"), F.col("l_linenumber").cast("string"))
    docs = read("documents").select("doc_id", "source")
    number = F.regexp_extract("source", r"(\d+)", 1)
    parts = [
        _node(read("region"), key("R", "r_regionkey", 2), "StandardsFramework", description=F.col("r_name")),
        _node(read("nation"), key("N", "n_nationkey", 2), "StandardsFrameworkItem", description=F.col("n_name"), normalizedStatementType=F.lit("Standard")),
        _node(read("supplier"), key("S", "s_suppkey", 7), "LearningComponent", description=F.col("s_name")),
        _node(read("customer"), key("C", "c_custkey", 7), "Course", description=F.col("c_name"), audience=F.col("c_mktsegment")),
        _node(orders_in_turn(spark, sf_dir), key("O", "o_orderkey", 9), "LessonGrouping", description=F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), groupName=F.col("o_orderstatus"), position=F.col("position")),
        _node(lines(spark, sf_dir), line_id, "Lesson", position=F.col("l_linenumber").cast("int"), educationalUse=F.when(F.col("l_returnflag") == "R", "Assessment")),
        _node(read("part"), key("P", "p_partkey", 7), "Material", description=F.col("p_name"), materialType=F.col("p_type")),
        _node(docs.select("source").distinct(), key("T", number, 3), "TeachingLearningMaterial", description=F.col("source")),
        _node(_with_position(docs), key("D", "doc_id", 7), "DocumentSection", position=F.col("position")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _edge_id() -> Column:
    return F.concat("type", F.lit(":"), "src", F.lit("->"), "dst").alias("id")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges of the published graph, without their sequence number and their id, which follows from the rest (``_edge_id``)."""
    read = lambda name: table(spark, sf_dir, name)
    line_id = F.concat(key("L", "l_orderkey", 9), F.lit("-"), F.col("l_linenumber").cast("string"))
    docs = read("documents").select("doc_id", "source")
    turns, items = orders_in_turn(spark, sf_dir), lines(spark, sf_dir)

    def edge(df: DataFrame, kind: str, src: Column, dst: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"))

    parts = [
        edge(read("nation"), "hasChild", key("R", "n_regionkey", 2), key("N", "n_nationkey", 2)),
        edge(read("supplier"), "supports", key("S", "s_suppkey", 7), key("N", "s_nationkey", 2)),
        edge(read("customer"), "hasEducationalAlignment", key("C", "c_custkey", 7), key("N", "c_nationkey", 2)),
        edge(turns, "hasPart", key("C", "o_custkey", 7), key("O", "o_orderkey", 9)),
        edge(turns.where("before IS NOT NULL"), "hasDependency", key("O", "o_orderkey", 9), key("O", "before", 9)),
        edge(items, "hasPart", key("O", "l_orderkey", 9), line_id),
        edge(items, "hasPart", line_id, key("P", "l_partkey", 7)),
        edge(docs, "hasPart", key("T", F.regexp_extract("source", r"(\d+)", 1), 3), key("D", "doc_id", 7)),
        edge(docs.where("doc_id % 10 <> 0"), "covers", key("D", "doc_id", 7), key("O", "doc_id", 9)),
    ]
    return reduce(DataFrame.unionByName, parts)


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """What the files of the graph's tables look like: changed files make another graph."""
    jvm = spark.sparkContext._jvm
    found = []
    for name in TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        found.append(tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))
    return spark.sparkContext.applicationId, sf_dir, scratch.shared_dir(spark), tuple(found)


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """A table of the graph, written at its first use in a session and read from then on."""
    known = _stored.setdefault(_state(spark, sf_dir), {})
    if name not in known or not files.exists(spark, f"{known[name]}/_SUCCESS"):
        path = f"{scratch.shared_dir(spark)}/graph-{name}-{uuid.uuid4().hex}"
        writer = build().write.options(**scratch.PACKED)
        with scratch.passing(spark):
            (writer.partitionBy(by) if by else writer).parquet(path)
        known[name] = path
    return spark.read.parquet(known[name])


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the published graph, written once, in a folder for each type: what asks for a type reads that alone."""
    found = _once(spark, sf_dir, "nodes", lambda: nodes(spark, sf_dir), "type")
    return found.select("id", "type", "labels", "props"), _ranged(spark, sf_dir).select(_edge_id(), "type", "src", "dst")


def _ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges in order of (type, src, dst), each with its range and its place in it."""

    def build() -> DataFrame:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = edges(spark, sf_dir).repartitionByRange(n, "type", "src", "dst").sortWithinPartitions("type", "src", "dst").withColumn("_at", F.monotonically_increasing_id())
        return rows.withColumn("_part", F.shiftright("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")

    return _once(spark, sf_dir, "edges", build, "type")


def numbered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges with ``seq``: their place in the order of (type, src, dst).

    A global number is made from the counts of ordered ranges, one for each task that wrote them, not by one sorted partition.
    """

    def build() -> DataFrame:
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = _ranged(spark, sf_dir).groupBy("_part").agg(F.count("*").alias("_n"))
        return sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))

    starts = F.broadcast(_once(spark, sf_dir, "starts", build))
    return _ranged(spark, sf_dir).join(starts, "_part").select(_edge_id(), "type", "src", "dst", (F.col("_start") + F.col("_place") + 1).alias("seq"))


def overlay(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The draft overlay: changed, added and removed (``_tombstone``) nodes and edges, written once."""
    build = lambda i: lambda: _overlay(spark, sf_dir)[i]
    return _once(spark, sf_dir, "overlay-nodes", build(0)), _once(spark, sf_dir, "overlay-edges", build(1))


def _overlay(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base, links = graph(spark, sf_dir)
    number = F.substring("id", 2, 9).cast("bigint")
    live, dead = F.lit(False).alias("_tombstone"), F.lit(True).alias("_tombstone")
    changed = base.where(F.col("type").isin("Course", "LessonGrouping") & (number % 97 == 3))
    draft = F.regexp_replace("props", r'("description":"[^"]*)"', '$1 (draft)"').alias("props")
    dead_parts = base.where((F.col("type") == "Material") & (number % 101 == 5))
    dead_edges = links.where((F.col("type") == "hasPart") & (F.substring("dst", 1, 1) == "P") & (F.substring("dst", 2, 9).cast("bigint") % 101 == 5))
    fresh = base.where((F.col("type") == "Course") & (number % 103 == 7)).select(F.col("id").alias("course"), key("X", number, 9).alias("id"))
    new_nodes = fresh.select("id", F.lit("LessonGrouping").alias("type"), F.array(F.lit("LessonGrouping")).alias("labels"), canonical(description=F.concat(F.lit("Added for "), F.col("course"))).alias("props"), live)
    new_edges = fresh.select(F.concat(F.lit("hasPart:"), "course", F.lit("->"), "id").alias("id"), F.lit("hasPart").alias("type"), F.col("course").alias("src"), F.col("id").alias("dst"), live)
    node_rows = changed.select("id", "type", "labels", draft, live).unionByName(dead_parts.select("id", "type", "labels", "props", dead)).unionByName(new_nodes)
    return node_rows, dead_edges.select("id", "type", "src", "dst", dead).unionByName(new_edges)


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log stand-in: one record for each event."""
    kinds = {"click": "apply", "view": "read", "purchase": "publish", "signup": "createDraft", "error": "blocked"}
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("event_type")]
    return e.select(
        key("", "event_id", 9).alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), F.col("user_id").cast("string").alias("actor"),
        kind.alias("eventType"), key("N", F.get_json_object("props", "$.k").cast("int") % 25, 2).alias("node"), "value",
        F.when(F.col("event_id") % 3 == 0, "edit_node").when(F.col("event_id") % 3 == 1, "add_nodes").alias("mutation"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("reason "), F.col("user_id").cast("string"))).alias("reason"),
        (F.col("event_id") % 7).alias("promoted"), (F.col("event_id") % 5 == 0).alias("selfAuthored"), (F.col("event_id") % 40).alias("readCount"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("q="), F.col("user_id").cast("string"))).alias("readQuery"),
        (F.col("event_id") % 3).alias("nodes_added"), (F.col("event_id") % 4).alias("nodes_changed"), (F.col("event_id") % 5).alias("edges_removed"),
    )


def extended(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The published graph with routines, formatters and what uses them, written once."""
    build = lambda i: lambda: _extended(spark, sf_dir)[i]
    return _once(spark, sf_dir, "extended-nodes", build(0)), _once(spark, sf_dir, "extended-edges", build(1))


def _extended(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n, e = graph(spark, sf_dir)
    read = lambda name: table(spark, sf_dir, name)
    regions, sources = read("region"), read("documents").select("source").distinct()
    routine, number = key("I", "r_regionkey", 2), F.regexp_extract("source", r"(\d+)", 1)
    tail = lambda c, s: F.concat(c, F.lit(s))
    marked = read("documents").where("doc_id % 50 = 0")
    more = [
        _node(regions, routine, "InstructionalRoutine", description=F.concat(F.lit("Routine "), F.col("r_name"))),
        _node(regions, tail(routine, "-1"), "InstructionalRoutine", description=F.lit("Practise"), position=F.lit(2)),
        _node(regions, tail(routine, "-2"), "Material", description=F.lit("Explain"), position=F.lit(1)),
        _node(regions, tail(routine, "-3"), "Material", description=F.lit("Sheet"), position=F.lit(1)),
        _node(sources, key("F", number, 3), "Formatter", description=F.concat(F.lit("Format "), F.col("source"))),
        _node(sources, tail(key("F", number, 3), "-1"), "FormatterSpec", description=F.lit("Wide")),
        _node(marked, key("E", "doc_id", 7), "Formatter", description=F.lit("Own")),
    ]

    def edge(df: DataFrame, kind: str, src: Column, dst: Column) -> DataFrame:
        return df.select(F.concat(F.lit(f"{kind}:"), src, F.lit("->"), dst).alias("id"), F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"))

    of_nation = read("customer").where("c_custkey % 3 = 0").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    links = [
        *(edge(regions, "hasPart", a, b) for a, b in ((routine, tail(routine, "-1")), (routine, tail(routine, "-2")), (tail(routine, "-1"), tail(routine, "-3")))),
        edge(sources, "hasPart", key("T", number, 3), key("F", number, 3)), edge(sources, "hasPart", key("F", number, 3), tail(key("F", number, 3), "-1")),
        edge(marked, "hasPart", key("D", "doc_id", 7), key("E", "doc_id", 7)),
        edge(of_nation, "usesRoutine", key("C", "c_custkey", 7), key("I", "n_regionkey", 2)),
        edge(sources.where(number.cast("int") % 2 == 0), "usesRoutine", key("T", number, 3), F.lit("I00")),
        edge(read("documents").where("doc_id % 20 = 0"), "usesRoutine", key("D", "doc_id", 7), F.lit("I01")),
    ]
    return reduce(DataFrame.unionByName, [n, *more]), reduce(DataFrame.unionByName, [e, *links])


def library(spark: SparkSession, sf_dir: str, graded: bool = False) -> tuple[DataFrame, DataFrame]:
    """A catalog with an entry for each customer: its orders are steps or sections, their lines materials or criteria.

    ``graded``: the same trees as rubrics, most of them below a document that covers the customer's course.
    """
    top, step, leaf = ("Rubric", "RubricSection", "RubricCriterion") if graded else ("InstructionalRoutine", "InstructionalRoutine", "Material")
    c, o, x = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), orders_in_turn(spark, sf_dir), lines(spark, sf_dir)
    kind = F.when(F.col("c_custkey") % 3 == 1, "formatter").when(F.col("c_custkey") % 3 == 2, "rubric")
    entry, part = lambda k: key("B", k, 7), lambda k: key("BO", k, 9)
    line = F.concat(key("BL", "l_orderkey", 9), F.lit("-"), F.col("l_linenumber").cast("string"))
    body = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("Flag "), F.col("l_returnflag")))
    nodes = [
        _node(c, entry("c_custkey"), top, description=F.col("c_name"), metadata=F.struct(kind.alias("catalogKind"), F.col("c_mktsegment").alias("scale"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("summary"))),
        _node(o, part("o_orderkey"), step, description=F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), metadata=F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("weight")), position=F.col("position")),
        _node(x, line, leaf, description=F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")), content=body, position=F.col("l_linenumber")),
    ]
    edge = lambda df, kind, src, dst: df.select(F.concat(F.lit(f"{kind}:"), src, F.lit("->"), dst).alias("id"), F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"))
    links = [edge(o, "hasPart", entry("o_custkey"), part("o_orderkey")), edge(x, "hasPart", part("l_orderkey"), line)]
    if graded:
        document = key("M", "c_custkey", 7)
        nodes.append(_node(c, document, "TeachingLearningMaterial", description=F.concat(F.lit("Of "), F.col("c_name"))))
        links += [edge(c.where("c_custkey % 4 <> 0"), "hasPart", document, entry("c_custkey")), edge(c.where("c_custkey % 7 <> 0"), "covers", document, key("C", "c_custkey", 7))]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, links)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership rows (userId, workspace, role, seq) and the last one of a user in a workspace counts: customers stand in."""
    role = F.element_at(F.array(F.lit("curator"), F.lit("approver"), F.lit("admin")), (F.col("c_custkey") % 3 + 1).cast("int"))
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("u"), (F.col("c_custkey") % 50).cast("string")).alias("userId"), F.lower("c_mktsegment").alias("workspace"), role.alias("role"), F.col("c_custkey").alias("seq"))


def users(spark: SparkSession) -> DataFrame:
    """(userId, superAdmin, legacyRole, known) of fifty users."""
    return spark.range(50).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("userId"), (F.col("id") % 17 == 0).alias("superAdmin"), F.when(F.col("id") % 5 == 0, "approver").alias("legacyRole"), (F.col("id") % 7 != 0).alias("known"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id % 13 <> 0")
    return d.select(key("O", "doc_id", 9).alias("nodeId"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("relPath"), F.md5("text").alias("md5"))


def bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id % 11 <> 0")
    md5 = F.when(F.col("doc_id") % 7 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text"))
    return d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("relPath"), md5.alias("md5"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, renderings map, tags): one entry for each part name."""
    p = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min(F.struct("p_partkey", "p_type")).alias("first"))
    return p.select(
        key("G", F.col("first.p_partkey"), 7).alias("id"), F.create_map(F.lit("en"), F.col("p_name"), F.lit("xx"), F.reverse("p_name")).alias("renderings"),
        F.array(F.col("first.p_type")).alias("tags"),
    )


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, domain) rows: the part types used in the orders at each position."""
    used = lines(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    at = orders_in_turn(spark, sf_dir).select("o_orderkey", F.col("position").alias("ordinal"))
    return used.join(at, F.col("l_orderkey") == F.col("o_orderkey")).select("ordinal", F.col("p_type").alias("domain"))


#: The same projection for DuckDB, as common table expressions.
SQL = r"""
turns AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, row_number() OVER w AS position, lag(o_orderkey) OVER w AS before
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_returnflag) AS k FROM lineitem) WHERE k = 1),
nodes AS (
  SELECT 'R' || lpad(CAST(r_regionkey AS VARCHAR), 2, '0') AS id, 'StandardsFramework' AS type, '{"description":"' || r_name || '"}' AS props FROM region
  UNION ALL SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), 'StandardsFrameworkItem', '{"description":"' || n_name || '","normalizedStatementType":"Standard"}' FROM nation
  UNION ALL SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0'), 'LearningComponent', '{"description":"' || s_name || '"}' FROM supplier
  UNION ALL SELECT 'C' || lpad(CAST(c_custkey AS VARCHAR), 7, '0'), 'Course', '{"audience":"' || c_mktsegment || '","description":"' || c_name || '"}' FROM customer
  UNION ALL SELECT 'O' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), 'LessonGrouping', '{"description":"Order ' || o_orderkey || '","groupName":"' || o_orderstatus || '","position":' || position || '}' FROM turns
  UNION ALL SELECT 'L' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || l_linenumber, 'Lesson',
    '{' || CASE WHEN l_returnflag = 'R' THEN '"educationalUse":"Assessment",' ELSE '' END || '"position":' || l_linenumber || '}' FROM lines
  UNION ALL SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 7, '0'), 'Material', '{"description":"' || p_name || '","materialType":"' || p_type || '"}' FROM part
  UNION ALL SELECT DISTINCT 'T' || lpad(regexp_extract(source, '(\d+)', 1), 3, '0'), 'TeachingLearningMaterial', '{"description":"' || source || '"}' FROM documents
  UNION ALL SELECT 'D' || lpad(CAST(doc_id AS VARCHAR), 7, '0'), 'DocumentSection', '{"position":' || row_number() OVER (PARTITION BY source ORDER BY doc_id) || '}' FROM documents),
edges AS (
  SELECT type || ':' || src || '->' || dst AS id, type, src, dst FROM (
    SELECT 'hasChild' AS type, 'R' || lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS src, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS dst FROM nation
    UNION ALL SELECT 'supports', 'S' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0'), 'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') FROM supplier
    UNION ALL SELECT 'hasEducationalAlignment', 'C' || lpad(CAST(c_custkey AS VARCHAR), 7, '0'), 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') FROM customer
    UNION ALL SELECT 'hasPart', 'C' || lpad(CAST(o_custkey AS VARCHAR), 7, '0'), 'O' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') FROM turns
    UNION ALL SELECT 'hasDependency', 'O' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), 'O' || lpad(CAST(before AS VARCHAR), 9, '0') FROM turns WHERE before IS NOT NULL
    UNION ALL SELECT 'hasPart', 'O' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0'), 'L' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || l_linenumber FROM lines
    UNION ALL SELECT 'hasPart', 'L' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || l_linenumber, 'P' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') FROM lines
    UNION ALL SELECT 'hasPart', 'T' || lpad(regexp_extract(source, '(\d+)', 1), 3, '0'), 'D' || lpad(CAST(doc_id AS VARCHAR), 7, '0') FROM documents
    UNION ALL SELECT 'covers', 'D' || lpad(CAST(doc_id AS VARCHAR), 7, '0'), 'O' || lpad(CAST(doc_id AS VARCHAR), 9, '0') FROM documents WHERE doc_id % 10 <> 0))
"""

#: Routines, formatters and what uses them, on top of ``SQL``.
EXTENDED_SQL = r"""
sources AS (SELECT DISTINCT source, lpad(regexp_extract(source, '(\d+)', 1), 3, '0') AS nr FROM documents),
routines AS (SELECT 'I' || lpad(CAST(r_regionkey AS VARCHAR), 2, '0') AS id, r_name FROM region),
ext_nodes AS (
  SELECT id, type, props FROM nodes
  UNION ALL SELECT id, 'InstructionalRoutine', '{"description":"Routine ' || r_name || '"}' FROM routines
  UNION ALL SELECT id || '-1', 'InstructionalRoutine', '{"description":"Practise","position":2}' FROM routines
  UNION ALL SELECT id || '-2', 'Material', '{"description":"Explain","position":1}' FROM routines
  UNION ALL SELECT id || '-3', 'Material', '{"description":"Sheet","position":1}' FROM routines
  UNION ALL SELECT 'F' || nr, 'Formatter', '{"description":"Format ' || source || '"}' FROM sources
  UNION ALL SELECT 'F' || nr || '-1', 'FormatterSpec', '{"description":"Wide"}' FROM sources
  UNION ALL SELECT 'E' || lpad(CAST(doc_id AS VARCHAR), 7, '0'), 'Formatter', '{"description":"Own"}' FROM documents WHERE doc_id % 50 = 0),
ext_edges AS (
  SELECT type, src, dst FROM edges
  UNION ALL SELECT 'hasPart', id, id || '-1' FROM routines UNION ALL SELECT 'hasPart', id, id || '-2' FROM routines UNION ALL SELECT 'hasPart', id || '-1', id || '-3' FROM routines
  UNION ALL SELECT 'hasPart', 'T' || nr, 'F' || nr FROM sources UNION ALL SELECT 'hasPart', 'F' || nr, 'F' || nr || '-1' FROM sources
  UNION ALL SELECT 'hasPart', 'D' || lpad(CAST(doc_id AS VARCHAR), 7, '0'), 'E' || lpad(CAST(doc_id AS VARCHAR), 7, '0') FROM documents WHERE doc_id % 50 = 0
  UNION ALL SELECT 'usesRoutine', 'C' || lpad(CAST(c_custkey AS VARCHAR), 7, '0'), 'I' || lpad(CAST(n_regionkey AS VARCHAR), 2, '0') FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0
  UNION ALL SELECT 'usesRoutine', 'T' || nr, 'I00' FROM sources WHERE CAST(nr AS INTEGER) % 2 = 0
  UNION ALL SELECT 'usesRoutine', 'D' || lpad(CAST(doc_id AS VARCHAR), 7, '0'), 'I01' FROM documents WHERE doc_id % 20 = 0)
"""

MEMBERS_SQL = r"""
members AS (SELECT 'u' || c_custkey % 50 AS userId, lower(c_mktsegment) AS workspace, CASE c_custkey % 3 WHEN 0 THEN 'curator' WHEN 1 THEN 'approver' ELSE 'admin' END AS role, c_custkey AS seq FROM customer),
users AS (SELECT 'u' || i AS userId, i % 17 = 0 AS superAdmin, CASE WHEN i % 5 = 0 THEN 'approver' END AS legacyRole, i % 7 <> 0 AS known FROM range(50) t(i)),
latest AS (SELECT userId, workspace, arg_max(role, seq) AS role FROM members GROUP BY ALL),
effective AS (
  SELECT userId, workspace, role FROM latest WHERE userId NOT IN (SELECT userId FROM users WHERE superAdmin)
  UNION ALL SELECT u.userId, 'building', legacyRole FROM users u WHERE legacyRole IS NOT NULL AND NOT superAdmin AND NOT EXISTS (SELECT 1 FROM latest l WHERE l.userId = u.userId AND l.workspace = 'building')
  UNION ALL SELECT u.userId, w.workspace, 'super_admin' FROM users u, (SELECT DISTINCT workspace FROM members) w WHERE superAdmin)
"""

#: The draft overlay and the merged draft, on top of ``SQL``.
OVERLAY_SQL = r"""
node_overlay AS MATERIALIZED (
  SELECT id, type, regexp_replace(props, '("description":"[^"]*)"', '\1 (draft)"') AS props, false AS dead FROM nodes
    WHERE type IN ('Course', 'LessonGrouping') AND CAST(substr(id, 2) AS BIGINT) % 97 = 3
  UNION ALL SELECT id, type, props, true FROM nodes WHERE type = 'Material' AND CAST(substr(id, 2) AS BIGINT) % 101 = 5
  UNION ALL SELECT 'X' || lpad(CAST(CAST(substr(id, 2) AS BIGINT) AS VARCHAR), 9, '0'), 'LessonGrouping', '{"description":"Added for ' || id || '"}', false
    FROM nodes WHERE type = 'Course' AND CAST(substr(id, 2) AS BIGINT) % 103 = 7),
edge_overlay AS MATERIALIZED (
  SELECT id, type, src, dst, true AS dead FROM edges WHERE type = 'hasPart' AND dst LIKE 'P%' AND CAST(substr(dst, 2) AS BIGINT) % 101 = 5
  UNION ALL SELECT 'hasPart:C' || lpad(CAST(CAST(substr(id, 2) AS BIGINT) AS VARCHAR), 7, '0') || '->' || id, 'hasPart', 'C' || lpad(CAST(CAST(substr(id, 2) AS BIGINT) AS VARCHAR), 7, '0'), id, false
    FROM node_overlay WHERE id LIKE 'X%'),
draft_nodes AS (
  SELECT id, type, props FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM node_overlay o WHERE o.id = n.id)
  UNION ALL SELECT id, type, props FROM node_overlay WHERE NOT dead),
draft_edges AS (
  SELECT id, type, src, dst FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edge_overlay o WHERE o.id = e.id)
  UNION ALL SELECT id, type, src, dst FROM edge_overlay WHERE NOT dead)
"""
