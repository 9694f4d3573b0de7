"""More queries of the graph engine: the store, mutations, memberships, catalog, files and scalar functions.

As in ``registry``, every query runs over whole tables and has its SQL.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import scratch
from weftgraph.functions import jsontext, text
from weftgraph.operators import audit, catalog, display, export, lifecycle, lookup, mutate, ordering, overlay, parse, rewrite, scope, stats, traverse, workspaces
from weftgraph.operators.mutate import Graph
from weftgraph.operators.store import Store
from weftgraph.plans.registry import _AUDIT, _DIFF, _DRAWN, _LEXICON, _UNITS, COURSE, _query, graph
from weftgraph.sources import files, project

NAMESPACE = "building/g1/maths"
_EXT, _MEMBERS = project.EXTENDED_SQL, project.MEMBERS_SQL


# --- store ----------------------------------------------------------------------------------------
def _store(spark: SparkSession, sf_dir: str) -> Store:
    s = Store(spark, scratch.new_path(spark, "store"))
    s.write(NAMESPACE, Graph(*graph(spark, sf_dir)), {"guide": "g"})
    return s


def _staged(spark: SparkSession, sf_dir: str) -> Store:
    s = _store(spark, sf_dir)
    s.create_draft(NAMESPACE)
    s.stage(NAMESPACE, Graph(*project.overlay(spark, sf_dir)))
    return s


@_query("SELECT id, type, props FROM nodes")
def k1_published_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).published(NAMESPACE).nodes.select("id", "type", "props")


@_query("SELECT 'building/g1/maths' AS namespace, true AS published, false AS draft, 'g' AS guide UNION ALL SELECT 'building/_catalog/maths', true, true, NULL")
def s3_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, other = _store(spark, sf_dir), "building/_catalog/maths"
    s.write(other, Graph(*graph(spark, sf_dir)))
    s.create_draft(other)
    rows = [(n, bool(p["published"]), bool(p["draft"]), (p["config"] or {}).get("guide")) for n in s.namespaces() if (p := s.pointer(n))]
    return spark.createDataFrame(rows, "namespace string, published boolean, draft boolean, guide string")


@_query("SELECT id, type, props FROM draft_nodes", True)
def o3_staged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(spark, sf_dir).active(NAMESPACE)[0].nodes.select("id", "type", "props")


@_query("SELECT id, type, src, dst FROM draft_edges", True)
def s17_active_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(spark, sf_dir).active(NAMESPACE)[0].edges.select("id", "type", "src", "dst")


@_query("SELECT id, type, props FROM draft_nodes", True)
def o4_published_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _staged(spark, sf_dir)
    s.publish(NAMESPACE)
    return s.published(NAMESPACE).nodes.select("id", "type", "props")


@_query("SELECT id, type, src, dst FROM edges")
def o5_discarded_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _staged(spark, sf_dir)
    s.discard(NAMESPACE)
    return s.active(NAMESPACE)[0].edges.select("id", "type", "src", "dst")


@_query("SELECT side, id, op FROM diff", True, _DIFF)
def o11_staged_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(spark, sf_dir).difference(NAMESPACE)


@_query("SELECT id, kind, title, text, ord, is_assessment FROM units", True, _UNITS.replace("FROM nodes WHERE", "FROM draft_nodes WHERE").replace("THEN json_extract_string(props, '$.groupName')", "THEN coalesce(json_extract_string(props, '$.groupName'), type)"))
def s18_draft_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, slot = _staged(spark, sf_dir).active(NAMESPACE)
    return parse.units(g.nodes.where(F.lit(slot == "draft")))


@_query("SELECT type, count(*) AS n FROM nodes WHERE id NOT LIKE 'D%' AND id NOT LIKE 'T%' GROUP BY type")
def m20_staged_and_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    documents = [r.id for r in graph(spark, sf_dir)[0].where("type = 'TeachingLearningMaterial'").collect()]  # one for each source
    s.stage_and_publish(NAMESPACE, lambda g: mutate.delete_nodes(g, documents))
    return s.published(NAMESPACE).nodes.groupBy("type").agg(F.count("*").alias("n"))


_ROLES = [("cora", "building", "curator"), ("ann", "building", "approver"), ("bob", "other", "admin")]


def _drafts(spark: SparkSession, sf_dir: str, self_approval: bool = True) -> lifecycle.Drafts:
    ticks = iter(range(10**6))
    return lifecycle.Drafts(_store(spark, sf_dir), spark.createDataFrame(_ROLES, "userId string, workspace string, role string"), lambda: f"2024-01-01T00:00:{next(ticks):06}Z", self_approval)


@_query("""SELECT * FROM (VALUES (1, 'apply', 'unauthorized', 'no role'), (2, 'apply', 'applied', NULL), (3, 'publish', 'unauthorized', 'needs approver'), (4, 'publish', 'preview', NULL),
  (5, 'discard', 'failed', 'token of another step'), (6, 'apply', 'applied', NULL), (7, 'publish', 'failed', 'the draft has moved'), (8, 'publish', 'done', NULL),
  (9, 'publish', 'failed', 'token used before'), (10, 'publish', 'preview', 'no draft')) v(step, action, status, reason)""")
def m20_publishing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, said = _drafts(spark, sf_dir), []
    cut = lambda ids: lambda g: mutate.delete_nodes(g, ids)
    note = lambda action, reply: said.append((len(said) + 1, action, reply["status"], "no draft" if reply.get("draft") is False else reply.get("reason")))
    note("apply", d.stage(NAMESPACE, "bob", "cut", cut(["T003"])))
    note("apply", d.stage(NAMESPACE, "cora", "cut", cut(["T003"])))
    note("publish", d.preview("publish", NAMESPACE, "cora"))
    note("publish", first := d.preview("publish", NAMESPACE, "ann"))
    note("discard", d.confirm("discard", NAMESPACE, "ann", first["token"]))
    note("apply", d.stage(NAMESPACE, "ann", "cut", cut(["T004"])))
    note("publish", d.confirm("publish", NAMESPACE, "ann", first["token"]))
    again = d.preview("publish", NAMESPACE, "ann")
    note("publish", d.confirm("publish", NAMESPACE, "ann", again["token"]))
    note("publish", d.confirm("publish", NAMESPACE, "ann", again["token"]))
    note("publish", d.preview("publish", NAMESPACE, "ann"))
    return spark.createDataFrame(said, "step int, action string, status string, reason string")


@_query("""SELECT * FROM (VALUES ('createDraft', 'cora', NULL, 0, NULL), ('apply', 'cora', NULL, 0, NULL), ('blocked', 'cora', 'node ''none'' not found', 0, NULL), ('apply', 'ann', NULL, 0, NULL),
  ('blocked', 'ann', 'unauthorized: own changes need another approver', 0, NULL), ('discard', 'ann', NULL, 2, NULL)) v("eventType", actor, reason, n_ids, self_authored)""")
def m20_logged_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _drafts(spark, sf_dir, self_approval=False)
    for actor, ids in (("cora", ["T003"]), ("cora", ["none"]), ("ann", ["T004"])):
        d.stage(NAMESPACE, actor, "cut", lambda g, ids=ids: mutate.delete_nodes(g, ids))
    for step in ("publish", "discard"):
        d.confirm(step, NAMESPACE, "ann", d.preview(step, NAMESPACE, "ann")["token"])
    n = F.coalesce(F.size("ids"), F.lit(0))
    return d.log(NAMESPACE).select("eventType", "actor", "reason", F.greatest(n, F.lit(0)).alias("n_ids"), F.col("selfAuthored").alias("self_authored"))


@_query("""SELECT id, type FROM draft_nodes WHERE id IN (SELECT id FROM course)""", True, more="course AS (SELECT 'C0000001' AS id UNION ALL SELECT dst FROM draft_edges WHERE type = 'hasPart' AND src = 'C0000001' UNION ALL SELECT b.dst FROM draft_edges a JOIN draft_edges b ON b.src = a.dst AND b.type = 'hasPart' WHERE a.type = 'hasPart' AND a.src = 'C0000001' UNION ALL SELECT c.dst FROM draft_edges a JOIN draft_edges b ON b.src = a.dst AND b.type = 'hasPart' JOIN draft_edges c ON c.src = b.dst AND c.type = 'hasPart' WHERE a.type = 'hasPart' AND a.src = 'C0000001')")
def c26_previewed_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lifecycle.Drafts(_staged(spark, sf_dir), spark.createDataFrame(_ROLES, "userId string, workspace string, role string"), lambda: "2024")
    return d.preview_course(NAMESPACE, "cora", COURSE)["nodes"].select("id", "type")


@_query("""SELECT * FROM (VALUES (1, 'unauthorized', 0, NULL), (2, 'read', 1, 'blocked'), (3, 'read', 1, 'read')) v(step, status, n, kind)""")
def c10_read_is_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, rows = _drafts(spark, sf_dir), []
    for actor, conditions in (("cora", {}), ("ann", {"outcome": "blocked"}), ("ann", {"event_type": "read"})):
        reply = d.read_log(NAMESPACE, actor, **conditions)
        found = reply.get("records", [])
        rows.append((len(rows) + 1, reply["status"], len(found), found[0]["eventType"] if found else None))
    return spark.createDataFrame(rows, "step int, status string, n int, kind string")


@_query("SELECT id, id AS document FROM nodes WHERE type = 'TeachingLearningMaterial' UNION ALL SELECT e.dst, min(e.src) FROM edges e JOIN nodes c ON c.id = e.dst AND c.type = 'Course' JOIN nodes d ON d.id = e.src AND d.type = 'TeachingLearningMaterial' WHERE e.type = 'covers' GROUP BY e.dst")
def j18_documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.documents_of(*graph(spark, sf_dir))


@_query("SELECT eventType, count(*) AS n FROM log GROUP BY eventType", more=_AUDIT)
def k11_appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, log = Store(spark, scratch.new_path(spark, "store")), project.audit(spark, sf_dir)
    s.append_audit(log.where("eventType = 'apply'"))
    s.append_audit(log.where("eventType <> 'apply'"))
    return s.audit().groupBy("eventType").agg(F.count("*").alias("n"))


# --- mutations ------------------------------------------------------------------------------------
def _whole(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(*graph(spark, sf_dir))


@_query("SELECT type, count(*) + CASE type WHEN 'Lesson' THEN 1 ELSE 0 END AS n FROM nodes GROUP BY type")
def m1_created_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.create_node(_whole(spark, sf_dir), "Z1", "Lesson", {"position": 1}).nodes.groupBy("type").agg(F.count("*").alias("n"))


@_query("SELECT src, dst FROM edges WHERE type = 'covers' UNION ALL SELECT src, dst FROM (VALUES ('T003', 'C0000001'), ('T004', 'C0000001')) v(src, dst)")
def m2_created_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = mutate.create_edges(_whole(spark, sf_dir), [("covers", "T003", COURSE), ("covers", "T004", COURSE)])
    return after.edges.where("type = 'covers'").select("src", "dst")


@_query("SELECT id FROM edges WHERE type = 'hasChild' AND id <> (SELECT min(id) FROM edges WHERE type = 'hasChild')")
def m3_deleted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _whole(spark, sf_dir)
    first = g.edges.where("type = 'hasChild'").agg(F.min("id").alias("id")).first().id
    return mutate.delete_edges(g, [first]).edges.where("type = 'hasChild'").select("id")


@_query("SELECT k AS id, CAST(p + n AS DOUBLE) AS position FROM (SELECT max(CAST(json_extract_string(n.props, '$.position') AS DOUBLE)) AS p FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.src = 'C0000001' AND e.type = 'hasPart') m, (VALUES ('Z1', 1), ('Z2', 2), ('Z3', 3)) v(k, n)")
def m8_added_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = mutate.add_nodes(_whole(spark, sf_dir), [{"id": f"Z{i}", "label": "LessonGrouping", "parent": COURSE} for i in (1, 2, 3)])
    return after.nodes.where("id LIKE 'Z%'").select("id", parse.prop("position").cast("double").alias("position"))


@_query("SELECT src, type, dst FROM edges WHERE dst = 'O000000001' AND type <> 'hasPart' UNION ALL SELECT 'C0000002', 'hasPart', 'O000000001'")
def m10_moved_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.move_node(_whole(spark, sf_dir), "O000000001", "C0000002").edges.where("dst = 'O000000001'").select("src", "type", "dst")


@_query("""SELECT id, '{"audience":"' || json_extract_string(props, '$.audience') || '","description":"Fresh","metadata":{"en":{"description":"New"},"summary":"short"},"position":7}' AS props FROM nodes WHERE id = 'C0000001' UNION ALL SELECT id, props FROM nodes WHERE type = 'Course' AND id <> 'C0000001'""")
def m12_edited_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = mutate.edit_node(_whole(spark, sf_dir), COURSE, title="Fresh", title_en="New", summary="short", position=7)
    return after.nodes.where("type = 'Course'").select("id", "props")


@_query("""SELECT id, path, regexp_matches(path, '^(position|description|normalizedStatementType|metadata\\.order|metadata\\.role)(\\.|$)') AS refused FROM (
  SELECT n.id, k.key || suffix AS path FROM nodes n, unnest(json_keys(n.props)) AS k(key), (VALUES (''), ('.x'), ('Foo')) s(suffix)
  UNION ALL SELECT id, 'metadata.' || k.key FROM (SELECT id, json_keys('{"order":1,"role":"a","guide":"b","roles":1}') AS keys FROM nodes WHERE type = 'Course'), unnest(keys) AS k(key))""".replace("\\\\", "\\"))
def m13_protected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every property that a node has, what would be inside it, and names that only begin like it, as paths of a free edit."""
    n = graph(spark, sf_dir)[0]
    own = n.select("id", F.explode(F.json_object_keys("props")).alias("key")).select("id", F.explode(F.array(*(F.concat("key", F.lit(x)) for x in ("", ".x", "Foo")))).alias("path"))
    inner = n.where("type = 'Course'").select("id", F.explode(F.array(*(F.lit(f"metadata.{x}") for x in ("order", "role", "guide", "roles")))).alias("path"))
    return own.unionByName(inner).withColumn("refused", mutate.is_protected(F.col("path")))


@_query("SELECT id, CASE WHEN id LIKE 'R%' THEN json_extract_string(props, '$.description') || '!' ELSE json_extract_string(props, '$.description') END AS description FROM nodes WHERE type IN ('StandardsFramework', 'StandardsFrameworkItem')")
def m5_edited_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _whole(spark, sf_dir)
    changes = g.nodes.where("type = 'StandardsFramework'").select("id", F.create_map(F.lit("description"), F.concat(parse.prop("description"), F.lit("!"))).alias("changes"))
    return mutate.edit_many(g, changes).nodes.where("type LIKE 'Standards%'").select("id", parse.prop("description").alias("description"))


@_query("SELECT 'preview' AS outcome, count(*) AS gone FROM (SELECT dst FROM edges WHERE src = 'R00' AND type = 'hasChild') UNION ALL SELECT 'applied', 0 UNION ALL SELECT 'token used before', 0 UNION ALL SELECT 'arguments differ', 0 UNION ALL SELECT 'stale', 0 UNION ALL SELECT 'blocked', 0")
def m19_previewed_and_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, w = _whole(spark, sf_dir), mutate.Workflow(lambda: 1000.0)
    args = {"ids": [r.id for r in g.edges.where("src = 'R00' AND type = 'hasChild'").select("id").collect()]}  # the nations of one region
    act = lambda base, a: mutate.delete_edges(base, a["ids"])
    p = w.preview("cut", g, g, args, act)
    rows = [(p["status"], p["counts"]["edges_removed"])]
    rows += [(w.confirm("cut", g, args, p["token"], act)[0], 0) for _ in range(2)]
    rows.append((w.confirm("cut", g, {"ids": []}, p["token"], act)[0], 0))
    fresh = w.preview("cut", g, g, args, act)
    rows.append((mutate.Workflow(lambda: 1000.0).confirm("cut", Graph(g.nodes, g.edges.where("type <> 'covers'")), args, fresh["token"], act)[0], 0))
    rows.append((w.preview("cut", g, g, {"ids": ["none"]}, act)["status"], 0))
    return spark.createDataFrame(rows, "outcome string, gone long")


_COURSE_GONE = """gone_orders AS (SELECT dst AS id FROM edges WHERE type = 'hasPart' AND src = 'C0000001'),
gone_lessons AS (SELECT dst AS id FROM edges WHERE type = 'hasPart' AND src IN (SELECT id FROM gone_orders)),
gone AS (SELECT 'C0000001' AS id UNION ALL SELECT id FROM gone_orders UNION ALL SELECT id FROM gone_lessons UNION ALL
  SELECT e.dst FROM edges e WHERE e.type = 'hasPart' AND e.dst LIKE 'P%' GROUP BY e.dst HAVING count(*) FILTER (e.src NOT IN (SELECT id FROM gone_lessons)) = 0)"""


@_query("""SELECT 'removes ' || (SELECT count(*) FROM gone) || ' node(s) and ' || (SELECT count(*) FROM edges WHERE src IN (SELECT id FROM gone) OR dst IN (SELECT id FROM gone)) || ' edge(s): '
  || (SELECT string_agg(id, ', ' ORDER BY place) FROM (SELECT id, row_number() OVER (ORDER BY id <> 'C0000001', id) AS place FROM gone) WHERE place <= 8) || CASE WHEN (SELECT count(*) FROM gone) > 8 THEN ', …' ELSE '' END AS warning""",
    more=_COURSE_GONE)
def l15_cascade_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(w,) for w in mutate.cascade_warnings(_whole(spark, sf_dir), [COURSE])], "warning string")


@_query("SELECT count(*) AS nodes, (SELECT count(*) FROM edges WHERE type = 'hasChild') AS edges FROM nodes WHERE type = 'Course'")
def l17_document_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    found = export.document({"id": "d"}, n.where("type = 'Course'").select("id", "props"), e.where("type = 'hasChild'").select("src", "dst"), 1000)["curriculum"]
    return spark.createDataFrame([(found["nodes"], found["edges"])], "nodes long, edges long")


@_query("SELECT count(*) AS n FROM edges WHERE dst LIKE 'P%'")
def v5_structural_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return overlay.dangling(e, n.where("type <> 'Material'")).agg(F.count("*").alias("n"))


# --- rewriting ------------------------------------------------------------------------------------
@_query("SELECT 'nodes' AS what, count(*) AS n FROM (SELECT DISTINCT e.src, json_extract_string(o.props, '$.groupName') FROM edges e JOIN nodes o ON o.id = e.dst WHERE o.type = 'LessonGrouping' AND e.type = 'hasPart') UNION ALL SELECT 'edges', (SELECT count(*) FROM edges) + (SELECT count(*) FROM (SELECT DISTINCT e.src, json_extract_string(o.props, '$.groupName') FROM edges e JOIN nodes o ON o.id = e.dst WHERE o.type = 'LessonGrouping' AND e.type = 'hasPart'))")
def p11_grouped_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    named = n.where("type = 'LessonGrouping'").select(F.col("id").alias("dst"), parse.prop("groupName").alias("name"))
    groups = e.where("type = 'hasPart'").join(named, "dst").select(F.col("src").alias("parent"), F.col("dst").alias("child"), "name")
    nodes, links = rewrite.grouped_between(e, groups)
    return nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "n").unionByName(links.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n"))


@_query("SELECT count(*) AS n, count(DISTINCT json_extract_string(props, '$.groupName')) AS names FROM (SELECT DISTINCT props->>'$.groupName' AS g, '{\"groupName\":\"' || (props->>'$.groupName') || '\"}' AS props FROM nodes WHERE type = 'LessonGrouping')")
def p12_minted(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = graph(spark, sf_dir)[0].where("type = 'LessonGrouping'").select(parse.prop("groupName").alias("g"))
    made = rewrite.mint(seeds, F.concat(F.lit("group/"), "g"), "LessonGrouping", F.to_json(F.struct(F.col("g").alias("groupName"))))
    return made.agg(F.count("*").alias("n"), F.countDistinct(parse.prop("groupName")).alias("names"))


@_query("""SELECT r.r_name AS week, s.session, coalesce(a.n, b.n) AS standard FROM region r, (VALUES (1, 'a'), (2, 'b')) s(session, type)
  LEFT JOIN (SELECT r_name AS week, CASE n_nationkey % 2 WHEN 0 THEN 'a' ELSE 'b' END AS type, min(n_name) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0 AND r_regionkey <> 1 GROUP BY ALL) a ON a.week = r.r_name AND a.type = s.type
  LEFT JOIN (SELECT r_name AS week, CASE n_nationkey % 2 WHEN 0 THEN 'a' ELSE 'b' END AS type, min(n_name) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0 AND r_regionkey = 2 GROUP BY ALL) b ON b.type = s.type""")
def p13_expanded_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = project.table(spark, sf_dir, "region"), project.table(spark, sf_dir, "nation")
    kind = F.when(F.col("n_nationkey") % 2 == 0, "a").otherwise("b")
    held = nation.where("n_nationkey % 3 <> 0 AND n_regionkey <> 1").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    standards = held.groupBy(F.col("r_name").alias("week"), kind.alias("type")).agg(F.min("n_name").alias("standard"))
    fallback = region.where("r_regionkey = 2").first().r_name
    sessions = spark.createDataFrame([(1, "a"), (2, "b")], "session int, type string")
    return rewrite.expanded(region.select(F.col("r_name").alias("week")), sessions, standards, fallback)


@_query("SELECT 'C' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS src, 'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS dst, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY c_custkey) - 1 AS INTEGER) AS running FROM customer JOIN supplier ON s_suppkey = c_custkey % 5 + 1")
def p14_aligned_to_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    c = project.table(spark, sf_dir, "customer")
    src, dst = project.key("C", "c_custkey", 7), project.key("S", F.col("c_custkey") % 5 + 1, 7)
    onto = c.select(F.concat(F.lit("hasEducationalAlignment:"), src, F.lit("->"), dst).alias("id"), F.lit("hasEducationalAlignment").alias("type"), src.alias("src"), dst.alias("dst"))
    ids = lambda kind: n.where(F.col("type") == kind).select("id")
    return rewrite.aligned_to_single_parent(e.where("type = 'supports'").unionByName(onto), ids("LearningComponent"), ids("StandardsFrameworkItem")).select("src", "dst", "running")


@_query("SELECT CASE WHEN type = 'Lesson' AND json_extract_string(props, '$.educationalUse') = 'Assessment' THEN 'Activity' ELSE type END AS type, count(*) AS n FROM nodes GROUP BY 1")
def p17_relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rewrite.relabel(graph(spark, sf_dir)[0], (F.col("type") == "Lesson") & (parse.prop("educationalUse") == "Assessment"), "Activity")
    return found.where("labels[0] = type").groupBy("type").agg(F.count("*").alias("n"))


@_query("SELECT CASE WHEN c_custkey % 10 = 0 THEN 'failed' WHEN c_custkey % 3 = 0 THEN 'skipped' ELSE 'applied' END AS state, count(*) AS n FROM customer GROUP BY 1")
def p19_edit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = project.table(spark, sf_dir, "customer")
    node = F.concat(F.when(F.col("c_custkey") % 10 == 0, "?").otherwise(""), project.key("C", "c_custkey", 7))
    value = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("!")))
    return rewrite.edited(graph(spark, sf_dir)[0], c.select(node.alias("id"), F.lit("description").alias("field"), value.alias("value")))[1]


@_query("SELECT id, type, src, dst FROM edges")
def p6_raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, _ = graph(spark, sf_dir)
    stored, links = parse.serialised(n, project.numbered_edges(spark, sf_dir), parse.units(n))
    return parse.raw_envelope(stored, links)[1].select("id", "type", "src", "dst")


# --- walks, scopes and views ----------------------------------------------------------------------
_WALKED = """stepped AS (
  SELECT 'C0000001' AS id, 0 AS depth UNION ALL SELECT e.dst, s.depth + 1 FROM stepped s JOIN edges e ON e.src = s.id AND e.type = 'hasPart' WHERE s.depth < 2),
walked AS (SELECT id, min(depth) AS depth FROM stepped GROUP BY id)"""


@_query("SELECT id, depth FROM (SELECT *, row_number() OVER (ORDER BY depth, id) AS k FROM walked) WHERE k BETWEEN 6 AND 10", more=_WALKED)
def t6_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    first = traverse.walk(n, e, COURSE, "out", ["hasPart"], most_depth=2, limit=5, include_edges=False)
    depths = traverse.reached(e, COURSE, "out", ["hasPart"], 2)
    at = traverse.decode_cursor(first.next_cursor)
    return depths.where(traverse.after(at)).orderBy("depth", "id").limit(5)


@_query("SELECT id, base64(encode('{\"depth\":' || depth || ',\"id\":\"' || id || '\"}')) AS cursor FROM walked", more=_WALKED)
def t7_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e = graph(spark, sf_dir)
    return traverse.reached(e, COURSE, "out", ["hasPart"], 2).select("id", traverse.cursor_of(F.col("depth"), F.col("id")).alias("cursor"))


@_query("SELECT e.id FROM edges e JOIN walked w ON w.id = e.src WHERE e.type = 'hasPart' AND w.depth < 2 AND w.depth >= 0", more=_WALKED)
def f2_walked_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    page = traverse.walk(n, e, COURSE, "out", ["hasPart"], most_depth=2, limit=500, page_bytes=10_000_000)
    return spark.createDataFrame([(x["id"],) for x in page.edges], "id string")


@_query("SELECT dst AS id FROM ext_edges WHERE src = 'T003' AND dst LIKE 'F%'", more=_EXT)
def t16_document_formatters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.document_formatters(*project.extended(spark, sf_dir), "T003")


@_query("SELECT dst AS id FROM ext_edges WHERE src = 'D0000050' AND type = 'hasPart'", more=_EXT)
def t17_own_formatters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.own_formatters(*project.extended(spark, sf_dir), "D0000050")


_ROUTINE = """candidates AS (
  SELECT 0 AS rank, 0 AS depth, dst FROM ext_edges WHERE type = 'usesRoutine' AND src = '{0}'
  UNION ALL SELECT 1, 1, u.dst FROM ext_edges h JOIN ext_edges u ON u.src = h.src AND u.type = 'usesRoutine' WHERE h.dst = '{0}' AND h.type = 'hasPart'
  UNION ALL SELECT 2, 1, u.dst FROM ext_edges c JOIN ext_edges p ON p.dst = c.dst AND p.type = 'hasPart' JOIN ext_edges u ON u.src = p.src AND u.type = 'usesRoutine' WHERE c.src = '{0}' AND c.type = 'covers'),
chosen AS (SELECT dst FROM candidates ORDER BY rank, depth, dst LIMIT 1),
held AS (SELECT dst AS id FROM chosen UNION SELECT e.dst FROM held h JOIN ext_edges e ON e.src = h.id AND e.type = 'hasPart')"""


@_query("SELECT id FROM held", more=_EXT + ", " + _ROUTINE.format("D0000040"))
def t18_own_routine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.section_routine(*project.extended(spark, sf_dir), "D0000040")


@_query("SELECT id FROM held", more=_EXT + ", " + _ROUTINE.format("D0000006"))
def t18_inherited_routine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.section_routine(*project.extended(spark, sf_dir), "D0000006")


@_query("SELECT 'hasPart:' || e.src || '->' || e.dst AS id FROM below b JOIN ext_edges e ON e.src = b.id AND e.type = 'hasPart' GROUP BY ALL", more=_EXT + ", below AS (SELECT dst AS id FROM ext_edges WHERE src = 'D0000041' AND type = 'covers' UNION SELECT e.dst FROM below b JOIN ext_edges e ON e.src = b.id AND e.type = 'hasPart')")
def t19_section_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.section_subgraph(*project.extended(spark, sf_dir), "D0000041")["curriculum_edges"].select("id")


@_query("SELECT id FROM down UNION SELECT a.dst FROM down d JOIN edges a ON a.src = d.id AND a.type = 'hasEducationalAlignment' UNION SELECT s.src FROM down d JOIN edges a ON a.src = d.id AND a.type = 'hasEducationalAlignment' JOIN edges s ON s.dst = a.dst AND s.type = 'supports'",
    more="down AS (SELECT 'C0000001' AS id UNION SELECT dst FROM edges WHERE src = 'C0000001' AND type = 'hasPart')")
def t21_exported_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = export.subtree(*graph(spark, sf_dir), COURSE, 1, most_bytes=10_000_000)
    return spark.createDataFrame([(x["id"],) for x in found["nodes"]], "id string")


@_query("SELECT src, dst, rel, type, CAST(row_number() OVER (ORDER BY kind, a, b) AS DOUBLE) AS ord FROM (SELECT src, dst, CASE type WHEN 'hasPart' THEN 'hasChild' ELSE type END AS rel, type, type AS kind, src AS a, dst AS b FROM edges WHERE type IN ('hasPart', 'hasChild', 'covers') UNION ALL SELECT dst, src, CASE type WHEN 'hasDependency' THEN 'buildsTowards' ELSE 'hasChild' END, CASE type WHEN 'hasDependency' THEN 'buildsTowards' ELSE type END, type, src, dst FROM edges WHERE type IN ('supports', 'hasEducationalAlignment', 'hasDependency'))")
def f12_edge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.display_edges(graph(spark, sf_dir)[0], project.numbered_edges(spark, sf_dir))


@_query("SELECT id, 'audience=' || json_extract_string(props, '$.audience') || '|description=' || json_extract_string(props, '$.description') AS props FROM nodes WHERE type = 'Course'")
def f11_flat_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = display.flat_props(graph(spark, sf_dir)[0].where("type = 'Course'"))
    pairs = F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return flat.select("id", F.array_join(pairs, "|").alias("props"))


@_query("SELECT DISTINCT parent, child FROM (SELECT dst AS parent, src AS child FROM drawn WHERE type = 'hasEducationalAlignment' AND dst LIKE 'C%' UNION ALL SELECT src, dst FROM drawn WHERE type = 'supports' AND src LIKE 'N%')", more=_DRAWN)
def u4_grafted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return display.grafted(display.display_edges(n, e), display.display_nodes(n), [("Course", "hasEducationalAlignment", "in"), ("Course", "hasPart", "out"), ("StandardsFrameworkItem", "supports", "out")])


@_query("SELECT id, min(depth) AS depth FROM up GROUP BY id", more=_DRAWN + ", numbered AS (SELECT *, row_number() OVER (ORDER BY type, src, dst) AS seq FROM edges), parent AS (SELECT child AS dst, arg_max(parent, seq) AS src FROM (SELECT src AS parent, dst AS child, seq FROM numbered WHERE type IN ('hasPart', 'hasChild') UNION ALL SELECT dst, src, seq FROM numbered WHERE type IN ('supports', 'hasEducationalAlignment')) GROUP BY child), up AS (SELECT 'O000000001' AS id, 0 AS depth UNION ALL SELECT p.src, u.depth + 1 FROM up u JOIN parent p ON p.dst = u.id)")
def c25_revealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.reveal(display.display_edges(graph(spark, sf_dir)[0], project.numbered_edges(spark, sf_dir)), "O000000001")


@_query("SELECT name, row_number() OVER (ORDER BY CASE name WHEN 'x' THEN 0 ELSE 1 END, TRY_CAST(name AS DOUBLE) NULLS LAST, name) AS place FROM (SELECT DISTINCT CASE WHEN p_partkey % 9 = 0 THEN 'x' WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 120 AS VARCHAR) ELSE p_type END AS name FROM part)")
def l12_bucket_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project.table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 9 == 0, "x").when(F.col("p_partkey") % 2 == 0, (F.col("p_partkey") % 120).cast("string")).otherwise(F.col("p_type"))
    from pyspark.sql import Window

    return p.select(name.alias("name")).distinct().select("name", F.row_number().over(Window.orderBy(*display.bucket_order(F.col("name"), ("x",)))).cast("long").alias("place"))


# --- log ------------------------------------------------------------------------------------------
@_query("SELECT id FROM log WHERE eventType = 'apply' AND node IN ('N07', 'N08')", more=_AUDIT)
def f5_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = project.audit(spark, sf_dir)
    diff = F.when(
        F.col("node") == "N08", F.lit('{"nodes":{"added":[],"removed":[],"changed":[]},"edges":{"added":[{"id":"hasChild:R01->N07"}],"removed":[],"changed":[]}}')
    ).otherwise(F.concat(F.lit('{"nodes":{"added":[],"removed":[],"changed":[{"id":"'), "node", F.lit('"}]},"edges":{"added":[],"removed":[],"changed":[]}}')))
    return audit.touching(log.withColumn("diff", diff), "N07").select("id")


@_query("SELECT coalesce(bool_or(actor = '17'), false) AS self_authored FROM log WHERE eventType = 'apply' AND ts >= (SELECT max(ts) FROM log WHERE eventType = 'createDraft')", more=_AUDIT)
def o17_self_authored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.self_authored(project.audit(spark, sf_dir), "17")


@_query("SELECT id FROM (SELECT *, lag(res) OVER (PARTITION BY actor ORDER BY ts, id) AS before FROM (SELECT *, 'v' || CAST(id AS BIGINT) AS res, 'v' || (CAST(id AS BIGINT) - CAST(id AS BIGINT) % 3) AS base FROM log WHERE eventType = 'apply')) WHERE before IS NOT NULL AND before <> base", more=_AUDIT)
def w7_broken_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id").cast("bigint")
    log = project.audit(spark, sf_dir).withColumn("resultingVersion", F.concat(F.lit("v"), n.cast("string"))).withColumn("baseVersion", F.concat(F.lit("v"), (n - n % 3).cast("string")))
    return audit.broken_chain(log, "actor").select("id")


@_query("SELECT id FROM log WHERE eventType = 'read' AND ts >= '2024-01-05T00:00:00.000Z' AND ts <= '2024-01-20T00:00:00.000Z'", more=_AUDIT)
def f4_matching_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.matching(project.audit(spark, sf_dir), event_type="read", since="2024-01-05T00:00:00.000Z", until="2024-01-20T00:00:00.000Z").select("id")


# --- memberships ----------------------------------------------------------------------------------
@_query("SELECT userId, string_agg(workspace || ':' || role, ',' ORDER BY workspace) AS roles FROM latest GROUP BY userId", more=_MEMBERS)
def s20_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.memberships(project.members(spark, sf_dir))
    return found.select("userId", F.array_join(F.transform(F.array_sort(F.map_entries("roles")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",").alias("roles"))


@_query("SELECT userId, workspace, role FROM effective", more=_MEMBERS)
def j19_effective_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.effective_roles(project.users(spark), project.members(spark, sf_dir), "building")


_TIERS = "tiers AS (SELECT * FROM (VALUES ('curator', 1), ('approver', 2), ('admin', 3), ('super_admin', 4)) v(tier, height)), needs AS (SELECT * FROM (VALUES ('apply', 1), ('discard', 1), ('readDraft', 1), ('publish', 2), ('readAudit', 2), ('manageMembers', 3), ('manageWorkspace', 4)) v(action, least))"


@_query(
    """SELECT u.userId, n.action, coalesce(known AND t.height >= n.least, false) AS allowed,
  CASE WHEN NOT known THEN 'no identity' WHEN t.height IS NULL THEN 'no role' WHEN t.height < n.least THEN 'needs ' || (SELECT tier FROM tiers WHERE height = n.least) END AS why
  FROM users u CROSS JOIN needs n LEFT JOIN effective e ON e.userId = u.userId AND e.workspace = 'building' LEFT JOIN tiers t ON t.tier = e.role""",
    more=_MEMBERS + ", " + _TIERS,
)
def v8_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = project.users(spark)
    asked = users.select("userId", "known", F.lit("building").alias("workspace"), F.explode(F.array(*map(F.lit, lookup.NEEDED))).alias("action"))
    return lookup.verdicts(asked, lookup.effective_roles(users, project.members(spark, sf_dir), "building")).select("userId", "action", "allowed", "why")


@_query("SELECT workspace, userId FROM latest l JOIN tiers t ON t.tier = l.role WHERE t.height >= 2", more=_MEMBERS + ", " + _TIERS)
def f15_approvers(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = project.members(spark, sf_dir).groupBy("userId", "workspace").agg(F.max_by("role", "seq").alias("role"))
    return lookup.allowed(latest, "approver").select("workspace", "userId")


@_query("SELECT workspace FROM latest WHERE role = 'admin' AND userId = 'u1' GROUP BY workspace HAVING count(*) <= 1", more=_MEMBERS)
def v9_last_admins(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = project.members(spark, sf_dir).groupBy("userId", "workspace").agg(F.max_by("role", "seq").alias("role"))
    return lookup.last_admin(latest.where("userId = 'u1'"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.members(spark, sf_dir).groupBy("workspace", "userId").agg(F.max_by("role", "seq").alias("role"))


@_query("SELECT userId, role FROM latest WHERE workspace = 'building'", more=_MEMBERS)
def s14_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.members_of(_members(spark, sf_dir), "Building").select("userId", "role")


@_query("SELECT workspace, role FROM latest WHERE userId = 'u7'", more=_MEMBERS)
def s14_memberships_of_a_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.of_user(_members(spark, sf_dir), "u7").select("workspace", "role")


@_query("SELECT workspace, userId, CASE WHEN userId = 'u7' AND workspace = 'building' THEN 'approver' ELSE role END AS role FROM latest UNION ALL SELECT 'building', 'new', 'curator' UNION ALL SELECT 'building', 'u7', 'approver' WHERE NOT EXISTS (SELECT 1 FROM latest WHERE userId = 'u7' AND workspace = 'building')", more=_MEMBERS)
def k16_granted(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    known = members.select(F.col("workspace").alias("id")).distinct()
    more = workspaces.granted(workspaces.granted(members, known, "building", "u7", "approver"), known, "building", "new", "curator")
    passing = workspaces.granted(more, known, "building", "brief", "curator")
    return workspaces.revoked(passing, "building", "brief").select("workspace", "userId", "role")


@_query("SELECT workspace, action, t.height >= least AS allowed FROM latest l JOIN tiers t ON t.tier = l.role CROSS JOIN needs WHERE userId = 'u7'", more=_MEMBERS + ", " + _TIERS)
def c23_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.capabilities(workspaces.of_user(_members(spark, sf_dir), "u7"))


@_query("SELECT lower(c_mktsegment) AS id, CASE lower(c_mktsegment) WHEN 'building' THEN 'Building' ELSE lower(c_mktsegment) END AS \"displayName\", max(role) AS role FROM customer LEFT JOIN latest ON userId = 'u7' AND workspace = lower(c_mktsegment) GROUP BY 1, 2 HAVING max(role) IS NOT NULL", more=_MEMBERS)
def l14_listed_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    contexts = members.select("workspace", F.lit("g1").alias("grade"), F.lit("maths").alias("subject")).distinct()
    registry = spark.createDataFrame([("building", "Building")], "id string, displayName string")
    return workspaces.listed(registry, contexts, workspaces.of_user(members, "u7")).select("id", "displayName", "role")


# --- terms and catalog ----------------------------------------------------------------------------
@_query("SELECT p_type AS section, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_type")
def a5_section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.section_counts(project.table(spark, sf_dir, "part").select(F.col("p_type").alias("section"), F.col("p_partkey").alias("place")))


@_query("SELECT id, en || '!' AS en, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 2 = 0 THEN NULL ELSE xx END AS xx FROM lexicon WHERE CAST(substr(id, 2) AS BIGINT) % 3 = 0 UNION ALL SELECT id, en, xx FROM lexicon WHERE CAST(substr(id, 2) AS BIGINT) % 3 <> 0", more=_LEXICON)
def j21_edited_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = project.lexicon(spark, sf_dir).select("id", "renderings")
    n = F.substring("id", 2, 9).cast("bigint")
    fresh = F.create_map(F.lit("EN"), F.concat(F.col("renderings")["en"], F.lit("! ")), F.lit("xx"), F.when(n % 2 == 0, " ").otherwise(F.col("renderings")["xx"]))
    after = lookup.edited_terms(lex, lex.where(n % 3 == 0).select("id", fresh.alias("renderings")))
    return after.select("id", F.try_element_at("renderings", F.lit("en")).alias("en"), F.try_element_at("renderings", F.lit("xx")).alias("xx"))


@_query("SELECT id, en FROM lexicon", more=_LEXICON)
def s15_glossary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = project.lexicon(spark, sf_dir)
    stored = lex.select("id", F.lit("Term").alias("type"), F.array(F.lit("LexiconEntry")).alias("labels"), F.to_json(F.struct("renderings", "tags")).alias("props"))
    n = graph(spark, sf_dir)[0].select("id", "type", "labels", "props")
    return lookup.glossary_entries(n.unionByName(stored)).select("id", F.col("renderings")["en"].alias("en"))


@_query("SELECT fr, wo FROM (SELECT DISTINCT p_type AS fr, p_name AS wo FROM part) WHERE fr || wo NOT IN (SELECT p_type || p_name FROM part WHERE p_partkey % 2 = 0)")
def j20_new_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = project.table(spark, sf_dir, "part").select(F.col("p_type").alias("fr"), F.col("p_name").alias("wo"), "p_partkey")
    return lookup.new_terms(terms, terms.where("p_partkey % 2 = 0")).select("fr", "wo")


@_query("SELECT \"nodeId\", \"relPath\" FROM (SELECT 'O' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS \"nodeId\", source || '/' || doc_id || '.docx' AS \"relPath\" FROM documents WHERE doc_id % 13 <> 0) WHERE \"nodeId\" <> 'O000000001' UNION ALL SELECT 'O000000001', 'moved.docx'")
def c9_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = spark.createDataFrame([("O000000001", "moved.docx", None)], "nodeId string, relPath string, md5 string")
    return lookup.recorded(project.history(spark, sf_dir), entry).select("nodeId", "relPath")


@_query("SELECT source || '/' || CASE doc_id % 4 WHEN 0 THEN doc_id || '.DOCX' WHEN 1 THEN '~$' || doc_id || '.docx' WHEN 2 THEN doc_id || '.docx' ELSE doc_id || '.pdf' END AS path FROM documents WHERE doc_id % 4 IN (0, 2)")
def s12_listed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = project.table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 4 == 0, F.concat(n, F.lit(".DOCX"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("~$"), n, F.lit(".docx"))).when(F.col("doc_id") % 4 == 2, F.concat(n, F.lit(".docx"))).otherwise(F.concat(n, F.lit(".pdf")))
    return lookup.documents_only(d.select(F.concat("source", F.lit("/"), name).alias("path")).unionByName(d.select(F.concat("source", F.lit("/")).alias("path")).distinct()))


@_query("SELECT id, 'routine' AS kind FROM routines", more=_EXT)
def c1_catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.entries(*project.extended(spark, sf_dir))


@_query("SELECT id, 'Routine ' || r_name AS name, 'Practise' AS steps, CAST(2 AS BIGINT) AS material_count FROM routines", more=_EXT)
def a11_catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.catalog_entries(*project.extended(spark, sf_dir)).select("id", "name", F.array_join("steps", ",").alias("steps"), F.col("material_count").cast("bigint").alias("material_count"))


@_query("SELECT 'catalog-root' AS id UNION ALL SELECT id FROM ext_nodes WHERE id LIKE 'I%'", more=_EXT)
def c5_assembled_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.assembled([project.extended(spark, sf_dir)], [])[0].select("id")


@_query("SELECT 1 AS line, '# Routine ' || r_name AS text FROM routines WHERE id = 'I01' UNION ALL SELECT 2, '*routine, shared catalog*' UNION ALL SELECT 3, '## Explain' UNION ALL SELECT 4, '## Practise'", more=_EXT)
def c2_rendered_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = catalog.rendered(*project.extended(spark, sf_dir), "I01")
    return spark.createDataFrame([(i, x) for i, x in enumerate((x for x in shown.split("\n") if x), 1)], "line int, text string")


@_query("SELECT type, count(*) AS n FROM ext_nodes WHERE id IN ('I01', 'I01-1', 'I01-2', 'I01-3') GROUP BY type", more=_EXT)
def c3_cloned_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = project.extended(spark, sf_dir)
    ids = traverse.closure(n.where("id = 'I01'").select("id"), traverse.steps(e, "out", ["hasPart"])).select("id")
    copies, _, renamed = lookup.cloned(n, e, ids, "stamp")
    return copies.join(renamed.select(F.col("new_id").alias("id")), "id", "left_semi").groupBy("type").agg(F.count("*").alias("n"))


@_query("SELECT type, count(*) + CASE type WHEN 'hasPart' THEN 3 WHEN 'usesRoutine' THEN 1 ELSE 0 END AS n FROM ext_edges GROUP BY type", more=_EXT)
def m14_used_routine(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = project.extended(spark, sf_dir)
    ids = traverse.closure(n.where("id = 'I01'").select("id"), traverse.steps(e, "out", ["hasPart"])).select("id")
    copies, links, renamed = lookup.cloned(n, e, ids, "stamp")
    root = renamed.where("old_id = 'I01'").first().new_id
    return mutate.use_routine(Graph(n, e), COURSE, Graph(copies, links), root).edges.groupBy("type").agg(F.count("*").alias("n"))


@_query("SELECT id, CASE id WHEN 'I02' THEN 'Formatter' WHEN 'I02-1' THEN 'FormatterSpec' WHEN 'I02-2' THEN 'FormatterSpec' ELSE type END AS label FROM ext_nodes WHERE id LIKE 'I%'", more=_EXT)
def c4_relabelled_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = project.extended(spark, sf_dir)
    return catalog.relabelled(n, e, "I02", ("Formatter", "FormatterSpec")).where("id LIKE 'I%'").select("id", F.col("type").alias("label"))


# --- files ----------------------------------------------------------------------------------------
def _file(spark: SparkSession, name: str, lines: list[str]) -> str:
    path = scratch.new_path(spark, name)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


@_query("SELECT id, props FROM nodes WHERE type IN ('StandardsFramework', 'StandardsFrameworkItem')")
def s7_envelope_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    few = n.where("type LIKE 'Standards%'")
    path = _file(spark, "envelope", [files.envelope_text(few, traverse.induced(e, few.select("id")))])
    return files.read_envelope(spark, path)[0].select("id", "props")


@_query("SELECT id, type, src, dst FROM edges WHERE type = 'hasChild'")
def k9_envelope_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    few = n.where("type LIKE 'Standards%'")
    path = _file(spark, "envelope", [files.envelope_text(few, traverse.induced(e, few.select("id")))])
    return files.read_envelope(spark, path)[1].select("id", "type", "src", "dst")


@_query("""SELECT 'C' || c_custkey AS id, 'Course' AS label, '{"marketSegment":"' || c_mktsegment || '","metadata":{"nationKey":' || c_nationkey || '},"sourceURI":"x"}' AS props FROM customer""")
def s8_line_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = project.table(spark, sf_dir, "customer")
    row = F.to_json(F.struct(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("identifier"), F.lit("Course").alias("entity_type"), F.col("c_mktsegment").alias("market_segment"), F.lit("x").alias("source_uri"), F.struct(F.col("c_nationkey").alias("nation_key")).alias("metadata")))
    nodes, edges = scratch.new_path(spark, "lines"), _file(spark, "lines", ["", " "])
    c.select(F.concat(row, F.when(F.col("c_custkey") % 5 == 0, "\n").otherwise("")).alias("value")).write.text(nodes)
    n, _ = files.read_lines(spark, nodes, edges)
    return n.select("id", F.col("labels")[0].alias("label"), "props")


@_query("SELECT r_name AS section, n_name AS francais, upper(n_name) AS wolof FROM nation JOIN region ON n_regionkey = r_regionkey")
def s9_terminology(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, nations = (project.table(spark, sf_dir, t).collect() for t in ("region", "nation"))  # two fixed small tables
    sections = [{"titre": r.r_name, "entrees": [{"francais": n.n_name, "wolof": n.n_name.upper()} for n in nations if n.n_regionkey == r.r_regionkey]} for r in regions]
    return files.read_terminology(spark, _file(spark, "terms", [json.dumps({"sections": sections})])).select("section", "francais", "wolof")


@_query("SELECT r_name AS domain, CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INTEGER) AS place FROM region")
def s10_domain_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r.r_name for r in project.table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    return files.read_domains(spark, _file(spark, "pool", [json.dumps({"domains": names})]))


@_query("SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS \"nodeId\", n_name || '.docx' AS \"relPath\" FROM nation")
def s11_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = [{"nodeId": f"N{r.n_nationkey:02}", "relPath": f"{r.n_name}.docx"} for r in project.table(spark, sf_dir, "nation").collect()]
    old = files.read_history(spark, _file(spark, "history", [json.dumps({"version": 2, "entries": entries})]))
    return files.read_history(spark, _file(spark, "history", [json.dumps({"version": 3, "entries": entries})])).unionByName(old).select("nodeId", "relPath")


@_query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def s13_docx_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    def packed(value: str) -> bytes:
        from xml.sax.saxutils import escape

        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in value.split("\n"))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
        return out.getvalue()

    @F.pandas_udf("string")
    def there_and_back(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: files.docx_text(packed(t)))

    return project.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", there_and_back("text").alias("text"))


@_query("SELECT type AS label, count(*) AS n FROM nodes WHERE type <> 'Material' GROUP BY type UNION ALL SELECT '(dangling)', count(*) FROM edges WHERE dst LIKE 'P%'")
def a16_import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return files.import_report(n.where("type <> 'Material'"), e)


# --- scalar functions -----------------------------------------------------------------------------
@_query("SELECT DISTINCT source, CAST(nullif(regexp_extract(source, '(\\d+)', 1), '') AS BIGINT) AS n FROM documents")
def fn_first_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.table(spark, sf_dir, "documents").select("source").distinct().select("source", text.first_int(F.col("source")).alias("n"))


@_query("SELECT doc_id, CASE WHEN length(text) > 140 THEN substr(text, 1, 139) || '…' ELSE text END AS short, CASE WHEN length(text) > 84 THEN substr(text, 1, 82) || '…' ELSE text END AS label FROM documents")
def fn_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.table(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text"), 140).alias("short"), text.node_label(F.col("text")).alias("label"))


@_query("SELECT c_custkey, greatest(5, least(c_custkey, 50)) AS kept FROM customer")
def fn_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.table(spark, sf_dir, "customer").select("c_custkey", text.clamped(F.col("c_custkey"), 5, 50).alias("kept"))


_SPACE = "lower(c_mktsegment) || '/g' || c_custkey % 4 || '/' || CASE WHEN c_custkey % 6 = 0 THEN 'reading' ELSE 'maths' END"


@_query(f"SELECT c_custkey, {_SPACE} AS ns, replace({_SPACE}, '/', '__') AS slug, {_SPACE} AS back, lower(c_mktsegment) AS workspace FROM customer")
def fn_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = project.table(spark, sf_dir, "customer")
    subject = F.when(F.col("c_custkey") % 6 == 0, "reading").otherwise("maths")
    ns = text.namespace(F.lower("c_mktsegment"), F.concat(F.lit("g"), (F.col("c_custkey") % 4).cast("string")), subject)
    rows = c.select("c_custkey", ns.alias("ns")).withColumn("slug", text.namespace_slug(F.col("ns")))
    return rows.withColumn("back", text.namespace_of_slug(F.col("slug"))).withColumn("workspace", text.namespace_parts(F.col("ns"))["workspace"])


@_query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN NULL ELSE 'PT' || c_custkey || 'M' END AS iso FROM customer")
def fn_iso_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = project.table(spark, sf_dir, "customer")
    said = F.when(F.col("c_custkey") % 3 == 0, "soon").otherwise(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" min")))
    return c.select("c_custkey", text.iso_minutes(said).alias("iso"))


@_query("SELECT name, row_number() OVER (ORDER BY head, n) AS place FROM (SELECT DISTINCT CASE p_partkey % 2 WHEN 0 THEN 'a' ELSE 'b' END AS head, p_partkey % 150 AS n, CASE p_partkey % 2 WHEN 0 THEN 'a' ELSE 'b' END || p_partkey % 150 AS name FROM part)")
def fn_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project.table(spark, sf_dir, "part")
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b"), (F.col("p_partkey") % 150).cast("string"))
    return p.select(name.alias("name")).distinct().withColumn("key", text.natural_key(F.col("name"))).transform(lambda df: ordering.in_order(df, "key", name="place")).select("name", "place")


@_query("SELECT id, en AS first, length(en) AS n FROM lexicon", more=_LEXICON)
def fn_renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = project.lexicon(spark, sf_dir)
    blank = F.map_concat(F.map_from_arrays(F.array(F.lit("EN"), F.lit("fr")), F.array(F.concat(F.lit("  "), F.col("renderings")["en"]), F.lit(" "))))
    normal = text.normal_renderings(blank)
    return lex.select("id", text.primary_rendering(normal).alias("first"), F.length(text.primary_rendering(normal)).cast("long").alias("n"))


@_query("SELECT id, props, sha256(props) AS digest FROM nodes")
def fn_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir)[0].select("id", jsontext.canonical_json(F.concat(F.lit(" "), "props")).alias("props"))
    return n.withColumn("digest", F.sha2("props", 256))


@_query("""SELECT c_custkey, '{"accountUUID":' || c_custkey || ',"inner":{"homeURI":"x"},"marketSegment":"' || c_mktsegment || '"}' AS props FROM customer""")
def fn_camel_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = project.table(spark, sf_dir, "customer")
    row = F.to_json(F.struct(F.col("c_mktsegment").alias("market_segment"), F.col("c_custkey").alias("account_uuid"), F.struct(F.lit("x").alias("home_uri")).alias("inner")))
    return c.select("c_custkey", jsontext.camel_json(row).alias("props"))


@_query("""SELECT id, '{"audience":{"level":"' || c_custkey || '"},"description":"' || c_name || '"}' AS props FROM nodes JOIN customer ON id = 'C' || lpad(CAST(c_custkey AS VARCHAR), 7, '0')""")
def fn_set_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir)[0].where("type = 'Course'")
    change = F.create_map(F.lit("audience.level"), F.substring("id", 2, 7).cast("bigint").cast("string"))
    return n.select("id", jsontext.set_paths(F.col("props"), change).alias("props"))


@_query("SELECT grade, subject, fr || ' — ' || upper(grade) AS fr, en || ' — ' || upper(grade) AS en FROM (SELECT DISTINCT 'g' || c_custkey % 4 AS grade, lower(c_mktsegment) AS subject, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS fr, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS en FROM customer)")
def fn_namespace_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = project.table(spark, sf_dir, "customer")
    rows = c.select(F.concat(F.lit("g"), (F.col("c_custkey") % 4).cast("string")).alias("grade"), F.lower("c_mktsegment").alias("subject")).distinct()
    label = text.namespace_label(F.col("grade"), F.col("subject"))
    return rows.select("grade", "subject", label["fr"].alias("fr"), label["en"].alias("en"))


@_query("SELECT doc_id, length(text) >= 4000 AS parked FROM documents WHERE text IS NOT NULL")
def fn_should_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.stored_apart(F.col("text"), 4000).alias("parked"))


@_query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'STORE_UNAVAILABLE' ELSE 'INTERNAL_ERROR' END AS code FROM events")
def fn_error_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = project.table(spark, sf_dir, "events")
    said = F.when(F.col("event_id") % 6 == 0, "connect ETIMEDOUT 1.2.3.4").when(F.col("event_id") % 3 == 0, "Rate Limit reached").otherwise(F.concat(F.lit("bad row "), F.col("event_id").cast("string")))
    return e.select("event_id", text.error_code(said).alias("code"))


@_query("SELECT id, CASE WHEN type = 'LessonGrouping' THEN CAST(CAST(json_extract_string(props, '$.position') AS BIGINT) AS VARCHAR) ELSE '' END AS shown FROM nodes WHERE type IN ('LessonGrouping', 'Course')")
def fn_number_or_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir)[0].where("type IN ('LessonGrouping', 'Course')")
    return n.select("id", text.text_of(parse.prop("position")).alias("shown"))


@_query("SELECT type AS label, min(length(props)) AS least, max(length(props)) AS most FROM nodes GROUP BY type")
def w9_props_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir)[0]
    return n.groupBy(stats.primary_label().alias("label")).agg(F.min(F.length("props")).cast("long").alias("least"), F.max(F.length("props")).cast("long").alias("most"))
