"""The queries of the graph engine and the SQL that each is held against.

Every query runs over whole tables. A start node, a page, a cap or a search text is part of the
operator that it shows. Names begin with the operator's number in the inventory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text
from weftgraph.operators import audit, display, export, lookup, mutate, overlay, parse, rewrite, scope, stats, traverse
from weftgraph.sources import project

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

COURSE, GROUPING, WORD, TERM = "C0000001", "O000000001", "order 7", "an"


def _query(sql: str | None = None, overlay_too: bool = False, more: str = ""):
    """Registers a query under its function's name; ``more``: further common table expressions."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            parts = [project.SQL, *([project.OVERLAY_SQL] if overlay_too else []), *([more] if more else [])]
            _SQL[f.__name__] = "WITH RECURSIVE " + ", ".join(parts) + sql
        return f

    return add


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return project.graph(spark, sf_dir)


def draft(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    (n, e), (on, oe) = graph(spark, sf_dir), project.overlay(spark, sf_dir)
    return overlay.merged(n, on), overlay.merged(e, oe)


_WALK = f"""walk AS (
  SELECT '{COURSE}' AS id, 0 AS depth
  UNION ALL SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.id AND e.type = 'hasPart' WHERE w.depth < 3),
depths AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""
_MEMBERS = """members AS (
  SELECT id AS root, id, 0 AS depth FROM nodes WHERE type = 'Course'
  UNION ALL SELECT m.root, e.dst, m.depth + 1 FROM members m JOIN edges e ON e.src = m.id AND e.type IN ('hasPart', 'hasChild')),
course_members AS (SELECT root, id, min(depth) AS depth FROM members GROUP BY root, id)"""


# --- traversal ------------------------------------------------------------------------------------
@_query("SELECT id, depth FROM depths JOIN nodes USING (id)", more=_WALK)
def t1_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return traverse.reached(e, COURSE, "out", ["hasPart"]).join(n.select("id"), "id", "left_semi")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t1_walk(spark, sf_dir)


@_query("SELECT id, type, depth FROM depths JOIN nodes USING (id) WHERE type = 'Lesson' AND (depth > 1 OR depth = 1 AND id > 'O') ORDER BY depth, id LIMIT 10", more=_WALK)
def t5_walk_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    rows = traverse.with_label(n, ["Lesson"]).join(traverse.reached(e, COURSE, "out", ["hasPart"]), "id")
    return rows.where(traverse.after((1, "O"))).orderBy("depth", "id").limit(10).select("id", "type", "depth")


@_query("SELECT e.id FROM edges e JOIN depths d ON e.src = d.id WHERE e.type = 'hasPart' AND d.depth < 3", more=_WALK)
def t3_traversed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e = graph(spark, sf_dir)
    return traverse.traversed(e, traverse.reached(e, COURSE, "out", ["hasPart"]), "out", ["hasPart"]).select("id")


@_query("SELECT count(*) > 0 AS truncated FROM edges e JOIN depths d ON e.src = d.id WHERE e.type = 'hasPart' AND d.depth = 2 AND e.dst NOT IN (SELECT id FROM depths WHERE depth <= 2)", more=_WALK)
def t4_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e = graph(spark, sf_dir)
    return traverse.cut_short(e, traverse.reached(e, COURSE, "out", ["hasPart"], 2), "out", ["hasPart"], 2)


@_query("SELECT id FROM nodes WHERE type = 'Course'")
def t8_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.courses(graph(spark, sf_dir)[0]).select("id")


@_query("SELECT root, id, depth FROM course_members", more=_MEMBERS)
def t9_course_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.course_nodes(*graph(spark, sf_dir))


@_query(f"SELECT e.id, e.type FROM edges e WHERE src IN (SELECT id FROM course_members WHERE root = '{COURSE}') AND dst IN (SELECT id FROM course_members WHERE root = '{COURSE}')", more=_MEMBERS)
def t9_course_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.course_subgraph(*graph(spark, sf_dir), COURSE)[1].select("id", "type")


@_query(
    f"""SELECT DISTINCT root, id FROM (
  SELECT '{COURSE}' AS root, a.id FROM aligned a UNION ALL
  SELECT '{COURSE}', e.dst FROM edges e JOIN aligned a ON e.src = a.id WHERE e.type IN ('hasChild', 'supports', 'buildsTowards') UNION ALL
  SELECT '{COURSE}', e.src FROM edges e JOIN aligned a ON e.dst = a.id WHERE e.type IN ('hasChild', 'supports', 'buildsTowards'))""",
    more=f"aligned AS (SELECT dst AS id FROM edges WHERE type = 'hasEducationalAlignment' AND src = '{COURSE}')",
)
def t10_standards_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return scope.standards_for(n, e, n.where(F.col("id") == COURSE).select("id"))


@_query(
    "SELECT root, id, min(depth) AS depth FROM below GROUP BY root, id",
    more="below AS (SELECT id AS root, id, 0 AS depth FROM nodes WHERE type IN ('StandardsFramework', 'TeachingLearningMaterial') UNION ALL SELECT b.root, e.dst, b.depth + 1 FROM below b JOIN edges e ON e.src = b.id AND e.type IN ('hasPart', 'hasChild'))",
)
def t11_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    starts = n.where(F.col("type").isin("StandardsFramework", "TeachingLearningMaterial"))
    return traverse.closure(starts.select("id"), traverse.steps(e, "out", ["hasPart", "hasChild"]))


@_query("""SELECT src AS document, dst AS section, CAST(json_extract_string(n.props, '$.position') AS DOUBLE) AS position,
  (SELECT string_agg(c.dst, ',' ORDER BY c.dst) FROM edges c WHERE c.type = 'covers' AND c.src = e.dst) AS covers
  FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.type = 'hasPart' AND n.type = 'DocumentSection'""")
def t12_document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.document_sections(*graph(spark, sf_dir)).withColumn("covers", F.array_join("covers", ","))


@_query(
    "SELECT DISTINCT id FROM (SELECT o.id FROM about o UNION ALL SELECT e.dst FROM about o JOIN edges e ON e.src = o.id AND e.type = 'hasPart' UNION ALL SELECT f.dst FROM about o JOIN edges e ON e.src = o.id AND e.type = 'hasPart' JOIN edges f ON f.src = e.dst AND f.type = 'hasPart')",
    more="about AS (SELECT c.dst AS id FROM edges h JOIN edges c ON c.src = h.dst AND c.type = 'covers' WHERE h.src = 'T003' AND h.type = 'hasPart')",
)
def t12_document_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.document_curriculum(*graph(spark, sf_dir), "T003")[1]


@_query("SELECT l.id AS root, e.src AS id, 1 AS depth FROM nodes l JOIN edges e ON e.dst = l.id AND e.type = 'hasPart' WHERE l.type = 'Lesson' UNION ALL SELECT l.id, f.src, 2 FROM nodes l JOIN edges e ON e.dst = l.id AND e.type = 'hasPart' JOIN edges f ON f.dst = e.src AND f.type = 'hasPart' WHERE l.type = 'Lesson'")
def t14_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return traverse.ancestors(n.where("type = 'Lesson'").select("id"), e)


@_query("SELECT dst AS root, src AS id, 1 AS depth FROM edges WHERE type = 'hasPart' AND src LIKE 'T%'")
def t15_owning_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return scope.owning_document(n, e, n.where("type = 'DocumentSection'").select("id"))


@_query("SELECT id, CAST(depth AS INTEGER) AS depth FROM depths UNION ALL SELECT id, CAST(NULL AS INTEGER) FROM aligned UNION ALL SELECT DISTINCT e.src, CAST(NULL AS INTEGER) FROM edges e JOIN aligned a ON e.dst = a.id WHERE e.type = 'supports'",
    more=_WALK + ", aligned AS (SELECT DISTINCT e.dst AS id FROM edges e JOIN depths d ON e.src = d.id WHERE e.type = 'hasEducationalAlignment')")
def t20_scoped_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return display.scoped_subtree(display.display_edges(n, e), n.where(F.col("id") == COURSE).select("id"), 3)


@_query(
    """SELECT id FROM seeds UNION ALL SELECT id FROM gone_orders UNION ALL SELECT id FROM gone_lessons UNION ALL
  SELECT e.dst FROM edges e WHERE e.type = 'hasPart' AND e.dst LIKE 'P%' GROUP BY e.dst HAVING count(*) FILTER (e.src NOT IN (SELECT id FROM gone_lessons)) = 0""",
    more="""seeds AS (SELECT id FROM nodes WHERE type = 'Course' AND json_extract_string(props, '$.audience') = 'BUILDING'),
gone_orders AS (SELECT dst AS id FROM edges WHERE type = 'hasPart' AND src IN (SELECT id FROM seeds)),
gone_lessons AS (SELECT dst AS id FROM edges WHERE type = 'hasPart' AND src IN (SELECT id FROM gone_orders))""",
)
def t22_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return traverse.cascade(n.where("type = 'Course' AND get_json_object(props, '$.audience') = 'BUILDING'"), e)


@_query("SELECT h.dst AS root, min(o.src) AS id, 2 AS depth FROM edges h JOIN edges o ON o.dst = h.src AND o.type = 'hasPart' WHERE h.type = 'hasPart' AND h.dst LIKE 'L%' GROUP BY h.dst")
def w10_nearest_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return rewrite.nearest_course(n, e, n.where("type = 'Lesson'").select("id"))


# --- counts ---------------------------------------------------------------------------------------
@_query("SELECT type AS label, count(*) AS n FROM nodes GROUP BY type")
def a1_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.node_counts(graph(spark, sf_dir)[0])


@_query("SELECT type, count(*) AS n FROM edges GROUP BY type")
def a1_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.edge_counts(graph(spark, sf_dir)[1])


_ROOTS = "top AS (SELECT id, type AS label FROM nodes WHERE id NOT IN (SELECT dst FROM edges WHERE type IN ('hasPart', 'hasChild')))"


@_query("SELECT id, label FROM top", more=_ROOTS)
def j6_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.roots(*graph(spark, sf_dir)).select("id", "label")


@_query("SELECT id, label, CASE label WHEN 'Course' THEN 0 WHEN 'TeachingLearningMaterial' THEN 1 WHEN 'StandardsFramework' THEN 2 WHEN 'LessonGrouping' THEN 3 ELSE 99 END AS rank, (SELECT count(*) FROM top) AS roots_total FROM top ORDER BY rank, id LIMIT 50", more=_ROOTS)
def a2_shown_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.shown_roots(*graph(spark, sf_dir)).select("id", "label", "rank", "roots_total")


@_query("SELECT 'empty framework' AS flag, id FROM nodes WHERE type = 'StandardsFramework' AND id NOT IN (SELECT src FROM edges WHERE type IN ('hasPart', 'hasChild')) UNION ALL SELECT 'no course', NULL WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE type = 'Course')")
def a3_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.flags(*graph(spark, sf_dir))


@_query("SELECT e.src AS id, p.type, e.type AS edge_type, c.type AS child_type, count(*) AS n, count(*) FILTER (json_extract_string(c.props, '$.educationalUse') = 'Assessment') AS assessments FROM edges e JOIN nodes c ON c.id = e.dst JOIN nodes p ON p.id = e.src WHERE e.type IN ('hasPart', 'hasChild') GROUP BY ALL")
def a4_child_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.child_histogram(*graph(spark, sf_dir))


@_query("SELECT dst AS id, count(DISTINCT src) AS parents FROM edges WHERE type IN ('hasPart', 'hasChild') GROUP BY dst HAVING count(DISTINCT src) > 1")
def a4_many_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.many_parents(graph(spark, sf_dir)[1])


# --- drafts ---------------------------------------------------------------------------------------
@_query("SELECT id, type, props FROM draft_nodes", True)
def o1_draft_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draft(spark, sf_dir)[0].select("id", "type", "props")


@_query("SELECT id, type, src, dst FROM draft_edges", True)
def o1_draft_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draft(spark, sf_dir)[1].select("id", "type", "src", "dst")


_DIFF = """diff AS (
  SELECT 'node' AS side, id, CASE WHEN a.props IS NULL THEN 'added' WHEN b.props IS NULL THEN 'removed' ELSE 'changed' END AS op
    FROM nodes a FULL JOIN draft_nodes b USING (id) WHERE a.props IS DISTINCT FROM b.props
  UNION ALL SELECT 'edge', id, CASE WHEN a.src IS NULL THEN 'added' ELSE 'removed' END FROM edges a FULL JOIN draft_edges b USING (id) WHERE a.src IS NULL OR b.src IS NULL)"""


@_query("SELECT side, id, op FROM diff", True, _DIFF)
def o7_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.whole_difference(graph(spark, sf_dir), draft(spark, sf_dir))


# The digests of a node's and of an edge's content: one label each, edges without properties.
_NODE_DIGEST = """sha256('v' || type || chr(31) || 'v["' || type || '"]' || chr(31) || 'v' || props)"""
_EDGE_DIGEST = "sha256('v' || type || chr(31) || 'v' || src || chr(31) || 'v' || dst || chr(31) || 'n')"


_LANES = ", ".join(f"CAST(sum(CAST(('0x' || substr(d, {16 * i + 1}, 16)) AS UBIGINT)::HUGEINT) % 18446744073709551616 AS VARCHAR) AS s{i}" for i in range(4))


@_query(
    f"SELECT sha256(concat_ws('/', n, s0, s1, s2, s3)) AS hash FROM (SELECT CAST(count(*) AS VARCHAR) AS n, {_LANES} FROM row_digests)",
    more=f"row_digests AS (SELECT sha256('node' || chr(30) || id || chr(30) || {_NODE_DIGEST}) AS d FROM nodes UNION ALL SELECT sha256('edge' || chr(30) || id || chr(30) || {_EDGE_DIGEST}) FROM edges)",
)
def o8_graph_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.graph_hash(*graph(spark, sf_dir))


_RANGES = 64


def _range_sql(table: str, side: str) -> str:
    """Leaves of the tree over a table, in SQL."""
    of = _NODE_DIGEST if side == "node" else _EDGE_DIGEST
    rows = f"SELECT CAST(('0x' || substr(md5(id), 1, 4)) AS INTEGER) % {_RANGES} AS range, sha256('{side}' || chr(30) || id || chr(30) || {of}) AS d FROM {table}"
    return f"SELECT range, n, sha256(concat_ws('/', n, s0, s1, s2, s3)) AS digest FROM (SELECT range, CAST(count(*) AS VARCHAR) AS n, {_LANES} FROM ({rows}) GROUP BY range)"


@_query("SELECT range, CAST(n AS BIGINT) AS n, digest FROM leaves", more=f"leaves AS ({_range_sql('nodes', 'node')})")
def a18_range_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.range_digests(graph(spark, sf_dir)[0], _RANGES)


@_query("SELECT sha256('0:' || sha256(string_agg(range || ':' || digest, '/' ORDER BY range))) AS hash FROM leaves", True, more=f"leaves AS ({_range_sql('draft_edges', 'edge')})")
def a18_merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.merkle_root(overlay.range_digests(draft(spark, sf_dir)[1], _RANGES, "edge"))


@_query("SELECT id, op FROM diff WHERE side = 'node'", True, _DIFF)
def o7_difference_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.difference_by_ranges(graph(spark, sf_dir)[0], draft(spark, sf_dir)[0], 4096)


@_query("SELECT id, 'changed' AS op FROM nodes WHERE type = 'Lesson' AND json_extract_string(props, '$.educationalUse') = 'Assessment'")
def o7_relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft that changes nothing but labels."""
    n = graph(spark, sf_dir)[0]
    more = F.when((F.col("type") == "Lesson") & (parse.prop("educationalUse") == "Assessment"), F.array_append("labels", F.lit("Assessment"))).otherwise(F.col("labels"))
    return overlay.difference(n, n.withColumn("labels", more))


@_query("SELECT id, true AS write FROM diff WHERE side = 'node' AND op <> 'removed' UNION ALL SELECT id, false FROM diff WHERE side = 'node' AND op = 'removed'", True, _DIFF)
def o9_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes, removals = overlay.delta(graph(spark, sf_dir)[0], draft(spark, sf_dir)[0])
    return writes.select("id", F.lit(True).alias("write")).unionByName(removals.select("id", F.lit(False).alias("write")))


@_query("SELECT side, op, id, total, total > 200 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY side, op ORDER BY id) AS k, count(*) OVER (PARTITION BY side, op) AS total FROM diff) WHERE k <= 200", True, _DIFF)
def o13_capped_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.capped(overlay.whole_difference(graph(spark, sf_dir), draft(spark, sf_dir))).select("side", "op", "id", "total", "truncated")


@_query("SELECT " + ", ".join(f"count(*) FILTER (side = '{s}' AND op = '{o}') AS {s}s_{o}" for s, o in (("node", "added"), ("node", "removed"), ("node", "changed"), ("edge", "added"), ("edge", "removed"))) + " FROM diff", True, _DIFF)
def o14_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.counts_of(overlay.whole_difference(graph(spark, sf_dir), draft(spark, sf_dir)))


@_query("SELECT a.id AS removed_id, 'Q' || substr(min(b.id), 2) AS added_id FROM nodes a JOIN nodes b ON a.type = b.type AND a.props = b.props WHERE a.type = 'Material' GROUP BY a.id")
def v1_disguised_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir)[0]
    after = n.withColumn("id", F.when(F.col("type") == "Material", F.concat(F.lit("Q"), F.substring("id", 2, 20))).otherwise(F.col("id")))
    return overlay.renamed(n, after)


@_query("SELECT id, dst AS missing FROM edges WHERE dst NOT IN (SELECT id FROM draft_nodes) UNION SELECT id, src FROM edges WHERE src NOT IN (SELECT id FROM draft_nodes)", True)
def v2_dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.dangling(graph(spark, sf_dir)[1], draft(spark, sf_dir)[0])


# --- parsing --------------------------------------------------------------------------------------
_UNITS = r"""units AS (
  SELECT id, CASE type WHEN 'LessonGrouping' THEN json_extract_string(props, '$.groupName') WHEN 'StandardsFrameworkItem' THEN 'Standard' ELSE type END AS kind,
    CASE WHEN type IN ('Course', 'LessonGrouping', 'StandardsFramework') THEN coalesce(json_extract_string(props, '$.description'), '') ELSE '' END AS title,
    CASE WHEN type IN ('Course', 'LessonGrouping', 'StandardsFramework') THEN '' ELSE coalesce(json_extract_string(props, '$.description'), '') END AS text,
    CAST(json_extract_string(props, '$.position') AS DOUBLE) AS ord, coalesce(json_extract_string(props, '$.educationalUse') = 'Assessment', false) AS is_assessment
  FROM nodes WHERE type NOT IN ('TeachingLearningMaterial', 'DocumentSection')),
held AS (
  SELECT src AS parent, dst AS child, 1 AS phase FROM edges WHERE type IN ('hasPart', 'hasChild') AND src NOT LIKE 'T%'
  UNION ALL SELECT dst, src, 2 FROM edges WHERE type IN ('supports', 'hasEducationalAlignment'))"""


@_query("SELECT id, kind, title, text, ord, is_assessment FROM units", more=_UNITS)
def p1_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.units(graph(spark, sf_dir)[0])


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n, e = graph(spark, sf_dir)
    e, units = project.numbered_edges(spark, sf_dir), parse.units(n)
    return e, units, parse.containment(e, units)


@_query("SELECT child AS id, arg_max(parent, phase || parent) AS parent_id FROM held GROUP BY child", more=_UNITS)
def p1f_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parents(_links(spark, sf_dir)[2])


@_query("SELECT parent AS id, CAST(row_number() OVER (PARTITION BY parent ORDER BY phase, child) - 1 AS INTEGER) AS place, child FROM held", more=_UNITS.replace("1 AS phase", "CASE type WHEN 'hasChild' THEN 10 ELSE 11 END AS phase").replace("dst, src, 2", "dst, src, CASE type WHEN 'hasEducationalAlignment' THEN 20 ELSE 21 END"))
def p1g_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.placed_children(_links(spark, sf_dir)[2])


@_query("SELECT dst AS src, src AS dst FROM edges WHERE type = 'hasDependency'")
def p1h_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, units, _ = _links(spark, sf_dir)
    return parse.progression(e, units).select("src", "dst")


@_query("SELECT id FROM nodes WHERE type IN ('Course', 'LessonGrouping', 'Lesson', 'Material') AND (type <> 'Material' OR id IN (SELECT dst FROM edges WHERE type = 'hasPart' AND src LIKE 'L%')) UNION ALL SELECT DISTINCT dst FROM edges WHERE type = 'hasEducationalAlignment' UNION ALL SELECT DISTINCT s.src FROM edges s JOIN edges a ON a.dst = s.dst AND a.type = 'hasEducationalAlignment' WHERE s.type = 'supports'")
def p2_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, units, links = _links(spark, sf_dir)
    units = units.join(parse.parents(links), "id", "left")
    return parse.pruned(units, ["Course"], ["Standard"], ["Course", "Lesson"], "LearningComponent", links).select("id")


@_query("SELECT id FROM units WHERE id NOT IN (SELECT child FROM held)", more=_UNITS)
def p3_model_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, units, links = _links(spark, sf_dir)
    return parse.model_roots(units.join(parse.parents(links), "id", "left")).select("id")


@_query("SELECT id, seq FROM (SELECT id, row_number() OVER (ORDER BY type, src, dst) AS seq FROM edges)")
def p4_stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return parse.serialised(n, project.numbered_edges(spark, sf_dir), parse.units(n))[1].select("id", "seq")


@_query("SELECT id, type NOT IN ('TeachingLearningMaterial', 'DocumentSection') AS spine FROM nodes")
def p4_stored_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return parse.serialised(n, project.numbered_edges(spark, sf_dir), parse.units(n))[0].select("id", "spine")


@_query("SELECT 'hasChild:' || parent || '->' || child AS id, CAST(row_number() OVER (PARTITION BY parent ORDER BY phase, child) - 1 AS INTEGER) AS place FROM held", more=_UNITS.replace("1 AS phase", "CASE type WHEN 'hasChild' THEN 10 ELSE 11 END AS phase").replace("dst, src, 2", "dst, src, CASE type WHEN 'hasEducationalAlignment' THEN 20 ELSE 21 END"))
def p5_spine_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, units, links = _links(spark, sf_dir)
    return parse.spine_rows(links, parse.progression(e, units)).where("type = 'hasChild'").select("id", "place")


# --- rewriting ------------------------------------------------------------------------------------
@_query("SELECT DISTINCT 'covers:' || f.src || '->' || c.src AS id FROM (SELECT src AS lesson, dst FROM edges WHERE type = 'hasPart' AND src LIKE 'L%') m JOIN edges o ON o.dst = m.lesson AND o.type = 'hasPart' JOIN edges f ON f.dst = o.src AND f.type = 'hasPart' JOIN edges c ON c.dst = o.src AND c.type = 'covers' WHERE false UNION ALL SELECT DISTINCT 'hasDependency:' || a.src || '->' || d.dst FROM edges d JOIN edges a ON a.dst = d.src AND a.type = 'hasPart' WHERE d.type = 'hasDependency'")
def p18_collapsed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    up = rewrite.nearest_course(n, e, n.where("type = 'LessonGrouping'").select("id"))
    return rewrite.collapsed(e, up, "hasDependency").select("id")


@_query("SELECT CASE WHEN type = 'supports' THEN 'hasEducationalAlignment' ELSE type END || ':' || src || '->' || dst AS id FROM edges")
def p9_canonical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return rewrite.canonical_edges(e, n.where("type IN ('Course', 'LessonGrouping', 'Lesson', 'LearningComponent')").select("id")).select("id")


@_query("SELECT src AS parent, arg_max(dst, CAST(json_extract_string(n.props, '$.position') AS DOUBLE)) AS id FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.type = 'hasPart' AND n.type = 'LessonGrouping' GROUP BY src")
def w6_flagged_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    kids = e.where("type = 'hasPart'").select(F.col("src").alias("parent"), F.col("dst").alias("id")).join(parse.units(n.where("type = 'LessonGrouping'")).select("id", "ord", F.col("title").alias("text")), "id")
    return rewrite.flagged_last(kids)


@_query("SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', CAST(strpos('0123456789abcdef', substr(h, 17, 1)) AS INTEGER), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id, id AS seed FROM (SELECT id, sha1(id) AS h FROM nodes WHERE type = 'Course')")
def p10_derived_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)[0].where("type = 'Course'").select(rewrite.derived_id(F.col("id")).alias("id"), F.col("id").alias("seed"))


@_query("SELECT id FROM (SELECT DISTINCT type || ':' || CASE WHEN type = 'covers' THEN 'T' || lpad(regexp_extract(source, '(\\d+)', 1), 3, '0') ELSE src END || '->' || dst AS id FROM edges LEFT JOIN documents ON type = 'covers' AND src = 'D' || lpad(CAST(doc_id AS VARCHAR), 7, '0'))".replace("\\\\", "\\"))
def p16_repointed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    moves = scope.owning_document(n, e, n.where("type = 'DocumentSection'").select("id")).select(F.col("root").alias("old_id"), F.col("id").alias("new_id"))
    moved = rewrite.repoint(e.where("type = 'covers'"), moves, "src")
    return e.where("type <> 'covers'").select("id").unionByName(moved.select("id"))


# --- side tables ----------------------------------------------------------------------------------
_USED = "used AS (SELECT t.position AS ordinal, p_type AS domain FROM lines JOIN part ON p_partkey = l_partkey JOIN turns t ON t.o_orderkey = l_orderkey)"


@_query("SELECT lower(domain) AS domain, string_agg(DISTINCT CAST(ordinal AS VARCHAR), ',' ORDER BY CAST(ordinal AS VARCHAR)) AS ordinals FROM used GROUP BY 1", more=_USED)
def a6_domain_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.domain_usage(project.domains(spark, sf_dir))
    return found.withColumn("ordinals", F.array_join(F.sort_array(F.transform("ordinals", lambda x: x.cast("string"))), ","))


@_query("SELECT DISTINCT CAST(o.ordinal AS INTEGER) AS ordinal, lower(u.domain) AS domain FROM (SELECT DISTINCT ordinal FROM used) o JOIN used u ON abs(u.ordinal - o.ordinal) <= 2 AND u.ordinal <> o.ordinal", more=_USED)
def j12_nearby_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.nearby_domains(project.domains(spark, sf_dir), 2)


@_query(
    """SELECT domain FROM (SELECT p.domain, u.last, p.place FROM pool p LEFT JOIN (SELECT lower(domain) AS key, max(ordinal) AS last, bool_or(abs(ordinal - 3) <= 2 AND ordinal <> 3) AS near FROM used GROUP BY 1) u ON u.key = lower(p.domain)
  WHERE NOT coalesce(u.near, false)) ORDER BY last IS NOT NULL, last NULLS FIRST, place LIMIT 1""",
    more=_USED + ", pool AS (SELECT p_type AS domain, row_number() OVER (ORDER BY p_type DESC) AS place FROM (SELECT DISTINCT p_type FROM part) UNION ALL SELECT 'kitchen', 1000 UNION ALL SELECT 'harbour', 1001)",
)
def a8_fresh_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    kinds = project.table(spark, sf_dir, "part").select(F.col("p_type").alias("domain")).distinct()
    pool = kinds.withColumn("place", F.row_number().over(Window.orderBy(F.col("domain").desc())))
    pool = pool.unionByName(spark.createDataFrame([("kitchen", 1000), ("harbour", 1001)], "domain string, place int"))
    return lookup.fresh_domain(pool, project.domains(spark, sf_dir), 3, 2)


_LEXICON = "lexicon AS (SELECT 'G' || lpad(CAST(min(p_partkey) AS VARCHAR), 7, '0') AS id, p_name AS en, reverse(p_name) AS xx FROM part GROUP BY p_name)"


@_query(f"SELECT id, en FROM lexicon WHERE contains(lower(strip_accents(en)), '{TERM}') OR contains(lower(strip_accents(xx)), '{TERM}') ORDER BY id LIMIT 20", more=_LEXICON)
def f8_matching_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.matching_terms(project.lexicon(spark, sf_dir), TERM).select("id", F.col("renderings")["en"].alias("en"))


@_query("SELECT DISTINCT doc_id AS passage_id, id FROM (SELECT doc_id, lower(strip_accents(text || ' ' || upper(p_name))) AS t FROM documents JOIN part ON p_partkey = doc_id % 40 + 1) JOIN lexicon l ON contains(t, lower(en)) OR contains(t, lower(xx))", more=_LEXICON)
def f8_terms_in_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = project.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_part"), F.upper("p_name").alias("_name"))
    docs = project.table(spark, sf_dir, "documents").join(named, F.col("doc_id") % 40 + 1 == F.col("_part")).select(F.col("doc_id").alias("passage_id"), F.concat("text", F.lit(" "), "_name").alias("text"))
    return lookup.terms_in(docs, project.lexicon(spark, sf_dir))


_FILES = """history AS (SELECT 'O' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS nodeId, source || '/' || doc_id || '.docx' AS relPath, md5(text) AS md5 FROM documents WHERE doc_id % 13 <> 0),
bucket AS (SELECT source || '/' || doc_id || '.docx' AS relPath, CASE WHEN doc_id % 7 = 0 THEN md5(text || '!') ELSE md5(text) END AS md5 FROM documents WHERE doc_id % 11 <> 0)"""


@_query("SELECT relPath, CASE WHEN b.md5 IS NULL THEN 'missing' WHEN h.md5 IS NULL THEN 'new' WHEN h.md5 = b.md5 THEN 'unchanged' ELSE 'modified' END AS state FROM history h FULL JOIN bucket b USING (relPath)", more=_FILES)
def j9_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.reconciled(project.history(spark, sf_dir), project.bucket(spark, sf_dir))


@_query("SELECT h.nodeId, h.relPath, b.md5 FROM history h JOIN bucket b USING (relPath)", more=_FILES)
def c8_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.survivors(project.history(spark, sf_dir), project.bucket(spark, sf_dir)).select("nodeId", "relPath", "md5")


@_query("SELECT nodeId, CAST(position AS DOUBLE) AS ordinal FROM history h LEFT JOIN turns t ON h.nodeId = 'O' || lpad(CAST(t.o_orderkey AS VARCHAR), 9, '0') WHERE position IS NULL OR position > 1 OR (position = 1 AND nodeId > 'O000000020') ORDER BY position NULLS LAST, nodeId LIMIT 25", more=_FILES)
def l4_documents_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = project.orders_in_turn(spark, sf_dir).select(project.key("O", "o_orderkey", 9).alias("nodeId"), F.col("position").cast("double").alias("ordinal"))
    return lookup.documents_page(project.history(spark, sf_dir), at, after=(1.0, "O000000020")).select("nodeId", "ordinal")


_AUDIT = """log AS (SELECT lpad(CAST(event_id AS VARCHAR), 9, '0') AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts, CAST(user_id AS VARCHAR) AS actor,
  CASE event_type WHEN 'click' THEN 'apply' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'publish' WHEN 'signup' THEN 'createDraft' WHEN 'error' THEN 'blocked' END AS eventType,
  'N' || lpad(CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 25 AS VARCHAR), 2, '0') AS node FROM events)"""


@_query("SELECT id, ts, actor, eventType FROM log WHERE eventType = 'apply' AND ts <= '2024-01-20T00:00:00.000Z' ORDER BY ts DESC, id DESC LIMIT 25", more=_AUDIT)
def c10_audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = audit.matching(project.audit(spark, sf_dir), event_type="apply", until="2024-01-20T00:00:00.000Z")
    return audit.page(log).select("id", "ts", "actor", "eventType")


@_query("SELECT id, CASE WHEN eventType = 'blocked' THEN 'blocked' ELSE 'applied' END AS outcome FROM log", more=_AUDIT)
def f6_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.outcome(project.audit(spark, sf_dir)).select("id", "outcome")


@_query("SELECT id, ts, actor FROM log WHERE eventType = 'apply' AND ts >= (SELECT max(ts) FROM log WHERE eventType = 'createDraft')", more=_AUDIT)
def o16_draft_applies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.draft_applies(project.audit(spark, sf_dir)).select("id", "ts", "actor")


@_query("SELECT actor AS owner FROM log WHERE eventType = 'createDraft' ORDER BY ts DESC, id DESC LIMIT 1", more=_AUDIT)
def c22_draft_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.draft_owner(project.audit(spark, sf_dir))


@_query("SELECT node, eventType, count(*) AS n FROM log GROUP BY ALL", more=_AUDIT)
def a14_events_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.audit(spark, sf_dir).groupBy("node", "eventType").agg(F.count("*").alias("n"))


# --- display --------------------------------------------------------------------------------------
_DRAWN = """drawn AS (
  SELECT src, dst, CASE type WHEN 'hasPart' THEN 'hasChild' ELSE type END AS rel, type FROM edges WHERE type IN ('hasPart', 'hasChild', 'covers')
  UNION ALL SELECT dst, src, CASE type WHEN 'hasDependency' THEN 'buildsTowards' ELSE 'hasChild' END, CASE type WHEN 'hasDependency' THEN 'buildsTowards' ELSE type END FROM edges WHERE type IN ('supports', 'hasEducationalAlignment', 'hasDependency')),
shown AS (SELECT id, type AS label, coalesce(json_extract_string(props, '$.description'), '') AS text, CASE WHEN json_type(props, '$.order') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract(props, '$.order') AS DOUBLE) END AS ord,
  coalesce(json_extract_string(props, '$.normalizedStatementType'), '') AS nt FROM nodes)"""


@_query("SELECT id, label, text, ord, nt FROM shown", more=_DRAWN)
def f10_display_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.display_nodes(graph(spark, sf_dir)[0]).select("id", "label", "text", "ord", "nt")


@_query("SELECT src, dst, rel, type, CAST(0 AS DOUBLE) AS ord FROM drawn", more=_DRAWN)
def f13_display_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.display_edges(*graph(spark, sf_dir))


@_query("SELECT label, count(*) AS n, CASE label WHEN 'Course' THEN 0 WHEN 'Lesson' THEN 1 ELSE 2 END AS place FROM shown GROUP BY label", more=_DRAWN)
def a9_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.taxonomy(display.display_nodes(graph(spark, sf_dir)[0]), ("Course", "Lesson"))


@_query("SELECT json_extract_string(c.props, '$.audience') AS audience, json_extract_string(o.props, '$.groupName') AS groupName, count(*) AS n, min(o.id) AS first FROM edges e JOIN nodes c ON c.id = e.src JOIN nodes o ON o.id = e.dst WHERE e.type = 'hasPart' AND c.type = 'Course' GROUP BY 1, 2")
def c13_grouped_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    of = n.where("type = 'Course'").select(F.col("id").alias("src"), parse.prop("audience").alias("audience"))
    to = n.where("type = 'LessonGrouping'").select("id", parse.prop("groupName").alias("groupName"))
    held = e.where("type = 'hasPart'").select("src", F.col("dst").alias("id"))
    return display.grouped(held.join(of, "src").join(to, "id"), ["audience", "groupName"])


@_query("SELECT label, count(*) AS n, min(id) AS first, max(id) AS last FROM shown GROUP BY label", more=_DRAWN)
def c14_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.by_kind(display.display_nodes(graph(spark, sf_dir)[0]))


@_query(
    "SELECT root, id, min(depth) AS depth FROM tree GROUP BY root, id",
    more=_DRAWN + ", tree AS (SELECT id AS root, id, 0 AS depth FROM nodes WHERE type = 'StandardsFramework' UNION ALL SELECT t.root, d.dst, t.depth + 1 FROM tree t JOIN drawn d ON d.src = t.id AND d.rel = 'hasChild' AND d.dst SIMILAR TO '[NS].*')",
)
def c15_label_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return display.label_tree(display.display_nodes(n), display.display_edges(n, e), ["StandardsFramework", "StandardsFrameworkItem", "LearningComponent"], root_kinds=["StandardsFramework"])


@_query("SELECT DISTINCT src AS id FROM drawn WHERE rel = 'buildsTowards' AND src NOT IN (SELECT dst FROM drawn WHERE rel = 'buildsTowards')", more=_DRAWN)
def c17_progression_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.progression(display.display_edges(*graph(spark, sf_dir)))


@_query(
    "SELECT id, min(depth) = 0 AS matched FROM hits GROUP BY id",
    more=_DRAWN + f", hits AS (SELECT id, 0 AS depth FROM shown WHERE contains(lower(text), '{WORD}') UNION ALL SELECT d.src, h.depth + 1 FROM hits h JOIN drawn d ON d.dst = h.id AND d.rel = 'hasChild')",
)
def c19_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return display.search(display.display_nodes(n), display.display_edges(n, e), WORD)


@_query(f"SELECT DISTINCT CASE WHEN rel = 'hasChild' AND dst = '{GROUPING}' THEN 'parent' WHEN rel = 'hasChild' THEN 'child' WHEN src = '{GROUPING}' THEN 'builds_to' ELSE 'built_from' END AS way, CASE WHEN src = '{GROUPING}' THEN dst ELSE src END AS id FROM drawn WHERE rel IN ('hasChild', 'buildsTowards') AND '{GROUPING}' IN (src, dst)", more=_DRAWN)
def c24_node_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.detail(display.display_edges(*graph(spark, sf_dir)), GROUPING)


# --- expectations on content: ours, stated only in prose elsewhere -------------------------------
@_query("""SELECT 'empty grouping' AS check_name, id FROM nodes WHERE type = 'LessonGrouping' AND id NOT IN (SELECT src FROM edges WHERE type = 'hasPart')
  UNION ALL SELECT 'no assessment', e.src FROM edges e JOIN nodes l ON l.id = e.dst WHERE e.type = 'hasPart' AND l.type = 'Lesson' GROUP BY e.src HAVING count(*) FILTER (json_extract_string(l.props, '$.educationalUse') = 'Assessment') = 0""")
def c27_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    held = stats.child_histogram(n, e).where("type = 'LessonGrouping' AND child_type = 'Lesson'")
    bare = n.where("type = 'LessonGrouping'").join(held, "id", "left_anti").select(F.lit("empty grouping").alias("check_name"), "id")
    return bare.unionByName(held.where("assessments = 0").select(F.lit("no assessment").alias("check_name"), "id"))


# --- more of the inventory ------------------------------------------------------------------------
@_query("SELECT count(*) > 0 AS open, count(*) AS edits_staged FROM diff", True, _DIFF)
def o15_draft_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = overlay.whole_difference(graph(spark, sf_dir), draft(spark, sf_dir))
    return diff.agg((F.count("*") > 0).alias("open"), F.count("*").alias("edits_staged"))


@_query("SELECT src AS id, CAST(row_number() OVER (PARTITION BY src ORDER BY type, dst) - 1 AS INTEGER) AS place, dst AS child FROM edges WHERE type IN ('hasPart', 'hasChild')")
def p7_ordered_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = project.numbered_edges(spark, sf_dir).where("type IN ('hasPart', 'hasChild')").withColumn("place", F.lit(None).cast("double"))
    return parse.placed_stored_children(e)


@_query("SELECT e.src AS parent, CAST(greatest(max(coalesce(CAST(json_extract_string(n.props, '$.position') AS DOUBLE), 0)), 0) + 1 AS DOUBLE) AS next_position FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.type = 'hasPart' GROUP BY e.src")
def a12_next_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return mutate.next_positions(n, e.where("type = 'hasPart'").select(F.col("src").alias("parent"), F.col("dst").alias("id")))


@_query(
    "SELECT type, count(*) AS n FROM nodes WHERE id NOT IN (SELECT id FROM seeds UNION ALL SELECT id FROM gone_orders UNION ALL SELECT id FROM gone_lessons UNION ALL SELECT e.dst FROM edges e WHERE e.type = 'hasPart' AND e.dst LIKE 'P%' GROUP BY e.dst HAVING count(*) FILTER (e.src NOT IN (SELECT id FROM gone_lessons)) = 0) GROUP BY type",
    more="""seeds AS (SELECT 'C0000001' AS id),
gone_orders AS (SELECT dst AS id FROM edges WHERE type = 'hasPart' AND src IN (SELECT id FROM seeds)),
gone_lessons AS (SELECT dst AS id FROM edges WHERE type = 'hasPart' AND src IN (SELECT id FROM gone_orders))""",
)
def m6_after_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = mutate.delete_nodes(mutate.Graph(*graph(spark, sf_dir)), [COURSE])
    return after.nodes.groupBy("type").agg(F.count("*").alias("n"))


@_query("SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY coalesce(CAST(json_extract_string(n.props, '$.position') AS DOUBLE), 0), dst) AS INTEGER) AS place FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.type = 'hasPart'")
def l9_running_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return mutate.running_positions(e, n)


@_query("SELECT src AS id, 'out' AS way, dst AS other, type FROM edges UNION ALL SELECT dst, 'in', src, type FROM edges")
def t25_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.neighbours(*graph(spark, sf_dir))


@_query(
    """SELECT id, CASE eventType
  WHEN 'apply' THEN concat_ws(' — ', mutation, nullif(concat_ws('; ',
    CASE WHEN na + nc > 0 THEN na || ' added / ' || nc || ' changed / 0 removed node(s)' END, CASE WHEN er > 0 THEN '0 added / 0 changed / ' || er || ' removed edge(s)' END), ''))
  WHEN 'createDraft' THEN 'draft created from published'
  WHEN 'publish' THEN 'promoted ' || event_id % 7 || ' apply(ies)' || CASE WHEN event_id % 5 = 0 THEN ' · self-approved' ELSE '' END
  WHEN 'blocked' THEN concat_ws(': ', mutation, reason)
  WHEN 'read' THEN 'returned ' || event_id % 40 || ' record(s)' || CASE WHEN event_id % 3 = 0 THEN ' · q=' || user_id ELSE '' END END AS summary
  FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'edit_node' WHEN 1 THEN 'add_nodes' END AS mutation, CASE WHEN event_id % 2 = 0 THEN 'reason ' || user_id END AS reason,
    event_id % 3 AS na, event_id % 4 AS nc, event_id % 5 AS er FROM log JOIN events e ON log.id = lpad(CAST(e.event_id AS VARCHAR), 9, '0'))""",
    more=_AUDIT,
)
def f14_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.summary(project.audit(spark, sf_dir))


@_query("SELECT p_name AS name, trim(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM (SELECT DISTINCT p_name FROM part)")
def fn_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().select("name", text.slug(F.col("name")).alias("slug"))


@_query("SELECT doc_id, substr(text, 101, 200) AS piece, CASE WHEN length(text) > 300 THEN 300 END AS next_offset FROM documents")
def l5_text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = text.text_window(F.col("text"), 100, 200)
    return project.table(spark, sf_dir, "documents").select("doc_id", w["text"].alias("piece"), w["next_offset"].alias("next_offset"))


@_query("SELECT a.id AS a, b.id AS b, d.rel, true AS forward FROM drawn d JOIN nodes a ON a.id = d.src JOIN nodes b ON b.id = d.dst WHERE a.type = 'LessonGrouping' AND b.type = 'LessonGrouping' UNION ALL SELECT d.dst, d.src, d.rel, false FROM drawn d WHERE d.src LIKE 'O%' AND d.dst LIKE 'O%'", more=_DRAWN)
def c18_relations_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    drawn = display.display_edges(n, e)
    both = drawn.where("src LIKE 'O%' AND dst LIKE 'O%'")
    pairs = both.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(both.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    return display.between(drawn, pairs)


_LEGEND = ("StandardsFramework", "StandardsFrameworkItem", "Course", "LessonGrouping", "Lesson", "Activity", "Material", "LearningComponent", "TeachingLearningMaterial", "DocumentSection")


@_query("SELECT label, count(*) AS n, CASE label " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(_LEGEND)) + " END AS place FROM shown GROUP BY label", more=_DRAWN)
def c11_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.whole(*graph(spark, sf_dir))[2]["legend"]


@_query("SELECT true AS standards, true AS components, true AS curriculum, true AS documents, true AS progression")
def c11_views_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.whole(*graph(spark, sf_dir))[2]["views"]


@_query("SELECT type AS label, id AS example, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY id) AS k FROM nodes) WHERE k = 1")
def v6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.templates(graph(spark, sf_dir)[0]).withColumn("keys", F.array_join("keys", ","))


@_query("SELECT label, arg_min(edge_type, (-n, edge_type)) AS edge_type FROM (SELECT n.type AS label, e.type AS edge_type, count(*) AS n FROM edges e JOIN nodes n ON n.id = CASE e.type WHEN 'supports' THEN e.src ELSE e.dst END WHERE e.type IN ('hasPart', 'hasChild', 'supports') GROUP BY ALL) GROUP BY label")
def v6_containment_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.containment_types(*graph(spark, sf_dir))


def queries() -> dict[str, Query]:
    from weftgraph.plans import more, orders, reviews  # noqa: F401  register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from weftgraph.plans import more, orders, reviews  # noqa: F401

    return dict(_SQL)
