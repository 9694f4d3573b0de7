"""Queries on orders of trees, versions of the store, and confirmations: each over whole tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import scratch
from weftgraph.operators import catalog, display, lookup, mutate, ordering, overlay, parse, rewrite
from weftgraph.operators.mutate import Graph
from weftgraph.operators.postings import Postings
from weftgraph.operators.store import Store
from weftgraph.plans.more import NAMESPACE
from weftgraph.plans.registry import _AUDIT, _DRAWN, _LEXICON, TERM, WORD, _query, draft, graph
from weftgraph.sources import files, project
from weftgraph.streaming import confirmations

_NUMBERED = "numbered AS (SELECT *, row_number() OVER (ORDER BY type, src, dst) AS seq FROM edges)"


# --- trees ----------------------------------------------------------------------------------------
def _course_forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The courses as tops, in order of their numbers, and containment with its place."""
    n, _ = graph(spark, sf_dir)
    roots = n.where("type = 'Course'").select("id", F.substring("id", 2, 7).cast("bigint").alias("place"))
    held = project.numbered_edges(spark, sf_dir).where("type = 'hasPart'")
    return roots, held.select(F.col("src").alias("parent"), F.col("dst").alias("id"), F.col("seq").alias("place"))


_PATHS = _NUMBERED + """, paths AS (
  SELECT id, CAST(NULL AS VARCHAR) AS parent, [CAST(substr(id, 2) AS BIGINT)] AS path FROM nodes WHERE type = 'Course'
  UNION ALL SELECT e.dst, e.src, list_append(p.path, e.seq) FROM paths p JOIN numbered e ON e.src = p.id AND e.type = 'hasPart'),
seen AS (SELECT id, arg_min(parent, path) AS parent, min(path) AS path FROM paths GROUP BY id)"""


@_query("SELECT id, parent, row_number() OVER (ORDER BY path) - 1 AS preorder, len(path) - 1 AS depth FROM seen", more=_PATHS)
def t23_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every node of all courses in a depth-first walk, each node once."""
    roots, held = _course_forest(spark, sf_dir)
    return ordering.preorder(ordering.first_seen(roots, held)).select("id", "parent", "preorder", "depth")


@_query("SELECT id, (SELECT count(*) FROM ext_edges e WHERE e.type = 'hasPart' AND (e.src = n.id OR e.src LIKE n.id || '-%')) + 1 AS size FROM ext_nodes n WHERE type = 'InstructionalRoutine' AND id LIKE 'I__'", more=project.EXTENDED_SQL)
def t23_catalog_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes each catalog entry has, itself included, by the size of its range of places."""
    n, e = project.extended(spark, sf_dir)
    held = e.where("type = 'hasPart'").join(n.where("id LIKE 'I%'").select(F.col("id").alias("dst")), "dst", "left_semi")
    tops = n.where("type = 'InstructionalRoutine'").join(held.select(F.col("dst").alias("id")), "id", "left_anti").select("id", F.lit(0).alias("place"))
    numbered = ordering.in_order(held.select(F.col("src").alias("parent"), F.col("dst").alias("id")), "parent", "id", name="place")
    found = ordering.preorder(tops.select("id", F.lit(None).cast("string").alias("parent"), "place").unionByName(numbered.select("id", "parent", "place")))
    return found.where("parent IS NULL").select("id", "size")


@_query("SELECT id, arg_max(parent, path) AS parent_id FROM (SELECT e.dst AS id, e.src AS parent, list_append(s.path, e.seq) AS path FROM seen s JOIN numbered e ON e.src = s.id AND e.type = 'hasPart') GROUP BY id", more=_PATHS)
def t24_view_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.last_parents(*_course_forest(spark, sf_dir))


@_query(
    "SELECT id, max(hit::INT) = 1 AS matched FROM up GROUP BY id",
    more=_PATHS + f""", vparent AS (SELECT id, arg_max(parent, path) AS parent_id FROM (SELECT e.dst AS id, e.src AS parent, list_append(s.path, e.seq) AS path FROM seen s JOIN numbered e ON e.src = s.id AND e.type = 'hasPart') GROUP BY id),
up AS (SELECT id, true AS hit FROM nodes WHERE contains(lower(json_extract_string(props, '$.description')), '{WORD}')
  UNION ALL SELECT v.parent_id, false FROM up JOIN vparent v ON v.id = up.id)""",
)
def t24_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in a view: hits, and above them only the parents under which the view shows them."""
    n, e = graph(spark, sf_dir)
    return display.search(display.display_nodes(n), display.display_edges(n, e), WORD, ordering.last_parents(*_course_forest(spark, sf_dir)))


@_query(
    "SELECT root, id, min(depth) AS depth FROM below GROUP BY root, id",
    more="below AS (SELECT id AS root, id, 0 AS depth FROM nodes WHERE type IN ('StandardsFramework', 'TeachingLearningMaterial') UNION ALL SELECT b.root, e.dst, b.depth + 1 FROM below b JOIN edges e ON e.src = b.id AND e.type IN ('hasPart', 'hasChild'))",
)
def t11_members_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What frameworks and documents contain, by ranges of places instead of a closure."""
    n, _ = graph(spark, sf_dir)
    roots = n.where("type IN ('StandardsFramework', 'TeachingLearningMaterial')").select("id")
    held = project.numbered_edges(spark, sf_dir).where("type = 'hasChild' OR type = 'hasPart' AND src LIKE 'T%'").select(F.col("dst").alias("id"), F.col("src").alias("parent"), F.col("seq").alias("place"))
    tree = roots.select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("place")).unionByName(held)
    return ordering.inside(scratch.written(ordering.preorder(tree), "places"), roots).select("root", "id", F.col("depth").cast("int").alias("depth"))


@_query("SELECT root, id, depth FROM up", more="""before AS (SELECT src AS id, dst AS parent FROM edges WHERE type = 'hasDependency'),
up AS (SELECT id AS root, id, 0 AS depth FROM nodes WHERE type = 'LessonGrouping' UNION ALL SELECT u.root, b.parent, u.depth + 1 FROM up u JOIN before b ON b.id = u.id)""")
def t14_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that each grouping depends on, step after step: chains as long as a customer has orders, by doubling."""
    n, e = graph(spark, sf_dir)
    parents = e.where("type = 'hasDependency'").select(F.col("src").alias("id"), F.col("dst").alias("parent"))
    return ordering.chains(n.where("type = 'LessonGrouping'").select("id"), parents)


# --- views ----------------------------------------------------------------------------------------
@_query("SELECT label, row_number() OVER (PARTITION BY label ORDER BY coalesce(ord, 0), id) - 1 AS place, id FROM shown", more=_DRAWN)
def c14_kind_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.kind_rows(display.display_nodes(graph(spark, sf_dir)[0]))


_HELD = "held AS (SELECT o.id, json_extract_string(c.props, '$.audience') AS audience, json_extract_string(o.props, '$.groupName') AS name, CAST(json_extract_string(o.props, '$.position') AS DOUBLE) AS spot FROM edges e JOIN nodes c ON c.id = e.src JOIN nodes o ON o.id = e.dst WHERE e.type = 'hasPart' AND c.type = 'Course')"


@_query(
    """SELECT 0 AS depth, NULL AS parent, audience AS bucket, count(*) AS n, NULL AS anchor, CAST(NULL AS BIGINT) AS place FROM held GROUP BY audience
  UNION ALL SELECT 1, audience, audience || '/' || name, count(*), NULL, NULL FROM held GROUP BY audience, name
  UNION ALL SELECT 2, audience || '/' || name, NULL, 1, id, row_number() OVER (PARTITION BY audience, name ORDER BY spot, id) - 1 FROM held""",
    more=_HELD,
)
def c13_nested_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    of = n.where("type = 'Course'").select(F.col("id").alias("src"), parse.prop("audience").alias("audience"))
    to = n.where("type = 'LessonGrouping'").select("id", parse.prop("groupName").alias("groupName"), parse.prop("position").cast("double").alias("at"))
    held = e.where("type = 'hasPart'").select("src", F.col("dst").alias("id"))
    return display.nested(held.join(of, "src").join(to, "id"), ["audience", "groupName"], "at", "id")


@_query("SELECT id, section, dense_rank() OVER (ORDER BY first) - 1 AS section_place, row_number() OVER (PARTITION BY section ORDER BY en, id) - 1 AS place FROM (SELECT *, min(id) OVER (PARTITION BY section) AS first FROM (SELECT l.id, l.en, p.p_type AS section FROM lexicon l JOIN part p ON CAST(substr(l.id, 2) AS BIGINT) = p.p_partkey))", more=_LEXICON)
def w9_section_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms under their sections: sections in the order in which their first entries come, entries by name."""
    terms = project.lexicon(spark, sf_dir).select("id", F.col("renderings")["en"].alias("name"), F.col("tags")[0].alias("section"))
    return lookup.section_order(terms)


# --- smaller operators ----------------------------------------------------------------------------
@_query("SELECT CASE json_extract_string(o.props, '$.groupName') WHEN 'F' THEN 'N00' WHEN 'O' THEN 'N01' ELSE 'N02' END AS src, e.dst FROM edges e JOIN nodes o ON o.id = e.src WHERE e.type = 'hasPart' AND o.type = 'LessonGrouping'")
def p15_derived_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lessons move from groupings to the standard that the grouping's name stands for."""
    n, e = graph(spark, sf_dir)
    groupings = n.where("type = 'LessonGrouping'").select("id", F.concat(F.lit("status — "), parse.prop("groupName")).alias("key"))
    at = F.substring("id", 2, 2).cast("int") + 1
    leaves = n.where("type = 'StandardsFrameworkItem' AND id < 'N03'").select("id", F.concat(F.lit("status — "), F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), at)).alias("key"))
    return rewrite.derived_components(n, e, groupings, leaves, "Lesson")[1].where("type = 'hasChild' AND dst LIKE 'L%'").select("src", "dst")


@_query("SELECT ordinal, string_agg(domain, ',' ORDER BY first, domain) AS domains FROM (SELECT t.position AS ordinal, p_type AS domain, min(l_orderkey * 10 + l_linenumber) AS first FROM lines JOIN part ON p_partkey = l_partkey JOIN turns t ON t.o_orderkey = l_orderkey WHERE t.position IN (1, 2, 4, 5) GROUP BY ALL) GROUP BY ordinal")
def a7_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = project.orders_in_turn(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"), F.col("position").alias("ordinal"))
    parts = project.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("domain"))
    used = project.lines(spark, sf_dir).join(parts, "l_partkey").join(at, "l_orderkey").select("ordinal", "domain", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return lookup.neighbourhood(used, 3, 2).withColumn("domains", F.array_join("domains", ","))


@_query("SELECT id, kind, row_number() OVER (ORDER BY kind <> 'routine', name, id) AS place FROM (SELECT id, 'Routine ' || r_name AS name, CASE WHEN r_name < 'B' THEN 'rubric' ELSE 'routine' END AS kind FROM routines)", more=project.EXTENDED_SQL)
def l13_card_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = project.extended(spark, sf_dir)
    named = catalog.entries(n, e).join(n.select("id", parse.prop("description").alias("name")), "id")
    return catalog.card_order(named.withColumn("kind", F.when(F.col("name") < "Routine B", "rubric").otherwise(F.col("kind")))).select("id", "kind", "place")


@_query(f"SELECT id, en FROM lexicon WHERE contains(lower(strip_accents(en)), '{TERM}') ORDER BY id LIMIT 20", more=_LEXICON)
def f9_terms_of_a_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.matching_terms(project.lexicon(spark, sf_dir), TERM, languages=["en"]).select("id", F.col("renderings")["en"].alias("en"))


# --- versions -------------------------------------------------------------------------------------
def _with_places(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph with each containment's place among its parent's as a property of the edge; the places are written, as they are read more than once."""
    n, _ = graph(spark, sf_dir)
    e = project.numbered_edges(spark, sf_dir)
    held_of = lambda e: ordering.placed(e.where("type IN ('hasPart', 'hasChild')"), "src", "seq").withColumn("props", F.to_json(F.struct(F.col("place").alias("orderInParent")))).drop("place")
    held = scratch.settled(spark, "places", lambda: held_of(e), packed=True)
    return Graph(n, held.unionByName(e.where("type NOT IN ('hasPart', 'hasChild')").withColumn("props", F.lit(None).cast("string"))))


_PLACED = _NUMBERED + """, placed AS (SELECT id, type, src, dst, CASE WHEN type IN ('hasPart', 'hasChild') THEN row_number() OVER (PARTITION BY src, type IN ('hasPart', 'hasChild') ORDER BY seq) - 1 END AS place FROM numbered)"""


@_query("SELECT id, CASE WHEN place = 0 AND src LIKE 'C%' THEN '{\"orderInParent\":99}' WHEN place IS NOT NULL THEN '{\"orderInParent\":' || place || '}' END AS props FROM placed", more=_PLACED)
def k1_edge_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge properties through the store: a draft changes nothing but the first place below each course, and is published."""
    s, g = Store(spark, scratch.new_path(spark, "store")), _with_places(spark, sf_dir)
    s.seed(NAMESPACE, g)
    first = (F.col("src").startswith("C")) & (F.col("props") == '{"orderInParent":0}')
    live = F.lit(False).alias("_tombstone")
    moved = g.edges.where(first).withColumn("props", F.lit('{"orderInParent":99}')).select("*", live)
    s.stage(NAMESPACE, Graph(g.nodes.limit(0).select("*", live), moved))
    s.publish(NAMESPACE)
    return s.published(NAMESPACE).edges.select("id", "props")


@_query("SELECT id, type || CASE WHEN json_extract_string(props, '$.educationalUse') = 'Assessment' THEN ',Assessment' ELSE '' END AS labels FROM nodes")
def k2_published_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft that changes nothing but labels, published."""
    s, (n, e) = Store(spark, scratch.new_path(spark, "store")), graph(spark, sf_dir)
    s.seed(NAMESPACE, Graph(n, e))
    more = F.when(parse.prop("educationalUse") == "Assessment", F.array_append("labels", F.lit("Assessment"))).otherwise(F.col("labels"))
    s.apply(NAMESPACE, Graph(n.withColumn("labels", more), e))
    s.publish(NAMESPACE)
    return s.published(NAMESPACE).nodes.select("id", F.array_join("labels", ",").alias("labels"))


@_query("SELECT DISTINCT CASE WHEN side = 'node' THEN 'nodes/' ELSE 'edges/' END || CAST(('0x' || substr(md5(id), 1, 4)) AS INTEGER) % 16 AS bucket FROM (SELECT 'node' AS side, id FROM nodes WHERE type = 'StandardsFramework')")
def o3_written_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishing a change of the frameworks writes the buckets that hold them and no others."""
    s, (n, e) = Store(spark, scratch.new_path(spark, "store")), graph(spark, sf_dir)
    s.seed(NAMESPACE, Graph(n, e))
    before = s.pointer(NAMESPACE)["published"]
    title = F.create_map(F.lit("description"), F.concat(parse.prop("description"), F.lit("!")))
    s.apply(NAMESPACE, mutate.edit_many(Graph(n, e), n.where("type = 'StandardsFramework'").select("id", title.alias("changes"))))
    s.publish(NAMESPACE)
    after = s.pointer(NAMESPACE)["published"]
    moved = [(f"{side}/{b}",) for side in ("nodes", "edges") for b, entry in after[side].items() if entry["path"] != before[side].get(b, {}).get("path")]
    return spark.createDataFrame(moved, "bucket string")  # a name for each bucket at most


@_query("SELECT id, type, props FROM draft_nodes", True)
def k5_seeded_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeding a seeded namespace changes nothing."""
    s = Store(spark, scratch.new_path(spark, "store"))
    s.seed(NAMESPACE, Graph(*draft(spark, sf_dir)))
    s.seed(NAMESPACE, Graph(*graph(spark, sf_dir)))
    return s.published(NAMESPACE).nodes.select("id", "type", "props")


@_query("SELECT side, id, op FROM (SELECT 'edge' AS side, id, 'changed' AS op FROM placed WHERE place = 0 AND src LIKE 'C%')", more=_PLACED)
def o7_changed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose properties differ, found by ranges whose digests differ."""
    e = _with_places(spark, sf_dir).edges
    first = (F.col("src").startswith("C")) & (F.col("props") == '{"orderInParent":0}')
    after = e.withColumn("props", F.when(first, '{"orderInParent":99}').otherwise(F.col("props")))
    return overlay.difference_by_ranges(e, after, 256, "edge").select(F.lit("edge").alias("side"), "id", "op")


# --- documents ------------------------------------------------------------------------------------
def _document(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path, g = scratch.new_path(spark, "document"), _with_places(spark, sf_dir)
    files.write_document(g.nodes, g.edges, path, "gzip")
    return files.read_document(spark, path)


@_query("SELECT id, type AS labels, props FROM nodes")
def s7_document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph as one document in parts, written and read by many tasks."""
    return _document(spark, sf_dir)[0].select("id", F.array_join("labels", ",").alias("labels"), "props")


@_query("SELECT id, src, dst, coalesce('{\"orderInParent\":' || place || '}', '{}') AS props, row_number() OVER (ORDER BY type, src, dst) AS seq FROM placed", more=_PLACED)
def k9_document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document(spark, sf_dir)[1].select("id", "src", "dst", "props", "seq")


# --- log and search -------------------------------------------------------------------------------
@_query("SELECT id, ts, actor FROM log WHERE eventType = 'publish' ORDER BY ts DESC, id DESC LIMIT 60", more=_AUDIT)
def l2_newest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the stored log; only the folders of its newest days are read."""
    s = Store(spark, scratch.new_path(spark, "store"))
    s.append_audit(project.audit(spark, sf_dir).select("id", "ts", "actor", "eventType", F.lit(NAMESPACE).alias("namespace")))
    schema = "id string, ts string, actor string, eventType string, namespace string"
    rows = s.audit_page(NAMESPACE, schema, 60, keep=lambda log: log.where("eventType = 'publish'"))
    return spark.createDataFrame(rows, schema).select("id", "ts", "actor")  # one page


@_query("SELECT doc_id AS id FROM documents WHERE contains(lower(strip_accents(text)), 'thre')")
def c20_indexed_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold a word, found through kept postings."""
    docs = project.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return Postings(spark, scratch.new_path(spark, "postings")).build(docs).search("Thré")


@_query(f"SELECT id FROM lexicon WHERE contains(lower(strip_accents(en)), '{TERM} ') OR contains(lower(strip_accents(xx)), '{TERM} ')", more=_LEXICON)
def f8_indexed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms by any of their renderings, found through kept postings."""
    terms = project.lexicon(spark, sf_dir).select("id", F.explode(F.map_values("renderings")).alias("text"))
    return Postings(spark, scratch.new_path(spark, "postings")).build(terms).search(f"{TERM.upper()} ")


# --- confirmations --------------------------------------------------------------------------------
@_query(
    """SELECT id, key, CASE WHEN opened IS NULL OR spot > opened + 900 THEN 'unknown' WHEN nth = 1 THEN 'applied' ELSE 'used' END AS outcome FROM (
  SELECT *, sum(is_confirm::INT) OVER (PARTITION BY key, n_opened ORDER BY spot, id) AS nth FROM (
    SELECT *, last_value(CASE WHEN NOT is_confirm THEN spot END IGNORE NULLS) OVER w AS opened, sum((NOT is_confirm)::INT) OVER w AS n_opened FROM requests WINDOW w AS (PARTITION BY key ORDER BY spot, id ROWS UNBOUNDED PRECEDING))) WHERE is_confirm""",
    more="requests AS (SELECT event_id AS id, user_id AS key, epoch(ts) AS spot, event_type = 'purchase' AS is_confirm FROM events WHERE event_type IN ('click', 'purchase'))",
)
def v3_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log read as requests: a click previews, a purchase of the same user confirms within a quarter of an hour, once."""
    e = project.table(spark, sf_dir, "events").where("event_type IN ('click', 'purchase')")
    requests = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").alias("at"), F.when(F.col("event_type") == "purchase", "confirm").otherwise("preview").alias("kind"))
    return confirmations.outcomes(requests)
