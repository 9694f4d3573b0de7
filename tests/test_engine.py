"""Small hand-built graphs for what the projected tables do not show."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import jsontext, text
from weftgraph.operators import audit, display, lookup, mutate, parse, rewrite, scope, traverse
from weftgraph.sources import files
from weftgraph.streaming import log as stream_log


def build(spark, nodes, links):
    n = mutate.node_rows(spark, [(i, t, [t], p) for i, t, p in nodes])
    rows = [(f"{t}:{a}->{b}", t, a, b, k) for k, (t, a, b) in enumerate(links, 1)]
    return n, spark.createDataFrame(rows, "id string, type string, src string, dst string, seq long")


def ids(df, column="id"):
    return {r[column] for r in df.select(column).collect()}


@pytest.fixture(scope="module")
def star(spark):
    return build(spark, [("root", "Course", {"content": "x" * 1000})] + [(f"n{i:02}", "Lesson", {"content": "y" * 1000}) for i in range(60)], [("hasPart", "root", f"n{i:02}") for i in range(60)])


def test_pages_join_up_to_the_whole(star):
    n, e = star
    seen, cursor, pages = [], None, 0
    while True:
        p = traverse.walk(n, e, "root", limit=25, cursor=cursor, page_bytes=10**9)
        seen += [x["id"] for x in p.nodes]
        pages += 1
        assert p.truncated_by_limit == (p.next_cursor is not None) and not p.truncated
        if not (cursor := p.next_cursor):
            break
    assert pages == 3 and seen == ["root"] + [f"n{i:02}" for i in range(60)]


def test_page_is_cut_by_size_but_never_empty(star):
    n, e = star
    p = traverse.walk(n, e, "root", page_bytes=3000, include_edges=False)
    assert 0 < len(p.nodes) < 4 and p.truncated_by_size and p.next_cursor
    assert len(traverse.walk(n, e, "root", page_bytes=10).nodes) == 1


def test_label_filter_does_not_stop_the_walk_and_cycles_end(spark):
    n, e = build(spark, [(i, t, {}) for i, t in (("a", "X"), ("b", "Y"), ("c", "X"), ("d", "X"))], [("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "c", "d"), ("q", "a", "zz")])
    p = traverse.walk(n, e, "a", labels=["X"], most_depth=2)
    assert [x["id"] for x in p.nodes] == ["a", "c"] and p.truncated
    assert {x["id"] for x in traverse.walk(n, e, "c", direction="both", most_depth=1).nodes} == {"a", "b", "c", "d"}
    for bad in ({"from_id": "zz"}, {"from_id": "a", "cursor": "%%"}, {"from_id": "a", "cursor": "e30="}):
        with pytest.raises(ValueError):
            traverse.walk(n, e, **bad)
    assert ids(traverse.closure(n.where("id = 'b'").select("id"), traverse.steps(e))) == {"a", "b", "c", "d", "zz"}


@pytest.fixture(scope="module")
def library(spark):
    nodes = [
        ("c", "Course", {}), ("g", "LessonGrouping", {}), ("l", "Lesson", {}), ("t", "TeachingLearningMaterial", {}), ("s1", "DocumentSection", {"position": 2}), ("s2", "DocumentSection", {"position": 1}),
        ("f1", "Formatter", {}), ("f2", "Formatter", {}), ("r1", "InstructionalRoutine", {"description": "R1"}), ("r2", "InstructionalRoutine", {"description": "R2"}), ("st", "RoutineStep", {"position": 1, "description": "step"}), ("m", "Material", {}),
    ]
    links = [("hasPart", "c", "g"), ("hasPart", "g", "l"), ("hasPart", "t", "s1"), ("hasPart", "t", "s2"), ("hasPart", "t", "f1"), ("hasPart", "s1", "f2"), ("covers", "s1", "l"), ("covers", "t", "c"), ("usesRoutine", "g", "r1"), ("usesRoutine", "c", "r2"), ("hasPart", "r1", "st"), ("hasPart", "st", "m")]
    return build(spark, nodes, links)


def test_sections_formatters_and_routines(library):
    n, e = library
    got = scope.section_subgraph(n, e, "s1")
    assert ids(got["document"]) == {"t"} and ids(got["curriculum"]) == {"l"}
    assert ids(got["formatters"]) == {"f1", "f2"}  # its own, and the document's, not other sections'
    assert ids(got["routine"]) == {"r1", "st", "m"}  # nearest above what it covers
    assert ids(scope.document_formatters(n, e, "t")) == {"f1"}
    assert scope.document_curriculum(n, e, "t")[0] == "sections"
    assert [(r.section, r.position) for r in scope.document_sections(n, e).orderBy("position").collect()] == [("s2", 1.0), ("s1", 2.0)]
    assert scope.course_subgraph(n, e, "t") is None
    top = {r.id: r for r in lookup.catalog_entries(n, e).collect()}
    assert top["r1"].steps == ["step"] and top["r1"].material_count == 1 and top["r2"].material_count == 0


def test_clone_keeps_the_shape(library, spark):
    n, e = library
    members = traverse.closure(n.where("id = 'r1'").select("id"), traverse.steps(e, "out", ["hasPart"])).select("id")
    nodes, links, renamed = lookup.cloned(n, e, members, "stamp")
    assert nodes.count() == 3 and links.count() == 2 and not ids(nodes) & ids(n)
    back = {r.new_id: r.old_id for r in renamed.collect()}
    assert {(back[r.src], back[r.dst]) for r in links.collect()} == {("r1", "st"), ("st", "m")}
    g = mutate.Graph(n, e)
    root = next(k for k, v in back.items() if v == "r1")
    assert f"usesRoutine:l->{root}" in ids(mutate.use_routine(g, "l", mutate.Graph(nodes, links), root).edges)
    for bad in ("m", "nope"):
        with pytest.raises(mutate.Rejected):
            mutate.use_routine(g, bad, mutate.Graph(nodes, links), root)


def test_parse_order_ties_and_round_trip(spark):
    nodes = [("c", "Course", {"description": "C"}), ("a", "Lesson", {"position": 1.5}), ("b", "Lesson", {"position": "2"}), ("s", "StandardsFrameworkItem", {"position": 4}), ("t", "DocumentSection", {})]
    n, e = build(spark, nodes, [("hasPart", "c", "b"), ("hasPart", "c", "a"), ("hasPart", "c", "b"), ("supports", "a", "s"), ("buildsTowards", "a", "b"), ("hasPart", "c", "t")])
    got = {r.id: r for r in parse.parsed(n, e).collect()}
    assert "t" not in got and got["c"].child_ids == ["b", "a", "b"] and got["a"].parent_id == "s" and got["b"].parent_id == "c"
    assert (got["a"].ord, got["b"].ord, got["s"].ord) == (1.5, None, None) and got["a"].builds_towards == ["b"]
    stored, links = parse.serialised(n, e, parse.units(n))
    assert {r.id for r in links.collect()} >= {"hasPart:c->b", "hasPart:c->b#2"}
    raw_nodes, raw_edges = parse.raw_envelope(stored, links)
    assert [tuple(r) for r in raw_edges.collect()] == [tuple(r) for r in e.select("id", "type", "src", "dst", "seq").orderBy("seq").collect()]
    assert {r.id: r.child_ids for r in parse.parsed(raw_nodes, raw_edges).collect()} == {i: r.child_ids for i, r in got.items()}


def test_rewrites(spark):
    n, e = build(spark, [("p", "Course", {}), ("x", "Lesson", {}), ("y", "Lesson", {})], [("hasPart", "p", "x"), ("hasPart", "p", "y")])
    groups = spark.createDataFrame([("p", "x", "Mon"), ("p", "y", "Mon")], "parent string, child string, name string")
    nodes, links = rewrite.grouped_between(e, groups)
    assert nodes.count() == 1 and links.count() == 3
    moves = spark.createDataFrame([("x", "y")], "old_id string, new_id string")
    assert ids(rewrite.repoint(e, moves)) == {"hasPart:p->y"}
    assert [r.type for r in rewrite.relabel(n, F.col("id") == "x", "Activity").orderBy("id").collect()] == ["Course", "Activity", "Lesson"]
    weeks = spark.createDataFrame([("1",), ("2",)], "week string")
    plan = spark.createDataFrame([("s1", "read"), ("s2", "write")], "session string, type string")
    standards = spark.createDataFrame([("1", "read", "A"), ("1-8", "read", "B"), ("1-8", "write", "C")], "week string, type string, standard string")
    assert sorted(map(tuple, rewrite.expanded(weeks, plan, standards, "1-8").collect())) == [("1", "s1", "A"), ("1", "s2", "C"), ("2", "s1", "B"), ("2", "s2", "C")]
    edits = spark.createDataFrame([("x", "a", "1"), ("x", "b", "2"), ("q", "a", "1")], "id string, field string, value string")
    after, counts = rewrite.edited(n, edits)
    assert after.where("id = 'x'").first().props == '{"a":"1","b":"2"}' and {r.state: r.n for r in counts.collect()} == {"applied": 2, "failed": 1}


def test_text_functions(spark):
    df = spark.createDataFrame([("Été ÀÇ  x-1",), ("a10",), ("a9",), (None,)], "t string")
    got = [tuple(r) for r in df.select(text.no_accents(F.col("t")), text.slug(F.col("t")), text.first_int(F.col("t"))).collect()]
    assert got == [("ete ac  x-1", "ete-ac-x-1", 1), ("a10", "a10", 10), ("a9", "a9", 9), (None, None, None)]
    assert [r.t for r in df.where("t LIKE 'a%'").orderBy(text.natural_key(F.col("t"))).collect()] == ["a9", "a10"]
    one = spark.range(1)
    row = one.select(
        text.truncated(F.lit("abcdef"), 4).alias("cut"), text.namespace_parts(F.lit("w/g/s")).alias("parts"), text.namespace_parts(F.lit("w/_catalog/s")).alias("kept"), text.iso_minutes(F.lit("45 min")).alias("iso"),
        text.text_window(F.lit("héllo😀x"), 1, 3).alias("w"), text.normal_renderings(F.create_map(F.lit("FR"), F.lit(" a "), F.lit("wo"), F.lit(" "), F.lit("fr"), F.lit("b"))).alias("r"),
    ).first()
    assert row.cut == "abc…" and tuple(row.parts) == ("w", "g", "s") and row.kept is None and row.iso == "PT45M"
    assert tuple(row.w) == ("éll", 4) and row.r == {"fr": "b"}
    assert jsontext.canonical_text('{"b":1.0,"a":[null,{"d":1.50,"c":2}]}') == '{"a":[null,{"c":2,"d":1.5}],"b":1}'
    assert jsontext.camel_keys({"case_uuid": 1, "x_uri": None, "a_b": {"c_d": 1}}) == {"caseUUID": 1, "aB": {"cD": 1}}


def test_lexicon(spark):
    lex = spark.createDataFrame([("1", {"fr": "Été", "wo": "nawet"}, None), ("2", {"fr": "a"}, "math"), ("3", {"fr": ""}, None)], "id string, renderings map<string,string>, subject string")
    assert ids(lookup.matching_terms(lex, "ete")) == {"1"}
    passages = spark.createDataFrame([("p", "un ÉTÉ long"), ("q", "xyz"), ("r", "nawet b")], "passage_id string, text string")
    assert sorted(map(tuple, lookup.terms_in(passages, lex).collect())) == [("p", "1"), ("r", "1"), ("r", "2")]
    assert ids(lex.where(lookup.entry_applies(subject="science"))) == {"1", "3"}
    new = spark.createDataFrame([("1", {"WO": "", "en": "summer"}, None)], "id string, renderings map<string,string>, subject string")
    assert lookup.merged_entry(lex, new).where("id = '1'").first().renderings == {"fr": "Été", "wo": "nawet", "en": "summer"}
    users = spark.createDataFrame([("u", "author", False), ("v", None, True)], "userId string, legacyRole string, superAdmin boolean")
    rows = spark.createDataFrame([("u", "w1", "viewer", 1), ("u", "w1", "admin", 2)], "userId string, workspace string, role string, seq int")
    assert sorted(map(tuple, lookup.effective_roles(users, rows, "w0").collect())) == [("u", "w0", "author"), ("u", "w1", "admin"), ("v", "w1", "super_admin")]
    assert lookup.memberships(rows).first().roles == {"w1": "admin"} and ids(lookup.last_admin(rows), "workspace") == {"w1"}


def test_audit_reads(spark):
    diff = json.dumps({"nodes": {"added": [{"id": "n1"}]}, "edges": {"removed": [{"id": "hasPart:a->b"}]}})
    rows = [("1", "2024-01-01T00:00:00.000Z", "u", "createDraft", None, None, None), ("2", "2024-01-02T00:00:00.000Z", "u", "apply", diff, "v0", "v1"), ("3", "2024-01-02T00:00:00.000Z", "v", "apply", None, "v1", "v2"), ("4", "2024-01-03T00:00:00.000Z", "v", "apply", "{}", "v9", "v3")]
    log = spark.createDataFrame([(*r, "ns", None) for r in rows], "id string, ts string, actor string, eventType string, diff string, baseVersion string, resultingVersion string, namespace string, reason string")
    assert [r.id for r in audit.page(log, 2).collect()] == ["4", "3"]
    assert [r.id for r in audit.page(log, 2, ("2024-01-02T00:00:00.000Z", "3")).collect()] == ["2", "1"]
    for node, found in (("n1", {"2"}), ("b", {"2"}), ("zz", set())):
        assert ids(audit.touching(log, node)) == found
    assert ids(audit.draft_applies(log)) == {"2", "3", "4"} and audit.self_authored(log, "v").first()[0] and not audit.self_authored(log, "w").first()[0]
    assert ids(audit.broken_chain(log)) == {"4"}


def test_display_folds(spark):
    n, e = build(spark, [("a", "Course", {"metadata": {"x": 1, "en": 2}, "x": 0, "y": 1}), ("b", "Lesson", {}), ("c", "LearningComponent", {})], [("hasPart", "a", "b"), ("supports", "c", "a"), ("odd", "a", "c"), ("hasPart", "a", "gone")])
    got = sorted((r.src, r.dst, r.rel, r.type) for r in display.display_edges(n, e).collect())
    assert got == [("a", "b", "hasChild", "hasPart"), ("a", "c", "hasChild", "supports"), ("a", "c", "odd", "odd")]
    n2, e2 = build(spark, [(i, "X", {}) for i in "abcs"], [("hasChild", "a", "b"), ("hasEducationalAlignment", "b", "s"), ("supports", "c", "s")])
    moved = spark.createDataFrame([("b", "c"), ("s", "gone")], "activity string, component string")
    drawn = display.display_edges(n2, e2, moved)
    assert {(r.src, r.dst, r.type) for r in drawn.collect()} == {("c", "b", "illustrates"), ("s", "c", "supports")}
    start = n2.where("id = 'b'").select("id")
    assert ids(display.scoped_subtree(drawn, start)) == {"b", "c"}
    assert ids(display.scoped_subtree(display.display_edges(n2, e2), start)) == {"b", "s", "c"}
    assert {(r.parent, r.child) for r in display.grafted(display.display_edges(n2, e2), display.display_nodes(n2), [("X", "supports", "out")]).collect()} == {("s", "c")}
    assert display.flat_props(n).where("id = 'a'").first().props == {"x": "1", "y": "1"}


def test_files(spark, tmp_path):
    envelope = {"nodes": [{"id": "a", "labels": ["Course"], "properties": {"k": None, "z": 1}}, {"id": "b"}], "relationships": [{"id": "r", "type": "hasPart", "start": "a", "end": "b", "properties": {}}]}
    (tmp_path / "e.json").write_text(json.dumps(envelope, indent=1))
    n, e = files.read_envelope(spark, f"file://{tmp_path}/e.json")
    assert {r.id: (r.labels, r.props) for r in n.collect()} == {"a": (["Course"], '{"k":null,"z":1}'), "b": ([], "{}")}
    assert json.loads(files.envelope_text(n, e))["relationships"] == envelope["relationships"]
    (tmp_path / "n.jsonl").write_text('{"entity_type":"Course","identifier":"a","case_uuid":"u","x":null,"metadata":{"some_key":1}}\n\n{"entity_type":"Lesson","identifier":"b","metadata":null}\n')
    (tmp_path / "r.jsonl").write_text('{"relationship_type":"hasPart","source_entity_value":"a","target_entity_value":"q","identifier":"1"}\n')
    n, e = files.read_lines(spark, f"file://{tmp_path}/n.jsonl", f"file://{tmp_path}/r.jsonl")
    assert {r.id: r.props for r in n.collect()} == {"a": '{"caseUUID":"u","metadata":{"someKey":1}}', "b": "{}"}
    assert {r.label: r.n for r in files.import_report(n, e).collect()} == {"Course": 1, "Lesson": 1, "(dangling)": 1}
    (tmp_path / "t.json").write_text(json.dumps({"sections": [{"titre": "A", "entrees": [{"francais": "un"}, {"francais": "deux", "wolof": "ñaar"}]}, {"titre": None, "entrees": [{"francais": "x"}]}]}))
    terms = files.read_terminology(spark, f"file://{tmp_path}/t.json")
    assert {r.section: r.n for r in lookup.section_counts(terms).collect()} == {"A": 2, None: 1}
    assert files.read_terminology(spark, f"file://{tmp_path}/no.json").count() == 0
    assert files.read_domains(spark, None).count() == 10
    (tmp_path / "h.json").write_text(json.dumps({"version": 2, "entries": [{"id": "1"}]}))
    assert files.read_history(spark, f"file://{tmp_path}/h.json").count() == 0
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>un</w:t><w:tab/><w:t>deux</w:t></w:r></w:p><w:p><w:r><w:t>trois</w:t></w:r></w:p></w:body></w:document>')
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.DOCX").write_bytes(buffer.getvalue())
    (docs / "~$a.docx").write_bytes(b"lock")
    (docs / "b.txt").write_bytes(b"no")
    assert [r.text for r in files.read_documents(spark, f"file://{docs}").collect()] == ["un\tdeux\ntrois"]


def test_streams(spark, tmp_path):
    schema = "id string, ts string, actor string, eventType string"
    rows = [("1", "2024-01-01T00:10:00.000Z", "u", "apply"), ("1", "2024-01-01T00:11:00.000Z", "u", "apply"), ("2", "2024-01-01T00:50:00.000Z", "u", "read"), ("3", "2024-01-01T01:10:00.000Z", "v", "apply"), ("9", "2024-01-02T00:00:00.000Z", "v", "read")]
    for i, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        del i
    for name, make in (("windows", stream_log.windowed), ("once", stream_log.once), ("runs", stream_log.sessions)):
        q = make(stream_log.read(spark, f"{tmp_path}/log", schema, 1)).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination(90)
    assert {(r.start.hour, r.eventType, r.n) for r in spark.table("windows").collect() if r.start.day == 1} == {(0, "apply", 2), (0, "read", 1), (1, "apply", 1)}
    assert spark.table("once").count() == 4
    assert {(r.actor, r.n) for r in spark.table("runs").collect() if r.start.day == 1} >= {("u", 2), ("v", 1)}


def test_levels_become_one_table(spark, monkeypatch):
    monkeypatch.setattr(traverse, "FAN", 3)
    edges = spark.createDataFrame([(f"e{i}", "hasPart", f"n{i}", f"n{i + 1}") for i in range(8)] + [("back", "hasPart", "n4", "n1")], "id string, type string, src string, dst string")
    start = spark.createDataFrame([("n0",)], "id string")
    found = traverse.closure(start, traverse.steps(edges))
    assert sorted((r.depth, r.id) for r in found.collect()) == [(i, f"n{i}") for i in range(9)]
    assert len(found.inputFiles()) and found._jdf.queryExecution().logical().collectLeaves().size() < 9
    gone = traverse.cascade(start, edges.where("id <> 'back'"))
    assert {r.id for r in gone.collect()} == {f"n{i}" for i in range(9)}
