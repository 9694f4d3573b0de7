import json

import pytest

from pyspark.sql import functions as F

from weftgraph.operators import catalog, display, export, lookup, mutate, profile, workspaces
from weftgraph.operators.store import Store


def graph(spark, nodes, links):
    return mutate.node_rows(spark, [(i, t, [t], p) for i, t, p in nodes]), mutate.edge_rows(spark, links)


def test_profiles():
    core = {"id": "a", "capabilities": {"exampleDomainRotation": True}, "parse": {"numberFrom": "order"}}
    assert profile.checked(core | {"deliverables": []}) == {"core": core}
    assert profile.checked({"core": core, "guide": "# g"})["guide"] == "# g"
    for bad in (None, [], core | {"x": 1}, core | {"id": ""}, core | {"parse": {"numberFrom": "size"}}, {"core": core, "guide": 3}, {"core": core, "guide": "x" * 100_001}):
        with pytest.raises(ValueError):
            profile.checked(bad)
    p = profile.preview({"core": core}, {"core": core, "guide": "g"})
    assert p["status"] == "preview" and p["changed"]
    assert profile.confirm({"core": core}, {"core": core, "guide": "g"}, p["token"])[0] == "applied"
    assert profile.confirm({"core": core, "guide": "other"}, {"core": core, "guide": "g"}, p["token"])[0] == "stale"
    assert profile.confirm({"core": core}, {"core": core}, p["token"])[0] == "arguments differ"
    assert profile.preview(None, {"id": 1})["status"] == "blocked"


def test_workspaces(spark):
    registry = spark.createDataFrame([("a", "A")], "id string, displayName string")
    contexts = spark.createDataFrame([("b", "g", "s")], "workspace string, grade string, subject string")
    roles = spark.createDataFrame([("b", "curator")], "workspace string, role string")
    assert [(r.id, r.displayName, r.role, len(r.contexts)) for r in workspaces.listed(registry, contexts, roles).collect()] == [("b", "b", "curator", 1)]
    assert len(workspaces.listed(registry, contexts, roles, True).collect()) == 2
    assert workspaces.created(registry, "Été 1", "E").count() == 2 and workspaces.slugged("Été 1") == "ete-1"
    for bad in ("A", "--"):
        with pytest.raises(workspaces.Refused):
            workspaces.created(registry, bad, "x")
    members = spark.createDataFrame([("a", "u", "admin"), ("a", "v", "curator")], "workspace string, userId string, role string")
    with pytest.raises(workspaces.Refused):
        workspaces.revoked(members, "a", "u")
    more = workspaces.granted(members, registry, "A", "v", "admin")
    assert [(r.userId, r.role) for r in workspaces.members_of(workspaces.revoked(more, "a", "u"), "a").collect()] == [("v", "admin")]
    assert workspaces.may({"a": "approver"}, "a", "publish") and not workspaces.may({"a": "curator"}, "a", "publish") and workspaces.may({}, "q", "manageWorkspace", True)
    assert {r.action for r in workspaces.capabilities(roles).where("allowed").collect()} == {"apply", "discard", "readDraft"}
    assert workspaces.of_user(more, "v").first().role == "admin" and workspaces.member(more, "a", "zz").count() == 0
    with pytest.raises(workspaces.Refused):
        workspaces.granted(members, registry, "a", "v", "viewer")


def test_catalog(spark):
    r = catalog.ROUTINE
    nodes = [("r", r, {"description": "R", "metadata": {"summary": "sum"}}), ("s2", r, {"description": "two", "position": 2, "timeRequired": "PT5M"}), ("s1", "Material", {"description": "one", "position": 1, "content": "do"}), ("m", "Material", {"content": "body"}), ("f", r, {"description": "F", "metadata": {"catalogKind": "formatter", "role": "x", "keep": 1}}), ("fm", "Material", {"content": "spec"}), ("c", "Course", {})]
    links = [("hasPart", "r", "s1"), ("hasPart", "r", "s2"), ("hasPart", "s2", "m"), ("hasPart", "f", "fm"), ("hasPart", "c", "r")]
    n, e = graph(spark, nodes, links)
    assert {(x.id, x.kind) for x in catalog.entries(n, e).collect()} == {("r", "routine"), ("f", "formatter")}
    text = catalog.rendered(n, e, "r")
    assert text.index("## one") < text.index("do") < text.index("## two (PT5M)") < text.index("node `m`") and catalog.rendered(n, e, "c") is None
    cn, ce = catalog.assembled([(n, e)], [(n, e)])
    assert {x.id for x in cn.collect()} == {"catalog-root", "r", "s1", "s2", "m", "f", "fm"}
    assert {x.dst for x in ce.where("src = 'catalog-root'").collect()} == {"r", "f"}
    after = {x.id: x for x in catalog.relabelled(n, e, "f", ("Formatter", "FormatterSpec")).collect()}
    assert after["f"].type == "Formatter" and after["fm"].labels == ["FormatterSpec"] and after["r"].type == r
    assert json.loads(after["f"].props) == {"description": "F", "metadata": {"keep": 1}}


def test_cards_follow_the_rules(spark):
    rows = [
        ("a", "task", [], {"text": "", "title": "t", "code": 7, "order": "3", "metadata": {"order": 4, "en": {"os_texte": "e"}}}),
        ("b", "Lesson", ["Lesson", "Course"], {"osTexte": "o", "statementCode": "s", "order": 2.5, "contentType": "c", "sourceKey": "k"}),
        ("c", "odd", [""], {"title": "T", "description": "d", "position": 9, "identifier": "i", "statementType": "st", "metadata": {"en": {"description": "D", "statement_type": "x"}}}),
    ]
    got = {r.id: r.asDict() for r in display.display_nodes(mutate.node_rows(spark, rows)).collect()}
    assert got["a"] == {"id": "a", "label": "Activity", "code": "7", "ord": 4.0, "text": "", "text_en": "e", "nt": "", "st": "", "st_en": "", "source": ""}
    assert got["b"] == {"id": "b", "label": "Lesson", "code": "s", "ord": 2.5, "text": "o", "text_en": "", "nt": "c", "st": "", "st_en": "", "source": "k"}
    assert got["c"] == {"id": "c", "label": "odd", "code": "i", "ord": None, "text": "T", "text_en": "D", "nt": "", "st": "st", "st_en": "x", "source": ""}
    n = mutate.node_rows(spark, rows)
    links = spark.createDataFrame([("1", "hasPart", "b", "c", 3, '{"orderInParent":2}'), ("2", "hasPart", "c", "a", 4, '{"orderInParent":"x","sequenceInFrom":5}'), ("3", "covers", "a", "b", 6, None)], "id string, type string, src string, dst string, seq int, props string")
    drawn = display.display_edges(n, links)
    assert {(r.src, r.dst): r.ord for r in drawn.collect()} == {("b", "c"): 2.0, ("c", "a"): 5.0, ("a", "b"): 6.0}
    shown = display.display_nodes(n)
    found = lambda q, **k: {(r.id, r.matched) for r in display.search(shown, drawn, q, **k).collect()}
    assert found(" E ") == {("a", True), ("b", False), ("c", False)} and found("  ") == set() and found("t") == {("c", True), ("b", False)}
    one = spark.createDataFrame([("a", "b")], "id string, parent_id string")
    assert found("e", view_parents=one) == {("a", True), ("b", False)}
    hung = display.display_edges(n, links.limit(0).unionByName(spark.createDataFrame([("4", "hasEducationalAlignment", "a", "b", 1, None)], links.schema)), spark.createDataFrame([("a", "c", 8)], "activity string, component string, ord int"))
    assert [(r.src, r.dst, r.type, r.ord) for r in hung.collect()] == [("c", "a", "illustrates", 8.0)]
    from weftgraph.operators import stats
    assert [(r.id, r["rank"]) for r in stats.shown_roots(n, links.limit(0)).collect()] == [("b", 0), ("a", 99), ("c", 99)]


def test_summaries(spark):
    from weftgraph.operators import audit

    rows = [("1", "discard", None, None, 3), ("2", "preview", None, None, 0), ("3", "preview", None, "r" * 200, 0), ("4", "membership", None, "added", 0), ("5", "workspace", None, None, 0), ("6", "apply", "m", None, 0)]
    log = spark.createDataFrame(rows, "id string, eventType string, mutation string, reason string, discarded int")
    got = {r.id: r.summary for r in audit.summary(log).collect()}
    assert got == {"1": "discarded 3 apply(ies)", "2": "preview", "3": "r" * 139 + "…", "4": "added", "5": "workspace", "6": "m"}


def test_exports(spark):
    n, e = graph(spark, [("c", "Course", {"description": "C", "z": "y" * 500}), ("l", "Lesson", {}), ("q", "Lesson", {})], [("hasPart", "c", "l"), ("hasDependency", "q", "l")])
    whole = export.subtree(n, e, "c", detail=True)
    assert [x["id"] for x in whole["nodes"]] == ["c", "l"] and len(whole["nodes"][0]["props"]["z"]) == 500 and len(whole["edges"]) == 1
    lean = export.subtree(n, e, "c", detail=True, most_bytes=700)
    assert [x["props"] for x in lean["nodes"]] == [{}, {}]
    assert export.subtree(n, e, "c", most_bytes=50)["too_large"]
    with pytest.raises(ValueError):
        export.subtree(n, e, "zz")
    _, _, meta = export.whole(n, e)
    assert meta["views"].first().asDict() == {"standards": False, "components": False, "curriculum": True, "documents": False, "progression": True}
    big = export.response({"a": [0] * 100_000, "b": "x", "c": None})
    assert not big["ok"] and big["shape"] == {"a": "array(100000)", "b": "string(1 chars)", "c": "null"} and export.response({"a": 1})["ok"]


def test_terms_and_records(spark):
    lex = spark.createDataFrame([("1", {"fr": "un"}, None)], "id string, renderings map<string,string>, subject string")
    row = lambda i, r: spark.createDataFrame([(i, r, None)], lex.schema)
    assert lookup.added_terms(lex, row("2", {"FR": " deux "})).where("id = '2'").first().renderings == {"fr": "deux"}
    assert lookup.edited_terms(lex, row("1", {"wo": "benn"})).first().renderings == {"fr": "un", "wo": "benn"}
    assert lookup.removed_terms(lex, lex.select("id")).count() == 0
    for bad in (lambda: lookup.added_terms(lex, row("3", {"fr": " "})), lambda: lookup.added_terms(lex, row("1", {"fr": "x"})), lambda: lookup.edited_terms(lex, row("9", {})), lambda: lookup.removed_terms(lex, row("9", {}))):
        with pytest.raises(ValueError):
            bad()
    history = spark.createDataFrame([("c", "a.docx"), ("t", "b.docx")], "nodeId string, relPath string")
    edges = mutate.edge_rows(spark, [("covers", "t", "c")])
    assert lookup.document_record(history, edges, "t").first().relPath == "a.docx"
    assert lookup.document_record(history, edges.limit(0), "t").first().relPath == "b.docx"


def test_orders(spark):
    names = spark.createDataFrame([("10",), ("9",), ("b",), ("first",), ("a",)], "n string")
    assert [r.n for r in names.orderBy(*display.bucket_order(F.col("n"), ("first",))).collect()] == ["first", "9", "10", "a", "b"]
    cards = spark.createDataFrame([("x", None, "a10"), ("y", 0.0, "a9"), ("z", -1.0, "q")], "id string, ord double, code string")
    assert [r.id for r in display.card_order(cards).collect()] == ["z", "y", "x"]


def test_staged_changes_leave_no_draft(spark, tmp_path):
    g = mutate.Graph(*graph(spark, [("c", "Course", {}), ("l", "Lesson", {})], [("hasPart", "c", "l")]))
    s = Store(spark, f"file://{tmp_path}")
    s.write("w/g/s", g)
    s.stage_and_publish("w/g/s", lambda x: mutate.edit_node(x, "c", {"a": 1}))
    assert s.published("w/g/s").nodes.where("id = 'c'").first().props == '{"a":1}'
    with pytest.raises(mutate.Rejected):
        s.stage_and_publish("w/g/s", lambda x: mutate.delete_nodes(x, ["q"]))
    assert s.pointer("w/g/s")["draft"] is None
