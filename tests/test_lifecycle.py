import itertools

import pytest

from weftgraph.operators import catalog, display, export, lifecycle, parse, profile, scope
from weftgraph.operators import mutate as M
from weftgraph.operators.store import Store

NS = "w/g/s"


@pytest.fixture
def drafts(spark, tmp_path):
    store, ticks = Store(spark, f"file://{tmp_path}"), itertools.count()
    nodes = M.node_rows(spark, [(i, "Lesson", ["Lesson"], {"n": i}) for i in "abc"])
    store.write(NS, M.Graph(nodes, M.edge_rows(spark, [("hasPart", "a", "b")])), {"guide": 1})
    roles = spark.createDataFrame([("cora", "w", "curator"), ("ann", "w", "approver")], "userId string, workspace string, role string")
    return lifecycle.Drafts(store, roles, lambda: f"{next(ticks):06}")


def test_nothing_is_shown_or_done_without_the_right(drafts):
    assert drafts.stage(NS, None, "x", lambda g: g) == {"status": "unauthorized", "reason": "no identity"}
    assert drafts.preview("publish", NS, "cora") == {"status": "unauthorized", "reason": "needs approver"}
    assert [r.eventType for r in drafts.log(NS).collect()] == ["blocked"] * 2 and drafts.store.pointer(NS)["draft"] is None


def test_tokens_hold_for_one_content_and_once(drafts):
    assert drafts.preview("discard", NS, "cora") == {"status": "preview", "draft": False}
    assert drafts.confirm("discard", NS, "cora", None)["reason"] == "no token" and drafts.confirm("discard", NS, "cora", "x")["reason"] == "malformed token"
    drafts.stage(NS, "cora", "cut", lambda g: M.delete_nodes(g, ["c"]))
    shown = drafts.preview("discard", NS, "cora")
    assert shown["counts"]["nodes_removed"] == 1 and not shown["config_changed"]
    drafts.store.write_config(NS, {"guide": 2})  # the configuration is part of what is confirmed
    assert drafts.confirm("discard", NS, "cora", shown["token"])["reason"] == "the draft has moved"
    token = drafts.preview("discard", NS, "cora")["token"]
    assert drafts.confirm("discard", NS, "cora", token)["status"] == "done"
    later = lifecycle.Drafts(drafts.store, drafts.roles, drafts.clock)  # a restart forgets no token
    assert later.confirm("discard", NS, "cora", token)["reason"] == "token used before"
    assert drafts.store.pointer(NS)["draft"] is None and drafts.store.published(NS).nodes.count() == 3


def test_a_published_record_names_its_applies(drafts):
    first = drafts.stage(NS, "cora", "cut", lambda g: M.delete_nodes(g, ["c"]))
    drafts.confirm("publish", NS, "ann", drafts.preview("publish", NS, "ann")["token"])
    r = drafts.log(NS).where("eventType = 'publish'").first()
    assert r.ids == [first["id"]] and r.selfAuthored is False and r.baseVersion != r.resultingVersion
    assert drafts.store.published(NS).nodes.count() == 2


def test_documents_are_inlined_up_to_a_bound(spark):
    nodes, edges = spark.createDataFrame([("a", "x" * 50), ("b", None)], "id string, t string"), spark.createDataFrame([("a", "b")], "src string, dst string")
    assert export.document({"k": 1}, nodes, edges)["curriculum"]["edges"] == [{"src": "a", "dst": "b"}]
    small = export.document({"k": 1}, nodes, edges, 90)
    assert small["k"] == 1 and small["curriculum"]["too_large"] and small["curriculum"]["nodes"] == 2
    assert export.document({"k": "y" * 200}, nodes, edges, 200)["curriculum"]["too_large"]


def test_reads_are_logged_after_the_page(drafts):
    drafts.stage(NS, "cora", "cut", lambda g: M.delete_nodes(g, ["c"]))
    assert drafts.read_log(NS, "cora")["status"] == "unauthorized"
    page = drafts.read_log(NS, "ann", outcome="applied", limit=1)["records"]
    assert [r["eventType"] for r in page] == ["apply"]
    r = drafts.log(NS).where("eventType = 'read'").first()
    assert (r.readCount, r.readQuery) == (1, '{"outcome":"applied"}')
    with pytest.raises(ValueError):
        drafts.read_log(NS, "ann", outcome="odd")
    assert drafts.preview_course(NS, "cora", "a")["status"] == "not found"


def test_entries_are_filed_below_the_container(spark):
    kind = catalog.ROUTINE
    lib = M.Graph(M.node_rows(spark, [("r", kind, [kind], {}), ("s", kind, [kind], {})]), M.edge_rows(spark, [("hasPart", "r", "s")]))
    copy = M.Graph(M.node_rows(spark, [("n", kind, [kind], {})]), M.edge_rows(spark, [("hasPart", "n", "n2")]).limit(0))
    assert {r.id for r in catalog.filed(lib, copy, "n").edges.collect()} == {"hasPart:r->s", "hasPart:r->n"}
    for bad, root in ((copy, "x"), (lib, "r")):
        with pytest.raises(M.Rejected):
            catalog.filed(lib, bad, root)
    with pytest.raises(M.Rejected):
        catalog.filed(M.Graph(lib.nodes.limit(0), lib.edges.limit(0)), copy, "n")


def test_first_covering_document_and_chips(spark):
    nodes = M.node_rows(spark, [("c", "Course", ["Course"], {"sourceKey": "x"}), ("d1", "TeachingLearningMaterial", ["TeachingLearningMaterial"], {}), ("d2", "TeachingLearningMaterial", ["TeachingLearningMaterial"], {"sourceKey": "y"}), ("l", "Lesson", ["Lesson"], {})])
    edges = M.edge_rows(spark, [("covers", "d2", "c"), ("covers", "d1", "c"), ("covers", "l", "c"), ("covers", "d1", "l"), ("hasPart", "c", "l")])
    assert sorted(map(tuple, scope.documents_of(nodes, edges).collect())) == [("c", "d1"), ("d1", "d1"), ("d2", "d2")]
    found = display.chips(display.display_nodes(nodes), display.display_edges(nodes, edges), ("Course", "TeachingLearningMaterial"), ["x"])
    assert [(r.chip, r.n) for r in found.orderBy("place").collect()] == [("nodes", 3), ("Course", 1), ("TeachingLearningMaterial", 1), ("edges", 4)]


def test_profiles_name_rules_and_take_validators(spark):
    assert parse.prune_of(None) is None
    for bad in ({"strategy": "odd"}, {"strategy": "content-reachable-from-roots", "rootKinds": []}):
        with pytest.raises(ValueError):
            parse.prune_of(bad)
    nodes = M.node_rows(spark, [("c", "Course", ["Course"], {}), ("l", "Lesson", ["Lesson"], {}), ("o", "Lesson", ["Lesson"], {})])
    edges = M.edge_rows(spark, [("hasPart", "c", "l")]).selectExpr("*", "1L AS seq")
    kept = parse.parsed(nodes, edges, after=parse.prune_of({"strategy": "content-reachable-from-roots", "rootKinds": ["Course"]}))
    assert {r.id for r in kept.select("id").collect()} == {"c", "l"}
    good = {"core": {"id": "p", "capabilities": {"exampleDomainRotation": True}, "parse": {}}}
    assert profile.preview({}, good, lambda p: (["no such course"], []))["status"] == "blocked"
    shown = profile.preview({}, good, lambda p: ([], ["rare kind"]))
    assert shown["warnings"] == ["rare kind"] and profile.confirm({}, good, shown["token"], lambda p: (["late"], [])) == ("blocked", None)
    assert profile.confirm({}, good, shown["token"])[0] == "applied"
