"""Rubrics, libraries and histories on rows made by hand."""

import pytest

from weftgraph.operators import catalog, evaluate, libraries, lifecycle, lookup, traverse
from weftgraph.operators import mutate as M
from weftgraph.operators.store import Store
from weftgraph.sources import files
from weftgraph.sources.numbered import Conflict

R, DOC = catalog.ROUTINE, "TeachingLearningMaterial"


@pytest.fixture(scope="module")
def graded(spark):
    node = lambda i, label, **p: (i, label, [label], p)
    nodes = M.node_rows(spark, [
        node("d", DOC, description="Plan"), node("e", DOC), node("c", "Course"),
        node("r", "Rubric", description="Grid", metadata={"scale": "oui/non", "summary": "s"}), node("q", "Rubric", description="Bare"),
        node("s1", "RubricSection", description="Second", position=2), node("s2", "RubricSection", description="First", metadata={"order": 1, "weight": "40"}),
        node("k1", "RubricCriterion", description="A", content="see", position=1), node("k2", "RubricCriterion", description="B"), node("m", "Material"),
    ])
    edges = M.edge_rows(spark, [("hasPart", *x) for x in (("d", "r"), ("d", "q"), ("r", "s1"), ("r", "s2"), ("s2", "k1"), ("s2", "k2"), ("s2", "m"), ("m", "k1"))] + [("covers", "d", "c")])
    return nodes, edges


def test_one_document_with_its_rubrics(spark, graded):
    history = spark.createDataFrame([("c", "plan.docx"), ("d", "own.docx")], "nodeId string, relPath string")
    got = evaluate.evaluation(*graded, history, "c")
    assert got["document"] == {"id": "d", "name": "Plan", "covers": "c", "relPath": "plan.docx"} and got["criteria_count"] == 2
    assert got["rubrics"][0] == {"id": "q", "name": "Bare", "summary": None, "scale": None, "sections": []}
    assert got["rubrics"][1]["sections"] == [
        {"id": "s2", "name": "First", "weight": "40", "criteria": [{"id": "k2", "name": "B", "indicator": None}, {"id": "k1", "name": "A", "indicator": "see"}]},
        {"id": "s1", "name": "Second", "weight": None, "criteria": []},
    ]
    assert [r["id"] for r in evaluate.evaluation(*graded, history, "d", "r")["rubrics"]] == ["r"]
    for target, rubric in (("e", None), ("d", "x"), ("k1", None)):
        assert "error" in evaluate.evaluation(*graded, history, target, rubric)
    rows = {tuple(r) for r in evaluate.evaluations(*graded, history.where("nodeId = 'd'")).collect()}
    assert rows == {("d", "Plan", "c", "own.docx", 2, 2)}
    assert evaluate.described(graded[0].limit(0), graded[1]).count() == 0


def test_lines_of_all_entries_are_those_of_each(spark):
    node = lambda i, label, **p: (i, label, [label], p)
    nodes = M.node_rows(spark, [
        node("a", R, metadata={"summary": "of a"}), node("a2", R, description="Two", position=2, timeRequired="PT5M"), node("a1", "Material", description="One", content="x\ny", position=1), node("a3", "Material", content="z"),
        node("f", R, description="F", metadata={"catalogKind": "formatter"}), node("f1", "Material", description="no", content="wide"), node("f2", R, description="no"),
        node("g", R, description="G", metadata={"catalogKind": "rubric", "scale": "1-4"}), node("g1", R, description="S", metadata={"weight": "10"}), node("g2", "Material", content="c"), node("g3", "Material"), node("g4", "Lesson"),
        node("h", R),
    ])
    edges = M.edge_rows(spark, [("hasPart", *x) for x in (("a", "a1"), ("a", "a2"), ("a2", "a3"), ("f", "f1"), ("f", "f2"), ("g", "g1"), ("g1", "g2"), ("g1", "g3"), ("g", "g4"), ("g", "g3"))])
    found: dict[str, list] = {}
    for r in catalog.pages(nodes, edges, "own").orderBy("entry", "line").collect():
        found.setdefault(r.entry, []).extend(r.text.split("\n"))
    assert set(found) == {"a", "f", "g", "h"}
    for entry, lines in found.items():
        assert [x.strip() for x in lines] == [x.strip() for x in catalog.rendered(nodes, edges, entry, "own").split("\n") if x], entry


@pytest.fixture
def shelf(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    roles = spark.createDataFrame([("cora", "w", "curator"), ("ann", "w", "approver"), ("zoe", "v", "admin")], "userId string, workspace string, role string")
    ticks = iter(range(10**6))
    drafts = lifecycle.Drafts(store, roles, lambda: f"2024-01-01T00:00:{next(ticks):06}Z")
    return libraries.Libraries(drafts, M.Workflow(lambda: 0.0, str(tmp_path / "flow")), frozenset(["root"]))


def test_a_catalog_is_changed_and_published_in_one_step(spark, shelf):
    lib = M.Graph(M.node_rows(spark, [("a", R, [R], {"description": "A"}), ("b", R, [R], {})]), M.edge_rows(spark, [("hasPart", "a", "b")]).limit(0))
    cut, args = lambda g, a: M.delete_nodes(g, a["ids"]), {"ids": ["b"]}
    ask = lambda library, actor, token=None, args=args: shelf.write(library, "w", actor, "cut", args, cut, token)
    assert ask("workspace", "ann")["reason"] == "the workspace catalog of 'w' is not seeded"
    own, shared = "w/_catalog/routines", "_shared/_catalog/routines"
    shelf.store.write(own, lib)
    shelf.store.write(shared, lib)
    assert ask("shared", "ann")["status"] == ask("v", "ann")["status"] == ask("workspace", "zoe")["status"] == "unauthorized"
    assert ask("workspace", "ann", args={"ids": ["none"]})["status"] == "blocked"
    shown = ask("workspace", "cora")
    assert shown["publishes_on_confirm"] and shown["namespace"] == own
    assert ask("workspace", "cora", shown["token"])["status"] == "unauthorized"
    assert shelf.store.published(own).nodes.count() == 2
    assert ask("workspace", "ann", shown["token"], {"ids": ["a"]})["reason"] == "arguments differ"
    done = ask("workspace", "ann", shown["token"])
    assert done["published"] and [r.id for r in shelf.store.published(own).nodes.collect()] == ["a"]
    assert shelf.store.pointer(own)["draft"] is None
    assert ask("workspace", "ann", shown["token"])["status"] == "failed"
    assert ask("shared", "root", ask("shared", "root")["token"])["status"] == "done"
    assert [(r.scope, r.id) for r in libraries.exported_catalog(shelf.store, "w/g/s").orderBy("scope", "id").collect()] == [("shared", "a"), ("workspace", "a")]
    assert "# A" in libraries.exported_entry(shelf.store, "w/g/s", "a") and libraries.exported_entry(shelf.store, "w/g/s", "b") is None
    assert libraries.exported_catalog(shelf.store, own) is None and libraries.exported_catalog(Store(spark, shelf.store.root + "/none"), "w/g/s").count() == 0


def test_a_publish_that_fails_leaves_nothing(spark, shelf, monkeypatch):
    lib = M.Graph(M.node_rows(spark, [("a", R, [R], {}), ("b", R, [R], {})]), M.edge_rows(spark, [("hasPart", "a", "b")]).limit(0))
    own = "w/_catalog/routines"
    shelf.store.write(own, lib)
    ask = lambda token=None: shelf.write("workspace", "w", "ann", "cut", {"ids": ["b"]}, lambda g, a: M.delete_nodes(g, a["ids"]), token)
    token = ask()["token"]

    def broken(namespace):
        raise ValueError("no room")

    monkeypatch.setattr(shelf.store, "publish", broken)
    assert ask(token) == {"status": "failed", "reason": "no room", "published": False, "scope": "workspace", "namespace": own}
    assert shelf.store.pointer(own)["draft"] is None and shelf.store.published(own).nodes.count() == 2
    shelf.store.create_draft(own)
    assert ask()["reason"] == "a draft is open"


def test_a_glossary_is_for_approvers_and_seeds_itself(spark, shelf):
    add = lambda g, a: M.Graph(g.nodes.unionByName(M.node_rows(spark, [(a["id"], "LexiconEntry", ["LexiconEntry"], {"renderings": {"fr": "eau"}})])), g.edges)
    ask = lambda actor, token=None: shelf.edit_terms("w", actor, "add", {"id": "t"}, add, token)
    assert ask("cora")["status"] == "unauthorized" and shelf.store.pointer("w/_glossary/terms") is None
    assert ask("ann", ask("ann")["token"])["published"]
    workspace, terms = libraries.exported_terms(shelf.store, "w/g/s")
    assert workspace == "w" and [(r.id, r.renderings) for r in terms.collect()] == [("t", {"fr": "eau"})]
    assert libraries.exported_terms(shelf.store, "v/g/s")[1].count() == 0 and libraries.exported_terms(shelf.store, "w/_glossary/terms") is None
    assert {r.eventType for r in shelf.drafts.log("w/_glossary/terms").collect()} == {"blocked", "publish"}


def test_new_nodes_have_normalised_and_raw_properties():
    got = M.created_props({"grouping": True, "boilerplate": {"license": "x", "metadata": {"a": 1}}, "order_paths": ["raw.metadata.order"], "role": "week"}, "T", 3, "i", "En", extra={"license": "y", "metadata.b": None})
    assert got == {"title": "T", "position": 3, "raw": {"license": "y", "identifier": "i", "description": "T", "metadata": {"a": 1, "en": {"description": "En"}, "order": 3, "role": "week"}}}
    assert M.created_props({}, None, 1, assessment=True) == {"position": 1, "isAssessment": True, "raw": {}}


def test_history_in_parts(spark, tmp_path):
    import json

    rows = spark.createDataFrame([("b", 'x"y,\n', None), ("a", "p", "m"), (None, None, None)], "nodeId string, relPath string, md5 string")
    for name, df in (("some", rows), ("none", rows.limit(0))):
        path = str(tmp_path / name)
        files.write_history(df, path)
        whole = "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
        assert json.loads(whole)["version"] == 3
        assert sorted(map(tuple, files.read_history_parts(spark, path, "nodeId string, relPath string, md5 string").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_ties_on_a_page_are_in_the_order_of_a_dictionary(spark):
    names = ["B", "a", "C", "é", "z", "10", "9"]
    nodes = M.node_rows(spark, [("top", "Course", ["Course"], {})] + [(x, "Lesson", ["Lesson"], {}) for x in names])
    edges = M.edge_rows(spark, [("hasPart", "top", x) for x in names])
    shown, cursor = [], None
    while True:
        page = traverse.walk(nodes, edges, "top", limit=3, cursor=cursor, include_edges=False)
        shown += [n["id"] for n in page.nodes]
        if not (cursor := page.next_cursor):
            break
    assert shown == ["top", "10", "9", "a", "B", "C", "é", "z"]
    assert [n["id"] for n in traverse.walk(nodes, edges, "top", include_edges=False, collation=None).nodes] == ["top", *sorted(names)]


def test_profiles_are_edited_in_two_steps(spark, shelf):
    d, ns = shelf.drafts, "w/g/s"
    good = lambda guide: {"core": {"id": "p", "capabilities": {"exampleDomainRotation": True}, "parse": {}}, "guide": guide}
    assert d.edit_profile(ns, "cora", good("a"))["status"] == "failed"
    d.store.write(ns, M.Graph(M.node_rows(spark, [("a", "Course", ["Course"], {})]), M.edge_rows(spark, [("x", "y", "z")]).limit(0)), good("old"))
    assert d.edit_profile(ns, "zoe", good("a"))["status"] == "unauthorized"
    assert d.edit_profile(ns, "cora", {"core": {}})["status"] == "blocked"
    first, second = (d.edit_profile(ns, "cora", good(x))["token"] for x in "ab")
    assert d.edit_profile(ns, "cora", good("b"), first)["reason"] == "arguments differ"
    assert d.edit_profile(ns, "cora", good("a"), "odd")["reason"] == "malformed token"
    assert d.edit_profile(ns, "cora", good("a"), first)["status"] == "applied" and d.store.config(ns)["guide"] == "a"
    assert d.edit_profile(ns, "cora", good("b"), second)["reason"] == "stale"
    assert [r.eventType for r in d.log(ns).orderBy("ts").collect()] == ["blocked", "blocked", "config"]
    seen = d.store.seen(ns)
    d.store.create_draft(ns)
    with pytest.raises(Conflict):
        d.store.write_config(ns, good("late"), seen)
    d.edit_profile(ns, "cora", good("c"), d.edit_profile(ns, "cora", good("c"))["token"])
    assert d.store.config(ns)["guide"] == "c" and d.store.pointer(ns)["config"]["guide"] == "a"


def test_clones_take_given_identifiers(spark, graded):
    ids = spark.createDataFrame([("r",), ("s1",)], "id string")
    given = spark.createDataFrame([("r", "mine"), ("x", "other")], "old_id string, new_id string")
    copies, links, renamed = lookup.cloned(*graded, ids, "stamp", given)
    new = {r.old_id: r.new_id for r in renamed.collect()}
    assert new["r"] == "mine" and set(new) == {"r", "s1"} and {r.id for r in copies.collect()} == set(new.values())
    assert [(r.src, r.dst) for r in links.collect()] == [("mine", new["s1"])]
    assert new["s1"] == {r.old_id: r.new_id for r in lookup.cloned(*graded, ids, "stamp")[2].collect()}["s1"]
    with pytest.raises(ValueError):
        lookup.cloned(*graded, ids, "stamp", given.unionByName(given))
