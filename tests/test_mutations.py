import json

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import mutate as M
from weftgraph.operators import overlay
from weftgraph.operators.store import Store


@pytest.fixture(scope="module")
def g(spark):
    nodes = [("c", "Course"), ("g1", "LessonGrouping"), ("g2", "LessonGrouping"), ("l1", "Lesson"), ("l2", "Lesson"), ("l3", "Lesson"), ("m", "Material"), ("s", "StandardsFrameworkItem"), ("t", "TeachingLearningMaterial")]
    rows = [(i, t, [t], {"description": f"node {i}", "position": k}) for k, (i, t) in enumerate(nodes)]
    links = [("hasPart", "c", "g1"), ("hasPart", "c", "g2"), ("hasPart", "g1", "l1"), ("hasPart", "g1", "l2"), ("hasPart", "g2", "l2"), ("hasPart", "g2", "l3"), ("hasPart", "l3", "m"), ("hasDependency", "l2", "l1"), ("hasEducationalAlignment", "l1", "s")]
    return M.Graph(M.node_rows(spark, rows).cache(), M.edge_rows(spark, links).cache())


def ids(df):
    return {r.id for r in df.select("id").collect()}


def test_cascade_keeps_shared_children_and_dependents(g):
    after = M.delete_nodes(g, ["g1"])
    assert ids(g.nodes) - ids(after.nodes) == {"g1", "l1"}
    assert "hasPart:g2->l2" in ids(after.edges) and "hasDependency:l2->l1" not in ids(after.edges)
    assert ids(g.nodes) - ids(M.delete_nodes(g, ["g1", "g2"]).nodes) == {"g1", "g2", "l1", "l2", "l3", "m"}


def test_warnings_of_a_deletion(g):
    assert M.cascade_warnings(g, ["g1"]) == ["removes 2 node(s) and 5 edge(s): g1, l1"]
    assert M.cascade_warnings(g, ["t"]) == []
    assert M.cascade_warnings(g, ["c"], shown=2)[0].endswith(": c, g1, …")
    w = M.Workflow(lambda: 0.0)
    p = w.preview("delete", g, g, {"ids": ["g1"]}, lambda b, a: M.delete_nodes(b, a["ids"]), full=True, warn=lambda b, a: M.cascade_warnings(b, a["ids"]))
    assert p["warnings"] and ids(p["difference"].where("side = 'node'")) == {"g1", "l1"}


def test_batches_are_all_or_nothing(g):
    for bad in ([], [("hasPart", "c", "nope")], [("hasPart", "c", "c")], [("hasPart", "c", "g1")], [("odd", "c", "l1")], [("covers", "t", "c")] * 2):
        with pytest.raises(M.Rejected):
            M.create_edges(g, bad)
    assert "covers:t->c" in ids(M.create_edges(g, [("covers", "t", "c"), ("usesRoutine", "l1", "m")]).edges)
    with pytest.raises(M.Rejected):
        M.delete_edges(g, ["hasPart:c->g1", "nope"])
    with pytest.raises(M.Rejected):
        M.add_nodes(g, [{"id": "x", "label": "Lesson", "parent": "g1"}, {"id": "l1", "label": "Lesson"}])


def test_added_nodes_take_the_next_positions(g):
    after = M.add_nodes(g, [{"id": "x", "label": "Lesson", "parent": "g1"}, {"id": "y", "label": "Lesson", "parent": "g1", "align_to": "s"}, {"id": "z", "label": "Lesson", "props": {"a": 1}}])
    at = {r.id: json.loads(r.props).get("position") for r in after.nodes.where(F.col("id").isin("x", "y", "z")).collect()}
    assert at == {"x": 5, "y": 6, "z": None}
    assert ids(after.edges) - ids(g.edges) == {"hasPart:g1->x", "hasPart:g1->y", "hasEducationalAlignment:y->s"}


def test_edits_and_moves(g, spark):
    after = M.edit_node(g, "l1", {"metadata.level.a": [1, 2.0]}, title="new")
    assert after.nodes.where("id = 'l1'").first().props == '{"description":"new","metadata":{"level":{"a":[1,2]}},"position":3}'
    for path in ("normalizedType", "metadata", "metadata.role.x", "position", "description", "content", ""):
        with pytest.raises(M.Rejected):
            M.edit_node(g, "l1", {path: "x"})
    for bad in ({"content": ""}, {"title": ""}, {"position": float("nan")}, {"position": "1"}, {}):
        with pytest.raises(M.Rejected):
            M.edit_node(g, "l1", **bad)
    both = M.edit_node(M.edit_node(g, "l1", {"metadataFoo": 1, "metadata.x": 1}), "l1", position=4, title_en="E", summary="S")
    assert json.loads(both.nodes.where("id = 'l1'").first().props) == {"description": "node l1", "position": 4, "metadataFoo": 1, "metadata": {"x": 1, "en": {"description": "E"}, "summary": "S"}}
    ordered = M.Graph(M.node_rows(spark, [("a", "Lesson", ["Lesson"], {"metadata": {"order": 1}, "text": "t"})]), g.edges)
    assert json.loads(M.edit_node(ordered, "a", position=2, title="T").nodes.first().props) == {"metadata": {"order": 2}, "text": "T", "description": "T"}
    many = spark.createDataFrame([("l1", {"a.b": "1"}), ("l2", {"position": "x"})], "id string, changes map<string,string>")
    assert json.loads(M.edit_many(g, many).nodes.where("id = 'l1'").first().props)["a"] == {"b": "1"}
    moved = M.move_node(g, "l2", "c", position=9)
    assert ids(moved.edges) - ids(g.edges) == {"hasPart:c->l2"} and ids(g.edges) - ids(moved.edges) == {"hasPart:g1->l2", "hasPart:g2->l2"}
    with pytest.raises(M.Rejected):
        M.move_node(g, "c", "l1")


def test_structural_rules(g):
    renamed = M.Graph(g.nodes.withColumn("id", F.when(F.col("id") == "m", "m2").otherwise(F.col("id"))), g.edges)
    assert len(M.structural_errors(g, renamed)) == 2
    assert M.structural_errors(g, g) == []


def test_preview_and_confirm(g):
    now = [1000.0]
    w = M.Workflow(lambda: now[0])
    act = lambda base, args: M.delete_nodes(base, args["ids"])
    p = w.preview("delete", g, g, {"ids": ["g1"]}, act)
    assert p["status"] == "preview" and p["counts"]["nodes_removed"] == 2 and p["counts"]["edges_removed"] == 5
    assert w.preview("delete", g, g, {"ids": ["q"]}, act)["status"] == "blocked"
    go = lambda **k: w.confirm(**({"name": "delete", "base": g, "args": {"ids": ["g1"]}, "token": p["token"], "apply": act} | k))[0]
    assert go(token="x") == "malformed token" and go(name="other") == "token of another mutation" and go(args={"ids": ["g2"]}) == "arguments differ"
    now[0] += 10_000
    assert go(base=M.edit_node(g, "c", {"a": 1})) == "stale" and go() == "expired"
    now[0] -= 10_000
    assert go(key="k") == "applied" and go(key="k") == "applied" and go() == "token used before"
    assert w.confirm("delete", g, {"ids": ["g1"]}, p["token"], act, "k")[0] == "applied"


def test_hash_ignores_order_and_sees_content(g):
    h = lambda x: overlay.graph_hash(*x).first().hash
    assert h(g) == h(M.Graph(g.nodes.orderBy(F.col("id").desc()).repartition(3), g.edges.repartition(2)))
    assert h(g) != h(M.edit_node(g, "c", title="other"))


def test_store_lifecycle(g, spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    assert s.pointer("w/g/s") is None and s.namespaces() == []
    with pytest.raises(ValueError):
        s.create_draft("w/g/s")
    s.write("w/g/s", g, {"guide": 1})
    s.write("w/_catalog/s", g)
    assert s.namespaces() == ["w/_catalog/s", "w/g/s"] and s.namespaces(reserved=False) == ["w/g/s"]
    before = overlay.graph_hash(*s.published("w/g/s")).first().hash
    s.apply("w/g/s", M.delete_nodes(g, ["g1"]))
    s.apply("w/g/s", M.edit_node(s.active("w/g/s")[0], "c", title="draft"))
    s.write_config("w/g/s", {"guide": 2})
    assert overlay.graph_hash(*s.published("w/g/s")).first().hash == before and s.active("w/g/s")[1] == "draft"
    ops = sorted((r.side, r.op, r.id) for r in s.difference("w/g/s").collect())
    assert ("node", "changed", "c") in ops and ("node", "removed", "l1") in ops and len(ops) == 8
    with pytest.raises(ValueError):
        s.write("w/g/s", g)
    s.publish("w/g/s")
    assert s.active("w/g/s")[1] == "published" and s.pointer("w/g/s")["config"] == {"guide": 2}
    assert "l1" not in ids(s.published("w/g/s").nodes)
    s.create_draft("w/g/s")
    s.discard("w/g/s")
    s.discard("w/g/s")
    s.append_audit(spark.createDataFrame([("1", "t")], "id string, ts string"))
    s.delete("w/g/s")
    assert s.namespaces() == ["w/_catalog/s"] and s.audit().count() == 1
