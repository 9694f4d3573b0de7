"""Orders of trees, expiring values, versions: against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftgraph import scratch
from weftgraph.operators import lifecycle, mutate, ordering, overlay, postings, rewrite
from weftgraph.operators.mutate import Graph
from weftgraph.operators.pending import Pending
from weftgraph.operators.postings import Postings
from weftgraph.operators.store import Store
from weftgraph.sources import files
from weftgraph.sources.numbered import Conflict, Numbered
from weftgraph.streaming import confirmations

TREE = "id string, parent string, place bigint"
NODES, EDGES = "id string, type string, labels array<string>, props string", "id string, type string, src string, dst string, props string"


def walked(rows):
    """(id, parent, preorder, size, depth) by recursion."""
    below, out = {}, []
    for i, parent, place in rows:
        below.setdefault(parent, []).append((place is not None, place or 0, i))

    def enter(i, parent, depth):
        at = len(out)
        out.append(None)
        for _, _, c in sorted(below.get(i, [])):
            enter(c, i, depth + 1)
        out[at] = (i, parent, at, len(out) - at, depth)

    for _, _, top in sorted(below.get(None, [])):
        enter(top, None, 0)
    return sorted(out)


def test_preorder_of_random_forests(spark):
    draw = random.Random(3)
    rows = [(f"n{i}", f"n{draw.randrange(i)}" if i > 3 else None, draw.choice((None, 0, 1, 2))) for i in range(150)]
    got = ordering.preorder(spark.createDataFrame(rows, TREE)).select("id", "parent", "preorder", "size", "depth")
    assert sorted(map(tuple, got.collect())) == walked(rows)
    assert ordering.preorder(spark.createDataFrame([], TREE)).count() == 0


def test_cycles_are_named(spark):
    with pytest.raises(ValueError, match="cycle"):
        ordering.preorder(spark.createDataFrame([("a", "b", 0), ("b", "a", 0), ("r", None, 0)], TREE))


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    n, written, write = 5000, [], scratch.written
    monkeypatch.setattr(ordering.scratch, "written", lambda df, name, *more: written.append(name) or write(df, name, *more))
    parents = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"))
    found = ordering.chains(spark.createDataFrame([(str(n - 1),)], "id string"), parents)
    assert found.agg(F.count("*"), F.max("depth"), F.countDistinct("id")).first() == (n, n - 1, n)
    assert written.count("chains") <= 15
    places = ordering.preorder(parents.withColumn("place", F.lit(0)))
    assert places.where("preorder = depth AND size = 5000 - preorder").count() == n
    assert written.count("walk") <= 16


def dag(draw, n):
    return [(f"n{i}", f"n{j}", place) for j in range(1, n) for place, i in enumerate(sorted(draw.sample(range(j), min(j, draw.choice((1, 1, 2, 3))))))]


def test_first_seen_and_last_looked_at(spark):
    draw = random.Random(8)
    edges = [(a, b, k) for k, (a, b, _) in enumerate(sorted(dag(draw, 60), key=lambda e: draw.random()))]
    first, last, seen = {}, {}, set()

    def walk(i):
        seen.add(i)
        for _, c in sorted((k, b) for a, b, k in edges if a == i):
            last[c] = i
            if c not in seen:
                first[c] = i
                walk(c)

    walk("n0")
    roots, held = spark.createDataFrame([("n0", 0)], "id string, place bigint"), spark.createDataFrame(edges, "parent string, id string, place bigint")
    tree = ordering.first_seen(roots, held)
    assert {r.id: r.parent for r in tree.collect() if r.parent} == first
    assert {r.id: r.parent_id for r in ordering.last_parents(roots, held).collect()} == last


def test_members_by_ranges(spark):
    draw = random.Random(5)
    rows = [(f"n{i:03}", f"n{draw.randrange(i):03}" if i > 5 else None, 0) for i in range(200)]
    places = ordering.preorder(spark.createDataFrame(rows, TREE))
    up = {i: p for i, p, _ in rows}
    roots = [i for i, p, _ in rows if p in ("n000", "n001", "n002")]
    want = set()
    for i in up:
        at, depth = i, 0
        while at is not None:
            if at in roots:
                want.add((at, i, depth))
            at, depth = up[at], depth + 1
    got = ordering.inside(places, spark.createDataFrame([(r,) for r in roots], "id string"))
    assert {tuple(r) for r in got.collect()} == want


def test_places_within_groups_and_previous_rows(spark):
    draw = random.Random(2)
    rows = [(draw.choice(("hub", "hub", "hub", "a", None)), i, f"v{i}") for i in range(300)]
    table = spark.createDataFrame(rows, "g string, n int, v string").repartition(5)
    placed = {(r.g, r.n): r.place for r in ordering.placed(table, "g", "n").collect()}
    before = {(r.g, r.n): r.was for r in ordering.with_previous(table, "g", "n", value="v", name="was").collect()}
    for g in ("hub", "a", None):
        mine = sorted(n for x, n, _ in rows if x == g)
        assert [placed[g, n] for n in mine] == list(range(len(mine)))
        assert [before[g, n] for n in mine] == [None, *(f"v{n}" for n in mine[:-1])]


# --- versions ---------------------------------------------------------------------------------------
@pytest.fixture
def g(spark):
    nodes = [(f"n{i}", "Lesson", ["Lesson"], '{"position":%d}' % i) for i in range(200)]
    edges = [(f"hasPart:n0->n{i}", "hasPart", "n0", f"n{i}", '{"orderInParent":%d}' % i) for i in range(1, 200)]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def test_labels_and_edge_properties_are_content(spark, g, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    assert s.seed("w/g/s", g) and not s.seed("w/g/s", Graph(g.nodes.limit(1), g.edges.limit(1)))
    more = Graph(g.nodes.withColumn("labels", F.when(F.col("id") == "n7", F.array(F.lit("Lesson"), F.lit("LexiconEntry"))).otherwise(F.col("labels"))), g.edges.withColumn("props", F.when(F.col("dst") == "n9", '{"orderInParent":0}').otherwise(F.col("props"))))
    assert overlay.graph_hash(*g).first() != overlay.graph_hash(*more).first()
    assert {tuple(r) for r in overlay.whole_difference(g, more).collect()} == {("node", "n7", "changed"), ("edge", "hasPart:n0->n9", "changed")}
    s.apply("w/g/s", more)
    assert len(s.publish("w/g/s")) == 2  # one bucket of each side
    now = s.published("w/g/s")
    assert now.nodes.where("id = 'n7'").first().labels == ["Lesson", "LexiconEntry"] and now.edges.where("dst = 'n9'").first().props == '{"orderInParent":0}'
    assert now.nodes.count() == 200 and now.edges.count() == 199


def test_of_two_writers_one_is_refused(spark, g, tmp_path):
    one, two = Store(spark, f"file://{tmp_path}"), Store(spark, f"file://{tmp_path}")
    one.seed("w/g/s", g)
    cut = lambda *ids: lambda base: mutate.delete_nodes(base, list(ids))

    def meanwhile(base):
        two.stage_and_publish("w/g/s", cut("n3"))
        return cut("n4")(base)

    with pytest.raises(Conflict):
        one.stage_and_publish("w/g/s", meanwhile)
    there = {r.id for r in one.published("w/g/s").nodes.collect()}
    assert "n3" not in there and "n4" in there and one.active("w/g/s")[1] == "published"
    seen = one.seen("w/g/s")
    two.apply("w/g/s", cut("n5")(two.published("w/g/s")))
    with pytest.raises(Conflict):
        one.apply("w/g/s", cut("n6")(one.published("w/g/s")), seen)


def test_a_number_is_written_once(spark, tmp_path):
    files = Numbered(spark, f"file://{tmp_path}")
    folder = f"file://{tmp_path}/x"
    assert files.latest(folder) == (0, None)
    won = []

    def write(i):
        try:
            files.add(folder, 0, {"i": i})
            won.append(i)
        except Conflict:
            pass

    for i in range(4):
        write(i)
    assert won == [0] and files.latest(folder) == (1, {"i": 0})
    for n in range(1, 30):
        files.add(folder, n, {"n": n})
    assert files.latest(folder)[0] == 30 and len(files.numbers(folder)) <= 16


def test_one_twin_for_each_removed_row(spark):
    rows = [(f"a{i}", "Lesson", ["Lesson"], "{}") for i in range(200)]
    before, after = spark.createDataFrame(rows, NODES), spark.createDataFrame([(f"b{i}", *r[1:]) for i, r in enumerate(rows)], NODES)
    assert overlay.renamed(before, after).agg(F.count("*"), F.max("added_id")).first() == (200, "b0")


# --- what expires -------------------------------------------------------------------------------------
def test_values_expire_and_are_claimed_once(spark, tmp_path):
    now = [0.0]
    make = lambda: Pending(spark, f"file://{tmp_path}", lambda: now[0])
    assert make().claim("nonces", "k", {"a": 1}, 900) and not make().claim("nonces", "k", {"a": 2}, 900)
    assert make().get("nonces", "k") == {"a": 1} and make().sweep() == []
    now[0] = 901
    assert make().get("nonces", "k") is None and make().sweep() == [{"a": 1}]
    assert make().claim("nonces", "k", {"a": 3}, 10)
    make().drop("nonces", "k")
    assert make().get("nonces", "k") is None


def test_confirmations_hold_after_a_restart(spark, g, tmp_path):
    now = [1000.0]
    start = lambda: mutate.Workflow(lambda: now[0], f"file://{tmp_path}")
    act = lambda base, args: mutate.delete_nodes(base, args["ids"])
    p = start().preview("cut", g, g, {"ids": ["n5"]}, act)
    said, after = start().confirm("cut", g, None, p["token"], act, key="once")  # the arguments were parked
    assert said == "applied" and after.nodes.count() == 199
    again = start().confirm("cut", g, {"ids": ["n5"]}, p["token"], act, key="once")
    assert again[0] == "applied" and again[1].nodes.count() == 199
    assert start().confirm("cut", g, {"ids": ["n6"]}, p["token"], act, key="once")[0] == "arguments differ"
    assert start().confirm("cut", g, {"ids": ["n5"]}, p["token"], act)[0] == "token used before"
    late = start().preview("cut", g, g, {"ids": ["n6"]}, act)
    now[0] += 901
    assert start().confirm("cut", g, None, late["token"], act)[0] == "expired"
    now[0] += 24 * 3600
    w = start()
    assert w.sweep(spark) >= 2 and w.confirm("cut", g, {"ids": ["n5"]}, p["token"], act, key="once")[0] == "expired"


def test_a_draft_that_moved_blocks_the_slower_one(spark, g, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    s.seed("w/g/s", g)
    d = lifecycle.Drafts(s, spark.createDataFrame([("a", "w", "admin")], "userId string, workspace string, role string"), lambda: "2024-01-01")

    def slow(base):
        d.stage("w/g/s", "a", "cut", lambda x: mutate.delete_nodes(x, ["n8"]))
        return mutate.delete_nodes(base, ["n9"])

    assert d.stage("w/g/s", "a", "cut", slow)["errors"] == ["the draft has moved"]
    there = {r.id for r in s.active("w/g/s")[0].nodes.collect()}
    assert "n8" not in there and "n9" in there


def test_a_stream_of_confirmations_says_what_the_log_says(spark, tmp_path):
    draw = random.Random(4)
    rows = [(f"u{draw.randrange(6)}", i, 60.0 * i + draw.randrange(50), draw.choice(("preview", "confirm", "confirm"))) for i in range(200)]
    log = spark.createDataFrame(rows, "key string, id int, at double, kind string").withColumn("at", F.col("at").cast("timestamp"))
    for part in range(4):
        log.where(f"id DIV 50 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
        query = confirmations.stream(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if kept is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {tuple(r) for r in confirmations.outcomes(log).collect()} and {o for _, _, o in got} == {"applied", "used", "unknown"}


# --- log and postings ---------------------------------------------------------------------------------
def test_a_page_reads_the_newest_days_alone(spark, tmp_path):
    s, schema = Store(spark, f"file://{tmp_path}"), "id string, ts string, actor string, namespace string"
    rows = [(f"{d:02}-{i}", f"2024-01-{d:02}T00:00:0{i}Z", "a" if i % 2 else "b", ns) for d in range(1, 8) for i in range(5) for ns in ("w/g/s", "w/g/t")]
    s.append_audit(spark.createDataFrame(rows, schema))
    want = sorted(((r[1], r[0]) for r in rows if r[3] == "w/g/s"), reverse=True)
    at = lambda found: [(r.ts, r.id) for r in found]
    assert at(s.audit_page("w/g/s", schema, 12)) == want[:12] and at(s.audit_page("w/g/s", schema, 12, want[11])) == want[12:24]
    assert at(s.audit_page("w/g/s", schema, 100, since="2024-01-03T00:00:02Z", until="2024-01-05T00:00:01Z")) == [x for x in want if "2024-01-03T00:00:02Z" <= x[0] <= "2024-01-05T00:00:01Z"]
    assert at(s.audit_page("w/g/s", schema, 100, keep=lambda log: log.where("actor = 'b'"))) == [x for x in want if int(x[1][-1]) % 2 == 0]
    assert s.audit_page("none", schema) == [] and s.audit(schema, "w/g/t").count() == 35
    for d in range(1, 7):  # a first page needs none of these
        scratch.remove(spark, f"file://{tmp_path}/_audit/_ns=w__g__s/_day=2024-01-{d:02}")
    assert at(s.audit_page("w/g/s", schema, 5)) == want[:5]


def test_postings_find_what_a_scan_finds(spark, tmp_path, monkeypatch):
    draw = random.Random(1)
    rows = [(i, "".join(draw.choices("abé A", k=draw.randint(0, 30)))) for i in range(300)] + [(300, None), (301, ""), (302, "ab"), (1, "zzabcz")]
    p = Postings(spark, f"file://{tmp_path}").build(spark.createDataFrame(rows, "id int, text string"))
    fold = lambda t: t.lower().replace("é", "e")
    for query in ("a", "ab", "AbÉ", "a b", "eeee", "abc", "none"):
        assert {r.id for r in p.search(query).collect()} == {i for i, t in rows if t and fold(query) in fold(t)}, query
    monkeypatch.setattr(postings, "MOST_BROADCAST", 0)
    assert {r.id for r in p.search("abe").collect()} == {i for i, t in rows if t and "abe" in fold(t)} and p.search("").count() == 0


def test_parts_of_a_document_are_one_json_text(spark, g, tmp_path):
    files.write_document(g.nodes, g.edges, f"file://{tmp_path}/doc")
    parts = sorted((tmp_path / "doc").glob("part-*"))
    whole = json.loads("".join(p.read_text(encoding="utf-8") for p in parts))
    assert len(parts) > 1 and [n["id"] for n in whole["nodes"]] == sorted(f"n{i}" for i in range(200)) and len(whole["relationships"]) == 199
    assert whole["relationships"][0]["properties"] == {"orderInParent": 1}
    nodes, edges = files.read_document(spark, f"file://{tmp_path}/doc")
    assert [r.id for r in edges.orderBy("seq").collect()] == [e["id"] for e in whole["relationships"]] and nodes.count() == 200
    none = Graph(g.nodes.limit(0), g.edges.limit(0))
    files.write_document(*none, f"file://{tmp_path}/none")
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*")))) == {"nodes": [], "relationships": []}


def test_activation_says_what_is_wrong(spark, g, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    assert s.activated("w/g/s") == {"ok": False, "reason": "no graph in namespace 'w/g/s'", "available": []}
    s.seed("w/g/s", g)
    found = s.activated("w/g/s")
    assert found["ok"] and found["units"].count() == 200 and found["profile"] is None
    s.write_config("w/g/s", {"core": {"id": ""}})
    assert "id: a text is needed" in s.activated("w/g/s")["reason"] and s.activated("w/g/s")["available"] == ["w/g/s"]
    scratch.remove(spark, next(iter(s.pointer("w/g/s")["published"]["nodes"].values()))["path"])
    assert "lacks 1 bucket" in s.activated("w/g/s")["reason"]


def test_groupings_without_a_single_leaf_are_refused(spark, g):
    keyed = lambda *rows: spark.createDataFrame(list(rows), "id string, key string")
    for leaves in (keyed(("n1", "other")), keyed(("n1", "k"), ("n2", "k"))):
        with pytest.raises(ValueError, match="n0"):
            rewrite.derived_components(*g, keyed(("n0", "k")), leaves, "Lesson")
    nodes, edges = rewrite.derived_components(g.nodes, g.edges, keyed(("n0", "k")), keyed(("n1", "k")), "Lesson", keyed(("n7", "")))
    assert nodes.count() == 198 and {(r.type, r.src) for r in edges.collect()} == {("hasChild", "n1")} and edges.count() == 198
