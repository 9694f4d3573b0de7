"""What the store and scratch tables leave on disk, and that sparing it changes no result."""

import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftgraph import scratch
from weftgraph.operators import ordering, overlay
from weftgraph.operators.mutate import Graph
from weftgraph.operators.store import Store
from weftgraph.sources import files

NS = "w/g/s"


def shuffled(spark):
    """Bytes of shuffle files that Spark holds."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(os.path.getsize(os.path.join(at, f)) for top in dirs for at, _, names in os.walk(top) for f in names if f.startswith("shuffle_"))


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.range(60).select(F.format_string("n%02d", "id").alias("id"), F.lit("Lesson").alias("type"), F.array(F.lit("Lesson")).alias("labels"), F.format_string('{"position":%d}', "id").alias("props"))
    edges = spark.range(59).select(F.when(F.col("id") == 5, "own").otherwise(F.format_string("hasPart:n%02d->n%02d", "id", F.col("id") + 1)).alias("id"), F.lit("hasPart").alias("type"), F.format_string("n%02d", "id").alias("src"), F.format_string("n%02d", F.col("id") + 1).alias("dst"))
    return Graph(nodes, edges)


def test_shuffles_of_a_written_table_go_with_its_job(spark):
    before = shuffled(spark)
    scratch.written(spark.range(200_000).repartition(3, "id"), "wide")
    for _ in range(50):
        if shuffled(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffled(spark) <= before


@pytest.mark.parametrize(("ids", "hashes"), [(100, 1000), (1, 1000), (1, 1)])
def test_rows_are_named_the_same_however_they_meet(spark, g, monkeypatch, ids, hashes):
    monkeypatch.setattr(overlay, "MOST_IDS", ids)
    monkeypatch.setattr(overlay, "MOST_HASHES", hashes)
    some = spark.createDataFrame([("n03",), ("n07",), ("none",)], "id string")
    assert sorted(r.id for r in overlay.named(g.nodes, some).collect()) == ["n03", "n07"]
    assert sorted(r.id for r in overlay.without(g.nodes, some).collect()) == sorted({f"n{i:02}" for i in range(60)} - {"n03", "n07"})


def test_staged_changes_are_the_draft(spark, g):
    s = Store(spark, scratch.new_path(spark, "store"))
    s.write(NS, g, buckets=4)
    assert s.version(NS) == overlay.graph_hash(*g).first().hash
    assert "own" in {r.id for r in s.published(NS).edges.collect()}
    row = lambda i, props, dead: (i, "Lesson", ["Lesson"], props, dead)
    nodes = spark.createDataFrame([row("n01", "{}", False), row("n02", '{"position":2}', False), row("n59", None, True), row("gone", None, True), row("x", "{}", False)], "id string, type string, labels array<string>, props string, _tombstone boolean")
    edges = spark.createDataFrame([("own", "hasPart", "n05", "n06", True)], "id string, type string, src string, dst string, _tombstone boolean")
    s.stage(NS, Graph(nodes, edges))
    want = [("edge", "own", "removed"), ("node", "n01", "changed"), ("node", "n59", "removed"), ("node", "x", "added")]
    assert sorted((r.side, r.id, r.op) for r in s.difference(NS).collect()) == want
    assert s.version(NS) == overlay.graph_hash(*s.active(NS)[0]).first().hash != s.version(NS, published=True)
    again = nodes.where("id = 'x'").withColumn("_tombstone", F.lit(True))
    s.stage(NS, Graph(again, edges.limit(0)))
    assert sorted((r.side, r.id, r.op) for r in s.difference(NS).collect()) == want[:3]
    draft = s.version(NS)
    s.publish(NS)
    assert s.version(NS) == draft == overlay.graph_hash(*s.published(NS)).first().hash


def left(spark, name):
    return set(Path(scratch.shared_dir(spark)).glob(f"{name}-*"))


def test_of_tables_of_rounds_the_last_one_stays(spark):
    before = left(spark, "walk")
    tree = spark.createDataFrame([("a", None, 0), ("b", "a", 0), ("c", "b", 0), ("d", "a", 1)], "id string, parent string, place int")
    found = ordering.preorder(tree)
    assert sorted((r.id, r.preorder, r.size) for r in found.collect()) == [("a", 0, 4), ("b", 1, 2), ("c", 2, 1), ("d", 3, 1)]
    assert len(left(spark, "walk") - before) == 1


def test_places_keep_one_table(spark, g):
    before = left(spark, "ordered")
    assert {r.place for r in ordering.placed(g.edges, "type", "src").collect()} == set(range(59))
    assert left(spark, "ordered") == before


def test_a_compressed_document_is_read_as_it_was(spark, g, tmp_path):
    before = left(spark, "document")
    files.write_document(g.nodes, g.edges, f"{tmp_path}/d", "gzip")
    n, e = files.read_document(spark, f"{tmp_path}/d")
    assert sorted(n.select("id", "props").collect()) == sorted(g.nodes.select("id", "props").collect())
    assert [r.id for r in e.orderBy("seq").collect()] == sorted(r.id for r in g.edges.collect())
    assert list(tmp_path.glob("d/*.gz")) and left(spark, "document") == before
