"""File sources and sinks: raw envelopes, line exports, terminology, domain pools, history, documents."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftgraph import scratch
from weftgraph.functions.jsontext import camel_keys, dumps
from weftgraph.operators.ordering import in_order

#: Domains offered where no pool is given.
DEFAULT_DOMAINS = ("market", "school", "garden", "kitchen", "football", "fishing", "travel", "family", "music", "crafts")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


@F.pandas_udf(StringType())
def _split_envelope(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A JSON array of [kind, place, item] texts for each envelope."""
    for part in texts:
        yield part.map(lambda t: json.dumps([[k, i, dumps(x)] for k in ("nodes", "relationships") for i, x in enumerate((json.loads(t) if t else {}).get(k) or [])], ensure_ascii=False))


def read_envelope(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Raw nodes (id, labels, props) and edges (id, type, src, dst, seq, props) of an envelope file, or of one for each file of a folder.

    Properties stay JSON text, so an absent key and a null differ.
    """
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.explode(F.from_json(_split_envelope("value"), "array<array<string>>")).alias("x")).select(F.col("x")[0].alias("kind"), F.col("x")[1].cast("bigint").alias("place"), F.col("x")[2].alias("item"))
    got = lambda k: F.get_json_object("item", f"$.{k}")
    labels = F.coalesce(F.from_json(got("labels"), "array<string>"), F.array().cast("array<string>"))
    nodes = items.where("kind = 'nodes'").select(got("id").alias("id"), labels.alias("labels"), F.coalesce(got("properties"), F.lit("{}")).alias("props"))
    edges = items.where("kind = 'relationships'").select(got("id").alias("id"), got("type").alias("type"), got("start").alias("src"), got("end").alias("dst"), (F.col("place") + 1).alias("seq"), F.coalesce(got("properties"), F.lit("{}")).alias("props"))
    return nodes, edges


def _node_item() -> Column:
    return F.to_json(F.struct("id", "labels", F.parse_json("props").alias("properties")))


def _edge_item(edges: DataFrame) -> Column:
    own = [F.parse_json(F.coalesce("props", F.lit("{}"))).alias("properties")] if "props" in edges.columns else []
    return F.to_json(F.struct("id", "type", F.col("src").alias("start"), F.col("dst").alias("end"), *own))


#: Lines of a document that hold no item.
_OPEN, _BETWEEN, _CLOSE = '{"nodes":[', '],"relationships":[', "]}"


def write_document(nodes: DataFrame, edges: DataFrame, path: str, compression: str | None = None) -> None:
    """One envelope document in parts: an item a line, nodes by id, then edges by seq or id. Each task writes its part; the parts in order of their names are one JSON text.

    ``compression``: a codec that Spark reads again by the files' names, such as gzip, for which parts in order are one compressed text.
    """
    order = F.lpad(F.col("seq").cast("string"), 20, "0") if "seq" in edges.columns else F.col("id")
    none = F.lit(None).cast("string")
    items = nodes.select(F.lit(1).alias("kind"), F.col("id").alias("key"), _node_item().alias("item")).unionByName(edges.select(F.lit(3).alias("kind"), order.alias("key"), _edge_item(edges).alias("item")))
    frame = nodes.sparkSession.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(x).alias("item")) for k, x in ((0, _OPEN), (2, _BETWEEN), (4, _CLOSE))))).alias("x"))
    every = items.unionByName(frame.select("x.kind", none.alias("key"), "x.item"))
    rows = scratch.settled(nodes.sparkSession, "document", lambda: in_order(every, "kind", "key"), packed=True)
    first = F.broadcast(rows.groupBy("kind").agg(F.min("seq").alias("first")))  # five rows
    comma = F.when(F.col("kind").isin(1, 3) & (F.col("seq") > F.col("first")), ",").otherwise("")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = rows.join(first, "kind").select("seq", F.concat(comma, "item").alias("value"))
    with scratch.passing(nodes.sparkSession):
        lines.repartitionByRange(n, "seq").sortWithinPartitions("seq").select("value").write.text(path, compression=compression)
    scratch.forget(rows)


#: First and last line of a history in parts.
_HISTORY, _HISTORY_END = '{"version":3,"entries":[', "]}"


def write_history(history: DataFrame, path: str) -> None:
    """A history of any size as one JSON document in parts, an entry a line, by nodeId and relPath: each task writes its part, in order of their names."""
    rows = scratch.written(in_order(history.select("nodeId", "relPath", F.to_json(F.struct(*history.columns)).alias("item")), "nodeId", "relPath", "item"), "history")
    last = rows.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("n"))
    ends = last.select(F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("seq"), F.lit(_HISTORY).alias("value")), F.struct((F.col("n") + 1).alias("seq"), F.lit(_HISTORY_END).alias("value")))).alias("x"))
    lines = rows.select("seq", F.concat(F.when(F.col("seq") > 1, ",").otherwise(""), "item").alias("value")).unionByName(ends.select("x.*"))
    n = int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(n, "seq").sortWithinPartitions("seq").select("value").write.text(path)


def read_history_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries of a history in parts, read by as many tasks as the files have splits."""
    lines = spark.read.text(path).where(~F.col("value").isin(_HISTORY, _HISTORY_END))
    return lines.select(F.from_json(F.regexp_replace("value", "^,", ""), schema).alias("x")).select("x.*")


def read_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, as ``read_envelope`` has them, of a document in parts. Lines are read by as many tasks as the files have splits; ``seq`` is the edges' order in them."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^,", "").alias("item"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    items = lines.where(~F.col("item").isin(_OPEN, _BETWEEN, _CLOSE) & (F.col("item") != ""))
    got = lambda k: F.get_json_object("item", f"$.{k}")
    edge = got("start").isNotNull()
    labels = F.coalesce(F.from_json(got("labels"), "array<string>"), F.array().cast("array<string>"))
    nodes = items.where(~edge).select(got("id").alias("id"), labels.alias("labels"), F.coalesce(got("properties"), F.lit("{}")).alias("props"))
    links = items.where(edge).select(got("id").alias("id"), got("type").alias("type"), got("start").alias("src"), got("end").alias("dst"), F.coalesce(got("properties"), F.lit("{}")).alias("props"), "file", "block", "line")
    return nodes, in_order(links, "file", "block", "line").drop("file", "block", "line")


def write_envelope(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One envelope as lines of JSON: every node, then every edge in order of seq, a file for each task.

    Meant for graphs of any size; ``envelope_text`` makes the single document of a small one.
    """
    n = nodes.select(F.lit("node").alias("kind"), _node_item().alias("value"))
    e = edges.select(F.lit("relationship").alias("kind"), _edge_item(edges).alias("value"))
    n.unionByName(e).write.partitionBy("kind").text(path)


def envelope_text(nodes: DataFrame, edges: DataFrame) -> str:
    """The envelope of a small graph as canonical JSON, for export to one file."""
    rows = [{"id": r.id, "labels": list(r.labels or []), "properties": json.loads(r.props or "{}")} for r in nodes.orderBy("id").toLocalIterator()]
    has = "props" in edges.columns
    links = [{"id": r.id, "type": r.type, "start": r.src, "end": r.dst, "properties": json.loads((r.props if has else None) or "{}")} for r in edges.orderBy(F.col("seq").asc_nulls_last() if "seq" in edges.columns else "id").toLocalIterator()]
    return dumps({"nodes": rows, "relationships": links})


def _converted_node(text: str) -> str:
    row = json.loads(text)
    props = camel_keys({k: v for k, v in row.items() if k not in ("entity_type", "identifier", "metadata")})
    meta = camel_keys(row.get("metadata") or {})
    return dumps({"id": row["identifier"], "label": row["entity_type"], "props": dumps(props | ({"metadata": meta} if meta else {}))})


def _converted_edge(text: str) -> str:
    row = json.loads(text)
    return dumps({"id": row["identifier"], "type": row["relationship_type"], "src": row["source_entity_value"], "dst": row["target_entity_value"]})


@F.pandas_udf(StringType())
def _nodes_converted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(_converted_node)


@F.pandas_udf(StringType())
def _edges_converted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(_converted_edge)


def read_lines(spark: SparkSession, node_path: str, edge_path: str) -> tuple[DataFrame, DataFrame]:
    """A line export: keys to camelCase, nulls dropped, label metadata kept; blank lines are skipped."""
    lines = lambda path: spark.read.text(path).where(F.length(F.trim("value")) > 0)
    n = lines(node_path).select(F.from_json(_nodes_converted("value"), "id string, label string, props string").alias("x"))
    e = lines(edge_path).select(F.from_json(_edges_converted("value"), "id string, type string, src string, dst string").alias("x"))
    return n.select("x.id", F.array("x.label").alias("labels"), "x.props"), e.select("x.*")


def import_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, n): counts by label, and the edges with an end that is not a node under ``(dangling)``."""
    from weftgraph.operators.overlay import dangling

    counts = nodes.groupBy(F.get(F.col("labels"), 0).alias("label")).agg(F.count("*").alias("n"))
    return counts.unionByName(dangling(edges, nodes).select("id").distinct().agg(F.count("*").alias("n")).select(F.lit("(dangling)").alias("label"), "n"))


def read_terminology(spark: SparkSession, path: str) -> DataFrame:
    """(section, francais, wolof, exemple, place) of a terminology file; no such file, no rows."""
    schema = "sections array<struct<titre:string,entrees:array<struct<francais:string,wolof:string,exemple:string>>>>"
    if not exists(spark, path):
        return spark.createDataFrame([], "section string, francais string, wolof string, exemple string, place int")
    rows = spark.read.schema(schema).json(path, multiLine=True)
    s = rows.select(F.posexplode("sections").alias("i", "s"))
    return s.select("i", F.col("s.titre").alias("section"), F.posexplode("s.entrees").alias("j", "e")).select("section", "e.francais", "e.wolof", "e.exemple", (F.col("i") * 100_000 + F.col("j")).alias("place"))


def read_domains(spark: SparkSession, path: str | None) -> DataFrame:
    """(domain, place) of a pool: a JSON array or {domains: [...]}; else the default one."""
    names = list(DEFAULT_DOMAINS)
    if path and exists(spark, path):
        found = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one small file
        names = found if isinstance(found, list) else found.get("domains") or names
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "domain string, place int")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a history file of version 3; another version or no file counts as empty."""
    schema = "version int, entries array<struct<id:string,nodeId:string,relPath:string,md5:string,updated:string,source:string,recordedAt:string>>"
    if not exists(spark, path):
        return spark.createDataFrame([], "id string, nodeId string, relPath string, md5 string, updated string, source string, recordedAt string")
    return spark.read.schema(schema).json(path, multiLine=True).where("version = 3").select(F.explode("entries").alias("e")).select("e.*")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def docx_text(data: bytes | None) -> str | None:
    """Plain text of a document: a line for each paragraph; None if it is no document."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    lines = []
    for p in root.iter(f"{_W}p"):
        lines.append("".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else x.text or "" for x in p.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")))
    return "\n".join(lines)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, text) of the documents below a path."""
    from weftgraph.operators.lookup import documents_only

    @F.pandas_udf(StringType())
    def text(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in contents:
            yield part.map(docx_text)

    files = documents_only(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    return files.select("path", "modificationTime", "length", text("content").alias("text"))

