"""Ranked lexical search over a hierarchical max tree.

Documents are cut into shards of at most ``SHARD_DOCS`` rows and ``SHARD_BYTES`` bytes. A shard keeps the postings of
the terms that are asked for. Above it stands a tree of document ranges: the shards of one input partition, ``FAN`` partitions,
and so on to one root; inside it ranges of ``SUPER`` and of ``BLOCK`` documents. Each range has, for each
term, the highest impact of any of its documents, so the weighted sum over an item's terms bounds every score below it.

Branch and bound goes twice from the root. First each item follows its ``BEAM`` highest bounds down to shards, whose best
documents give its threshold, a score that the tenth document reaches at least. Then every range is opened whose bound is not below
that threshold; a bound equal to it is opened too, as ties are decided by identifier. Inside a shard the same goes
on with a heap, best bound first, while the threshold rises. Ranges below it are never read, and no other document can be among the best.

The query set is shipped to the tasks in blocks of at most ``BLOCK_TERMS`` distinct terms; with more, one block follows the
other. Tasks send maxima and at most ``k`` documents of a shard for each item, never postings.

Cases: a null or empty text has no terms and is never found; a null or empty item has no rows; repeated items are answered each; rows with
equal identifiers are documents of their own; equal scores come by ascending identifier, null identifiers last; a table without
any term answers nothing; columns of the documents other than identifier and text are not read; texts of any length are read whole.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph import scratch
from weftgraph.llm.textcols import as_strings, buffers, lower_ascii, row_chunks, token_hashes, tokens

K = 10
#: Most documents and bytes of text in a shard, and documents in the two ranges inside it.
SHARD_DOCS, SHARD_BYTES, SUPER, BLOCK = 1024, 4 << 20, 128, 16
#: Ranges below one range of the upper tree, and how many an item follows first.
FAN, BEAM = 32, 2
#: Distinct terms of the items that are asked together.
BLOCK_TERMS = 8192
#: Shards that one partition may have.
_MOST_SHARDS = 1 << 24

_GAP = np.ones(256, dtype=bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_TABLE_BITS = 20


def term_list(text: str | None) -> list[bytes]:
    """The terms of one text in order, with repeats."""
    raw, offsets = buffers(as_strings(pa.array([text], pa.string())))
    low = lower_ascii(raw).tobytes()
    starts, ends, _ = tokens(raw, offsets, _GAP)
    return [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What an occurrence count is worth in a document of ``n`` terms, among so many documents and terms."""
    m = 100 - 90 + (90 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass
class Terms:
    """The distinct terms of a block of items, in order of their hashes; a table of the hashes' first bits tells quickly what is none."""

    hash: np.ndarray
    raw: np.ndarray
    start: np.ndarray
    size: np.ndarray
    table: np.ndarray

    @classmethod
    def build(cls, words: list[bytes]) -> tuple[Terms, dict[bytes, int]]:
        raw = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        h = token_hashes(raw, start, start + size)
        order = np.argsort(h)
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        return cls(h[order], raw, start[order], size[order], table), {words[i]: k for k, i in enumerate(order.tolist())}

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which token, which term) of the tokens that are terms, compared byte by byte."""
        h = token_hashes(raw, starts, ends)
        maybe = np.flatnonzero(self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.hash, h[maybe]), len(self.hash) - 1)
        good = (self.hash[term] == h[maybe]) & (self.size[term] == (ends - starts)[maybe])
        maybe, term = maybe[good], term[good]
        size = self.size[term]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        equal = raw[np.repeat(starts[maybe], size) + inner] == self.raw[np.repeat(self.start[term], size) + inner]
        same = np.logical_and.reduceat(equal, np.cumsum(size) - size) if len(size) else np.zeros(0, bool)
        return maybe[same], term[same]


def _shards(docs: DataFrame, known: Terms) -> DataFrame:
    """A row for each shard: its documents' identifiers and sizes, and the postings (place, count) of its terms, one term after the other."""
    id_type = docs.schema[0].dataType.simpleString()
    schema = f"shard bigint, ids array<{id_type}>, n binary, documents bigint, total bigint, terms array<int>, df array<int>, at binary, tf binary"

    def cut(strings: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for row, raw, offsets in row_chunks(strings, SHARD_BYTES):
            for i in range(0, len(offsets) - 1, SHARD_DOCS):
                part = offsets[i : i + SHARD_DOCS + 1]
                yield row + i, raw[part[0] : part[-1]], part - part[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() * _MOST_SHARDS
        for batch in batches:
            for row, raw, offsets in cut(as_strings(batch.column(1))):
                low = lower_ascii(raw)
                starts, ends, n = tokens(low, offsets, _GAP)
                which, term = known.find(low, starts, ends)
                owner = np.repeat(np.arange(len(n)), n)[which]
                found, tf = np.unique(term * SHARD_DOCS + owner, return_counts=True)
                terms, df = np.unique(found // SHARD_DOCS, return_counts=True)
                ids = batch.column(0).slice(row, len(n))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), ids), pa.array([n.astype(np.int64).tobytes()]),
                        pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([terms.astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([df.astype(np.int32)], pa.list_(pa.int32())), pa.array([(found % SHARD_DOCS).astype(np.uint16).tobytes()]), pa.array([tf.astype(np.uint32).tobytes()]),
                    ], ["shard", "ids", "n", "documents", "total", "terms", "df", "at", "tf"],
                )
                shard += 1

    return docs.mapInArrow(run, schema)


@dataclass
class Items:
    """The items of a block: the terms of each with their weights."""

    terms: list[np.ndarray]
    weights: list[np.ndarray]

    def rows(self, item: int, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sorted ``terms`` the item has, and their weights."""
        mine = self.terms[item]
        at = np.minimum(np.searchsorted(terms, mine), len(terms) - 1)
        here = terms[at] == mine if len(terms) else np.zeros(len(mine), bool)
        return at[here], self.weights[item][here]


def _postings(row: dict, documents: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a shard, where the postings of each end, and place and impact of each posting."""
    terms, ends = np.asarray(row["terms"], np.int64), np.cumsum(np.asarray(row["df"], np.int64))
    at, n = np.frombuffer(row["at"], np.uint16).astype(np.int64), np.frombuffer(row["n"], np.int64)
    return terms, ends, at, impacts(np.frombuffer(row["tf"], np.uint32).astype(np.int64), n[at], documents, total)


def _tree(shards: DataFrame, documents: int, total: int) -> list[DataFrame]:
    """For each level from the shards up: (node, parent, terms, highest) of its ranges; the last level is one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                terms, ends, _, worth = _postings(row, documents, total)
                highest = np.maximum.reduceat(worth, np.concatenate([[0], ends[:-1]])) if len(terms) else worth
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]], pa.int64()), pa.array([row["shard"] // _MOST_SHARDS], pa.int64()), pa.array([terms.astype(np.int32)], pa.list_(pa.int32())), pa.array([highest], pa.list_(pa.int64()))],
                    ["node", "parent", "terms", "highest"],
                )

    level = scratch.written(shards.select("shard", "n", "terms", "df", "at", "tf").mapInArrow(run, "node bigint, parent bigint, terms array<int>, highest array<bigint>"), "ranges", "zstd")
    levels, widest = [level], level.agg(F.max("parent")).first()[0]
    while True:
        each = level.select("parent", F.explode(F.arrays_zip("terms", "highest")).alias("x")).groupBy("parent", "x.terms").agg(F.max("x.highest").alias("highest"))
        of = each.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("terms", "highest"))).alias("x"))  # at most all terms of the block
        above = F.floor(F.col("parent") / FAN).alias("above")
        level = scratch.written(of.select(F.col("parent").alias("node"), above, F.col("x.terms").alias("terms"), F.col("x.highest").alias("highest")).withColumnRenamed("above", "parent"), "ranges", "zstd")
        levels.append(level)
        if widest == 0:
            return levels
        widest //= FAN


def _below(level: DataFrame, opened: DataFrame | None, items: Items, least: list[int]) -> DataFrame:
    """(item, node, bound) of the ranges of a level, below the opened ranges (node, items), whose bounds reach the items' thresholds."""
    every = range(len(items.terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for row in batch.to_pylist():
                terms, highest = np.asarray(row["terms"], np.int64), np.asarray(row["highest"], np.int64)
                for item in row.get("items", every):
                    at, weights = items.rows(item, terms)
                    if (bound := int((highest[at] * weights).sum())) >= least[item]:
                        found.append((item, row["node"], bound))
            columns = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "node", "bound"])

    if opened is not None:
        level = level.join(opened.select(F.col("node").alias("parent"), "items"), "parent")
    return level.drop("parent").mapInArrow(run, "item int, node bigint, bound bigint")


def _opened(bounds: DataFrame) -> DataFrame:
    return bounds.groupBy("node").agg(F.collect_list("item").alias("items"))  # at most all items of the block


def best_in_shard(matrix: np.ndarray, weights: np.ndarray, ids: list, k: int, least: int) -> list[tuple[int, object]]:
    """Best-first branch and bound over one shard: the ``k`` highest (score, identifier), of scores of at least ``least`` and above 0.

    ``matrix`` has the impacts of an item's terms (rows) in the shard's documents (columns).
    """
    width = -(-matrix.shape[1] // SUPER) * SUPER
    wide = np.zeros((len(matrix), width), np.int64)
    wide[:, : matrix.shape[1]] = matrix
    ranges = wide.reshape(len(matrix), -1, BLOCK).max(axis=2)
    block = weights @ ranges
    upper = weights @ ranges.reshape(len(matrix), -1, SUPER // BLOCK).max(axis=2)
    heap = [(-b, 0, i) for i, b in enumerate(upper.tolist())]
    heapq.heapify(heap)
    found: list[tuple[int, bool, object]] = []
    least = max(least, 1)
    while heap and -heap[0][0] >= least:  # a range that only equals the threshold is opened: its documents may have smaller identifiers
        _, deep, i = heapq.heappop(heap)
        if not deep:
            for j in range(i * (SUPER // BLOCK), (i + 1) * (SUPER // BLOCK)):
                if block[j] >= least:
                    heapq.heappush(heap, (-int(block[j]), 1, j))
            continue
        scores = weights @ wide[:, i * BLOCK : (i + 1) * BLOCK]
        found += [(-int(scores[j]), ids[i * BLOCK + j] is None, ids[i * BLOCK + j]) for j in np.flatnonzero(scores >= least).tolist()]
        found.sort(key=lambda f: (f[0], f[1], 0 if f[1] else f[2]))
        del found[k:]
        if len(found) == k:
            least = max(least, -found[-1][0])
    return [(-s, i) for s, _, i in found]


def _answers(shards: DataFrame, opened: DataFrame, items: Items, documents: int, total: int, least: list[int], k: int) -> DataFrame:
    """(item, id, score) of the best documents of each opened shard (node, items)."""
    id_type = shards.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):  # one shard at a time
                row = batch.slice(i, 1).to_pylist()[0]
                terms, ends, at, worth = _postings(row, documents, total)
                found = []
                for item in sorted(row["items"]):
                    rows, weights = items.rows(item, terms)
                    matrix = np.zeros((len(rows), len(row["ids"])), np.int64)
                    for r, t in enumerate(rows.tolist()):
                        mine = slice(ends[t - 1] if t else 0, ends[t])
                        matrix[r, at[mine]] = worth[mine]
                    found += [(item, i, s) for s, i in best_in_shard(matrix, weights, row["ids"], k, least[item])]
                columns = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), kind, pa.int64()), strict=True)], ["item", "id", "score"])

    wanted = shards.select(F.col("shard").alias("node"), "ids", "n", "terms", "df", "at", "tf").join(opened, "node")
    return wanted.mapInArrow(run, T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", id_type), T.StructField("score", T.LongType())]))


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, texts: list[list[bytes]], k: int) -> DataFrame | None:
    """(item, rank, id, score); an item is its place in the block."""
    known, place = Terms.build(sorted({t for words in texts for t in words}))
    shards = scratch.written(_shards(docs, known), "shards", "zstd")
    documents, total = (int(x or 0) for x in shards.agg(F.sum("documents"), F.sum("total")).first())
    if not total:
        return None
    each = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df")).collect()  # a number for each term asked
    weights = np.zeros(len(place), np.int64)
    for r in each:
        weights[r.terms] = weight(r.df, documents)
    asked = [np.array(sorted({place[t] for t in words}), np.int64) for words in texts]
    items = Items(asked, [weights[a] for a in asked])
    levels, least = _tree(shards, documents, total), [1] * len(asked)

    def descended(keep) -> DataFrame:
        opened = None
        for level in reversed(levels):
            opened = scratch.written(_opened(keep(_below(level, opened, items, least))), "opened")
        return opened

    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "node")
    dive = descended(lambda b: b.withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= BEAM).drop("place"))
    reached = _first(_answers(shards, dive, items, documents, total, least, k), k).where(F.col("rank") == k).select("item", "score")
    for r in reached.collect():  # a number for each item
        least[r["item"]] = r["score"]
    return _first(_answers(shards, descended(lambda b: b), items, documents, total, least, k), k)


def _blocks(items: DataFrame, text_col: str) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(rows, terms of each) of the items that have terms, block after block."""
    rows, texts, distinct = [], [], set()
    for r in items.toLocalIterator():
        words = term_list(r[text_col])
        if not words:
            continue
        if rows and len(distinct | set(words)) > BLOCK_TERMS:
            yield rows, texts
            rows, texts, distinct = [], [], set()
        rows.append(r)
        texts.append(words)
        distinct |= set(words)
    if rows:
        yield rows, texts


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``k`` documents of the highest scores above 0."""
    spark, parts = docs.sparkSession, []
    short = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", items.schema[item_id].dataType)])
    for rows, texts in _blocks(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), "text"):
        found = _search_block(short, texts, k)
        if found is not None:
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], schema)
            parts.append(found.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score"))
    if not parts:
        empty = T.StructType([schema["item_id"], T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, parts)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's rows."""
    return search(docs, benchmark)


SQL = r"""
WITH words AS (
  SELECT doc_id, row AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS row FROM documents)),
sizes AS (SELECT doc, count(*) AS n FROM words GROUP BY doc),
totals AS (SELECT count(*) AS documents, sum(n)::BIGINT AS total FROM sizes),
asked AS (
  SELECT DISTINCT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS item FROM benchmark)),
postings AS (SELECT doc_id, doc, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term, documents),
scored AS (
  SELECT item, item_id, doc, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * documents) // total))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (doc), totals GROUP BY item, item_id, doc, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
