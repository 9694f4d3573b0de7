"""Near-duplicates by the exact Jaccard similarity of word shingles.

A second pass for what fingerprints leave (see ``simhash.keep_first``). Candidates meet in MinHash bands: a pair
of similarity s shares a band with probability 1 - (1 - s^7)^50, which misses 8 in a million pairs at 0.8.
Inside a bucket every pair that could still join two groups is compared by its whole sets of shingles, so
only pairs of at least the wanted similarity are linked. Texts with equal words are one unit.

A bucket of over ``BLOCK`` units is compared in blocks that share their first units, which joins most of a large
group; then the units outside the bucket's largest group are compared with all of the bucket. Two units of one
group need no comparison, so no link between groups is missed and a large group does not meet squared.

Cases: texts without words are one unit; fewer words than a shingle are one shingle; of rows with equal words and
identifiers one stays; null identifiers stay only where a group has no other; an empty table returns no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import scratch
from weftgraph.llm import simhash
from weftgraph.llm.textcols import as_strings
from weftgraph.operators.components import components

LEAST = 0.8
BANDS, ROWS = 50, 7
#: Units of a bucket that one task compares, and those that all blocks of a bucket share.
BLOCK, SHARED = 500, 8
#: Band keys that one task groups, about.
TASK_KEYS = 1_000_000

#: Odd factors of the MinHashes.
_FACTORS = np.random.default_rng(5).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def bands(h: np.ndarray) -> np.ndarray:
    """One key for each band of the MinHashes of a text's shingle hashes."""
    short = (_mixed(h) >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max)
    for i in range(0, len(short), 128):
        np.minimum(low, (short[i : i + 128, None] * _FACTORS).min(axis=0), out=low)
    low = low.astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = _mixed(key ^ column) + column
    return key


def linked(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (distinct values each) of at least this similarity."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    left, left_ids, found = np.arange(len(sets)), ids, []
    marked = np.zeros(len(values), bool)
    queue: list[int] = []
    while len(left):
        u = queue.pop() if queue else int(left[0])
        mine = ids[ends[u] - sizes[u] : ends[u]]
        marked[mine] = True
        n = sizes[left]
        shared = np.add.reduceat(marked[left_ids], np.cumsum(n) - n, dtype=np.int64)
        marked[mine] = False
        good = shared >= least * (n + sizes[u] - shared) - 1e-9
        near = left[good & (left != u)].tolist()
        found += [(u, v) for v in near]
        queue += near
        gone = good | (left == u)
        if gone.any():
            left_ids, left = left_ids[np.repeat(~gone, n)], left[~gone]
    return found


def _marked(rows: DataFrame, shingle: int) -> DataFrame:
    """(id, row, unit, bands) of (id, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, keys = [], []
            for t in as_strings(batch.column(2)):
                words = b" ".join((t.as_py() or "").encode("utf-8", "surrogatepass").lower().split())
                h = simhash.hashes(t.as_py(), shingle)
                units.append(xxhash.xxh3_64_intdigest(words))
                keys.append(bands(np.unique(h)).view(np.int64) if len(h) else np.zeros(0, np.int64))
            lists = pa.array(keys, pa.list_(pa.int64()))
            unit = pa.array(np.array(units, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), unit, lists], ["_id", "_row", "unit", "bands"])

    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {id_type}, _row bigint, unit bigint, bands array<bigint>")


def _buckets(keys: DataFrame, n_tasks: int) -> DataFrame:
    """(bucket, block, big, unit) of the keys with several units; keys with the same units are one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches]
        if not parts:
            return
        key, unit = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((unit, key))
        key, unit = key[order], unit[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        if not len(starts):
            return
        size = np.diff(np.append(starts, len(key)))
        bucket = np.add.reduceat(_mixed(unit.view(np.uint64)), starts).view(np.int64)
        at, big = np.arange(len(key)) - np.repeat(starts, size), np.repeat(size > BLOCK, size)
        bucket, many = np.repeat(bucket, size), np.repeat(size, size)
        several = many > 1
        yield from put(bucket[several], np.where(big, at // BLOCK, 0)[several], big[several], unit[several])
        for s, n in zip(starts[size > BLOCK].tolist(), size[size > BLOCK].tolist(), strict=True):  # the first units go to all other blocks
            others = np.repeat(np.arange(1, -(-n // BLOCK)), SHARED)
            yield from put(np.full(len(others), bucket[s]), others, np.ones(len(others), bool), np.tile(unit[s : s + SHARED], len(others) // SHARED))

    def put(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "block", "big", "unit"])

    return keys.repartition(n_tasks, "key").mapInArrow(run, "bucket bigint, block bigint, big boolean, unit bigint").distinct()


def _links(tasks: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b) of the units of each task (columns ``task``, ``unit``) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, units, held = None, [], []

        def out() -> pa.RecordBatch:
            pairs = linked(held, least) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([units[i] for i, _ in pairs], pa.int64()), pa.array([units[j] for _, j in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            for t, u, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if t != task:
                    if units:
                        yield out()
                    task, units, held = t, [], []
                units.append(u)
                held.append(np.frombuffer(data.as_py(), np.uint64))
        if units:
            yield out()

    rows = tasks.join(sets, "unit").select("task", "unit", "set").repartition("task").sortWithinPartitions("task")
    return rows.mapInArrow(run, "a bigint, b bigint")


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(unit, set) of (unit, text): the sorted distinct hashes of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(h if len(h := simhash.hashes(t.as_py(), shingle)) else np.zeros(1, np.uint64)).tobytes() for t in as_strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["unit", "set"])

    return rows.mapInArrow(run, "unit bigint, set binary")


def _rest(big: DataFrame, found: DataFrame) -> DataFrame:
    """Tasks (task, unit) that compare the units outside the largest group of each large bucket with all of it."""
    member = big.dropDuplicates(["bucket", "unit"]).join(found, F.col("unit") == F.col("node"), "left").select("bucket", "block", "unit", F.coalesce("root", "unit").alias("root"))
    sizes = member.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    most = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"))
    rest_of = most.select("bucket", F.col("most.root").alias("largest"), F.ceil((F.col("all") - F.col("most.n")) / BLOCK).alias("parts"), F.ceil(F.col("all") / BLOCK).alias("blocks")).where("parts > 0")
    member = member.join(rest_of, "bucket")
    task = F.xxhash64("bucket", "block", "part").alias("task")
    whole = member.select("bucket", "block", "unit", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    rest = member.where("root <> largest").select("bucket", "unit", F.pmod(F.xxhash64("unit"), "parts").alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    return whole.select(task, "unit").unionByName(rest.select(task, "unit")).distinct()


def later_rows(rows: DataFrame, shingle: int, least: float = LEAST) -> DataFrame:
    """Of rows (``_id``, ``_text``, ``_row``) the numbers of all but those with the smallest identifier of each group of similar ones."""
    spark = rows.sparkSession
    marked = scratch.written(_marked(rows.select("_id", "_row", "_text"), shingle), "marked", "zstd")
    units = marked.groupBy("unit").agg(F.min("_row").alias("_row"))
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-BANDS * marked.count() // TASK_KEYS))
    tasks = scratch.written(_buckets(marked.select(F.explode("bands").alias("key"), "unit").distinct(), n_tasks), "buckets")
    wanted = scratch.written(units.join(tasks.select("unit").distinct(), "unit"), "wanted")
    n_wanted = wanted.count()
    texts = rows.select("_row", "_text").join(F.broadcast(wanted) if n_wanted <= simhash.MOST_BROADCAST else wanted, "_row").select("unit", "_text")
    sets = scratch.written(_sets(texts, shingle), "sets", "none")
    found = components(_links(tasks.select(F.xxhash64("bucket", "block").alias("task"), "unit").distinct(), sets, least), "a", "b")
    big = tasks.where("big")
    if not big.isEmpty():
        more = _links(_rest(big, found), sets, least)
        found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "a", "b")
    grouped = marked.select("_id", "_row", "unit").join(found, F.col("unit") == F.col("node"), "left").select("_id", "_row", F.coalesce("root", "unit").alias("root"))
    return simhash.others(grouped, [F.col("root")], "_row")
