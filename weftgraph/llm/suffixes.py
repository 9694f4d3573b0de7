"""Removal of long repeated byte strings by column-wise construction of a collection's BWT.

Dealing out. A string of ``LENGTH`` bytes has an anchor: of the ``GRAM``-byte strings in it the one with the
smallest hash, the leftmost if several. Equal strings have equal anchors at equal places, so they are
found among the contexts of one anchor: the bytes from the first to the end of the last string with
that anchor, at most 2 * LENGTH - GRAM. A text has about one context for 140 bytes. Anchors that
occur once are told apart by a Bloom filter of the others, of a fixed largest size, and
dropped; equal contexts become one with a count before they are shuffled.

Construction. The contexts dealt to a task are its collection of documents, laid below each other so that
their anchors stand in one column. Each round, from the last column to the first, inserts one byte of every
document: the column of bytes in the order of the suffixes behind them is that column's part of the
Burrows-Wheeler transform, a stable sort by byte gives the order of the suffixes that begin here, and
the common prefix of two neighbours follows from the smallest one between them in the round before. A string
repeats if it shares LENGTH bytes with a neighbour, or if its context has a count over one. Suffixes are only
held against those that begin in their own column, which is where equal strings stand; so a round costs the
number of documents and the whole construction is linear. Columns are written once and read in order. As a task's
collection has a set size (``TASK_BYTES``), they are arrays in memory and no files of a machine that may be lost.

Crowded anchors. An anchor with more than ``GROUP`` different contexts, which fill a task (a passage in a third of all documents, with
other surroundings each time) is refined: its strings are parted by the place where they start before the
anchor into two halves, and each half is dealt out by the bytes that all its strings have in common. Those are
LENGTH less the width of the half, so they grow from GRAM to LENGTH in at most nine steps, each of which sends
the crowded contexts only, cut to the half and equal ones as one with a count. In the end a group is one string.

The spans found go back to their documents by a join in which only documents that may have
one carry their text.

Cases: a null text is empty; texts under LENGTH bytes are kept whole; repeated rows are repeats of
each other; rows with equal identifiers and different texts are told apart by a hash of the
text; strings never cross documents; an empty table returns no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import scratch
from weftgraph.llm import bloom
from weftgraph.llm.textcols import _powers_to, as_strings, buffers, mix, row_chunks

LENGTH, GRAM = 400, 120
#: Bytes of contexts that one task indexes, about.
TASK_BYTES = 2 << 20
#: Different contexts of one anchor that stay together: those that fill a task.
GROUP = TASK_BYTES // (2 * LENGTH - GRAM)
#: Bytes of text that are cut into contexts at once, and contexts that a task counts before it sends them.
SLICE_BYTES, MOST_SEEN = 1 << 19, 200_000
#: Most crowded groups whose keys are broadcast; more are joined.
MOST_BROADCAST = 500_000
_NO_ID = -(1 << 63)


def rolling(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` bytes."""
    if len(raw) < size:
        return np.zeros(0, np.uint64)
    up, down = _powers_to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.multiply(raw.astype(np.uint64) + np.uint64(1), up[: len(raw)], out=sums[1:])
    np.cumsum(sums, out=sums)
    return mix((sums[size:] - sums[:-size]) * down[: len(raw) - size + 1])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def contexts(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, anchor's hash, anchor, first start, last start) of each context; places count from the buffer's start."""
    n = len(raw)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, np.zeros(0, np.uint64), empty, empty, empty
    h = rolling(raw, gram)
    keyed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    at = (_sliding_min(keyed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # A start is good if its string ends in the same row.
    good = np.zeros(n - length + 2, np.int32)
    sizes = np.diff(offsets)
    rows = np.flatnonzero(sizes >= length)
    np.add.at(good, offsets[rows], 1)
    np.add.at(good, offsets[rows] + sizes[rows] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(good[:-1]) > 0)
    if not len(starts):
        return empty, np.zeros(0, np.uint64), empty, empty, empty
    owner = np.searchsorted(offsets, starts, side="right") - 1
    anchor = at[starts]
    fresh = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.append(fresh[1:], len(starts)) - 1
    return owner[fresh], h[anchor[fresh]], anchor[fresh], starts[fresh], starts[last]


def repeated_starts(texts: list[bytes], anchors: np.ndarray, groups: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its starts hold a string that another context of its group holds at the same column."""
    m = len(texts)
    sizes, anchors = np.fromiter(map(len, texts), np.int64, m), np.asarray(anchors, np.int64)
    left, right = -anchors, sizes - anchors  # columns of each document
    first, last = int(left.min()), int(right.max())
    # The columns of the collection, one line for each; 256 stands where a document has no byte.
    table = np.full((m, last - first), 256, np.uint16)
    for line, a, b, text in zip(table, (left - first).tolist(), (right - first).tolist(), texts, strict=True):
        line[a:b] = np.frombuffer(text, np.uint8)
    columns = np.ascontiguousarray(table.T)
    doc = np.argsort(groups, kind="stable")  # documents in the order of their suffixes, group by group
    rank = np.cumsum(np.concatenate([[0], groups[doc][1:] != groups[doc][:-1]])).astype(np.int64)
    place = rank << np.int64(29) | np.arange(m)
    end = np.full(m + 1, last)  # the column where the common prefix with the suffix above ends
    flags = np.zeros((m, last - first), bool)
    for j in range(last - 1, first - 1, -1):
        bwt = columns[j - first][doc]
        key = np.sort(place | bwt.astype(np.int64) << np.int64(20))
        before = key & np.int64((1 << 20) - 1)  # where each suffix stood without its first byte
        doc = doc[before]
        at = np.flatnonzero(key[1:] >> np.int64(20) == key[:-1] >> np.int64(20)) + 1  # same group, same byte as above
        low, high = before[at - 1], before[at]
        shared = end[high]
        far = np.flatnonzero(high > low + 1)
        if len(far):
            far = far[np.argsort(low[far])]
            shared[far] = np.minimum.reduceat(end, np.stack([low[far] + 1, high[far] + 1], axis=1).ravel())[::2]
        end = np.full(m + 1, j)
        end[at] = shared
        if j <= last - length:
            hit = np.minimum(end[:m], right[doc]) - j >= length
            hit[:-1] |= hit[1:]
            flags[doc, j - first] = hit & (left[doc] <= j) & (j + length <= right[doc])
    return [flags[i, a - first : b - first - length + 1] for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True))]


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


def _keyed(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
    return ids, as_strings(batch.column(1))


def _text_keys(strings: pa.Array) -> np.ndarray:
    raw, offsets = buffers(strings)
    view = memoryview(np.ascontiguousarray(raw))
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), np.uint64, len(strings))


def row_key(ids: np.ndarray, text_keys: np.ndarray) -> np.ndarray:
    return mix(ids.view(np.uint64) * np.uint64(0x9FB21C651E98DF25) + text_keys)


_FOUND = {
    "kind": "int", "key": "bigint", "c1": "bigint", "c2": "bigint", "anchor": "int", "times": "bigint", "bytes": "binary", "n": "int", "low": "int",
    "high": "int", "o1": "bigint", "o2": "bigint", "first": "int",
}
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
_SCHEMA = ", ".join(f"{k} {t}" for k, t in _FOUND.items())
# Rows of contexts: one with its bytes for each task that meets it; how often a task meets it; and where it lies, in
# a text (o1, o2: identifier and hash of the text) or in a crowded context (o1, o2: that one's hashes).
_CONTEXT, _PLACE = 0, 1


class _Contexts:
    """Gathers the rows of one task."""

    def __init__(self):
        self.seen: dict[tuple[int, int], int] = {}
        self.rows: list[tuple] = []

    def add(self, key: int, anchor: int, data, low: int, high: int, owner: tuple[int, int], first: int, times: int, length: int) -> None:
        """A context at byte ``first`` of its owner; its strings start ``-high`` to ``-low`` bytes before the anchor."""
        c = xxhash.xxh3_128_intdigest(data, seed=anchor & 0xFFFFFFFF)
        c = (c >> 64) - (1 << 63), (c & (1 << 64) - 1) - (1 << 63)
        if c not in self.seen:
            self.rows.append((_CONTEXT, key, *c, anchor, None, bytes(data), len(data) - length + 1, low, high, None, None, None))
        self.seen[c] = self.seen.get(c, 0) + times
        self.rows.append((_PLACE, None, *c, None, None, None, None, None, None, *owner, first))

    def batch(self) -> Iterator[pa.RecordBatch]:
        """What has been gathered since the last call."""
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(zip(*self.rows, strict=True), _FOUND.values(), strict=True)], list(_FOUND))
        self.rows = []

    def counts(self) -> Iterator[pa.RecordBatch]:
        if self.seen:
            self.rows = [(_CONTEXT, None, *c, None, n, *[None] * 7) for c, n in self.seen.items()]
            yield from self.batch()
        self.seen = {}


def _signed(value) -> int:
    value = int(value)
    return value - (1 << 64) if value >> 63 else value


def _refined(length: int):
    """Parts crowded contexts (key, c1, c2, anchor, bytes, low, high, times) in two by the places of their starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Contexts()
        for batch in batches:
            for c1, c2, anchor, data, low, high, times in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    start, stop = max(0, a + anchor), min(len(data) - length, b + anchor)
                    if start <= stop:
                        # All strings that start between a and b have these bytes.
                        key = xxhash.xxh3_64_intdigest(data[b + anchor : a + anchor + length], seed=b & 0xFFFFFFFF)
                        out.add(_signed(key), anchor - start, data[start : stop + length], a, b, (c1, c2), start, times, length)
            yield from out.batch()
            if len(out.seen) > MOST_SEEN:
                yield from out.counts()
        yield from out.counts()

    return run


def find(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, text_key, starts, ends): starts of repeated strings in each document, as half-open ranges of bytes.

    ``docs`` has a long ``id`` and a string ``text``.
    """
    spark = docs.sparkSession

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, offsets in row_chunks(as_strings(batch.column(1)), SLICE_BYTES):
                keys, n = np.unique(contexts(raw, offsets, length)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["gram", "n"])

    shared = scratch.written(docs.mapInArrow(grams, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram"), "grams")
    known = spark.sparkContext.broadcast(bloom.build(shared, shared.count()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Contexts()
        for batch in batches:
            ids, strings = _keyed(batch)
            text_keys = _text_keys(strings).view(np.int64)
            for row, raw, offsets in row_chunks(strings, SLICE_BYTES):
                owner, gram, anchor, low, high = contexts(raw, offsets, length)
                chosen = np.flatnonzero(bloom.maybe(known.value, gram)) if len(gram) else np.zeros(0, np.int64)
                view = memoryview(np.ascontiguousarray(raw))
                which = owner[chosen]
                columns = gram.view(np.int64)[chosen], anchor[chosen] - low[chosen], low[chosen], high[chosen] + length, ids[row + which], text_keys[row + which], low[chosen] - offsets[which]
                for g, at, a, b, i, t, first in zip(*(c.tolist() for c in columns), strict=True):
                    out.add(g, at, view[a:b], GRAM - length, 0, (i, t), first, 1, length)
                yield from out.batch()
            if len(out.seen) > MOST_SEEN:
                yield from out.counts()
        yield from out.counts()

    found = scratch.written(docs.mapInArrow(places, _SCHEMA), "contexts", "zstd")
    levels, settled, size = [], None, 0
    while True:
        levels.append((found, times := _times(found)))
        texts = found.where((F.col("kind") == _CONTEXT) & F.col("bytes").isNotNull()).select("key", "c1", "c2", "anchor", "bytes", "low", "high")
        size += times.agg(F.coalesce(F.sum(F.col("n") + length - 1), F.lit(0))).first()[0]
        crowded = scratch.written(times.where("low < high").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("key"), "crowded")
        n_crowded = crowded.count()
        if n_crowded <= MOST_BROADCAST:
            crowded = F.broadcast(crowded)
        cold = texts.join(crowded, "key", "left_anti") if n_crowded else texts
        settled = cold if settled is None else settled.unionByName(cold)
        if not n_crowded:
            break
        hot = texts.join(crowded, "key", "left_semi").dropDuplicates(["c1", "c2"]).join(times.select("c1", "c2", "times"), ["c1", "c2"])
        found = scratch.written(hot.select("key", "c1", "c2", "anchor", "bytes", "low", "high", "times").mapInArrow(_refined(length), _SCHEMA), "contexts", "zstd")
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, dict[tuple[int, int], tuple[int, bytes]]] = {}
        for batch in batches:
            for key, c1, c2, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                groups.setdefault(key, {})[c1, c2] = (at, data)
        part: list[tuple[tuple[int, int], int, bytes, int]] = []
        held = 0
        for key, members in groups.items():
            if len(members) == 1:  # no other context to share a string with
                continue
            part += [(c, at, data, key) for c, (at, data) in members.items()]
            held += sum(len(data) for _, data in members.values())
            if held >= TASK_BYTES:
                yield from _indexed(part, length)
                part, held = [], 0
        yield from _indexed(part, length)

    starts = settled.select("key", "c1", "c2", "anchor", "bytes").repartition(n_tasks, "key").mapInArrow(indexed, "c1 bigint, c2 bigint, starts array<int>, ends array<int>")
    if len(levels) > 1:
        starts = scratch.written(starts, "starts")
    # From the last refinement back to the texts: what repeats in a part repeats in the context that it was cut from.
    placed = None
    for found, times in reversed(levels):
        # A context with a count over one repeats at all of its starts.
        ranges = times.where("times > 1").select("c1", "c2", F.array(F.lit(0)).alias("starts"), F.array("n").alias("ends")).unionByName(starts)
        if placed is not None:
            ranges = ranges.unionByName(placed.select(F.col("o1").alias("c1"), F.col("o2").alias("c2"), "starts", "ends"))
        ranges = scratch.written(ranges, "ranges")
        spots = found.where(F.col("kind") == _PLACE).select("c1", "c2", "o1", "o2", "first")
        placed = spots.join(ranges, ["c1", "c2"]).select("o1", "o2", F.transform("starts", lambda s: s + F.col("first")).alias("starts"), F.transform("ends", lambda s: s + F.col("first")).alias("ends"))
    return placed.groupBy(F.col("o1").alias("id"), F.col("o2").alias("text_key")).agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))


def _times(found: DataFrame) -> DataFrame:
    """(c1, c2, times, key, n, low, high) of each different context."""
    facts = (F.max(c).alias(c) for c in ("key", "n", "low", "high"))
    return scratch.written(found.where(F.col("kind") == _CONTEXT).groupBy("c1", "c2").agg(F.coalesce(F.sum("times"), F.lit(0)).alias("times"), *facts), "times")


def _indexed(part: list[tuple[tuple[int, int], int, bytes, int]], length: int) -> Iterator[pa.RecordBatch]:
    if not part:
        return
    flags = repeated_starts([p[2] for p in part], np.array([p[1] for p in part]), np.array([p[3] for p in part]), length)
    rows = [(*p[0], *_runs(f)) for p, f in zip(part, flags, strict=True) if f.any()]
    if rows:
        types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["c1", "c2", "starts", "ends"])


def removed_spans(starts: list[int], ends: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings that begin in the given ranges."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b - 1 + length)
        else:
            out.append([a, b - 1 + length])
    return [(a, b) for a, b in out]


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, done = [], 0
    for a, b in spans:
        parts.append(data[done:a])
        done = b
    return b"".join([*parts, data[done:]])


def removed(docs: DataFrame, length: int = LENGTH, with_bytes: bool = False) -> DataFrame:
    """For each document (``id``, ``text``): id, n_bytes, n_removed, n_spans, kept_sha256, and its kept bytes if asked for."""
    spark = docs.sparkSession
    starts = scratch.written(find(docs, length), "repeats")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text_keys = (c.to_numpy() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(row_key(ids, text_keys.view(np.uint64)).view(np.int64))], ["key"])

    n = starts.count()
    known = spark.sparkContext.broadcast(bloom.build(starts.select("id", "text_key").mapInArrow(keys, "key bigint"), n))

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, strings = _keyed(batch)
            text_keys = _text_keys(strings)
            maybe = bloom.maybe(known.value, row_key(ids, text_keys)) if len(ids) else np.zeros(0, bool)
            data = strings.cast(pa.large_binary()).to_pylist()
            sums = [None if m and not with_bytes else hashlib.sha256(d).hexdigest() for m, d in zip(maybe, data, strict=True)]
            text = pa.array([d if m or with_bytes else None for m, d in zip(maybe, data, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids), pa.array(text_keys.view(np.int64)), pa.array([len(d) for d in data], pa.int64()), pa.array(sums, pa.string()), text], ["doc", "id", "text_key", "n_bytes", "sha", "data"])

    rows = docs.select("id", "text").mapInArrow(carried, "doc bigint, id bigint, text_key bigint, n_bytes bigint, sha string, data binary")
    rows = rows.join(starts, ["id", "text_key"], "left")
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    types = [pa.int64()] * 4 + [pa.string(), pa.binary()]

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, size, sha, data, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = removed_spans(low or [], high or [], length)
                kept = cut(data, spans) if spans else data
                sha = hashlib.sha256(kept).hexdigest() if spans or sha is None else sha
                out.append((doc, size, sum(b - a for a, b in spans), len(spans), sha, kept if with_bytes else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    done = rows.select("doc", "n_bytes", "sha", "data", "starts", "ends").mapInArrow(finished, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return done if with_bytes else done.drop("kept")


def report(docs: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    return removed(docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")).withColumnRenamed("id", "doc_id")
