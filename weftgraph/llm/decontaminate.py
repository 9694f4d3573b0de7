"""Benchmark decontamination with spaced seeds.

Texts are lower-cased and cut into tokens of letters and digits. A mask picks some positions of a
window and ignores the others, so a substituted word spoils only the masks that look at it. The
hashes of all masked windows of the benchmark are joined with those of the documents; around each
hit the item is laid over the document at the hit's offset, and the longest stretch
in which at least ``SIMILARITY`` of the tokens agree is measured. A document is contaminated by an item
if that stretch has ``LEAST_OVERLAP`` tokens, or four fifths of the item if that is fewer.

Items of 15 tokens and more have masks of weight six; of the patterns of substitutions that such an overlap allows
these miss 2 of 1326 at 15 tokens, and fewer of longer items. Items of 7 to 14 tokens have masks of weight four,
which miss none. Items of 3 to 6 tokens are looked up as they are, anywhere in a document. One or two
tokens are no passage: such an item only matches a document that is nothing else.

The benchmark is a query set: it is shipped to the tasks in blocks of at most ``BLOCK_BYTES``. One block holds
about a million tokens, so in practice there is one pass over the documents, without a shuffle. With more blocks,
one pass follows the other, each writes what it has found and lets go of its block, and the findings are merged by row.

Cases: null and empty texts are clean; repeated items are reported under each identifier; null and empty items
are ignored; rows with equal identifiers are judged each for itself; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph import scratch
from weftgraph.llm.textcols import as_strings, fresh, mix, row_chunks, token_hashes, tokens, without

#: Positions looked at (1) and ignored (0): masks of long items and of short ones, and the tokens from which an item is long or short.
MASKS, SHORT_MASKS = ("1111011", "110110011", "1110001011", "11010010101"), ("1111", "11011", "110011")
LONG, SHORT, RUN = 15, 7, 3
#: Pairs of equal seeds that are looked at together.
_PAIRS = 1 << 20
#: Share of agreeing tokens in an overlap, and its least length in tokens.
SIMILARITY, LEAST_OVERLAP = 0.8, 13
#: Largest block of the benchmark that is broadcast: seeds and tokens, in bytes.
BLOCK_BYTES = 128 << 20
_SEED_BYTES = 24 * len(MASKS) + 8

_GAP = np.ones(256, dtype=bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_TABLE_BITS = 22


def text_tokens(strings: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, token hashes, tokens per row) of slices of a string array."""
    for row, raw, offsets in row_chunks(pc.utf8_lower(strings)):
        starts, ends, counts = tokens(raw, offsets, _GAP)
        yield row, token_hashes(raw, starts, ends), counts


def seeds(hashes: np.ndarray, counts: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each masked window that lies in one row, and the token where it starts."""
    span, n = len(mask), len(hashes)
    if n < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n - span + 1, salt, dtype=np.uint64)
    for i, c in enumerate(mask):
        out *= np.uint64(0x9E3779B97F4A7C15)
        if c == "1":
            out += hashes[i : n - span + 1 + i]
    rows = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(rows[: n - span + 1] == rows[span - 1 :])
    return mix(out[at]), at


def longest_overlap(equal: np.ndarray, similarity: float = SIMILARITY) -> tuple[int, int]:
    """The longest stretch [a, b) with at least that share of agreement, the first one if several."""
    if not equal.any():
        return 0, 0
    share = round(similarity * 1000)
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1000 - share, -share))])
    # Both ends agree: a starts at an agreeing token, b ends after one.
    lowest = np.minimum.accumulate(np.where(equal, sums[:-1], np.iinfo(np.int64).max))
    ends = np.flatnonzero(equal) + 1
    first = np.searchsorted(-lowest, -sums[ends], side="left")  # the first a whose sum is no larger than that at b
    best = int((ends - first).argmax())
    return int(first[best]), int(ends[best])


def _whole(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n tokens that lies in one row, and the token where it starts."""
    return seeds(hashes, counts, "1" * n, 1000 + n)


@dataclass
class Seeds:
    """Hashes in order, each with its item and place in it; a table of their first bits says quickly what is not among them."""

    hash: np.ndarray
    item: np.ndarray
    at: np.ndarray
    table: np.ndarray

    @classmethod
    def build(cls, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Seeds:
        h, item, at = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        return cls(h[order], item[order], at[order], table)

    def pairs(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place of a hash, seed) of all equal ones, in slices."""
        maybe = self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
        h, at = h[maybe], at[maybe]
        low, high = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        ends = np.cumsum(high - low)
        start = 0
        while start < len(h):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _PAIRS, "right")))
            n = (high - low)[start:stop]
            yield np.repeat(at[start:stop], n), np.repeat(low[start:stop], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = stop


@dataclass
class Block:
    """Part of the benchmark: tokens of its items end to end, and its seeds by mask."""

    ids: list
    hashes: np.ndarray
    starts: np.ndarray
    seeds: dict[str, Seeds]
    runs: dict[int, Seeds]
    tiny: dict[bytes, list[int]]

    @classmethod
    def build(cls, ids: list, texts: pa.Array) -> Block:
        parts = list(text_tokens(as_strings(texts)))
        hashes = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint64)
        counts = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        owner = np.repeat(np.arange(len(counts)), counts)

        def of(h: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> Seeds | None:
            mine = chosen[owner[at]]
            h, at = h[mine], at[mine]
            return Seeds.build([(h, owner[at], at - starts[owner[at]])]) if len(h) else None

        found = {m: of(*seeds(hashes, counts, m, salt), counts >= LONG) for salt, m in enumerate(MASKS)}
        found |= {m: of(*seeds(hashes, counts, m, len(MASKS) + k), (counts >= SHORT) & (counts < LONG)) for k, m in enumerate(SHORT_MASKS)}
        runs = {n: of(*_whole(hashes, counts, n), counts == n) for n in range(RUN, SHORT)}
        tiny: dict[bytes, list[int]] = {}
        for i in np.flatnonzero((counts > 0) & (counts < RUN)):
            tiny.setdefault(hashes[starts[i] : starts[i + 1]].tobytes(), []).append(int(i))
        return cls(ids, hashes, starts, {m: x for m, x in found.items() if x}, {n: x for n, x in runs.items() if x}, tiny)

    def judge(self, hashes: np.ndarray, counts: np.ndarray) -> dict[int, dict[int, tuple[int, int, int]]]:
        """For each row with overlaps: item -> (tokens of the overlap, agreeing tokens, first token in the row)."""
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        owner = np.repeat(np.arange(len(counts)), counts)
        out: dict[int, dict[int, tuple[int, int, int]]] = {}
        tried = []
        for salt, mask in enumerate((*MASKS, *SHORT_MASKS)):
            if known := self.seeds.get(mask):
                for at, seed in known.pairs(*seeds(hashes, counts, mask, salt)):
                    rows = owner[at]
                    tried.append(np.unique(np.stack([rows, known.item[seed], at - offsets[rows] - known.at[seed]], axis=1), axis=0))
        for row, item, shift in np.unique(np.concatenate(tried), axis=0) if tried else ():
            there = self.hashes[self.starts[item] : self.starts[item + 1]]
            first, last = max(0, -shift), min(len(there), counts[row] - shift)
            at = offsets[row] + shift
            equal = np.zeros(len(there), dtype=bool)
            equal[first:last] = there[first:last] == hashes[at + first : at + last]
            a, b = longest_overlap(equal)
            if b - a >= min(LEAST_OVERLAP, round(SIMILARITY * len(there))) and b - a > out.get(int(row), {}).get(int(item), (0,))[0]:
                out.setdefault(int(row), {})[int(item)] = (int(b - a), int(equal[a:b].sum()), int(shift + a))
        for n, known in self.runs.items():
            for at, seed in known.pairs(*_whole(hashes, counts, n)):
                for place, item in zip(at.tolist(), known.item[seed].tolist(), strict=True):
                    if (self.hashes[self.starts[item] : self.starts[item + 1]] == hashes[place : place + n]).all():
                        row = int(owner[place])
                        out.setdefault(row, {}).setdefault(item, (n, n, int(place - offsets[row])))
        if self.tiny:
            for row in np.flatnonzero((counts > 0) & (counts < RUN)):
                for item in self.tiny.get(hashes[offsets[row] : offsets[row + 1]].tobytes(), ()):
                    out.setdefault(int(row), {})[item] = (int(counts[row]),) * 2 + (0,)
        return out


OVERLAP_TYPE = "array<struct<item_id:bigint,tokens:int,agreeing:int,at_token:int>>"
_OVERLAPS = pa.list_(pa.struct([("item_id", pa.int64()), ("tokens", pa.int32()), ("agreeing", pa.int32()), ("at_token", pa.int32())]))


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark in blocks; the driver holds one at a time."""
    ids, texts, size = [], [], 0
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t"))
    for r in rows.toLocalIterator():
        ids.append(r.i), texts.append(r.t)
        size += (len(r.t) // 2 + 1) * _SEED_BYTES  # a token takes two characters at least
        if size >= most:
            yield Block.build(ids, pa.array(texts, pa.string()))
            ids, texts, size = [], [], 0
    if ids:
        yield Block.build(ids, pa.array(texts, pa.string()))


def _found_by(block: Block, texts: pa.Array) -> list[list[dict]]:
    """The overlaps of each text with the items of one block, in order of item."""
    found: list[list[dict]] = [[] for _ in range(len(texts))]
    for row, hashes, counts in text_tokens(texts):
        for i, items in block.judge(hashes, counts).items():
            found[row + i] = sorted(
                ({"item_id": block.ids[k], "tokens": n, "agreeing": m, "at_token": at} for k, (n, m, at) in items.items()),
                key=lambda x: (x["item_id"] is not None, x["item_id"] or 0, x["at_token"]),
            )
    return found


def overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", to: str = "overlaps", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` with an array of the items that each contains, in order of item."""
    docs = without(docs, to)
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T._parse_datatype_string(OVERLAP_TYPE))])
    context = docs.sparkSession.sparkContext
    queue = blocks(benchmark, most=block_bytes)
    block, after = next(queue, None), next(queue, None)
    if block is None:
        return docs.withColumn(to, F.array().cast(OVERLAP_TYPE))
    if after is None:
        only = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _found_by(only.value, as_strings(batch.column(batch.schema.get_field_index(text_col))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _OVERLAPS)], schema.names)

        return docs.mapInArrow(run, schema)

    row = fresh(docs.columns, "_row")
    numbered = scratch.written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", "zstd")
    parts = None
    while block is not None:
        shipped = context.broadcast(block)

        def hits(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _found_by(shipped.value, as_strings(batch.column(1)))
                some = [i for i, x in enumerate(found) if x]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int64())), pa.array([found[i] for i in some], _OVERLAPS)], ["row", "found"])

        part = scratch.written(numbered.select(row, text_col).mapInArrow(hits, f"row bigint, found {OVERLAP_TYPE}"), "overlaps")
        shipped.unpersist()
        parts = part if parts is None else parts.unionByName(part)
        block, after = after, next(queue, None)
    merged = parts.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    joined = numbered.join(merged.withColumnRenamed("row", "_hit").withColumnRenamed("found", "_found"), F.col(row) == F.col("_hit"), "left")
    return joined.select(*docs.columns, F.coalesce("_found", F.array().cast(OVERLAP_TYPE)).alias(to))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    to = fresh(docs.columns, "_overlaps")
    return overlaps(docs, benchmark, to=to).where(F.size(to) == 0).drop(to)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each document: contaminated, number of items, their identifiers, longest overlap and its agreeing tokens."""
    found = overlaps(docs.select("doc_id", "text"), benchmark).drop("text")
    best = F.array_max(F.transform("overlaps", lambda x: F.struct(x["tokens"].alias("tokens"), x["agreeing"].alias("agreeing"))))
    return found.select(
        "doc_id", (F.size("overlaps") > 0).alias("contaminated"), F.size("overlaps").cast("bigint").alias("n_items"),
        F.array_join(F.transform("overlaps", lambda x: x["item_id"].cast("string")), ",", "null").alias("items"),
        F.coalesce(best["tokens"], F.lit(0)).cast("bigint").alias("overlap_tokens"), F.coalesce(best["agreeing"], F.lit(0)).cast("bigint").alias("agreeing_tokens"),
    )
