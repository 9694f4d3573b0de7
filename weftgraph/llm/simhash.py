"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64-bit SimHashes of word shingles. The anchors are the code words of a covering
code: two binary Golay codes side by side on the first 46 bits. The Golay code is perfect, so
each half of a fingerprint lies within distance 3 of exactly one code word, its home anchor.
A fingerprint is stored at its home anchor and replicated to every anchor within the covering radius plus
the threshold that can be home to a fingerprint within the threshold: its own, and those at
distance at most 3 + 2 in one half or 3 + 1 in both (68 of 16.7 million anchors on average).
So two fingerprints within the threshold always meet at the home anchor of either, and are compared there.
For thresholds 3 and 4 the same anchors serve: a fingerprint halfway between two such fingerprints is within
2 bits of both, so its home anchor holds both; there all members are compared, not only with those at home.

Only distinct fingerprints take part: equal ones are one row with a count, so thousands of
copies never meet. At an anchor, linked fingerprints are reduced to a spanning forest before any
leave, so a group of n close fingerprints gives n - 1 links and not n squared. The
forests of all anchors are joined to components by hooking to the smallest neighbour, in rounds that are
written to the shared folder.

Cases: a null or wordless text has fingerprint zero, which is linked like any other; fewer words than
a shingle are one shingle; rows with equal identifiers are judged each for itself; a
component without any identifier has a null component; an empty table returns no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph import scratch
from weftgraph.llm.textcols import as_strings, fresh, without
from weftgraph.operators.components import components

SHINGLE, THRESHOLD, SEED = 3, 2, 42
#: Bits that replication allows for, and the largest threshold, which two replicas share.
REACH, MOST_THRESHOLD = 2, 4
#: Replicated fingerprints that one task compares, about.
TASK_ROWS = 400_000
#: Rows to be dropped whose numbers are broadcast; more are joined.
MOST_BROADCAST = 2_000_000
#: Pairs compared at once.
_PAIRS = 1 << 21

# The binary Golay code: length, dimension, and the coefficients of its generator polynomial (fixed value).
_LENGTH, _DIMENSION, _GENERATOR = 23, 12, 0b101011100011


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's word shingles in order, none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)


def folded(h: np.ndarray) -> int:
    """SimHash of hashes: a bit is 1 if it is set in over half of them."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        counts += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(h))))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the text's word shingles; zero for a text without words."""
    return folded(hashes(text, shingle))


def with_fingerprints(df: DataFrame, text_col: str = "text", shingle: int = SHINGLE, to: str = "fp", keep_text: bool = False) -> DataFrame:
    """Adds the fingerprint as a signed long and drops the text unless asked for."""
    df = without(df, to)
    fields = [f for f in df.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*fields, T.StructField(to, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            found = np.array([fingerprint(t.as_py(), shingle) for t in as_strings(batch.column(at))], dtype=np.uint64).view(np.int64)
            names = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(found)], [*names, to])

    return df.mapInArrow(run, schema)


def _syndromes(values: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit value by the generator polynomial."""
    out = values.astype(np.uint32).copy()
    for bit in range(_LENGTH - 1, _LENGTH - _DIMENSION - 1, -1):
        out ^= ((out >> np.uint32(bit)) & np.uint32(1)) * np.uint32(_GENERATOR << (bit - (_LENGTH - _DIMENSION)))
    return out


@functools.cache
def _code() -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For each syndrome: the error of the nearest code word, and the flips to the code words within 4 and within 5.

    Adding any of these to a value gives a code word, so all three depend on the syndrome alone.
    """
    single = np.uint32(1) << np.arange(_LENGTH, dtype=np.uint32)
    pairs = np.array([a ^ b for i, a in enumerate(single) for b in single[:i]], dtype=np.uint32)
    triples = np.unique(np.array([p ^ s for p in pairs for s in single if not p & s], dtype=np.uint32))
    errors = np.concatenate([np.zeros(1, np.uint32), single, pairs, triples])
    nearest = np.zeros(1 << (_LENGTH - _DIMENSION), np.uint32)
    nearest[_syndromes(errors)] = errors
    by_one, by_two = [], []
    for s in range(len(nearest)):
        value = nearest[s]  # a value with this syndrome
        home = np.uint32(0)
        reach = lambda flips: np.unique((value ^ flips) ^ nearest[_syndromes(value ^ flips)])  # noqa: B023, E731  code words at home to what flips reach
        one = reach(single)
        two = np.setdiff1d(reach(pairs), np.append(one, home))
        one = np.setdiff1d(one, [home])
        by_one.append(one ^ value), by_two.append(two ^ value)
    return nearest, by_one, by_two


@functools.cache
def _tables():
    nearest, by_one, by_two = _code()
    pad = lambda rows: np.array([np.pad(r, (0, max(map(len, rows)) - len(r)), constant_values=np.uint32(0xFFFFFFFF)) for r in rows], dtype=np.uint32)
    return nearest, pad(by_one), pad(by_two)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, whether it is the row's home) for every anchor where a fingerprint must be: homes of all within 2 bits of it."""
    nearest, by_one, by_two = _tables()
    mask = np.uint64((1 << _LENGTH) - 1)
    halves = [(fps & mask).astype(np.uint32), ((fps >> np.uint64(_LENGTH)) & mask).astype(np.uint32)]
    syndromes = [_syndromes(h) for h in halves]
    home = [h ^ nearest[s] for h, s in zip(halves, syndromes, strict=True)]
    none = np.uint32(0xFFFFFFFF)
    near = [np.where(by_one[s] == none, none, h[:, None] ^ by_one[s]) for h, s in zip(halves, syndromes, strict=True)]
    far = [np.where(by_two[s] == none, none, h[:, None] ^ by_two[s]) for h, s in zip(halves, syndromes, strict=True)]
    n = len(fps)
    row = np.arange(n)
    rows, found = [row], [home[0].astype(np.uint64) | home[1].astype(np.uint64) << np.uint64(_LENGTH)]

    def put(low: np.ndarray, high: np.ndarray) -> None:
        low, high = np.broadcast_arrays(low, high)
        good = (low != none) & (high != none)
        rows.append(np.broadcast_to(row.reshape(-1, *[1] * (low.ndim - 1)), low.shape)[good])
        found.append(low[good].astype(np.uint64) | high[good].astype(np.uint64) << np.uint64(_LENGTH))

    for low, high in ((near[0], home[1][:, None]), (far[0], home[1][:, None]), (home[0][:, None], near[1]), (home[0][:, None], far[1])):
        put(low, high)
    put(near[0][:, :, None], near[1][:, None, :])
    return np.concatenate(rows), np.concatenate(found), np.concatenate([np.ones(n, bool), *(np.zeros(len(r), bool) for r in rows[1:])])


def _forest(fps: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between positions of ``fps`` as (fingerprint, smallest of its component), without the smallest itself."""
    label = np.arange(len(fps))
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def _compared(fps: np.ndarray, at: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest links of all fingerprints that meet at their anchors and differ in at most ``threshold`` bits."""
    order = np.lexsort((~home, at))
    fps, at, home = fps[order], at[order], home[order]
    distinct, position = np.unique(fps, return_inverse=True)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    sizes = np.diff(np.append(starts, len(at)))
    homes = np.add.reduceat(home, starts, dtype=np.int64) if threshold <= REACH else sizes
    busy = (homes > 0) & (sizes > 1)
    starts, sizes, homes = starts[busy], sizes[busy], homes[busy]
    left_found, right_found = [], []

    def test(left: np.ndarray, right: np.ndarray) -> None:
        good = (np.bitwise_count(fps[left] ^ fps[right]) <= threshold) & (left != right)
        left_found.append(position[left[good]])
        right_found.append(position[right[good]])

    cost = sizes * homes
    small = cost <= _PAIRS
    block, total = [], 0
    small_groups = np.flatnonzero(small)
    cuts = np.searchsorted(np.cumsum(cost[small]), np.arange(_PAIRS, int(cost[small].sum()) + _PAIRS, _PAIRS), side="right") if small.any() else []
    begin = 0
    for cut in dict.fromkeys([*map(int, cuts), len(small_groups)]):
        g = small_groups[begin:cut]
        begin = max(begin, cut)
        if not len(g):
            continue
        n = cost[g]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        base, size = np.repeat(starts[g], n), np.repeat(sizes[g], n)
        test(base + inner // size, base + inner % size)
    for g in np.flatnonzero(~small):  # a crowded anchor: by pigeonhole, close fingerprints agree in one of the bands
        members = np.arange(starts[g], starts[g] + sizes[g])
        edges = np.linspace(0, 64, threshold + 2).astype(int)
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            band = (fps[members] >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
            o = members[np.argsort(band, kind="stable")]
            sorted_band = np.sort(band)
            step = 1
            # Compare each with the next ones of its band run, one distance at a time.
            while step < len(o):
                same = np.flatnonzero(sorted_band[step:] == sorted_band[:-step])
                if not len(same):
                    break
                test(o[same], o[same + step])
                step += 1
    if not left_found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _forest(distinct, np.concatenate(left_found), np.concatenate(right_found))


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) forest links between distinct fingerprints (one column ``fp``) at most ``threshold`` bits apart."""
    if threshold > MOST_THRESHOLD:
        raise ValueError(f"the anchors are laid out for thresholds up to {MOST_THRESHOLD}")
    spark = fps.sparkSession

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(values), 20_000):
                part = values[i : i + 20_000]
                row, at, home = anchors(part)
                yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(part[row].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches]
        if parts:
            at, fp, home = (np.concatenate(c) for c in zip(*parts, strict=True))
            a, b = _compared(fp.view(np.uint64), at.view(np.uint64), home, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-68 * fps.count() // TASK_ROWS))
    spread_out = fps.repartition(max(1, n_tasks // 8)).mapInArrow(spread, "anchor bigint, fp bigint, home boolean")
    return spread_out.repartition(n_tasks, "anchor").mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``df`` without the text, with ``fp`` and ``component_id``, the smallest identifier of the component."""
    marked = scratch.written(with_fingerprints(without(df, "component_id", "_fp"), text_col, shingle), "simhash")
    groups = scratch.written(marked.groupBy("fp").agg(F.min(id_col).alias("low")), "fps")
    found = components(links(groups.select("fp"), threshold), "a", "b")  # (node, root) of linked fingerprints only
    rooted = groups.join(found, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = rooted.join(lowest, "root").select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(of_fp, F.col("fp") == F.col("_fp"), "left").drop("_fp")


def others(rows: DataFrame, group: list, row: str) -> DataFrame:
    """The row numbers of all rows but the first of each group: that with the smallest ``_id``, null only if none has one."""
    first = F.min(F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col(row).alias("row")))
    stay = rows.groupBy(*group).agg(first.alias("first")).select(F.col("first.row").alias(row))
    return rows.select(row).join(stay, row, "left_anti")


def less(table: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """The table without some rows; it is not shuffled for up to ``MOST_BROADCAST`` of them."""
    return table.join(F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone, row, "left_anti")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", then: Callable | None = None, **options) -> DataFrame:
    """One document of each component: that with the smallest identifier (of equal rows one; nulls only if none has one).

    ``then`` thins out the rows that stay further: given these (``_id``, ``_text``, ``_row``), it returns the row numbers that go.
    """
    spark, row = docs.sparkSession, fresh(docs.columns, "_row")
    numbered = scratch.written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", "zstd")
    short = numbered.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(row).alias("_row"))

    def repeated() -> DataFrame:
        found = near_duplicates(short, "_id", "_text", **options)
        # A component without identifiers is told apart by its fingerprint.
        return others(found, [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp"))], "_row")

    gone = scratch.settled(spark, "gone", repeated)
    if then is not None:
        rest = less(short, gone, "_row")
        gone = gone.unionByName(scratch.settled(spark, "gone", lambda: then(rest)))
    return less(numbered, gone.withColumnRenamed("_row", row), row).drop(row)


def report(docs: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
