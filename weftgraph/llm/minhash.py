"""Near-duplicates by b-bit MinHash: exact links of word-shingle sets of at least ``LEAST`` hundredths of Jaccard similarity.

A document's set are its distinct five-word shingles; documents with equal sets are one unit. A unit has ``BANDS * ROWS`` MinHashes. Rows
of them make the keys of bands, in which candidates meet; of each minimum the lowest ``BITS`` bits are kept and packed into a signature.
Two signatures are compared by counting equal places: of sets of similarity J, a share of C + (1 - C) J agrees, where C = 2**-BITS of unequal
minima collide. A candidate goes on to the comparison of full sets if its count is not below ``FEWEST``, which a pair of the
wanted similarity misses once in 10**10. A pair of just that similarity shares a band but for 7 in 10**7, one of 0.9 but for 2 in 10**10.

Buckets of any size are met in three steps, none of which holds a whole bucket:
1. Stars: every unit is compared with the smallest unit of each of its buckets, first by signature. Copies of one text are joined by this.
2. In buckets whose units are then of several groups, signatures meet in blocks of ``SIGNATURES``; a unit stays if it is
   close enough to one of another group. What comes out is units, not pairs.
3. The units that stay meet by full sets in blocks of ``SETS``, block against block; what is in one group already is not compared again.
Only keys that two units have are shuffled with their units, by a Bloom filter of bounded size, and buckets with the same units are one, before and after step 2.
A group needs no more links than hold it together, so a group of n gives n - 1 and not n squared.

Cases: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer words than a shingle are one
shingle; of rows with equal texts all are in one component; a component's identifier is its smallest one, null if no row has any, and ``kept`` is then null;
an empty table returns no rows; other columns are not read; sets of any size are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph import scratch
from weftgraph.llm import bloom
from weftgraph.llm.textcols import as_strings, lower_ascii, mix, row_chunks, token_hashes, tokens
from weftgraph.operators.components import components

SHINGLE, LEAST = 5, 85
BANDS, ROWS, BITS = 30, 6, 2
#: Equal places of two signatures, of ``BANDS * ROWS``, below which a pair is no candidate.
FEWEST = 129
#: Signatures, and full sets, of a block that meets another in one task.
SIGNATURES, SETS = 4096, 256
#: Units whose numbers are broadcast to find their texts; of more, texts are shuffled.
MOST_BROADCAST = 2_000_000
_PLACES = BANDS * ROWS
_WORDS = -(-_PLACES * BITS // 64)

#: Odd factors of the MinHashes.
_FACTORS = np.random.default_rng(13).integers(0, 1 << 63, _PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(strings: pa.Array, shingle: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, hashes per row) of slices of a string array: each row's distinct shingles in order of their hashes."""
    for row, raw, offsets in row_chunks(strings):
        low = lower_ascii(raw)
        starts, ends, counts = tokens(low, offsets)
        h, first = token_hashes(low, starts, ends), np.cumsum(counts) - counts
        n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        size = np.repeat(np.minimum(counts, shingle), n)
        out = size.astype(np.uint64)
        for i in range(shingle):  # of a text with fewer words only as many places as it has
            here = i < size
            out[here] = mix(out[here] * np.uint64(0x9E3779B97F4A7C15) + h[at[here] + i])
        owner = np.repeat(np.arange(len(counts)), n)
        order = np.lexsort((out, owner))
        out, owner = out[order], owner[order]
        new = np.ones(len(out), bool)
        new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
        yield row, out[new], np.bincount(owner[new], minlength=len(counts))


def minima(h: np.ndarray) -> np.ndarray:
    """The MinHashes of a set."""
    low = np.full(_PLACES, np.iinfo(np.uint64).max)
    for i in range(0, len(h), 64):
        np.minimum(low, (h[i : i + 64, None] * _FACTORS).min(axis=0), out=low)
    return mix(low)


def band_keys(low: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = mix(key ^ column) + column
    return key


def packed(low: np.ndarray) -> np.ndarray:
    """The lowest bits of the minima, in words of 64 bits."""
    bits = np.zeros(_WORDS * 64 // BITS, np.uint64)
    bits[:_PLACES] = low & np.uint64((1 << BITS) - 1)
    each = 64 // BITS
    return np.bitwise_or.reduce(bits.reshape(-1, each) << (np.arange(each, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def equal_places(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """How many places of a packed signature agree with each of many, by bit counts."""
    differ = one ^ many
    folded = differ.copy()
    for i in range(1, BITS):
        folded |= differ >> np.uint64(i)
    lowest = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    return _PLACES - np.bitwise_count(folded & lowest).sum(axis=-1, dtype=np.int64)


def estimate(equal: np.ndarray) -> np.ndarray:
    """Similarity for a number of equal places, corrected for low bits that agree by chance."""
    chance = 2.0**-BITS
    return (equal / _PLACES - chance) / (1 - chance)


def similar(one: np.ndarray, other: np.ndarray, least: int = LEAST) -> bool:
    """Whether two sorted sets have at least that many hundredths of Jaccard similarity."""
    small, large = sorted((len(one), len(other)))
    if 100 * small < least * large:
        return False
    shared = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * shared >= least * (small + large - shared)


def _marked(rows: DataFrame) -> DataFrame:
    """(id, row, text, n, h1, h2, keys, signature) of (id, row, text); ``h1`` and ``h2`` are a digest of the set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, keys, signatures, sizes = [], [], [], []
            for _, h, counts in shingle_sets(as_strings(batch.column(2))):
                ends = np.cumsum(counts).tolist()
                for begin, end in zip([0, *ends[:-1]], ends, strict=True):
                    own = h[begin:end]
                    sizes.append(len(own))
                    if not len(own):
                        digests.append((None, None)), keys.append(None), signatures.append(None)
                        continue
                    low = minima(own)
                    digests.append(tuple(int(mix(own ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64)) for salt in (1, 2)))
                    keys.append(band_keys(low).view(np.int64)), signatures.append(packed(low).tobytes())
            columns = [pa.array(sizes, pa.int64()), *(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)), pa.array(keys, pa.list_(pa.int64())), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["_id", "_row", "_text", "n", "h1", "h2", "keys", "signature"])

    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {id_type}, _row bigint, _text string, n bigint, h1 bigint, h2 bigint, keys array<bigint>, signature binary")


def _sets(rows: DataFrame) -> DataFrame:
    """(unit, set) of (unit, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, h, counts in shingle_sets(as_strings(batch.column(1))):
                ends = np.cumsum(counts).tolist()
                found += [h[b:e].tobytes() for b, e in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["unit", "set"])

    return rows.mapInArrow(run, "unit bigint, set binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Of candidates (a, b) those whose full sets are similar. Partners of one ``a`` are dealt in blocks of about ``SETS``, with its set in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, _, unit, value in _by_task(batches):
            held = [np.frombuffer(v, np.uint64) for v in value]  # the first one is that of ``a``
            good = [i for i in range(1, len(held)) if similar(held[0], held[i], least)]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([unit[i] for i in good], pa.int64())], ["a", "b"])

    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / SETS).alias("parts"))
    dealt = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("block"), F.lit(1).alias("side"), F.col("b").alias("unit"))
    centres = dealt.select("a", "block").distinct().select("a", "block", F.lit(0).alias("side"), F.col("a").alias("unit"))
    rows = dealt.unionByName(centres).join(sets, "unit").select(F.concat_ws(" ", "a", "block").alias("task"), "a", "side", "unit", "set")
    return rows.repartition("task").sortWithinPartitions("task", "side").mapInArrow(run, "a bigint, b bigint")


def _close(pairs: DataFrame, signatures: DataFrame, fewest: int) -> DataFrame:
    """Of candidates (a, b) those whose signatures agree in enough places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, _WORDS) for c in batch.columns[2:])
            good = pa.array(equal_places(one, other) >= fewest)
            yield pa.RecordBatch.from_arrays([c.filter(good) for c in batch.columns[:2]], ["a", "b"])

    left, right = (signatures.select(F.col("unit").alias(c), F.col("signature").alias(f"{c}_signature")) for c in "ab")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "a_signature", "b_signature").mapInArrow(run, "a bigint, b bigint")


def _met(members: DataFrame, size: int, values: DataFrame) -> DataFrame:
    """(task, side, unit, root, bucket, value) of members (bucket, unit, root) with their values (unit, value): the members of each bucket in blocks of about ``size``, each block with each.

    ``side`` is 0 for the first block of a task, 1 for the second, and 2 where a block meets itself. Values come last, so that they move to their tasks only.
    """
    parts = F.ceil(F.col("n") / size)
    dealt = members.join(members.groupBy("bucket").agg(F.count("*").alias("n")), "bucket").withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("unit", "bucket"), "parts"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    dealt_out = other.select(F.struct("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).alias("task"), side.alias("side"), "unit", "root", "bucket")
    return dealt_out.join(values, "unit").select("task", "side", "unit", "root", "bucket", values.columns[1])


def _tasks(met: DataFrame) -> DataFrame:
    """The rows of each task together."""
    return met.withColumn("task", F.xxhash64("task")).repartition("task").sortWithinPartitions("task")


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, ...]]:
    """The columns but the first, which is the task, of each task's rows in turn."""
    task, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != task and held:
                yield tuple(zip(*held, strict=True))
                held = []
            task = row[0]
            held.append(row[1:])
    if held:
        yield tuple(zip(*held, strict=True))


def _near_others(members: DataFrame, signatures: DataFrame, fewest: int) -> DataFrame:
    """(bucket, unit) of the members (bucket, unit, root) that may be similar to one of another group in their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for side, unit, root, bucket, value in _by_task(batches):
            side, root = np.array(side), np.array(root)
            all_of = np.frombuffer(b"".join(value), np.uint64).reshape(-1, _WORDS)
            near = np.zeros(len(unit), bool)
            second = np.flatnonzero(side != 0)
            for i in np.flatnonzero(side != 1).tolist():
                good = (equal_places(all_of[i], all_of[second]) >= fewest) & (root[second] != root[i])
                near[second[good]] = True
                near[i] |= good.any()
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x)[near]) for x in (bucket, unit)], ["bucket", "unit"])

    return _tasks(_met(members, SIGNATURES, signatures)).mapInArrow(run, "bucket bigint, unit bigint").distinct()


def linked(side: np.ndarray, root: np.ndarray, sets: list[np.ndarray], least: int = LEAST) -> list[tuple[int, int]]:
    """Links between members of a task that join groups: pairs of similar sets, at most one for each two groups that become one.

    Sides as in ``_met``. Two members are compared only if their groups are still apart.
    """
    group, found = np.unique(root, return_inverse=True)[1], []
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    first, second = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    for i in first.tolist():
        fit = second[(100 * np.minimum(sizes[second], sizes[i]) >= least * np.maximum(sizes[second], sizes[i]))]
        for j in fit.tolist():
            if group[i] != group[j] and similar(sets[i], sets[j], least):
                found.append((i, j))
                group[group == group[j]] = group[i]
    return found


def _joined(members: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """(a, b) links between the members (bucket, unit, root) of each bucket, compared by full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for side, unit, root, _, value in _by_task(batches):
            pairs = linked(np.array(side), np.array(root), [np.frombuffer(v, np.uint64) for v in value], least)
            yield pa.RecordBatch.from_arrays([pa.array([unit[i] for i, _ in pairs], pa.int64()), pa.array([unit[j] for _, j in pairs], pa.int64())], ["a", "b"])

    return _tasks(_met(members, SETS, sets)).mapInArrow(run, "a bigint, b bigint")


def _maybe_in(units: DataFrame, repeated: DataFrame) -> DataFrame:
    """(key, unit) of units (unit, keys) for all keys of a table and, by a Bloom filter's errors, a few others."""
    shipped = units.sparkSession.sparkContext.broadcast(bloom.build(repeated.select("key"), repeated.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            key, unit = lists.flatten(), batch.column(1).take(pc.list_parent_indices(lists))
            hit = pa.array(bloom.maybe(shipped.value, key.to_numpy(zero_copy_only=False).view(np.uint64)))
            yield pa.RecordBatch.from_arrays([key.filter(hit), unit.filter(hit)], ["key", "unit"])

    return units.select("keys", "unit").mapInArrow(run, "key bigint, unit bigint")


def _one_of_equals(members: DataFrame) -> DataFrame:
    """Members (bucket, unit, ...) without those of buckets whose units are the same as another's."""
    each = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("unit").cast("decimal(38,0)")).alias("h"), F.min("unit").alias("first"))
    return members.join(each.groupBy("n", "h", "first").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket", "left_semi")


def links(units: DataFrame, texts: DataFrame, least: int = LEAST, fewest: int = FEWEST) -> DataFrame:
    """(node, root) of the components of units (unit, keys, signature), whose texts are (unit, text)."""
    keys = units.select(F.explode("keys").alias("key"), "unit")
    repeated = scratch.written(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("unit").alias("low")).where("n > 1").select("key", "low"), "repeated")
    met = scratch.written(_maybe_in(units, repeated).join(repeated, "key").select(F.col("key").alias("bucket"), "unit", "low"), "met")
    members = scratch.written(_one_of_equals(met), "members")  # buckets with the same units, of whatever bands, are one
    stars = members.where("unit <> low").select(F.col("low").alias("a"), F.col("unit").alias("b")).distinct()
    close = scratch.written(_close(stars, units.select("unit", "signature"), fewest), "close")
    ends = close.select(F.explode(F.array("a", "b")).alias("unit")).distinct()
    found = components(_confirmed(close, _sets(_of(texts, ends)), least))
    rooted = members.join(found, F.col("unit") == F.col("node"), "left").select("bucket", "unit", F.coalesce("root", "unit").alias("root"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    apart = scratch.written(rooted.join(mixed, "bucket"), "apart")
    near = _near_others(apart, units.select("unit", "signature"), fewest)
    near = scratch.written(near.join(apart, ["bucket", "unit"]).select("bucket", "unit", "root"), "near")
    few = scratch.written(_one_of_equals(near), "few")
    more = scratch.written(_joined(few, _sets(_of(texts, few.select("unit").distinct())), least), "more")
    if more.isEmpty():
        return found
    return components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def _of(texts: DataFrame, units: DataFrame) -> DataFrame:
    """The texts of some units, which are not shuffled for up to ``MOST_BROADCAST`` of them."""
    wanted = scratch.written(units, "wanted")
    return texts.join(F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted, "unit", "left_semi").select("unit", "text")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, fewest: int = FEWEST) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document."""
    short = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("_text"))
    marked = scratch.written(_marked(short), "marked", "zstd")
    units = marked.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("_row").alias("unit"))
    of_row = scratch.written(marked.select("_id", "_row", "n", "h1", "h2").join(units, ["h1", "h2"], "left").select("_id", "_row", "n", F.coalesce("unit", "_row").alias("unit")), "units")
    first = of_row.where("_row = unit AND n > 0").select("unit")
    of_unit = scratch.written(marked.select(F.col("_row").alias("unit"), "keys", "signature").join(first, "unit"), "signatures")
    found = links(of_unit, marked.select(F.col("_row").alias("unit"), F.col("_text").alias("text")), least, fewest)
    rooted = of_row.join(found, F.col("unit") == F.col("node"), "left").select("_id", "n", F.coalesce("root", "unit").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("_id").alias("component_id"))
    return rooted.join(lowest, "root").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", (F.col("_id") == F.col("component_id")).alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    return near_duplicates(docs)
