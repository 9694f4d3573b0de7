"""Exact document fingerprints: canonical form, wide hash, byte comparison inside equal buckets.

The canonical form of a text is NFKC, case folded, NFKC again, with every run of white space
as one space and none at the ends. Its fingerprint is the 128-bit XXH3 hash. Texts whose hashes
are equal are then compared byte by byte: the canonical texts of a bucket are reduced to
their smallest and largest (a partial aggregate, so a huge group sends one pair for each task),
and only a bucket where these differ, a true collision, is numbered, which adds ``-1``, ``-2`` and
so on to the fingerprints of all but its first text.

Only texts in buckets of two or more need comparing. They are found with a Bloom filter of a
fixed largest size; a false hit sends one more text and changes no result.

For the comparison with the next document, rows are sorted by identifier over range partitions,
so each text moves once. Only the last document of a partition needs another one's first; these
pairs, one for each partition, are joined afterwards.

Cases: a null text is the empty text; null identifiers come last; rows with the same identifier
are ordered by the hash of their text; equal rows stay as many rows; an empty table
returns no rows; a table of one document is its own next document.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph import scratch
from weftgraph.llm.textcols import mix, without

#: Largest Bloom filter of repeated fingerprints that is broadcast, in bytes.
FILTER_BYTES = 32 << 20
#: Bytes of text that one task sorts, about.
PART_BYTES = 64 << 20


def canonical(text: str | None) -> str:
    """The form whose bytes decide equality."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def wide_hash(data: bytes, bits: int = 128) -> str:
    """XXH3 of the bytes as hexadecimal digits; fewer bits only serve tests of collisions."""
    return xxhash.xxh3_128_hexdigest(data)[: bits // 4]


def _bloom_slots(keys: list[str], size: int) -> np.ndarray:
    """Four bit positions for each hexadecimal key."""
    h = np.array([int(k[:16].ljust(16, "0"), 16) for k in keys], dtype=np.uint64)
    return np.concatenate([(mix(h + np.uint64(i)) % np.uint64(size * 8)).astype(np.int64) for i in range(4)]).reshape(4, -1)


def numbered(texts: DataFrame, bits: int = 128, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Buckets with different canonical texts: (hash, sha, number), one row for each such text.

    ``texts`` has a column ``text``. Without a collision the result is empty.
    """
    spark = texts.sparkSession

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([wide_hash(canonical(t.as_py()).encode("utf-8", "surrogatepass"), bits) for t in batch.column(0)], pa.string())], ["hash"])

    repeated = texts.select("text").mapInArrow(hashes, "hash string").groupBy("hash").count().where("count > 1")
    repeated = scratch.written(repeated, "repeated")
    n = repeated.count()
    size = max(1024, min(filter_bytes, 2 * n))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits_set = np.zeros(size, dtype=np.uint8)
        for batch in batches:
            at = _bloom_slots(batch.column(0).to_pylist(), size).ravel()
            np.bitwise_or.at(bits_set, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits_set.tobytes()], pa.binary())], ["bits"])

    table = np.zeros(size, dtype=np.uint8)
    for row in repeated.select("hash").coalesce(4).mapInArrow(slots, "bits binary").toLocalIterator():
        table |= np.frombuffer(row.bits, dtype=np.uint8)
    shipped = spark.sparkContext.broadcast(table)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canonical(t.as_py()).encode("utf-8", "surrogatepass") for t in batch.column(0)]
            keys = [wide_hash(f, bits) for f in forms]
            at = _bloom_slots(keys, size) if keys else np.zeros((4, 0), np.int64)
            hit = ((shipped.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)
            chosen = dict.fromkeys((keys[i], forms[i]) for i in np.flatnonzero(hit))  # equal texts of a batch are one
            pack = zstandard.ZstdCompressor(level=1)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in chosen], pa.string()), pa.array([pack.compress(f) for _, f in chosen], pa.binary())], ["hash", "form"])

    # Equal canonical bytes compress to equal bytes, and different ones to different bytes.
    pairs = texts.select("text").mapInArrow(members, "hash string, form binary")
    spread = pairs.groupBy("hash").agg(F.min("form").alias("low"), F.max("form").alias("high")).where("low <> high")
    clashing = scratch.written(spread.select("hash"), "clashing")
    if not clashing.take(1):
        return spark.createDataFrame([], "hash string, sha string, number int")

    def shas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unpack = zstandard.ZstdDecompressor()
            found = [hashlib.sha256(unpack.decompress(x.as_py())).hexdigest() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["hash", "sha"])

    distinct = pairs.join(clashing, "hash", "left_semi").mapInArrow(shas, "hash string, sha string").distinct()
    return distinct.withColumn("number", F.row_number().over(Window.partitionBy("hash").orderBy("sha")) - 1)


def fingerprints(df: DataFrame, text_col: str = "text", bits: int = 128) -> DataFrame:
    """The rows of ``df`` with ``fingerprint``; equal canonical texts and only they share one."""
    df = without(df, "fingerprint", "_hash", "_sha")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canonical(t.as_py()).encode("utf-8", "surrogatepass") for t in batch.column(batch.schema.get_field_index(text_col))]
            extra = [pa.array([wide_hash(f, bits) for f in forms], pa.string()), pa.array([hashlib.sha256(f).hexdigest() for f in forms], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "_hash", "_sha"])

    schema = T.StructType([*df.schema.fields, T.StructField("_hash", T.StringType()), T.StructField("_sha", T.StringType())])
    hashed = df.mapInArrow(run, schema)
    return _with_numbers(hashed, numbered(df.select(F.col(text_col).alias("text")), bits), "_hash", "_sha", "fingerprint").drop("_hash", "_sha")


def _with_numbers(df: DataFrame, numbers: DataFrame, hash_col: str, sha_col: str, to: str) -> DataFrame:
    if not numbers.take(1):
        return df.withColumn(to, F.col(hash_col))
    n = numbers.select(F.col("hash").alias("_h"), F.col("sha").alias("_s"), "number")
    joined = df.join(n, (F.col(hash_col) == F.col("_h")) & (F.col(sha_col) == F.col("_s")), "left")
    suffix = F.when(F.col("number") > 0, F.concat(F.lit("-"), F.col("number").cast("string"))).otherwise("")
    return joined.withColumn(to, F.concat(F.col(hash_col), suffix)).drop("_h", "_s", "number")


_ROW = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "hash": pa.string(), "sha": pa.string(), "edited_hash": pa.string(),
    "edited_form_sha": pa.string(), "next_hash": pa.string(), "next_sha": pa.string(), "kind": pa.int32(), "part": pa.int32(), "packed": pa.binary(),
}
_ROW_SCHEMA = ", ".join(f"{k} {'bigint' if t == pa.int64() else 'int' if t == pa.int32() else 'binary' if t == pa.binary() else 'string'}" for k, t in _ROW.items())
_DONE, _FIRST, _LAST = 0, 1, 2


def _encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _row(doc_id: int | None, text: str) -> dict:
    form = _encoded(canonical(text))
    return dict.fromkeys(_ROW) | {"doc_id": doc_id, "n_chars": len(text), "hash": wide_hash(form), "sha": hashlib.sha256(form).hexdigest()}


def _paired(row: dict, text: str, after: dict, after_text: str) -> dict:
    """The finished row of a document, given the document after it."""
    half = row["n_chars"] // 2
    new = text[: row["n_chars"] - half] + after_text[:half]
    form = _encoded(canonical(new))
    return row | {
        "edited_sha256": hashlib.sha256(_encoded(new)).hexdigest(), "edited_hash": wide_hash(form), "edited_form_sha": hashlib.sha256(form).hexdigest(),
        "next_hash": after["hash"], "next_sha": after["sha"], "kind": _DONE, "packed": None,
    }


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in _ROW.items()], list(_ROW))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished rows of one sorted partition; its first and last rows also with their texts."""
    part = TaskContext.get().partitionId()
    press = zstandard.ZstdCompressor(level=3)
    before, text = None, ""
    for batch in batches:
        rows = []
        for doc_id, value in zip(batch.column(0), batch.column(1), strict=True):
            now = value.as_py()
            row = _row(doc_id.as_py(), now)
            if before is None:
                rows.append(row | {"kind": _FIRST, "part": part, "packed": press.compress(_encoded(now))})
            else:
                rows.append(_paired(before, text, row, now))
            before, text = row, now
        if rows:
            yield _batch(rows)
    if before is not None:
        yield _batch([before | {"kind": _LAST, "part": part, "packed": press.compress(_encoded(text))}])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finishes the last row of each partition with the first row of the one after."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            text, after_text = (unpack.decompress(r[k]).decode("utf-8", "surrogatepass") for k in ("packed", "after_packed"))
            rows.append(_paired({k: r[k] for k in _ROW}, text, {"hash": r["after_hash"], "sha": r["after_sha"]}, after_text))
        if rows:
            yield _batch(rows)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of _ROW_SCHEMA: each document with its edited text's digests and the next document's."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = (F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    found = scratch.written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_edited, _ROW_SCHEMA), "digests")
    firsts, lasts = found.where(F.col("kind") == _FIRST), found.where(F.col("kind") == _LAST)
    # One row for each partition that has rows; after the last of these comes the first.
    parts = firsts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("after"))
    after = firsts.select(F.col("part").alias("after"), F.col("hash").alias("after_hash"), F.col("sha").alias("after_sha"), F.col("packed").alias("after_packed"))
    ends = lasts.join(parts, "part").join(after, "after").select(*_ROW, "after_hash", "after_sha", "after_packed").mapInArrow(_across, _ROW_SCHEMA)
    return found.where(F.col("kind") == _DONE).unionByName(ends)


def report(docs: DataFrame) -> DataFrame:
    """The contract's row for each document; likeness of exact digests is 1 if equal, else 0."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    numbers = numbered(docs)
    rows = with_next(docs)
    rows = _with_numbers(rows, numbers, "hash", "sha", "fingerprint")
    rows = _with_numbers(rows, numbers, "edited_hash", "edited_form_sha", "edited_fingerprint")
    # Equal hashes of an edited text and another are the same text only if their SHA-256 is equal too.
    like = lambda h, sha: F.when((F.col("hash") == F.col(h)) & (F.col("sha") == F.col(sha)), 1.0).otherwise(0.0)
    near = like("edited_hash", "edited_form_sha").alias("near_edited"), like("next_hash", "next_sha").alias("near_next")
    edited = F.when((F.col("hash") == F.col("edited_hash")) & (F.col("sha") != F.col("edited_form_sha")), F.concat("edited_fingerprint", F.lit("-edited"))).otherwise(F.col("edited_fingerprint"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", edited.alias("edited_fingerprint"), *near)
