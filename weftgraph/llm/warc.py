"""WARC archives as seekable Zstandard bundles.

A bundle is a byte string that any Zstandard reader can read: records are grouped into frames
that decompress on their own, and a skippable frame at the end holds the seek table (sizes of
each frame, frame count, magic number), in the published seekable format. An index maps each
record identifier to its frame and to the offset inside the decompressed frame, so one record
is read by decompressing one frame.

Bundles are written as binary rows of a Parquet table in the shared folder, because that is
what Spark can write to any store; ``export`` copies them to ``.warc.zst`` files.

Of records with equal payloads of at least ``REVISIT_LEAST`` bytes, the one with the smallest
identifier is the response; the others become revisit records without a payload, which name the response's record.
Rows are numbered and written once, so that numbers stay what they are if an executor is lost. Which are revisits
is found from digests alone; payloads move once, by their numbers, so that copies of one page spread over all tasks.

Cases: a null payload is an empty response; a null identifier sorts last and stays null; equal
rows (same identifier and payload) are one response and revisits of it; an empty table gives
no bundles; columns besides identifier, address and payload are not archived.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import scratch

#: Decompressed bytes in a frame and in a bundle, about; a larger record has a frame of its own.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 16 << 20
#: Payloads below this many bytes are always stored.
REVISIT_LEAST = 100
LEVEL = 3

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

BUNDLE_SCHEMA = "bundle_id string, index array<struct<record_id:string,frame:int,offset:int,length:int>>, n_records bigint, bundle binary"
_INDEX_TYPE = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))


@dataclass
class BundleWriter:
    """Collects records into frames; ``finish`` returns the bundle with its seek table."""

    frame_bytes: int = FRAME_BYTES
    out: bytearray = field(default_factory=bytearray)
    frames: list[tuple[int, int]] = field(default_factory=list)
    index: list[tuple[str, int, int, int]] = field(default_factory=list)
    pending: bytearray = field(default_factory=bytearray)
    size: int = 0

    def add(self, record_id: str, record: bytes) -> None:
        if self.pending and len(self.pending) + len(record) > self.frame_bytes:
            self._flush()
        self.index.append((record_id, len(self.frames), len(self.pending), len(record)))
        self.pending += record
        self.size += len(record)

    def _flush(self) -> None:
        if self.pending:
            packed = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress(bytes(self.pending))
            self.out += packed
            self.frames.append((len(packed), len(self.pending)))
            self.pending = bytearray()

    def finish(self) -> bytes:
        self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        return bytes(self.out) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the footer."""
    count, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    at, out = 0, []
    base = len(bundle) - 9 - 8 * count
    for i in range(count):
        packed, plain = struct.unpack_from("<II", bundle, base + 8 * i)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(bundle: bytes, frame: int, table: list[tuple[int, int, int]] | None = None) -> bytes:
    at, packed, plain = (table or seek_table(bundle))[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=max(1, plain))


def read_record(bundle: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record, decompressing only its frame."""
    return read_frame(bundle, frame)[offset : offset + length]


def warc_record(headers: dict[str, str], payload: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in order."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"not a record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        start, n = end + 4, int(headers["Content-Length"])
        if data[start + n : start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has the wrong length")
        yield headers, data[start : start + n]
        at = start + n + 4


def _plain(address: str | None) -> str:
    return " ".join((address or "about:blank").split()) or "about:blank"


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = REVISIT_LEAST) -> DataFrame:
    """Rows (id, url, payload, bytes, digest, refers_to, refers_row, revisit, row); a revisit's payload is null."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("bytes", F.octet_length("payload").cast("bigint"))
    rows = scratch.written(rows.withColumn("digest", F.sha2(F.encode("payload", "UTF-8"), 256)), "numbered", "zstd")
    large = rows.where(F.col("bytes") >= least).select("id", "row", "digest")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    first = large.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = large.join(first, "digest").where(F.col("row") != F.col("first.row"))
    again = scratch.written(again.select("row", F.col("first.id").alias("refers_to"), F.col("first.row").alias("refers_row")), "revisits")
    joined = rows.join(again, "row", "left")
    revisit = F.col("refers_row").isNotNull()
    return joined.select("id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "bytes", "digest", "refers_to", "refers_row", revisit.alias("revisit"), "row")


def _name(page, row: int) -> str:
    return f"urn:page:{'' if page is None else page}:{row}"


def bundles(rows: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Bundles of the rows of ``planned``, each task writing its own; see BUNDLE_SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(w: BundleWriter) -> pa.RecordBatch:
            data = w.finish()
            keys = ["record_id", "frame", "offset", "length"]
            index = pa.array([[dict(zip(keys, x, strict=True)) for x in w.index]], _INDEX_TYPE)
            name = hashlib.sha256(data).hexdigest()[:32]
            return pa.RecordBatch.from_arrays([pa.array([name]), index, pa.array([len(w.index)], pa.int64()), pa.array([data], pa.binary())], ["bundle_id", "index", "n_records", "bundle"])

        writer = BundleWriter(frame_bytes)
        for batch in batches:
            for r in batch.to_pylist():
                name = _name(r["id"], r["row"])
                headers = {
                    "WARC-Type": "revisit" if r["revisit"] else "response", "WARC-Record-ID": f"<{name}>", "WARC-Target-URI": _plain(r["url"]),
                    "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "text/html;charset=utf-8", "WARC-Payload-Digest": f"sha256:{r['digest']}",
                    "X-Payload-Length": str(r["bytes"]), "X-Page-ID": "" if r["id"] is None else str(r["id"]),
                }
                if r["revisit"]:
                    headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    headers["WARC-Refers-To"] = f"<{_name(r['refers_to'], r['refers_row'])}>"
                writer.add(name, warc_record(headers, (r["payload"] or "").encode("utf-8", "surrogatepass")))
                if writer.size >= bundle_bytes:
                    yield done(writer)
                    writer = BundleWriter(frame_bytes)
        if writer.index:
            yield done(writer)

    return rows.mapInArrow(run, BUNDLE_SCHEMA)


def write(pages: DataFrame, path: str, **columns: str) -> None:
    """Writes the archive of ``pages`` as a Parquet table of bundles; they are compressed already."""
    bundles(planned(pages, **columns)).write.option("compression", "none").parquet(path)


_RECORD = {"page_id": pa.string(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "refers_to_record": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}
_RECORD_SCHEMA = "page_id string, url string, record_type string, refers_to string, refers_to_record string, payload binary, payload_bytes bigint, payload_digest string"


def _parsed(headers: dict[str, str], block: bytes) -> tuple:
    """One record, its payload held against its length and digest."""
    revisit, digest = headers["WARC-Type"] == "revisit", headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if not revisit and (len(block) != int(headers["X-Payload-Length"]) or hashlib.sha256(block).hexdigest() != digest):
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    record = headers["WARC-Refers-To"][1:-1] if revisit else None
    to = record.removeprefix("urn:page:").rsplit(":", 1)[0] if revisit else None
    return headers["X-Page-ID"] or None, headers["WARC-Target-URI"], headers["WARC-Type"], to or None, record, None if revisit else block, int(headers["X-Payload-Length"]), digest


def _records(rows: list[tuple], *before: pa.Array) -> pa.RecordBatch:
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORD.values(), strict=True)]
    return pa.RecordBatch.from_arrays([*before, *arrays], [*(["record_id"] if before else []), *_RECORD])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of an archive: (page_id text, url, record_type, refers_to and its record, payload, bytes, digest).

    Each stored payload is held against its length and digest; a mismatch is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column(0):
                data = bundle.as_py()
                table = seek_table(data)
                for frame in range(len(table)):
                    yield _records([_parsed(*r) for r in parse_records(read_frame(data, frame, table))])

    return spark.read.schema(BUNDLE_SCHEMA).parquet(path).select("bundle").mapInArrow(run, _RECORD_SCHEMA)


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records that ``wanted`` names (one column, ``record_id``), found through the index: only their frames are decompressed.

    Unknown and null names find nothing, repeated ones one record.
    """
    archive = spark.read.schema(BUNDLE_SCHEMA).parquet(path)
    places = archive.select("bundle_id", F.explode("index").alias("at")).join(wanted.select(F.col("record_id")).distinct(), F.col("at.record_id") == F.col("record_id"))
    spots = places.groupBy("bundle_id").agg(F.sort_array(F.collect_list(F.struct("at.frame", "at.offset", "at.length", "record_id"))).alias("spots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, spots in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = bundle.as_py()
                table, now, plain = seek_table(data), None, b""
                rows = []
                for s in spots:
                    if s["frame"] != now:
                        now, plain = s["frame"], read_frame(data, s["frame"], table)
                    rows += [_parsed(*r) for r in parse_records(plain[s["offset"] : s["offset"] + s["length"]])]
                yield _records(rows, pa.array([s["record_id"] for s in spots], pa.string()))

    return archive.join(spots, "bundle_id").select("bundle", "spots").mapInArrow(run, f"record_id string, {_RECORD_SCHEMA}")


def export(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Copies bundles to ``<folder>/<bundle_id>.warc.zst`` from the executors; the folder's scheme must be one pyarrow knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, bundle in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with store.open_output_stream(f"{root}/{name}.warc.zst") as f:
                    f.write(bundle.as_buffer())
            yield batch.select(["bundle_id"])

    return spark.read.schema(BUNDLE_SCHEMA).parquet(path).select("bundle_id", "bundle").mapInArrow(run, "bundle_id string")


def report(pages: DataFrame) -> DataFrame:
    """Writes the pages' archive to the shared folder, reads it back, and returns the contract's rows."""
    spark = pages.sparkSession
    path = scratch.new_path(spark, "warc")
    write(pages, path)
    kind = pages.schema["page_id"].dataType
    return read(spark, path).select(
        F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind)
    )


#: The contract's rows in DuckDB SQL.
SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
ranked AS (
  SELECT *, n >= 100 AND row_number() OVER (PARTITION BY d ORDER BY page_id NULLS LAST) > 1 AS again,
    first_value(page_id) OVER (PARTITION BY d ORDER BY page_id NULLS LAST) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to
FROM ranked
"""
