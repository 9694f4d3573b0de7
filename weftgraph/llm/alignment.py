"""Alignment of two tokenizers' ids through a dictionary of groups.

A text is encoded twice. Byte offsets at which tokens of both end cut it into groups; inside a group, two tokens are
linked if their byte ranges overlap. The same few groups make up most of any corpus, so groups are interned: a
chunk of some ``CHUNK_CHARS`` characters of text keeps each distinct group once, the chunks' dictionaries become one of the corpus, and links are
expanded once for each distinct group there. A group's links times the documents that hold the group, added up by pair, count a
document as often as it has groups with the pair; what is over is counted in the chunk and taken off, so the counts are of distinct documents.
Counts come back to the groups, from there by group key to each chunk's dictionary, and so to the documents.

Both tokenizers cut at a single space between two characters that are no white space: the byte-level one splits there before
any merge, the other has no piece with a space behind another character (checked when it is loaded; without that, texts stay whole). So
a text is a row of segments, and distinct segments of a chunk are encoded once.

The tokenizers' files are read on the driver and sent to the tasks; their size is fixed. The largest thing in a task is a chunk with its dictionary;
its segments are encoded ``ENCODED`` at a time and its documents counted ``COUNTED`` segments at a time, and what moves of it is compressed.

Cases: a null or empty text, and one whose tokens do not spell a space and the text, has no tokens: zeros and an empty digest; repeated
rows are documents of their own; null identifiers are kept; an empty table returns no rows; other columns are not read; a text of
any length is encoded whole, one of over ``CHUNK_CHARS`` as a chunk of its own.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph import scratch
from weftgraph.llm.textcols import as_strings, mix

#: Where the tokenizers are, and the two that the query aligns.
FOLDER, BYTE_LEVEL, PIECES = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text that share a dictionary.
CHUNK_CHARS = 8 << 20
#: Segments that are encoded at once; the tokenizers' own results take a kilobyte each.
ENCODED = 4096
#: Segments whose documents are counted at once.
COUNTED = 1 << 17
_MOST_CHUNKS = 1 << 24
#: A single space between two characters that are no white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "▁"


@dataclass
class Pair:
    """Two tokenizers: how to encode, the bytes of each id, and whether texts may be cut at spaces."""

    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    segmented: bool

    def encoded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a space and each text by the first, and by the second, which adds the space itself."""
        return [e.ids for e in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@cache
def loaded(byte_level: str, pieces: bytes) -> Pair:
    """The tokenizers from the contents of their files."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_str(byte_level), SentencePieceProcessor(model_proto=pieces)
    a.encode_special_tokens = True
    alphabet, words = _byte_alphabet(), a.get_vocab(with_added_tokens=False)
    a_bytes = [b""] * (max(words.values()) + 1)
    for word, i in words.items():
        a_bytes[i] = bytes(alphabet[c] for c in word)
    names = [b.id_to_piece(i) for i in range(b.vocab_size())]
    b_bytes = [bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace(_SPACE, " ").encode() for i, n in enumerate(names)]
    return Pair(a, b, a_bytes, b_bytes, not any(_SPACE in n.lstrip(_SPACE) for n in names))


def segments(text: str) -> list[str]:
    """The text cut at every single space between two characters that are no white space."""
    parts = text.split(" ")
    if all(p and not p[0].isspace() and not p[-1].isspace() for p in parts):
        return parts
    return _CUT.split(text)


@dataclass
class Groups:
    """Groups of aligned tokens, end to end: the ids of both sides, and where each group's end."""

    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray

    def __len__(self) -> int:
        return len(self.a_end)

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.diff(self.a_end, prepend=0), np.diff(self.b_end, prepend=0)

    def take(self, at: np.ndarray) -> Groups:
        na, nb = (s[at] for s in self.sizes())
        return Groups(self.a[_runs(self.a_end[at] - na, na)], self.b[_runs(self.b_end[at] - nb, nb)], np.cumsum(na), np.cumsum(nb))

    def keys(self) -> list[bytes]:
        """The exact content of each group: the number of its first side's ids, and all ids, 32 bits each."""
        na, nb = self.sizes()
        out = np.zeros(len(self.a) + len(self.b) + len(self), np.int32)
        end = self.a_end + self.b_end + np.arange(1, len(self) + 1)
        start = end - na - nb - 1
        out[start] = na
        out[_runs(start + 1, na)], out[_runs(start + 1 + na, nb)] = self.a, self.b
        raw = out.tobytes()
        return [raw[4 * s : 4 * e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]

    @classmethod
    def of_keys(cls, keys: list[bytes]) -> Groups:
        raw = np.frombuffer(b"".join(keys), np.int32)
        size = np.fromiter(map(len, keys), np.int64, len(keys)) // 4
        start = np.cumsum(size) - size
        na = raw[start].astype(np.int64)
        nb = size - 1 - na
        return cls(raw[_runs(start + 1, na)], raw[_runs(start + 1 + na, nb)], np.cumsum(na), np.cumsum(nb))

    def links(self, a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, a, b) of all linked tokens; ``a_size`` and ``b_size`` are the bytes of each id.

        Between two neighbouring ends of any tokens lies one token of each side, so every end closes one link.
        """
        a_ends, b_ends = np.cumsum(a_size[self.a]), np.cumsum(b_size[self.b])
        ends = np.union1d(a_ends, b_ends)
        left, right = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        return np.searchsorted(self.a_end, left, side="right"), self.a[left], self.b[right]

    def interned(self) -> tuple[Groups, np.ndarray]:
        """The distinct groups, and the number of each group among them. Equal means equal in two hashes of 64 bits."""
        na, nb = self.sizes()
        salt, h = np.uint64(0), None
        while True:
            both = []
            for turn in (salt, salt + np.uint64(1)):
                side = [mix(ids.astype(np.uint64) ^ mix((place.astype(np.uint64) << np.uint64(3)) + which + (turn << np.uint64(40)))) for ids, place, which in ((self.a, _places(na), np.uint64(1)), (self.b, _places(nb), np.uint64(2)))]
                both.append(sum(np.add.reduceat(s, e - n) for s, e, n in zip(side, (self.a_end, self.b_end), (na, nb), strict=True)) if len(self) else np.zeros(0, np.uint64))
            h, other = both
            _, first, number = np.unique(h, return_index=True, return_inverse=True)
            if (other[first][number] == other).all():
                return self.take(first), number
            salt += np.uint64(2)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every run, one run after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _places(size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _some_documents(seg_count: np.ndarray) -> Iterator[slice]:
    """Segments of whole documents, about ``COUNTED`` at a time."""
    ends, begin = np.cumsum(seg_count), 0
    while len(ends) and begin < ends[-1]:
        end = int(ends[max(np.searchsorted(ends, begin + COUNTED, side="right") - 1, np.searchsorted(ends, begin, side="right"))])
        yield slice(begin, end)
        begin = end


def grouped(pair: Pair, texts: list[str]) -> tuple[Groups, np.ndarray, np.ndarray]:
    """The groups of all texts (none empty), how many each text has, and whether its tokens spell it; those that don't have none."""
    parts = []
    for begin in range(0, len(texts), ENCODED):
        some = texts[begin : begin + ENCODED]
        a, b = pair.encoded(some)
        fit = np.array([b"".join(map(pair.a_bytes.__getitem__, x)) == b"".join(map(pair.b_bytes.__getitem__, y)) == f" {t}".encode() for t, x, y in zip(some, a, b, strict=True)], bool)
        flat = lambda ids: np.fromiter((i for x, g in zip(ids, fit, strict=True) if g for i in x), np.int32)  # noqa: B023, E731
        parts.append((flat(a), flat(b), fit))
    a_ids, b_ids, good = (np.concatenate(x) for x in zip((np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)), *parts, strict=True))
    a_ends, b_ends = np.cumsum(_lengths(pair.a_bytes)[a_ids]), np.cumsum(_lengths(pair.b_bytes)[b_ids])
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    whole = np.cumsum(np.fromiter((len(t.encode()) + 1 if g else 0 for t, g in zip(texts, good, strict=True)), np.int64, len(texts)))
    per_text = np.diff(np.searchsorted(common, whole, side="right"), prepend=0)
    return Groups(a_ids, b_ids, np.searchsorted(a_ends, common) + 1, np.searchsorted(b_ends, common) + 1), per_text, good


def _pressed(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, compressed, since chunks move as rows: the four bytes of all of them, one place after the other."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpressed(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def _lengths(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, parts), np.int64, len(parts))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], list[str]]]:
    """Identifiers and texts of about ``CHUNK_CHARS`` characters at a time."""
    ids: list[pa.Array] = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        strings, begin = as_strings(batch.column(1)), 0
        for i, t in enumerate(strings):
            text = t.as_py()
            if held and held + len(text) > CHUNK_CHARS:
                ids.append(batch.column(0).slice(begin, i - begin))
                yield ids, texts
                ids, texts, held, begin = [], [], 0, i
            texts.append(text)
            held += len(text)
        ids.append(batch.column(0).slice(begin))
    if texts:
        yield ids, texts


def _encoded(docs: DataFrame, files) -> DataFrame:
    """A row for each chunk: what is known of its documents, their segments, and the chunk's dictionary."""
    id_type = docs.schema[0].dataType
    names = ["chunk", "ids", "n_a", "n_b", "n_groups", "n_links", "digest", "seg_count", "segs", "group_count", "groups", "keys", "held", "excess"]
    schema = T.StructType.fromDDL(
        "chunk bigint, ids array<int>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, digest array<string>, seg_count binary, segs binary, "
        "group_count binary, groups binary, keys array<binary>, held array<bigint>, excess array<struct<a:int,b:int,n:bigint>>"
    )
    schema = T.StructType([T.StructField(f.name, T.ArrayType(id_type) if f.name == "ids" else f.dataType) for f in schema])

    def chunk_row(pair: Pair, number: int, ids: list[pa.Array], texts: list[str]) -> pa.RecordBatch:
        known: dict[str, int] = {}
        seqs = [[known.setdefault(s, len(known)) for s in (segments(t) if pair.segmented else [t])] if t else [] for t in texts]
        all_groups, per_seg, good = grouped(pair, list(known))
        distinct, group_of = all_groups.interned()
        n_docs, seg_count = len(texts), np.fromiter(map(len, seqs), np.int64, len(texts))
        segs = np.fromiter((s for seq in seqs for s in seq), np.uint32, int(seg_count.sum()))
        owner = np.repeat(np.arange(n_docs), seg_count)
        bad = np.zeros(n_docs, bool)
        if len(segs):
            bad[owner[~good[segs]]] = True  # a text without tokens if any part of it does not spell itself
            segs, owner = segs[~bad[owner]], owner[~bad[owner]]
        seg_count = np.where(bad, 0, seg_count)
        na, nb = distinct.sizes()
        seg_of_group = np.repeat(np.arange(len(per_seg)), per_seg)
        total = lambda of_group: np.bincount(owner, np.bincount(seg_of_group, of_group[group_of], len(per_seg))[segs], n_docs).astype(np.int64)
        sums = [total(x) for x in (na, nb, np.ones(len(distinct), np.int64), na + nb - 1)]
        shown = [",".join(map(str, distinct.a[x - i : x].tolist())) + "|" + ",".join(map(str, distinct.b[y - j : y].tolist())) for i, j, x, y in zip(na.tolist(), nb.tolist(), distinct.a_end.tolist(), distinct.b_end.tolist(), strict=True)]
        parts, numbers, text_of = np.cumsum(per_seg).tolist(), group_of.tolist(), []
        for begin, end in zip([0, *parts], parts):
            text_of.append(";".join([shown[g] for g in numbers[begin:end]]))
        digest = ["" if b or not seq else hashlib.sha256(";".join([text_of[s] for s in seq]).encode()).hexdigest() for seq, b in zip(seqs, bad, strict=True)]
        of_group, a, b = distinct.links(_lengths(pair.a_bytes), _lengths(pair.b_bytes))
        width = len(pair.b_bytes)
        every_pair = len(pair.a_bytes) * width
        own = np.divmod(np.unique(of_group * every_pair + a.astype(np.int64) * width + b), every_pair)  # a pair once for each group
        pairs, pair_of = np.unique(own[1], return_inverse=True)
        n_own = np.bincount(own[0], minlength=len(distinct))
        # Which documents hold a group, and which hold a pair in several of their groups; some documents at a time.
        seg_start, own_start = np.cumsum(per_seg) - per_seg, np.cumsum(n_own) - n_own
        held, over = np.zeros(len(distinct), np.int64), np.zeros(len(pairs), np.int64)
        for some in _some_documents(seg_count):
            doc, seg = np.divmod(np.unique(owner[some] * len(per_seg) + segs[some]), len(per_seg))
            doc, group = np.divmod(np.unique(np.repeat(doc, per_seg[seg]) * len(distinct) + group_of[_runs(seg_start[seg], per_seg[seg])]), len(distinct))
            held += np.bincount(group, minlength=len(distinct))
            doc_pair, times = np.unique(np.repeat(doc, n_own[group]) * len(pairs) + pair_of[_runs(own_start[group], n_own[group])], return_counts=True)
            over += np.bincount((doc_pair % len(pairs))[times > 1], times[times > 1] - 1, len(pairs)).astype(np.int64)
        excess = [{"a": p // width, "b": p % width, "n": n} for p, n in zip(pairs[over > 0].tolist(), over[over > 0].tolist(), strict=True)]
        keep = np.flatnonzero(held > 0)  # groups of texts without tokens go
        renamed = np.zeros(len(distinct), np.uint32)
        renamed[keep] = np.arange(len(keep))
        column = lambda x: pa.array([x.tolist()], pa.list_(pa.int64()))
        every = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, n_docs], pa.int32()), every), *map(column, sums), pa.array([digest], pa.list_(pa.string())),
                *(pa.array([_pressed(x)], pa.binary()) for x in (seg_count, segs, per_seg, renamed[group_of])),
                pa.array([distinct.take(keep).keys()], pa.list_(pa.binary())), column(held[keep]), pa.array([excess], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))),
            ], names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, pair = TaskContext.get().partitionId() * _MOST_CHUNKS, loaded(*files.value)
        for ids, texts in _chunks(batches):
            yield chunk_row(pair, number, ids, texts)
            number += 1

    return docs.mapInArrow(run, schema)


def _group_links(dictionary: DataFrame, files) -> DataFrame:
    """(key, held, a, b, n): the pairs of each distinct group and how often it has them; ``held`` documents hold the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(*files.value)
        sizes, width = (_lengths(pair.a_bytes), _lengths(pair.b_bytes)), len(pair.b_bytes)
        for batch in batches:
            if not batch.num_rows:
                continue
            group, a, b = Groups.of_keys(batch.column(0).to_pylist()).links(*sizes)
            every_pair = len(sizes[0]) * width
            own, n = np.unique(group * every_pair + a.astype(np.int64) * width + b, return_counts=True)
            at, both = np.divmod(own, every_pair)
            columns = [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array((both // width).astype(np.int32)), pa.array((both % width).astype(np.int32)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "held", "a", "b", "n"])

    return dictionary.mapInArrow(run, "key binary, held bigint, a int, b int, n bigint")


@dataclass
class Alignment:
    """What an aligned corpus has: chunks with their documents, links of distinct groups, and pairs (a, b, docs, best)."""

    chunks: DataFrame
    links: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> Alignment:
    """Links the ids of two tokenizers over all documents; ``pairs`` has in how many documents each pair is linked, and whether that is its first id's most."""
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((Path(folder, byte_level).read_text(encoding="utf-8"), Path(folder, pieces).read_bytes()))  # of a fixed size
    chunks = scratch.written(_encoded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), files), "chunks", "zstd")
    each = chunks.select(F.explode(F.arrays_zip("keys", "held")).alias("x"))
    dictionary = each.groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.held").alias("held"))
    links = scratch.written(_group_links(dictionary, files), "links", "zstd")
    over = chunks.select(F.explode("excess").alias("x")).select("x.a", "x.b", (-F.col("x.n")).alias("docs"))
    docs_of = scratch.written(links.select("a", "b", F.col("held").alias("docs")).unionByName(over).groupBy("a", "b").agg(F.sum("docs").alias("docs")), "pairs")
    most = docs_of.groupBy("a").agg(F.max("docs").alias("most"))
    return Alignment(chunks, links, docs_of.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best")))


def per_document(found: Alignment) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    values = found.links.join(found.pairs, ["a", "b"]).groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("best"), F.sum(F.col("n") * F.col("docs")).alias("total"))
    asked = found.chunks.select("chunk", F.posexplode("keys").alias("at", "key"))
    back = asked.join(values, "key").groupBy("chunk").agg(F.collect_list(F.struct("at", "best", "total")).alias("values"))  # at most a chunk's own dictionary
    id_type = found.chunks.schema["ids"].dataType.elementType
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(n, T.LongType()) for n in names[1:-1]), T.StructField(names[-1], T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n).slice(i, 1) for n in batch.schema.names}
                inner = lambda n: row[n].flatten()  # noqa: B023, E731
                packed = lambda n: _unpressed(row[n][0].as_py())  # noqa: B023, E731
                seg_count, segs, group_count, groups = map(packed, ("seg_count", "segs", "group_count", "groups"))
                owner, seg_of_group = np.repeat(np.arange(len(seg_count)), seg_count), np.repeat(np.arange(len(group_count)), group_count)
                sums = []
                for name in ("best", "total"):
                    of_group = np.zeros(row["n_keys"][0].as_py(), np.int64)
                    if len(of_group):
                        listed = inner("values")
                        of_group[listed.field("at").to_numpy()] = listed.field(name).to_numpy()
                    of_seg, of_doc = np.zeros(len(group_count), np.int64), np.zeros(len(seg_count), np.int64)
                    if len(of_group):
                        np.add.at(of_seg, seg_of_group, of_group[groups])
                    np.add.at(of_doc, owner, of_seg[segs])
                    sums.append(pa.array(of_doc))
                yield pa.RecordBatch.from_arrays([inner("ids"), *map(inner, names[1:5]), *sums, inner("digest")], names)

    return found.chunks.withColumn("n_keys", F.size("keys")).drop("keys", "held", "excess").join(back, "chunk", "left").mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    return per_document(align(docs))
