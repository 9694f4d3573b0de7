"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts of words and of pairs of adjacent words are quantised to levels (for words 1, 2, 3, 4, then about
``BASE`` times the one before; for pairs powers of ``PAIR_BASE``). An n-gram of level q is put into the Bloom filter q times, as (n-gram, 1) to
(n-gram, q). A count is read back by probing level 1, 2, ... until a probe fails. The
probability of a word w after v interpolates the two orders:

    p(w)   = (c(w) + 1) / (N + V + 1)
    p(w|v) = (c(v,w) + k p(w)) / (c(v) + k),  k = KAPPA[0] * c(v) ** KAPPA[1]

so a context passes more to single words the rarer it is. All c here come from probes. The
base score of the contract is exact: it uses the word counts themselves.

The corpus is cut into chunks of whole texts, written once. Each chunk sends every shard of the hash space one
blob of the distinct n-grams that it asks for, in order, with how often its training texts have them. A shard adds
these up, builds its part of the filter from the sums, probes the filter for every n-gram that was asked for and
answers each chunk with one byte for each (and with the exact counts of words). So one exchange both teaches and
asks, a frequent n-gram is one entry of a chunk, and neither filter nor counts ever have to fit
on one machine: the filter grows with the corpus, a shard does not. Scoring reads each chunk again next to its answers.

Cases: a null text is empty, and an empty text is one end token; a null flag is no training text; repeated rows count
and are scored each for itself; without training texts every count is zero; an empty table returns no rows; columns of
the input with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph import scratch
from weftgraph.llm.textcols import as_strings, fresh, lower_ascii, mix, row_chunks, token_hashes, tokens, without

#: Ratio of neighbouring levels of large counts, for words and for pairs; filter bits for each entry, and bits that an entry sets.
BASE, PAIR_BASE, BITS, PROBES = 1.25, 2.0, 13, 5
#: Weight of single words against pairs: factor and power of the context's count.
KAPPA = (4.0, 0.8)
#: Text bytes of a chunk, and of all chunks for a task of shards, about; shards of such a task.
CHUNK_BYTES, TASK_BYTES, SHARDS_A_TASK = 8 << 20, 16 << 20, 4

#: Bytes of text that are cut into tokens at once.
SLICE_BYTES = 1 << 19

#: The hash of the end token, which is also the context of a text's first word.
END = np.uint64(0x5E1F_E0D0_0F7E_4751)
_LOW48 = np.uint64((1 << 48) - 1)

#: The least count of each level, from 1 up, for words and for pairs.
LEVELS = np.unique(np.ceil(BASE ** np.arange(0, 180)))
PAIR_LEVELS = PAIR_BASE ** np.arange(0, 60)


def level(counts: np.ndarray, levels: np.ndarray = LEVELS) -> np.ndarray:
    """Level of each count; 0 for none."""
    return np.searchsorted(levels, counts, side="right")


def middles(levels: np.ndarray = LEVELS) -> np.ndarray:
    """The count that each level stands for: the middle of its range; level 0 is 0."""
    return np.concatenate([[0.0], (levels[:-1] + levels[1:] - 1) / 2, levels[-1:]])


def quantised(counts: np.ndarray, levels: np.ndarray = LEVELS) -> np.ndarray:
    return middles(levels)[level(counts, levels)]


def text_words(strings: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes with an end token after each text, tokens per text) of slices."""
    for row, raw, offsets in row_chunks(strings, SLICE_BYTES):
        raw = lower_ascii(raw)
        starts, ends, counts = tokens(raw, offsets)
        h = token_hashes(raw, starts, ends)
        yield row, np.insert(h, np.cumsum(counts), END), counts + 1


def contexts(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The token before each token; the end token before a text's first."""
    before = np.concatenate([[END], h[:-1]]).astype(np.uint64)
    before[np.cumsum(counts) - counts] = END
    return before


def pair_hashes(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0xD6E8FEB86659FD93) + h)


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _pack48(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(data: bytes) -> np.ndarray:
    short = np.frombuffer(data, np.uint8).reshape(-1, 6)
    full = np.zeros((len(short), 8), np.uint8)
    full[:, :6] = short
    return full.view("<u8").ravel().astype(np.uint64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[starts], np.add.reduceat(n, starts) if len(k) else n


def filter_words(keys: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (key, level q): a 32-bit place, to be scaled to a shard's words, and the bits of that 64-bit word.

    All bits of an entry are in one word, so a probe is one read of memory.
    """
    h = mix(keys ^ np.uint64(q * 0x9E3779B97F4A7C15 % (1 << 64)))
    bits = np.zeros(len(h), np.uint64)
    for i in range(PROBES):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return h >> np.uint64(32), bits


def build_filter(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Bloom filter words holding every key at each level up to its own."""
    size = max(1, -(-int(levels.sum()) * BITS // 64))
    out = np.zeros(size, dtype=np.uint64)
    for q in range(1, int(levels.max(initial=0)) + 1):
        place, bits = filter_words(keys[levels >= q], q)
        np.bitwise_or.at(out, (place * np.uint64(size) >> np.uint64(32)).astype(np.int64), bits)
    return out


def probed(bits: np.ndarray, keys: np.ndarray, n_levels: int) -> np.ndarray:
    """The level of each key, read from a shard's filter level by level."""
    size, out, active = np.uint64(len(bits)), np.zeros(len(keys), np.uint8), np.arange(len(keys))
    for q in range(1, n_levels + 1):
        place, mask = filter_words(keys, q)
        held = bits[(place * size >> np.uint64(32)).astype(np.int64)] & mask == mask
        keys, active = keys[held], active[held]
        if not len(active):
            break
        out[active] = q
    return out


def terms(n_tokens: int, n_words: int, exact: np.ndarray, word: np.ndarray, context: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token, the base's and the model's log10 probability."""
    whole = n_tokens + n_words + 1
    base = np.log10((exact + 1) / whole)
    single = (word + 1) / whole
    k = KAPPA[0] * np.maximum(context, 1) ** KAPPA[1]
    return base, np.log10((pair + k * single) / (context + k))


def _ipc(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def chunks(df: DataFrame, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, rows): the rows of a table as compressed Arrow streams of about so many bytes of text each, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), pa.array([_ipc(pa.Table.from_batches(held))], pa.binary())], ["chunk", "rows"])

        for batch in batches:
            for row, raw, offsets in row_chunks(as_strings(batch.column(batch.schema.get_field_index(text_col))), chunk_bytes // 4):
                held.append(batch.slice(row, len(offsets) - 1))
                size += len(raw)
                if size >= chunk_bytes:
                    yield out()
                    n, held, size = n + 1, [], 0
        if held:
            yield out()

    return scratch.written(df.mapInArrow(run, "chunk bigint, rows binary"), "chunks", "none")


def _read(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class _Chunk:
    """Tokens of a chunk: distinct words and pairs in order of hash, and where each token has its own."""

    def __init__(self, texts: pa.Array):
        parts = [(h, counts) for _, h, counts in text_words(texts)]
        h, self.counts = (np.concatenate(c) for c in zip(*parts, strict=True))
        self.first = np.cumsum(self.counts) - self.counts
        self.words, self.word_at = np.unique(h, return_inverse=True)
        self.pairs, self.pair_at = np.unique(pair_hashes(contexts(h, self.counts), h), return_inverse=True)


def _asked(n_shards: int, text_col: str, learn_col: str):
    """For each chunk and shard: words and pairs, each with its count in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = _read(data.as_py())
                chunk = _Chunk(as_strings(rows.column(text_col)))
                learnt = np.repeat(rows.column(learn_col).combine_chunks().fill_null(False).to_numpy(zero_copy_only=False), chunk.counts)
                columns = []
                for keys, at, wide in ((chunk.words, chunk.word_at, True), (chunk.pairs, chunk.pair_at, False)):
                    n = np.bincount(at[learnt], minlength=len(keys)).astype("<u4")
                    cuts = np.searchsorted(shard_of(keys, n_shards), np.arange(n_shards + 1)).tolist()  # keys are in order of shard
                    columns.append([(keys[a:b].tobytes() if wide else _pack48(keys[a:b]), n[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
                for i in range(0, n_shards, 64):
                    part = [s for s in range(i, min(n_shards, i + 64)) if columns[0][s][0] or columns[1][s][0]]
                    arrays = [pa.array(part, pa.int32()), pa.array([number] * len(part), pa.int64()), *(pa.array([c[s][k] for s in part], pa.binary()) for c in columns for k in (0, 1))]
                    yield pa.RecordBatch.from_arrays(arrays, _ASKED_NAMES)

    return run


_ASKED = "shard int, chunk bigint, words binary, word_counts binary, pairs binary, pair_counts binary"
_ASKED_NAMES = [c.split()[0] for c in _ASKED.split(", ")]
_ANSWERS = "shard int, chunk bigint, counts binary, word_levels binary, pair_levels binary, n_tokens bigint, n_words bigint"
_ANSWER_NAMES = [c.split()[0] for c in _ANSWERS.split(", ")]


def _shard_answers(shard: int, asked: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Adds up what the chunks have counted, builds the shard's filter, and probes it for every chunk."""
    found = []
    for keys, counts, levels in ((1, 2, LEVELS), (3, 4, PAIR_LEVELS)):
        parts = [_unpack48(a[keys]) if keys == 3 else np.frombuffer(a[keys], np.uint64) for a in asked]
        known, total = _summed(parts, [np.frombuffer(a[counts], "<u4").astype(np.int64) for a in asked])
        found.append((parts, known, total, levels))
    learnt = [(known[total > 0] & _LOW48, level(total[total > 0], levels)) for _, known, total, levels in found]
    bits = build_filter(*(np.concatenate(x) for x in zip(*learnt, strict=True)))
    (words, known, total, _), (pairs, known_pairs, _, _) = found
    read = probed(bits, known & _LOW48, len(LEVELS)), probed(bits, known_pairs, len(PAIR_LEVELS))
    facts = int(total.sum()), int((total > 0).sum())
    for i, (a, w, p) in enumerate(zip(asked, words, pairs, strict=True)):
        at = np.searchsorted(known, w)
        values = shard, a[0], total[at].tobytes(), read[0][at].tobytes(), read[1][np.searchsorted(known_pairs, p)].tobytes(), *(facts if i == 0 else (0, 0))
        types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], _ANSWER_NAMES)


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list[tuple]] = {}
    for batch in batches:
        for shard, *asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found.setdefault(shard, []).append(tuple(asked))
    while found:
        shard, asked = found.popitem()
        yield from pa.Table.from_batches(_shard_answers(shard, asked)).combine_chunks().to_batches()


_OUT = {"n_tokens": "bigint", "n_known": "bigint", "base_score": "double", "score": "double", "train_tokens": "bigint"}


def score(df: DataFrame, learn: Column, text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``df``, its text replaced by n_tokens, n_known, base_score, score and train_tokens.

    The model learns from the rows for which ``learn`` holds.
    """
    spark = df.sparkSession
    df = without(df, *_OUT)
    flag = fresh(df.columns, "_learn")
    kept = [f for f in df.schema.fields if f.name != text_col]
    packed = chunks(df.withColumn(flag, learn), text_col, chunk_bytes)
    size = df.agg(F.coalesce(F.sum(F.octet_length(text_col).cast("bigint")), F.lit(0))).first()[0]
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    asked = packed.mapInArrow(_asked(SHARDS_A_TASK * n_tasks, text_col, flag), _ASKED)
    answers = scratch.written(asked.repartition(n_tasks, "shard").mapInArrow(_answered, _ANSWERS), "answers", "zstd")
    facts = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_words"))).first()

    def scored(data: bytes, answers: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        rows = _read(data)
        chunk = _Chunk(as_strings(rows.column(text_col)))
        exact, words, pairs = (np.frombuffer(b"".join(a), t) for a, t in zip(zip(*answers, strict=True), (np.int64, np.uint8, np.uint8), strict=True))
        word = middles()[words]
        context = np.concatenate([[0.0], word[chunk.word_at[:-1]]])
        context[chunk.first] = word[np.searchsorted(chunk.words, END)]
        base, own = terms(facts.n_tokens, facts.n_words, exact[chunk.word_at], word[chunk.word_at], context, middles(PAIR_LEVELS)[pairs][chunk.pair_at])
        sums = np.add.reduceat(exact[chunk.word_at] > 0, chunk.first, dtype=np.int64), np.add.reduceat(base, chunk.first), np.add.reduceat(own, chunk.first)
        arrays = [pa.array(chunk.counts, pa.int64()), *map(pa.array, sums), pa.array(np.full(rows.num_rows, facts.n_tokens), pa.int64())]
        return pa.RecordBatch.from_arrays([*(rows.column(f.name).combine_chunks() for f in kept), *arrays], [*(f.name for f in kept), *_OUT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []  # answers come in order of shard, and the chunk's rows after them
        for batch in batches:
            for chunk, rows, *answer in zip(*(batch.column(n).to_pylist() for n in ("chunk", "rows", "counts", "word_levels", "pair_levels")), strict=True):
                if chunk != now:
                    now, parts = chunk, []
                if rows is None:
                    parts.append(answer)
                else:
                    yield scored(rows, parts)

    nothing = {c: F.lit(None).cast("binary") for c in ("rows", "counts", "word_levels", "pair_levels")}
    last = F.lit(2**31 - 1)
    both = packed.select("chunk", last.alias("shard"), "rows", *(nothing[c].alias(c) for c in list(nothing)[1:])).unionByName(
        answers.select("chunk", "shard", nothing["rows"].alias("rows"), *list(nothing)[1:])
    )
    schema = T.StructType([*kept, *(T.StructField(k, T._parse_datatype_string(t)) for k, t in _OUT.items())])
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // chunk_bytes))
    return both.repartition(n_parts, "chunk").sortWithinPartitions("chunk", "shard").mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The contract's fold: crc32 of the identifier as text, remainder 2 of 7."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    found = score(docs.select("doc_id", "text").withColumn("held_out", held_out()), ~F.col("held_out"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
