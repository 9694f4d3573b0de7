"""Language identification with a bit-sliced Bloom filter over character n-grams.

One table of ``slots`` bit masks holds a Bloom filter for each language: bit ``l`` of a slot is
the filter bit of language ``l``. An n-gram sets its language's bit in ``probes`` slots; the AND
of the same slots later returns the mask of all languages that hold the n-gram. A text is
decided by counting, for each language, the n-grams whose mask has its bit, less the share
that the filter would return by chance (its measured fill to the power of the probes).

A language holds the n-grams that are at least ``1/contrast`` as frequent in it as in the
language where they are most frequent, so n-grams of foreign passages do not fill every filter.

Training reads a bounded sample: about ``TRAIN_DOCS`` whole documents of each language, taken by
a hash of the identifier, so it is the same at every run and its size does not grow with the
corpus. The table has a fixed size too, and is what is broadcast. Prediction reads every
text whole, in one pass without a shuffle.

Cases: a null text or one without a letter is ``und`` with score 0; ties go to the
first language by name; documents without a language are not learned from; with nothing to
learn from, all texts are ``und``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.textcols import as_strings, mix, without

#: About how many documents of each language are learned from.
TRAIN_DOCS = 5000
#: Characters in an n-gram, masks in the table, slots for each n-gram.
GRAM, SLOTS, PROBES = 4, 1 << 21, 2
#: An n-gram belongs to a language if it is at most so many times rarer there than where it is commonest.
CONTRAST = 3.0
#: Least count of an n-gram in a language's sample.
LEAST_COUNT = 3
#: A sample of fewer n-grams, or of fewer documents, is small: all its n-grams count.
LARGE_SAMPLE, SMALL_SAMPLE = 200_000, 200
UNDECIDED = "und"

_CHUNK_CHARS = 1 << 21


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def gram_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, the row of each, and letters per row.

    Texts are lower-cased; every run of other characters than letters is one boundary.
    """
    lowered = [" " + (t or "").lower() + " " for t in texts]
    lengths = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    starts = np.cumsum(lengths) - lengths
    n_letters = np.add.reduceat(letter, starts, dtype=np.int64) if len(lowered) else np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character after a letter is the boundary
    keep[starts] = True
    rows = np.repeat(np.arange(len(lowered), dtype=np.int32), lengths)[keep]
    symbols = np.where(letter, points, 32)[keep].astype(np.uint64)
    if len(symbols) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), n_letters
    h = symbols[: len(symbols) - GRAM + 1].copy()
    for i in range(1, GRAM):
        h *= np.uint64(0x100000001B3 * 2 + 1)
        h += symbols[i : len(symbols) - GRAM + 1 + i]
    same = rows[: len(h)] == rows[GRAM - 1 :]
    return h[same], rows[: len(h)][same], n_letters


def _slots(h: np.ndarray, slots: int, probes: int) -> list[np.ndarray]:
    h = mix(h)
    low, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(i) * step) & np.uint64(slots - 1)).astype(np.int64) for i in range(probes)]


@dataclass
class Filters:
    """Languages by name, the mask table (slots x words of 64 languages), and each filter's fill."""

    names: list[str]
    table: np.ndarray
    fill: np.ndarray
    probes: int

    @classmethod
    def build(cls, names: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]], slots: int = SLOTS, probes: int = PROBES) -> Filters:
        """counts: for each language the n-gram hashes and how often each occurs."""
        words = max(1, -(-len(names) // 64))
        table = np.zeros((slots, words), dtype=np.uint64)
        if names:
            hashes = np.concatenate([counts[n][0] for n in names])
            share = np.concatenate([counts[n][1] / max(1, counts[n][1].sum()) for n in names])
            enough = np.concatenate([counts[n][1] >= (LEAST_COUNT if counts[n][1].sum() >= LARGE_SAMPLE else 1) for n in names])
            which = np.repeat(np.arange(len(names)), [len(counts[n][0]) for n in names])
            _, at = np.unique(hashes, return_inverse=True)
            most = np.zeros(at.max(initial=-1) + 1)
            np.maximum.at(most, at, share)
            chosen = enough & (share * CONTRAST >= most[at])
            for slot in _slots(hashes[chosen], slots, probes):
                np.bitwise_or.at(table, (slot, which[chosen] // 64), np.uint64(1) << (which[chosen] % 64).astype(np.uint64))
        fill = np.array([np.count_nonzero(table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / slots for i in range(len(names))])
        if len(names) <= 8:  # a narrow table stays in the processor's cache
            table = table.astype(np.uint8)
        return cls(names, table, fill, probes)

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text and language the corrected share of n-grams held; n-grams and letters per text."""
        h, rows, letters = gram_hashes(texts)
        total = np.bincount(rows, minlength=len(texts)).astype(np.float64)
        hits = np.zeros((len(texts), len(self.names)))
        if len(h) and self.names:
            slots = _slots(h, len(self.table), self.probes)
            for word in range(self.table.shape[1]):
                column = self.table[:, word]
                mask = column[slots[0]]
                for slot in slots[1:]:
                    mask &= column[slot]
                for bit in range(min(64, len(self.names) - 64 * word)):
                    got = (mask >> mask.dtype.type(bit)) & mask.dtype.type(1)
                    hits[:, 64 * word + bit] = np.bincount(rows[got.astype(bool)], minlength=len(texts))
        chance = self.fill**self.probes
        with np.errstate(invalid="ignore", divide="ignore"):
            share = (hits / total[:, None] - chance) / (1 - chance)
        return np.clip(np.nan_to_num(share), 0, 1), total, letters

    def decide(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and corrected share of each text; ``und`` for one without a letter."""
        share, _, letters = self.shares(texts)
        if not self.names:
            return [(UNDECIDED, 0.0)] * len(texts)
        best = share.argmax(axis=1)
        return [(self.names[b], float(share[i, b])) if letters[i] else (UNDECIDED, 0.0) for i, b in enumerate(best)]


def by_chunks(texts: list[str | None], run) -> Iterator:
    """Applies ``run`` to slices of a few megabytes, so a batch of long texts stays small in memory."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _CHUNK_CHARS:
            yield from run(texts[start : i + 1])
            start, size = i + 1, 0
    if start < len(texts):
        yield from run(texts[start:])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = TRAIN_DOCS) -> Filters:
    """Learns the filters from about ``docs_per_language`` texts of each language."""
    rows = labelled.where(F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    names = sorted(sizes)
    if not names:
        return Filters.build([], {})
    limit = F.create_map(*(F.lit(x) for n in names for x in (n, min(1.0, docs_per_language / sizes[n]))))
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(place < limit[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            texts = np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs):
                parts = list(by_chunks(list(texts[langs == lang]), lambda part: [gram_hashes(part)[0]]))
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    totals = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # A language with few texts keeps the n-grams that it has once.
    rare = F.create_map(*(F.lit(x) for n in names for x in (n, 1 if sizes[n] < SMALL_SAMPLE else 2)))
    table = totals.where(F.col("n") >= rare[F.col("lang")]).toArrow()
    langs = np.array(table.column("lang").to_pylist(), dtype=object)
    grams, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
    return Filters.build(names, {x: (grams[langs == x], n[langs == x]) for x in names})


def identify(df: DataFrame, filters: Filters, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """The rows of ``df`` with the predicted language and its score; same columns otherwise."""
    df = without(df, lang_as, score_as)
    shipped = df.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            found = list(by_chunks(as_strings(batch.column(at)).to_pylist(), shipped.value.decide))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*batch.schema.names, lang_as, score_as],
            )

    schema = T.StructType([*df.schema.fields, T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType())])
    return df.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The contract's fold: crc32 of the identifier as text, remainder 0 of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    filters = train(rows.where(~F.col("held_out") & F.col("text").isNotNull()))
    return identify(rows.select("doc_id", "held_out", "text"), filters).select("doc_id", "held_out", "lang_pred", "score")
