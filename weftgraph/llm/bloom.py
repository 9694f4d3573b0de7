"""Bloom filters of 64-bit keys with a largest size, to spare rows a shuffle.

A false hit sends a row that need not be sent; nothing else depends on the filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm.textcols import mix

#: Largest filter that is broadcast, in bytes.
MOST_BYTES = 32 << 20
_PARTS = 8


def _words(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys)
    bits = np.uint64(1) << (h & np.uint64(63)) | np.uint64(1) << (h >> np.uint64(6) & np.uint64(63)) | np.uint64(1) << (h >> np.uint64(12) & np.uint64(63)) | np.uint64(1) << (h >> np.uint64(18) & np.uint64(63))
    return ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64), bits


def build(keys: DataFrame, n: int, most_bytes: int = MOST_BYTES) -> np.ndarray:
    """A filter of the only column, of type long, of a table of about ``n`` rows; 16 bits a key or the largest size."""
    size = max(16, min(most_bytes // 8, n // 4 + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.uint64)
        for batch in batches:
            at, bits = _words(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size)
            np.bitwise_or.at(table, at, bits)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["table"])

    table = np.zeros(size, np.uint64)
    for row in keys.coalesce(_PARTS).mapInArrow(run, "table binary").toLocalIterator():
        table |= np.frombuffer(row.table, np.uint64)
    return table


def maybe(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter."""
    at, bits = _words(keys, len(table))
    return table[at] & bits == bits
