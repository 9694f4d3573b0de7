"""Vectorised views of a batch of texts: byte buffers, tokens and their hashes.

Everything here works on whole Arrow batches with numpy, so the cost per token is a few
nanoseconds and no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial token hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text handled at once; larger batches are cut between rows.
CHUNK_BYTES = 2 << 20

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: tuple[np.ndarray, np.ndarray] | None = None


def fresh(taken: list[str], name: str) -> str:
    """A column name that is not taken, in any case of letters."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def without(df, *names: str):
    """The table without columns that an operator is about to add; an input's column of that name is replaced."""
    return df.drop(*names)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values (the splitmix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, _BASE_INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def as_strings(column) -> pa.Array:
    """A text column of a record batch as plain strings with null as the empty string."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column.cast(pa.large_string()).fill_null("")


def buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the row offsets into them."""
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(strings: pa.Array, most: int = CHUNK_BYTES):
    """Cuts a string array between rows into (first row, buffer, offsets) of about ``most`` bytes."""
    if not len(strings):
        return
    raw, offsets = buffers(strings)
    row = 0
    while row < len(strings):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def tokens(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run outside ``gap``, never across rows, and tokens per row."""
    n = len(raw)
    inside = np.empty(n + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(gap[raw], out=inside[1:-1])
    starts_at = inside[1:] & ~inside[:-1]
    ends_at = inside[:-1] & ~inside[1:]
    # A row boundary inside a run cuts it in two.
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    starts_at[cuts] = True
    ends_at[cuts] = True
    starts, ends = np.flatnonzero(starts_at[:n]), np.flatnonzero(ends_at)
    rows = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(rows)


def token_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run [start, end); equal bytes have equal hashes."""
    up, down = _powers_to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.multiply(raw.astype(np.uint64) + np.uint64(1), up[: len(raw)], out=sums[1:])
    np.cumsum(sums, out=sums)
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]
