"""Vectorised helpers over Arrow text columns, shared by the operators of this subpackage.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. In UTF-8 these six bytes never occur
inside a longer character, so words can be cut on bytes without decoding. All hashes are 64-bit polynomial
hashes read off prefix sums, which makes the hash of any span one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a single longer text is worked on alone.
CHUNK_BYTES = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-cases ASCII letters and the letters of UTF-8 that begin with byte C3 (Latin-1)."""
    out = LOWER[data]
    capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[1:][capital] += 0x20
    return out


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each bit of a 64-bit hash over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() reads the hash of any span."""
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * powers(_R, len(codes)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * powers(_R_INV, len(prefix))[starts])


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[data]


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets): consecutive texts of about ``most`` bytes. Null texts are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words begin (one entry more than texts)."""
    solid = np.zeros(len(data) + 2, dtype=bool)
    solid[1:-1] = ~SPACE[data]
    starts = solid[1:] & ~solid[:-1]
    ends = solid[:-1] & ~solid[1:]
    inner = offsets[1:-1]
    cut = inner[solid[inner] & solid[inner + 1]]  # a word may not run on into the next text
    starts[cut] = True
    ends[cut] = True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    return span_hash(prefix_hash(byte_codes(LOWER[data] if lower else data)), starts, ends)


def gram_hashes(hashes: np.ndarray, begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word grams and where each text's grams begin. Grams never cross texts."""
    counts = np.maximum(np.diff(begins) - n + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(bounds[-1]) + np.repeat(begins[:-1] - bounds[:-1], counts)
    prefix = prefix_hash(hashes)
    return span_hash(prefix, at, at + n), bounds


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values (blockwise prefix and suffix minima)."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Positions picked by winnowing: of each ``width`` consecutive values, every position that holds the minimum.

    Two equal stretches of ``width`` values therefore pick at least one position in common. Ties pick all their
    positions, which keeps the choice a function of the stretch alone.
    """
    low = sliding_min(values, width)
    if not len(low):
        return np.zeros(0, dtype=np.int64)
    # a position is picked if some window that covers it has its value as minimum
    best = np.full(len(values), 0, dtype=values.dtype)
    pad = np.zeros(width - 1, dtype=values.dtype)
    highest = ~sliding_min(~np.concatenate([pad, low, pad]), width)  # the largest minimum among windows over a position
    best[:] = highest
    return np.flatnonzero(values <= best)


def spans_union(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Mask of the positions that lie in any [start, end)."""
    steps = np.zeros(size + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0
