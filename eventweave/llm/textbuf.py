"""Whole texts as byte buffers, and word hashes computed over them with array operations."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.default_rng(20240517)
_BYTE = _rng.integers(0, 2**64, 256, dtype=U64)
_STEP = _rng.integers(0, 2**64, 64, dtype=U64) | U64(1)
_P = int(_rng.integers(0, 2**63, dtype=np.int64)) | 1
_P_INV = pow(_P, -1, 2**64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


_libc = ctypes.CDLL(None)


def release_freed_memory() -> None:
    """Give memory that was freed back to the system, where the C library can: many small results of native code leave it in pieces."""
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and n + 1 offsets into them. Null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(batch: pa.RecordBatch, name: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold at most ``limit`` bytes together, or that are one row."""
    _, offsets = text_buffer(batch.column(name))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, min(hi, n) - lo)
        lo = min(hi, n)


def binary_cells(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose cells are values[bounds[i]:bounds[i + 1]], which cover values end to end; nothing is copied by cell."""
    values = np.ascontiguousarray(values)
    offsets = np.asarray(bounds, np.int64) * values.itemsize
    if offsets[-1] >= 1 << 31:
        raise ValueError("more than 2 GB in one batch")
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes stand between words."""
    return _SPACES[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words ``[^\\x20\\x09-\\x0D]+`` and, for each text, where its words begin (n + 1 offsets)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACES[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of data; slices ascend and do not overlap."""
    global _powers
    out = np.empty(len(starts), U64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")))
        span = int(ends[hi - 1]) - base
        if len(_powers[0]) <= span:
            step = np.full(max(span, CHUNK_BYTES) + 1, _P, U64)
            step[0] = 1
            up = np.cumprod(step)
            step[1:] = _P_INV
            _powers = up, np.cumprod(step)
        up, down = _powers
        total = np.zeros(span + 1, U64)
        np.cumsum(_BYTE[data[base : base + span]] * up[:span], out=total[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (total[e] - total[s]) * down[s] + (e - s).astype(U64)
        lo = hi
    return mix(out)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingles(word_hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than ``width`` words make one shingle, none make none."""
    n = len(word_hashes)
    rolled = np.zeros(max(0, n - width + 1), U64)
    for j in range(width):
        rolled += word_hashes[j : j + len(rolled)] * _STEP[j]
    rolled = mix(rolled)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(np.unique(rolled[lo : hi - width + 1]))
        elif hi > lo:
            whole = (word_hashes[lo:hi] * _STEP[8 : 8 + hi - lo]).sum(dtype=U64, keepdims=True)
            out.append(mix(whole + U64(hi - lo)))
        else:
            out.append(np.zeros(0, U64))
    return out


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Shingle sets of lower-cased (A-Z) whole texts."""
    data, offsets = text_buffer(column)
    data = lowered(data)
    starts, ends, bounds = words(data, offsets)
    return shingles(slice_hashes(data, starts, ends), bounds, width)
