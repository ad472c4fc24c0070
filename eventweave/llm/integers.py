"""Whole numbers made of floating-point components, exact at any size."""

from __future__ import annotations

import math
import pickle

import numpy as np
from pyspark.sql import functions as F

#: The range of a long; larger results are reported as its ends.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def finite(column: str) -> F.Column:
    """Whether a vector is not null and holds neither null, NaN nor infinite components."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) for doubles x and a power of two: int64, or Python's integers where 2^62 would be passed."""
    if np.abs(values).max(initial=0) < 2.0**62 / scale:
        return np.floor(values * scale).astype(np.int64)
    exact = np.empty(values.shape, object)
    exact[...] = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in values.ravel().tolist()] if values.ndim == 1 else None
    if values.ndim > 1:
        for row, part in zip(exact, values, strict=True):
            row[...] = whole(part, scale)
    return exact


def peak(values: np.ndarray) -> int:
    """The largest magnitude, as a Python integer."""
    return max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0


def pack(values: np.ndarray) -> bytes:
    """Values in the fewest bytes of a common width; the first byte tells the width."""
    if values.dtype == object:
        return b"\0" + pickle.dumps(values.ravel().tolist())
    top = peak(values)
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([width]) + values.astype(f"<i{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    if data[0]:
        return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)
    items = pickle.loads(data[1:])
    out = np.empty(len(items), object)
    out[:] = items
    return out


def stacked(packed: list[bytes], dims: int) -> np.ndarray:
    """Packed vectors of one length as rows."""
    parts = [unpack(x) for x in packed]
    if any(x.dtype == object for x in parts):
        parts = [x.astype(object) for x in parts]
    return np.concatenate(parts).reshape(-1, dims) if parts else np.zeros((0, dims), np.int64)
