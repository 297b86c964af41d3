"""Whole number arrays as bytes: differences, byte planes apart, zstandard. Sorted or small numbers shrink well."""
from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray, differences: bool = False) -> bytes:
    """differences: for values in ascending order."""
    if differences and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind: type, differences: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    values = np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind) if len(raw) else np.zeros(0, kind)
    return np.cumsum(values, dtype=kind) if differences else values
