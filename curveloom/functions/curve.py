"""Space-filling curve keys: numpy kernels of the published 2004 algorithm of Skilling, and Arrow functions around them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _columns(x: np.ndarray, bits: int) -> np.ndarray:
    """A copy with a dimension to a row, so that each is contiguous, in the narrowest type that will do."""
    return np.array(x.T, dtype=np.uint32 if bits <= 31 else np.uint64, order="C")


def to_transposed(x: np.ndarray, bits: int) -> np.ndarray:
    """Rows of coordinates (n, dims) to transposed curve positions."""
    x = _columns(x, bits)
    kind = x.dtype.type
    first = x[0]
    for level in range(bits - 1, 0, -1):
        q, p = kind(1 << level), kind((1 << level) - 1)
        first ^= np.where(first & q, p, kind(0))
        for col in x[1:]:
            high = (col & q) != 0
            swap = np.where(high, kind(0), (first ^ col) & p)
            col ^= swap
            first ^= np.where(high, p, swap)
    np.bitwise_xor.accumulate(x, axis=0, out=x)
    t = np.zeros(x.shape[1], kind)
    for level in range(bits - 1, 0, -1):
        t ^= np.where(x[-1] & kind(1 << level), kind((1 << level) - 1), kind(0))
    x ^= t
    return x.T


def from_transposed(x: np.ndarray, bits: int) -> np.ndarray:
    """Inverse of :func:`to_transposed`."""
    x = _columns(x, bits)
    kind = x.dtype.type
    t = x[-1] >> kind(1)
    x[1:] ^= x[:-1].copy()
    x[0] ^= t
    first = x[0]
    for level in range(1, bits):
        q, p = kind(1 << level), kind((1 << level) - 1)
        for col in x[:0:-1]:
            high = (col & q) != 0
            swap = np.where(high, kind(0), (first ^ col) & p)
            col ^= swap
            first ^= np.where(high, p, swap)
        first ^= np.where(first & q, p, kind(0))
    return x.T.astype(np.uint64)


def interleave(x: np.ndarray, bits: int) -> np.ndarray:
    """Transposed rows to big-endian bytes (n, ceil(dims * bits / 8)); the highest bit of dimension 0 comes first."""
    n, dims = x.shape
    pad = -bits * dims % 8
    flat = np.zeros((pad + bits * dims, n), np.uint8)
    for k, level in enumerate(range(bits - 1, -1, -1)):
        flat[pad + k * dims : pad + (k + 1) * dims] = (x.T >> x.dtype.type(level)) & x.dtype.type(1)
    return np.ascontiguousarray(np.packbits(flat, axis=0).T)


def curve_order(x: np.ndarray, ids: np.ndarray, bits: int) -> np.ndarray:
    """Places of the rows along the curve, ties by id."""
    keys = interleave(to_transposed(x, bits), bits)
    first = np.argsort(ids, kind="stable")
    return first[np.argsort(keys[first].view(f"S{keys.shape[1]}").ravel(), kind="stable")]


def deinterleave(b: np.ndarray, bits: int, dims: int) -> np.ndarray:
    flat = np.unpackbits(b, axis=1)[:, -bits * dims :].reshape(len(b), bits, dims).astype(np.uint64)
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint64)
    return (flat << shifts[None, :, None]).sum(axis=1, dtype=np.uint64)


def _rows(s: pd.Series) -> np.ndarray:
    return np.concatenate(s.to_numpy()).reshape(len(s), -1).astype(np.int64)


def _keys(s: pd.Series, bits: int) -> np.ndarray:
    x = _rows(s)
    if x.min() < 0 or x.max() >= 1 << bits:
        raise ValueError(f"coordinates must lie in 0 .. {(1 << bits) - 1}")
    return interleave(to_transposed(x, bits), bits)


def curve_key(coords: Column, dims: int, bits: int) -> Column:
    """Position on the curve: ``bigint`` while dims * bits <= 63, else ``binary`` of fixed width, which sorts the same way. Null stays null."""
    if dims * bits <= 63:

        @F.pandas_udf(T.LongType())
        def key(s: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(s), dtype="Int64")
            ok = s.notna().to_numpy()
            if ok.any():
                b = _keys(s[ok], bits)
                wide = np.zeros((len(b), 8), np.uint8)
                wide[:, 8 - b.shape[1] :] = b
                out[ok] = wide.view(">i8").ravel().astype(np.int64)
            return out
    else:

        @F.pandas_udf(T.BinaryType())
        def key(s: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(s), dtype=object)
            ok = s.notna().to_numpy()
            if ok.any():
                out[ok] = [r.tobytes() for r in _keys(s[ok], bits)]
            return out

    return key(coords)


def curve_point(key: Column, dims: int, bits: int) -> Column:
    """Coordinates of a curve position."""
    small = dims * bits <= 63

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def point(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), dtype=object)
        ok = s.notna().to_numpy()
        if ok.any():
            raw = np.frombuffer(s[ok].astype("int64").to_numpy().astype(">i8").tobytes(), np.uint8).reshape(-1, 8) if small else np.stack([np.frombuffer(v, np.uint8) for v in s[ok]])
            rows = from_transposed(deinterleave(raw, bits, dims), bits).astype(np.int32)
            for at, row in zip(np.nonzero(ok)[0], rows, strict=True):
                out.iat[at] = row
        return out

    return point(key)


def bits_needed(n: Column) -> Column:
    """Smallest k with 2 ** k >= n."""
    return F.when(n > 1, F.length(F.bin((n - 1).cast("long")))).otherwise(F.lit(0)).cast("int")


def prefix(key: Column, dims: int, bits: int, to_bits: int) -> Column:
    """Key of the same point at fewer bits: the leading part of its full key (``bigint`` keys)."""
    return F.shiftright(key, dims * (bits - to_bits))


def curve_distance(a: Column, b: Column) -> Column:
    """Steps along the curve between two ``bigint`` keys."""
    return F.abs(a - b)
