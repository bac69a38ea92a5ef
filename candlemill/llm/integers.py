"""Integer vectors inside tasks: floors of scaled components, and the Walsh-Hadamard transform."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def floors(column: pa.Array, scale: int, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix): ``floor(scale * x)`` of the vectors whose components are all there and finite.

    Vectors shorter than ``width`` are extended by zeros. A component beyond ``most`` is an error, as sums
    of products would no longer be exact in 64 bits.
    """
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(size)), size)
    fine = column.is_valid().to_numpy(zero_copy_only=False).copy()
    fine[row[~np.isfinite(x)]] = False
    place = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((len(size), width), np.int64)
    use = fine[row]
    with np.errstate(over="ignore"):
        value = np.floor(x[use] * scale)
    if len(value) and np.abs(value).max() > most:
        raise ValueError(f"a component of {np.abs(value).max() / scale:g}: exact sums need components of at most {most / scale:g}")
    out[row[use], place[use]] = value.astype(np.int64)
    keep = np.flatnonzero(fine)
    return keep, out[keep]


def power_of_two(n: int) -> int:
    return 1 << max(0, int(n - 1).bit_length())


def padded(x: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((*x.shape[:-1], width), x.dtype)
    out[..., : x.shape[-1]] = x
    return out


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """The unscaled transform of the last axis (a power of two long), in natural order; integers stay integers."""
    out, n, h = x.copy(), x.shape[-1], 1
    while h < n:
        pairs = out.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        out = np.concatenate([pairs[..., :1, :] + pairs[..., 1:, :], pairs[..., :1, :] - pairs[..., 1:, :]], axis=-2).reshape(x.shape)
        h *= 2
    return out


def sequency_order(n: int) -> np.ndarray:
    """Natural positions of the transform's rows by their number of sign changes."""
    gray = np.arange(n) ^ (np.arange(n) >> 1)
    out = np.zeros(n, np.int64)
    for k in range(n.bit_length() - 1):
        out |= ((gray >> k) & 1) << (n.bit_length() - 2 - k)
    return out
