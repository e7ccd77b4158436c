"""Hilbert keys of points in a few dimensions, in numpy."""

from __future__ import annotations

import numpy as np


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of points (n x d, integers below 2**bits; d * bits of 62 or fewer), as signed longs.

    The axes are turned into the transposed index by undoing excess rotations and reflections from the highest bit
    down, then Gray-coded; the index's bits are then interleaved.
    """
    x = np.ascontiguousarray(points.T.astype(np.uint64))
    d = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        low = np.uint64((1 << level) - 1)
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[d - 1] >> np.uint64(level)) & one, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key.view(np.int64)


def quantised(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of about unit spread to integers below 2**bits, by a fixed sigmoid, so that no pass over the table is needed."""
    top = (1 << bits) - 1
    return np.clip(((1 / (1 + np.exp(-1.7 * np.clip(values, -20, 20)))) * (top + 1)).astype(np.int64), 0, top)
