"""Whole batches of texts cut into words and hashed with numpy, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_R = np.random.default_rng(20240607)
_BYTE = _R.integers(0, 2**64, 65536, dtype=np.uint64) | np.uint64(1)
_PLACE = _R.integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of units[start:end] for sorted, disjoint, non-empty spans; units: uint8 or code points below 65536."""
    out = np.empty(len(starts), np.uint64)
    lens = ends - starts
    at = 0
    while at < len(starts):  # some MB at a time, so that the 64-bit products stay small
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + step, "right")))
        n = lens[at:to]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        where = place + np.repeat(starts[at:to], n)
        out[at:to] = np.add.reduceat(_BYTE[units[where]] * _PLACE[place & 4095], first)
        at = to
    out ^= lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of each text; null: 0."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def cuts(texts: pa.Array, size: int) -> list[int]:
    """Ends of slices of about `size` bytes."""
    upto = np.cumsum(lengths(texts))
    out: list[int] = []
    while (done := out[-1] if out else 0) < len(upto):
        out.append(max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + size, "right"))))
    return out
