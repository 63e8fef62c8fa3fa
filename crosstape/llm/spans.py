"""Words of many texts at once: spans in one byte buffer, their hashes and their strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .columns import U64, flat, mix
from .shingles import _power_tables

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


def ended(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty), each followed by a line feed, and the n + 1 offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    whole = texts.cast(pa.large_string()).fill_null("")
    return flat(pc.binary_join_element_wise(whole, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())))


def blocks(data: np.ndarray, stop: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The buffer in parts of about most bytes, each ending behind a byte of stop (or at the end). A part grows
    only where most bytes hold no such byte."""
    lo = 0
    while lo < len(data):
        hi = min(lo + most, len(data))
        if hi < len(data):
            at = np.flatnonzero(stop[data[lo:hi]])
            if len(at):
                hi = lo + int(at[-1]) + 1
            else:
                while hi < len(data):
                    at = np.flatnonzero(stop[data[hi : hi + most]])
                    if len(at):
                        hi += int(at[0]) + 1
                        break
                    hi = min(hi + most, len(data))
        yield data[lo:hi]
        lo = hi


def words(data: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not in gap."""
    solid = np.zeros(len(data) + 2, bool)
    np.logical_not(gap[data], out=solid[1:-1])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    return edge[::2], edge[1::2]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as Arrow strings."""
    size = ends - starts
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    raw = data[np.repeat(starts - at[:-1], size) + np.arange(at[-1])] if len(size) else data[:0]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw))])
