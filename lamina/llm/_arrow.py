"""Vectorised helpers for operators that read whole texts in Arrow batches.

Everything here works on the UTF-8 buffer of a batch, slice by slice, so that
memory is bounded by the slice (or by the longest single document).
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 18
U = np.uint64
_P = U(0x9E3779B97F4A7C15)
_RNG = np.random.Generator(np.random.PCG64(0x5EED))
BYTE_CODE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
TAIL = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words in licence scans: letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges [i, j) of rows with at most `most` bytes, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each maximal run of bytes in `table`; runs end with their row."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


LONG = 256


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes have equal hashes in every batch.

    Spans are mixed in eight bytes at a time; the few over LONG bytes go through
    xxh3. Neither is linear in the bytes, so no texts collide by construction.
    """
    size = (ends - starts).astype(np.int64)
    h = mix(size.astype(np.uint64) + _P)
    if not len(size):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    at, left, who = starts.astype(np.int64), size, None
    while True:
        value = lanes[at] & TAIL[np.minimum(left, 8)]
        if who is None:
            h = mix(h ^ value)
        else:
            h[who] = mix(h[who] ^ value)
        more = np.flatnonzero((left > 8) & (left <= LONG)) if who is None else np.flatnonzero(left > 8)
        if not len(more):
            break
        who = more if who is None else who[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


def roll(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n symbols of h, by doubling; len(h) - n + 1 values."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, have, piece, size, p = None, 0, h, 1, _P
    bit = 1
    while True:
        if n & bit:
            if out is None:
                out, have = piece, size
            else:
                m = len(h) - (have + size) + 1
                out = out[:m] * U(pow(int(_P), size, 1 << 64)) + piece[have : have + m]
                have += size
        bit <<= 1
        if bit > n:
            return mix(out[: len(h) - n + 1])
        m = len(h) - 2 * size + 1
        piece = piece[:m] * U(pow(int(_P), size, 1 << 64)) + piece[size : size + m]
        size *= 2


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values; len(h) - w + 1 values."""
    size = 1
    while 2 * size <= w:
        h = np.minimum(h[: len(h) - size], h[size:])
        size *= 2
    rest = w - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def rows(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def give_back() -> None:
    """Returns freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        pass


def lean(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """run, with freed memory given back when the task ends: workers live on between tasks and stages."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped
