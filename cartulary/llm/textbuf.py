"""Vectorised text primitives shared by the corpus operators.

Everything here works on one contiguous UTF-8 buffer holding many documents, so
the per-document cost is numpy work and not interpreter work.  Buffers are cut
into chunks of bounded size; a document longer than the bound is a chunk of its
own, never truncated.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one chunk of documents holds at most (one long document may exceed it).
CHUNK_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUES = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def frugal(work: Callable) -> Callable:
    """A function of Arrow batches whose worker gives freed memory back when its task ends: workers live on between tasks."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def release() -> None:
    """Gives this process's freed memory back to the system."""
    _POWERS[:] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads the entropy of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        inverse = pow(int(_MULT), -1, 2**64)
        for k, base in enumerate((int(_MULT), inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


class Chunk:
    """Some documents in one buffer: rows [first, first + n) of their Arrow batch."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array, bound: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + bound, "right")) - 1)
        yield Chunk(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def spans(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and for each document the index of its first word (one more at the end)."""
    data, offsets = chunk.data, chunk.offsets
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = _SEPARATOR[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = gap[:-1]
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = gap[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = True
    last[inner - 1] = True
    starts = np.flatnonzero(first & ~gap)
    ends = np.flatnonzero(last & ~gap) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans; lower: after A-Z became a-z."""
    up, down = _powers(len(data) + 1)
    terms = _BYTE_VALUES[_LOWER[data] if lower else data]
    terms *= up[: len(data)]
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(terms, out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, and for each document the index of its first."""
    starts, ends, docs = spans(chunk)
    return hashes(chunk.data, starts, ends), docs
