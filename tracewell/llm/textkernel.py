"""Vectorised views of text columns inside tasks: word and line spans with 64-bit hashes over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.int64).astype(U)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose texts hold about max_bytes together (a longer text is a run of its own).

    Arrays over a run take some dozens of bytes per byte of text. What Arrow has freed goes back to the system after a batch.
    """
    ends = buffers(batch.column(column))[0][1:]
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + max_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row offsets, bytes) of a string column in UTF-8; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_MULT, pow(_MULT, -1, 2**64))):
            run = np.full(max(n, 1 << 20), U(base))
            run[0] = 1
            _POWERS[i] = np.multiply.accumulate(run)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher over 64 bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans values[start:end]; values are uint64."""
    power, inverse = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * power[: len(values)], dtype=U, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))


def solid(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    return ~_SPACE[raw]


def words(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every word, in order."""
    inside = solid(raw)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def byte_values(raw: np.ndarray) -> np.ndarray:
    return _BYTE[raw]


def windows(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word's index, hash) of every run of size words within one row."""
    at = np.arange(max(0, len(hashes) - size + 1))
    if len(at):
        at = at[row[at] == row[at + size - 1]]
    return at, span_hashes(hashes, at, at + size)
