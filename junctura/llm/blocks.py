"""Vectorised work on the UTF-8 bytes of many texts at once.

Texts arrive in Arrow batches; `pieces` cuts these into runs of a bounded number of bytes, so the
arrays below stay small whatever Spark's batch size is. Only a single text longer than the bound
is handled above it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_PRIME), -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def give_back() -> None:
    """Hand the process's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable) -> Callable:
    """A batch function after which the worker, kept for later tasks, hands its free memory back."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, extended on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 1 << 16)
            for name, base in (("up", _PRIME), ("down", _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


_POWERS = Powers()


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts hold at most ``most`` bytes, or one row if that is longer."""
    _, offsets = bytes_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def runs(inside: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; rows always end a run, and so does ``cut``."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n, bool)
    first[0] = True
    first[offsets[(offsets < n)]] = True
    if cut is not None:
        first |= cut
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (first | ~before))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:] & ~first[1:]
    return starts, np.flatnonzero(inside & ~after) + 1


def row_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row of each of the ascending places ``starts``."""
    begin = np.searchsorted(starts, offsets)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(begin))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair, by differences of a running polynomial."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    _POWERS.need(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _POWERS.up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * _POWERS.down[starts] + (ends - starts).astype(np.uint64))


def keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Other 64-bit hashes of data[start:end], never empty, taken eight bytes at a time: cheaper than `hashes` where runs are short."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = ends - starts
    key = left.astype(np.uint64) * _PRIME
    live, at = slice(None), starts
    while len(at):
        spare = (np.maximum(8 - left, 0) * 8).astype(np.uint64)
        key[live] = mix(key[live] ^ (eight[at] << spare >> spare))
        more = np.flatnonzero(left > 8)
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    return key


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every maximal run without ASCII white space."""
    starts, ends = runs(~SPACE[data], offsets)
    return row_of(starts, offsets), starts, ends


def counted(values: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Offsets by row of values whose rows ascend."""
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))]).astype(np.int64)
