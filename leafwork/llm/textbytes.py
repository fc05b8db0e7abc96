"""Vectorised numpy work on the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20_240_607)
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=U)
BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(BASE), -1, 1 << 64))
_POWERS = {"n": 0}


def give_back() -> None:
    """Returns what Arrow and the C library hold unused to the system; a process that lives on would keep its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """run, a function of batches for mapInArrow, that gives its memory back at the end of a task: workers outlive it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if _POWERS["n"] < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", _INVERSE)):
                p = np.full(size, base, U)
                p[0] = 1
                _POWERS[name] = np.cumprod(p, dtype=U)
        _POWERS["n"] = size
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, ends, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        keep = np.asarray(column.is_valid())
        if (np.diff(offsets)[~keep] != 0).any():
            return buffers(column.fill_null("" if not pa.types.is_binary(column.type) else b""))
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = 1 << 20):
    """Ranges of rows of about `size` bytes: the work arrays stay in the processor's cache and memory stays bounded."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words [^\\x20\\x09-\\x0D]+ of each row, and the rows' offsets among the words."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), z, z, np.zeros(len(offsets), np.int64)
    solid = ~SPACE[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    edge = np.empty(n, bool)
    edge[0] = True
    edge[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (edge | first[:n]))
    edge[:-1] = ~solid[1:]
    edge[-1] = True
    ends = np.flatnonzero(solid & (edge | first[1:])) + 1
    up, down = powers(n + 1)
    run = np.empty(n + 1, U)
    run[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(BYTE[LOWER[raw] if lower else raw] * up[:n], out=run[1:])
        hashes = mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(U))
    return hashes, starts, ends, np.searchsorted(starts, offsets)
