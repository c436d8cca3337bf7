"""NumPy views of Arrow string columns and the hashing that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def trimmed(run):
    """``run`` (of mapInArrow), after which the worker, which stays for other tasks, gives back what memory it has freed."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim:
            trim(0)

    return call


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse modulo 2**64, at least ``n`` of them."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for slot, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, U64(base))
            steps[0] = U64(1)
            _POWERS[slot] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def string_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of a string array, without copying; null is empty."""
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = array.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = 1 << 20, most_rows: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes and at most ``most_rows`` rows; one longer text is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), start + most_rows, n)
        yield start, stop
        start = stop


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the runs that hold no ASCII white space."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit rolling hashes of byte spans, from one prefix sum over the bytes."""
    up, down = _powers(len(data) + 1)
    prefix = np.empty(len(data) + 1, dtype=U64)
    prefix[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of ``n`` consecutive word hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=U64)
    total = np.zeros(count, dtype=U64)
    for i in range(n):
        total *= _BASE
        total += words[i : i + count]
    return mix(total)
