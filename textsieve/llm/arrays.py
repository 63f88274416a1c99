"""Arrow text columns as flat numpy bytes, and hashes over them."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U64 = np.uint64
#: An odd multiplier, so that its powers modulo 2^64 have inverses.
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def kept(key: tuple, make: Callable):
    """An object that the Python worker keeps for its later tasks, made at the first use of ``key``."""
    store = vars(sys.modules.setdefault("_textsieve_kept", types.ModuleType("_textsieve_kept")))
    if key not in store:
        store[key] = make()
    return store[key]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the offsets of the texts in it; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    binary = texts.cast(pa.large_binary())
    if binary.null_count:
        binary = pc.fill_null(binary, b"")
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    held = binary.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.empty(0, np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups_of_bytes(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    h = h ^ (h >> _U64(33))
    h = h * _U64(0xFF51AFD7ED558CCD)
    h ^= h >> _U64(33)
    h *= _U64(0xC4CEB9FE1A85EC53)
    h ^= h >> _U64(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    if size not in _POWERS:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, _U64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=_U64))
        if size <= 1 << 22:
            _POWERS[size] = (both[0], both[1])
        return both[0][:n], both[1][:n]
    up, down = _POWERS[size]
    return up[:n], down[:n]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes hash equally wherever they stand."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U64)
    np.cumsum((data.astype(_U64) + _U64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all ``k``-byte substrings."""
    if len(data) < k:
        return np.empty(0, _U64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U64)
    np.cumsum((data.astype(_U64) + _U64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[: len(data) - k + 1])


def lower_table() -> np.ndarray:
    """Byte table that lower-cases A-Z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_ranges(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes, and each run's row; runs end with their row."""
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] = inside[inner]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stops[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
