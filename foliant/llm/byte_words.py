"""Words of a batch of texts found and hashed with array operations on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
#: A random odd number for each byte, and the base of the polynomial.
BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_LOWER = BYTE[LOWER]
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, element by element."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n-1, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        out = np.full(max(n, 2 * len(_POWERS)), BASE, np.uint64)
        out[0] = 1
        _POWERS = np.multiply.accumulate(out)
    return _POWERS[:n]


_POWERS = np.ones(1, np.uint64)


def pieces(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a binary column with about *most* bytes: first row, end row, their bytes, and n+1 offsets into them.

    A longer single text is a run of its own. Nulls are empty.
    """
    size = np.diff(_offsets(column))
    at, n = 0, len(column)
    total = np.concatenate(([0], np.cumsum(size)))
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        part = column.slice(at, end - at)
        offsets = _offsets(part)
        data = np.frombuffer(part.buffers()[2], np.uint8) if part.buffers()[2] is not None else np.zeros(0, np.uint8)
        yield at, end, data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)
        at = end


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    raw = column.buffers()[1]
    if raw is None or not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(raw, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]


def spans(inside: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes *inside*, none across a text's border or a place marked in *cut*."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    border = offsets[:-1][np.diff(offsets) > 0]
    first[border] = inside[border]
    if cut is not None:
        first |= cut & inside
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, starts
    count = np.add.reduceat(inside, starts, dtype=np.int64)
    return starts, starts + count


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_LOWER) -> np.ndarray:
    """A 64-bit hash of each span; spans must not overlap and stand in order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    total = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(total[-1]) - np.repeat(total[:-1], size)
    values = table[data[place + np.repeat(starts, size)]] * powers(int(size.max()))[place]
    return mix(np.add.reduceat(values, total[:-1]) + size.astype(np.uint64) * BASE)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, row and hash (A-Z lower-cased) of each word between blanks (20, 09 to 0D)."""
    starts, ends = spans(~BLANK[data], offsets)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1, hashes(data, starts, ends)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, a place of each, and each key's number among them."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return ranked[new], order[new], number
