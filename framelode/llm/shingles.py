"""Words, hashes and shingles of many texts at once, as arrays over their UTF-8 bytes.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z in lower case; as UTF-8 keeps all other
characters out of those bytes, that is the same as on characters. A word's 64-bit hash is a polynomial over its
bytes, from prefix sums, then mixed; a shingle's is a mixed sum over its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_FIRST = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xBF58476D1CE4E5B9)
_THIRD = np.uint64(0x94D049BB133111EB)
#: An odd base, so that it has an inverse modulo 2**64.
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x + _FIRST
    x = (x ^ (x >> np.uint64(30))) * _SECOND
    x = (x ^ (x >> np.uint64(27))) * _THIRD
    return x ^ (x >> np.uint64(31))


#: A byte's random value, after folding A-Z.
_BYTE = mixed(_LOWER.astype(np.uint64) + np.uint64(1 << 20))

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base, and of its inverse; kept for the next call."""
    if len(_powers[0]) < n:
        for at, base in enumerate((_BASE, _INVERSE)):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _powers[at] = np.multiply.accumulate(row)
    return _powers[0][:n], _powers[1][:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins (and the end). Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the words' first bytes, and where each text's words begin (and the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = ~space
    last = first.copy()
    first[1:] &= space[:-1] | cut[1:-1]
    last[:-1] &= space[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    return hashes, starts, np.searchsorted(starts, offsets)


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words; the last ones, which would reach past the end, are left out."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(size):
            total += hashes[at : len(hashes) - size + 1 + at] * np.uint64(2 * at + 3)
            total = mixed(total)
    return total


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Each text's shingle hashes in order, repeated ones too. A text of fewer words is one shingle, one without words has none."""
    rows = rolled(hashes, size)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(rows[a : b - size + 1])
        elif b > a:
            out.append(rolled(hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(rows[:0])
    return out
