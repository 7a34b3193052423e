"""Vectorised hashing of text buffers, shared by the operators that work on words or bytes.

Everything here runs inside Spark tasks on one Arrow batch at a time and keeps no
state between batches but a table of powers.  Hashes are polynomials over random
64-bit byte values modulo 2**64, taken from prefix sums, so the hash of any slice
``[i, j)`` of a buffer costs two look-ups.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1, 2**60)) * 8 + 5
_INV = pow(_BASE, -1, 2**64)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept for the next batch."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INV)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    h = (h ^ (h >> _SHIFT)) * _MIX1
    h = (h ^ (h >> _SHIFT)) * _MIX2
    return h ^ (h >> _SHIFT)


class Prefix:
    """Prefix sums of a byte buffer from which the hash of any slice follows."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of data[start:end], element by element."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, width: int) -> np.ndarray:
        """Mixed hashes of every slice of the given width, in order."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets; null rows are empty.

    Copies nothing but the offsets; the bytes are a view of the Arrow buffer.
    """
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind, count=len(column) + 1, offset=column.offset * kind().itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words(NamedTuple):
    """Words of a batch of texts: spans in the byte buffer, owner rows, hashes."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  # row each word belongs to, ascending
    hash: np.ndarray
    first: np.ndarray  # index of the first word of each row, and the total at the end


def words(data: np.ndarray, at: np.ndarray, lower: bool = True) -> Words:
    """Splits texts into runs of bytes other than space and 0x09-0x0D.

    ``lower`` folds A-Z only.  Rows without a word own no entry.
    """
    n = len(data)
    ink = np.zeros(n + 2, dtype=bool)
    np.logical_not(_SPACE[data], out=ink[1 : n + 1])
    begins = ink[1:] & ~ink[:-1]
    ends = ink[:-1] & ~ink[1:]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    both = cuts[ink[cuts] & ink[cuts + 1]]  # a word may not run over the end of its text
    begins[both] = True
    ends[both] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    prefix = Prefix(LOWER[data] if lower else data)
    first = np.searchsorted(start, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(start, end, row, prefix.slices(start, end), first)


def shingles(w: Words, rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of ``size`` words of each row, sorted within rows.

    A row with fewer words, but at least one, has its whole word sequence as its
    only shingle; a row without words has none.  Returns the hashes and the
    offsets of the rows among them.
    """
    counts = np.diff(w.first)
    weights = [np.uint64(pow(_BASE, 3 + 2 * i, 2**64)) for i in range(size)]
    n = len(w.hash)
    full = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for i in range(size):
        full += w.hash[i : i + len(full)] * weights[i]
    full = mix(full)
    inside = w.row[: len(full)] == w.row[size - 1 :] if len(full) else np.zeros(0, bool)
    value, owner = full[inside], w.row[: len(full)][inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for i in range(size - 1):
            has = counts[short] > i
            extra[has] += w.hash[w.first[short[has]] + i] * weights[i]
        extra = mix(extra + counts[short].astype(np.uint64))  # as many words count as the words
        value, owner = np.concatenate([value, extra]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(rows + 1))
