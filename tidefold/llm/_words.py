"""Vectorised words, word hashes and shingles over Arrow string columns.

All functions work on slices of bounded size, so that memory does not depend on the
number of rows in a batch; a text of any length is read whole, slice by slice.
Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR, which is
the same on bytes of UTF-8 as on code points; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= _STEP
    x ^= x >> np.uint64(29)
    x *= np.uint64(_BASE)
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, dtype=np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


_UP, _DOWN = _powers(_BASE, SLICE + 1), _powers(_INVERSE, SLICE + 1)


def column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the row offsets in them; nulls are empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = pc.fill_null(values.cast(pa.large_string()), "")
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have SLICE bytes at most, or that hold one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _runs(data: np.ndarray, cut: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and polynomial hashes of the words of at most SLICE bytes; cut: where a new text begins."""
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1] if cut is None else (~word[:-1] | cut[1:])
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:] if cut is None else (~word[1:] | cut[1:])
    ends = np.flatnonzero(last) + 1
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * _UP[: len(data)], out=total[1:])
    return starts, ends, (total[ends] - total[starts]) * _DOWN[starts]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts, and the row of each; as slices() gives them, or one text of any length."""
    if offsets[-1] - offsets[0] <= SLICE:
        part = data[offsets[0] : offsets[-1]]
        if not len(part):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = offsets[:-1] - offsets[0]
        cut = np.zeros(len(part) + 1, dtype=bool)
        cut[at] = True
        starts, ends, h = _runs(part, cut[:-1])
        return mix(h ^ (ends - starts).astype(np.uint64)), np.searchsorted(offsets[1:] - offsets[0], starts, "right")
    found, open_h, open_n = [], 0, 0
    for a in range(int(offsets[0]), int(offsets[-1]), SLICE):
        part = data[a : min(a + SLICE, int(offsets[-1]))]
        starts, ends, h = _runs(part, None)
        n = (ends - starts).astype(np.uint64)
        joins = bool(open_n and len(starts) and starts[0] == 0)
        if joins:
            h[0] = (open_h + int(h[0]) * pow(_BASE, open_n, 1 << 64)) & _MASK
            n[0] += np.uint64(open_n)
        elif open_n:
            found.append(mix(np.array([open_h ^ open_n], dtype=np.uint64)))
        open_h = open_n = 0
        if len(ends) and ends[-1] == len(part):
            open_h, open_n = int(h[-1]), int(n[-1])
            h, n = h[:-1], n[:-1]
        found.append(mix(h ^ n))
    if open_n:
        found.append(mix(np.array([open_h ^ open_n], dtype=np.uint64)))
    out = np.concatenate(found)
    return out, np.zeros(len(out), np.int64)


def grams(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of ``width`` words, by first word; the caller leaves out those across texts."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, width):
        out *= _STEP
        out += h[k : n + k]
    return mix(out)


def by_text(values: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and word hashes of every text in a column."""
    data, offsets = column(values)
    for i, j in slices(offsets):
        h, row = words(data, offsets[i : j + 1])
        ends = np.searchsorted(row, np.arange(j - i + 1))
        for k in range(j - i):
            yield i + k, h[ends[k] : ends[k + 1]]


def shingle_set(h: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingles of a text in ascending order; with fewer words the whole sequence is one; none without words."""
    if 0 < len(h) < width:
        return mix(grams(h, len(h)) + np.uint64(len(h)))
    return np.unique(grams(h, width))
