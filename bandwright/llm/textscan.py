"""Vectorised scans over the UTF-8 bytes of many texts at once (numpy).

A batch of texts is one byte buffer with offsets, as Arrow stores it, so no
Python string is made for a text, line or word. A word is a run of bytes
outside 0x20 and 0x09-0x0D; in UTF-8 those bytes stand only for themselves.
Hashes are 64-bit polynomial hashes with a final mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 1 << 19

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    global _powers, _inverses
    if n > len(_powers):
        size = max(n, SLICE_BYTES + 4096)
        up, down = np.full(size, BASE, np.uint64), np.full(size, BASE_INV, np.uint64)
        up[0] = down[0] = 1
        _powers, _inverses = np.cumprod(up), np.cumprod(down)
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """What ``hash_between`` needs of values, for many ranges of the same values."""
    up, _ = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return total


def hash_between(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[s:e] for each range; equal sequences, equal hashes."""
    _, down = powers(len(total))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hash_neighbours(total: np.ndarray, n: int) -> np.ndarray:
    """What ``hash_between`` gives for each ``n`` neighbours."""
    _, down = powers(len(total))
    return mix((total[n:] - total[:-n]) * down[: len(total) - n] + np.uint64(n))


def hash_ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return hash_between(prefix_hashes(values), starts, ends)


class Texts:
    """Some texts as bytes, with their words and lines on demand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        self.n = len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the first word of each text (n + 1)."""
        inside = ~IS_SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(len(self.data), bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(len(self.data), bool)
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all lines (split at \\n), and the first line of each text."""
        cuts = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], cuts + 1]), kind="stable")
        ends = np.sort(np.concatenate([cuts, self.offsets[1:]]), kind="stable")
        per_text = np.searchsorted(cuts, self.offsets[1:]) - np.searchsorted(cuts, self.offsets[:-1]) + 1
        return starts, ends, np.concatenate([[0], np.cumsum(per_text)])

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """For each text, the sum of a value per byte."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def spans_of(first: np.ndarray) -> np.ndarray:
    """The owner of each item, from the first item of each owner (n + 1)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sum_by(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of a value per item over each owner."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def slices(column: pa.Array, lower: bool = False, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) over slices of about ``size`` bytes; whole texts, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, count=len(column) + 1, offset=column.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, Texts(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], lower)
        row = end


TRIMMED = np.isin(np.arange(256), np.frombuffer(b".,;:!?\"'()", np.uint8))
TRIMMED_SYMBOLS = TRIMMED | np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>[]{}_", np.uint8))


def bare_hashes(texts: Texts, marks: np.ndarray = TRIMMED, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words without up to ``most`` marks at either end, first word of each text)."""
    starts, ends, first = texts.words()
    low, high = starts.copy(), ends.copy()
    for _ in range(most if len(starts) else 0):
        high -= (high > low) & marks[texts.data[np.maximum(high - 1, 0)]]
        low += (low < high) & marks[texts.data[np.minimum(low, len(texts.data) - 1)]]
    return hash_ranges(texts.data, low, high), first


def bare_words(values: list[str]) -> list[np.ndarray]:
    """The bare word hashes of each of some strings, ASCII letters lower-cased, marks and symbols off."""
    raw = [v.encode() for v in values]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    hashes, first = bare_hashes(Texts(np.frombuffer(b"".join(raw), np.uint8), offsets, lower=True), TRIMMED_SYMBOLS, 6)
    return [hashes[first[i] : first[i + 1]] for i in range(len(values))]
