"""Words and word sequences of an Arrow text column, hashed a batch at a time.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D. Hashes are differences of prefix sums
of a random polynomial modulo 2**64, so a batch is scanned with a few array operations, whole texts
included: long ones are worked off in pieces of PIECE bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
SPACES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and where each row begins; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0 or column.null_count == n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    _, places, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(places, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of `batch` in slices whose column `text` has about `size` bytes; a longer text stands alone."""
    _, rows = flat(batch.column(text))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(rows, rows[a] + size, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


class Words:
    """Hashes of the words of a batch; `offsets` says where each row's words begin."""

    def __init__(self, offsets, hashes, starts, ends):
        self.offsets, self.hashes, self.starts, self.ends = offsets, hashes, starts, ends

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


class Scanner:
    """One polynomial (`seed`) and what it needs; made once per task."""

    def __init__(self, seed: int = 1, lower: bool = False):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.values = draw.integers(0, 2**64, 256, dtype=np.uint64)
        if lower:
            self.values[65:91] = self.values[97:123]
        self.base = int(draw.integers(0, 2**61)) * 8 + 5
        self.space = np.zeros(256, bool)
        self.space[SPACES] = True
        self._powers(PIECE)

    def _powers(self, size: int) -> None:
        def run(base: int) -> np.ndarray:
            out = np.full(size, base, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        self.power, self.inverse = run(self.base), run(pow(self.base, -1, 2**64))

    def _between(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[begin:end] for each pair of places."""
        if len(values) > len(self.power):
            self._powers(2 * len(values))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[:len(values)], out=sums[1:])
        return (sums[end] - sums[begin]) * self.inverse[begin]

    def words(self, column: pa.Array) -> Words:
        data, rows = flat(column)
        if not len(data):
            none = np.zeros(0, np.int64)
            return Words(np.zeros(len(rows), np.int64), np.zeros(0, np.uint64), none, none)
        solid = ~self.space[data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        begins = rows[:-1][rows[:-1] < len(data)]
        first[begins] = solid[begins]
        last[:-1] &= ~solid[1:]
        closes = rows[1:][rows[1:] > 0] - 1
        last[closes] = solid[closes]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + PIECE - 4096)))
            a, b = starts[i], ends[j - 1]
            h = self._between(self.values[data[a:b]], starts[i:j] - a, ends[i:j] - a)
            hashes[i:j] = h + (ends[i:j] - starts[i:j]).astype(np.uint64)
            i = j
        return Words(np.searchsorted(starts, rows).astype(np.int64), mixed(hashes), starts, ends)

    def windows(self, words: Words, begin: np.ndarray, size: int) -> np.ndarray:
        """Hash of the `size` words from each of the sorted places `begin`."""
        out = np.empty(len(begin), np.uint64)
        i = 0
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(begin, begin[i] + PIECE - size - 1)))
            a, b = begin[i], begin[j - 1] + size
            out[i:j] = self._between(words.hashes[a:b], begin[i:j] - a, begin[i:j] - a + size)
            i = j
        return mixed(out)

    @staticmethod
    def room(words: Words, size: int) -> np.ndarray:
        """Places from which `size` words of the same row follow."""
        left = np.repeat(words.offsets[1:], words.counts) - np.arange(len(words.hashes))
        return np.flatnonzero(left >= size)


def shingle_sets(scanner: Scanner, column: pa.Array) -> tuple[Words, list[np.ndarray]]:
    """Sorted distinct hashes of the word pairs of each row; one word stands for itself."""
    words = scanner.words(column)
    h = words.hashes
    pairs = np.zeros(len(h), np.uint64)
    if len(h) > 1:
        pairs[:-1] = mixed(h[:-1] * np.uint64(0xA24BAED4963EE407) + h[1:])
    pairs = pairs.view(np.int64)
    sets = []
    for a, b in zip(words.offsets[:-1], words.offsets[1:]):
        if b - a == 1:
            sets.append(mixed(h[a:b] + np.uint64(1)).view(np.int64))
        else:
            sets.append(np.unique(pairs[a:max(a, b - 1)]))
    return words, sets
