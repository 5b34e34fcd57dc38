"""Static binary-fuse filter over 64-bit keys: three cells and eight bits per key, no false negatives."""

from __future__ import annotations

import numpy as np

from panelmill.llm.scan import mixed

#: Tries with another seed before the array grows; a try fails with a probability of a few percent.
TRIES = 20


def _cells(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three cells in neighbouring segments for each key, and its fingerprint."""
    h = mixed(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    g = mixed(h + np.uint64(0x632BE59BD9B4E019))
    start = ((h >> np.uint64(32)) * np.uint64(segments - 2) >> np.uint64(32)).astype(np.int64) * segment
    mask = np.uint64(segment - 1)
    places = [(h & mask), (g & mask), ((g >> np.uint64(24)) & mask)]
    cells = np.stack([start + i * segment + p.astype(np.int64) for i, p in enumerate(places)])
    return cells, (g >> np.uint64(56)).astype(np.uint8)


def _peeled(cells: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Layers of (keys, their own cell) in the order of removal; None where a core is left."""
    n = cells.shape[1]
    count = np.bincount(cells.ravel(), minlength=size)
    owner = np.zeros(size, np.int64)
    np.add.at(owner, cells.ravel(), np.tile(np.arange(n), 3))
    layers, left = [], n
    single = np.flatnonzero(count == 1)
    while len(single):
        keys, first = np.unique(owner[single], return_index=True)
        layers.append((keys, single[first]))
        gone = cells[:, keys].ravel()
        np.subtract.at(count, gone, 1)
        np.subtract.at(owner, gone, np.tile(keys, 3))
        left -= len(keys)
        touched = np.unique(gone)
        single = touched[count[touched] == 1]
    return layers if left == 0 else None


def build(keys: np.ndarray) -> bytes:
    """Filter of distinct 64-bit keys, as bytes: seed, segment size, segments, then the cells."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << max(2, min(18, int(np.log2(max(n, 2)) / np.log2(3.33) + 2.25)))
    room = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 10)))
    seed = 0
    while True:
        segments = max(3, int(np.ceil(n * room / segment)) + 2)
        for _ in range(TRIES):
            seed += 1
            cells, prints = _cells(keys, seed, segment, segments)
            layers = _peeled(cells, segment * segments)
            if layers is not None:
                table = np.zeros(segment * segments, np.uint8)
                for members, own in reversed(layers):
                    table[own] = 0
                    c = cells[:, members]
                    table[own] = prints[members] ^ table[c[0]] ^ table[c[1]] ^ table[c[2]]
                return np.array([seed, segment, segments], np.uint32).tobytes() + table.tobytes()
        room *= 1.2


def contains(filter_: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every key the filter was built from, and for one in 256 others."""
    seed, segment, segments = (int(x) for x in np.frombuffer(filter_[:12], np.uint32))
    table = np.frombuffer(filter_, np.uint8)[12:]
    cells, prints = _cells(keys.astype(np.uint64), seed, segment, segments)
    return prints == table[cells[0]] ^ table[cells[1]] ^ table[cells[2]]
