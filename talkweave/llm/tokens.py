"""Words of Arrow string columns as 64-bit hashes, whole batches at a time."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of ``h``."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows of about ``size`` bytes; a longer text is a run of its own."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        stop = min(stop, len(column))
        yield row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word, in order; words end at ASCII white space and at the end of a row."""
    # A word begins, or white space ends one, where the kind of byte changes or a row ends.
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(_SPACE[data], out=inside[:-1])
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = ~inside
    closes[1:] &= inside[:-1]
    closes[0] = False
    edges = offsets[1:-1]
    opens[edges] = inside[edges]
    edges = edges[edges > 0]
    closes[edges] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # Every byte adds a number drawn by its place in the word and its value.
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    places = np.arange(firsts[-1] + lengths[-1], dtype=np.uint64) - np.repeat(firsts.astype(np.uint64), lengths)
    letters = (_LOWER if lower else _SAME)[data[inside[:-1]]]
    drawn = mixed(((places << np.uint64(8)) | letters) * _STEP)
    hashes = np.add.reduceat(drawn, firsts)
    return mixed(hashes + lengths.astype(np.uint64) * _STEP), np.searchsorted(offsets, starts, "right") - 1


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; fewer words are one run."""
    size = min(size, len(words))
    factors = np.cumprod(np.full(size + 1, _STEP), dtype=np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out += words[i:len(words) - size + 1 + i] * factors[i]
    return mixed(out)
