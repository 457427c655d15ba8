"""Vectorised scanning of Arrow text columns: words, their 64-bit hashes and their places, without a Python loop over words.

Two different words share a 64-bit hash with probability 2**-64; n distinct words collide at all with about n*n/2**65.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _random(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed)) * _U(0x9E3779B97F4A7C15))


BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_WORD = ~BLANK
_BYTE = _random(256, 11)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_PLACE = _random(4096, 77) | _U(1)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > _PLACE.size:
        _PLACE = _random(max(n, 2 * _PLACE.size), 77) | _U(1)
    return _PLACE


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for later tasks, and what one task freed the next one may not find."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with at most ``most`` bytes of text, one row at least. Gives memory back at the end."""
    try:
        yield from _cut_batches(batches, column, most)
    finally:
        give_back()


def _cut_batches(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def scan_words(data: np.ndarray, offsets: np.ndarray, fold: bool = True, chunk: int = 1 << 19, refine=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of bytes other than ASCII blanks. Returns their starts, lengths, hashes (A-Z folded to a-z if ``fold``), and the bounds of each row among them.

    ``refine(bytes, word, begins)`` may change the bytes that are hashed and add starts within words.
    """
    table = _FOLDED if fold else _BYTE
    at, last = int(offsets[0]), int(offsets[-1])
    starts, lengths, hashes = [], [], []
    while at < last:
        end = min(at + chunk, last)
        if end < last:
            stop = int(offsets[np.searchsorted(offsets, end, "left")])
            while end < stop:
                found = np.flatnonzero(BLANK[data[end : min(end + 4096, stop)]])
                if found.size:
                    end += int(found[0])
                    break
                end = min(end + 4096, stop)
        b = data[at:end]
        word = _WORD[b]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        rows = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, end, "left")] - at
        begins[rows] = word[rows]
        if refine:
            b, begins = refine(b, word, begins)
        index = np.flatnonzero(word)
        if index.size:
            flags = begins[index]
            first = np.flatnonzero(flags)
            start = index[first]
            place = index - start[np.cumsum(flags) - 1]
            value = table[b[index]] * _places(int(place.max()) + 1)[place]
            length = np.diff(np.append(first, index.size))
            starts.append(start + at)
            lengths.append(length)
            hashes.append(mix(np.add.reduceat(value, first) + length.astype(_U) * _U(0xD1B54A32D192ED03)))
        at = end
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, _U), np.zeros(offsets.size, np.int64)
    start = np.concatenate(starts)
    return start, np.concatenate(lengths), np.concatenate(hashes), np.searchsorted(start, offsets, "left")


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values. Sorting is many times faster here than the hash table of np.unique."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if x.size else x


def any_in_rows(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a row has a byte with its flag set; ``offsets`` begin at 0."""
    out = np.zeros(offsets.size - 1, bool)
    filled = np.flatnonzero(np.diff(offsets))
    if filled.size:
        out[filled] = np.logical_or.reduceat(flags, offsets[filled])
    return out


def row_ids(bounds: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(bounds.size - 1), np.diff(bounds))
