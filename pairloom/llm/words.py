"""Vectorised words and shingles of whole Arrow text columns, shared by the text operators.

A text column arrives as one byte buffer with offsets. Words are runs of bytes of a byte class, so no Python
string is made; every word becomes a 64-bit hash. Work is cut into slices of about SLICE bytes; a text longer
than that is hashed piece by piece, cut between words, so memory follows its number of words, never a multiple
of its bytes. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 1 << 20


def tidy(run):
    """A task function that gives freed memory back when its task ends: workers stay alive between tasks and stages."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return task



_BYTES = np.arange(256)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
# Bytes of a word: all but white space, or letters and digits with every byte beyond ASCII.
VISIBLE = ~_SPACE
ALNUM = (_BYTES >= 0x80) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
SAME = _BYTES.astype(np.uint8)

_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = powers(_BASE, 4096)


class Words(NamedTuple):
    """Rows first .. first + rows - 1 of a batch; words of row r are hashes[bounds[r - first]:bounds[r - first + 1]]."""

    first: int
    rows: int
    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, bounds


def _hash_pieces(raw: np.ndarray, bounds: np.ndarray, kind: np.ndarray, fold: np.ndarray):
    """Hashes, starts and ends of the words of raw; no word spans one of bounds."""
    inside = kind[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0], edge[-1] = True, True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[bounds] = True
    cuts = np.flatnonzero(edge)
    if len(cuts) < 2:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty
    word = inside[cuts[:-1]]
    starts, ends = cuts[:-1][word], cuts[1:][word]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    length = ends - starts
    codes = fold[raw[inside]]
    at = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(len(codes)) - np.repeat(at, length)
    longest = int(length.max())
    scale = _POWERS if longest <= len(_POWERS) else powers(_BASE, longest)
    return mix(np.add.reduceat(_TABLE[codes] * scale[place], at) + length.astype(np.uint64) * _STEP), starts, ends


def iter_words(column, kind: np.ndarray = VISIBLE, fold: np.ndarray = LOWER) -> Iterator[Words]:
    """Words of every row of a text column, in groups of rows of about SLICE bytes."""
    raw, bounds = text_buffer(column)
    rows, row = len(bounds) - 1, 0
    while row < rows:
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + SLICE, "right")) - 1)
        low, high = int(bounds[row]), int(bounds[last])
        if high - low <= 2 * SLICE:
            own = bounds[row : last + 1] - low
            hashes, starts, ends = _hash_pieces(raw[low:high], own, kind, fold)
            yield Words(row, last - row, hashes, np.searchsorted(starts, own), starts, ends)
        else:
            parts, begin = [], low
            while begin < high:
                end = min(high, begin + SLICE)
                while end < high and kind[raw[end]] and kind[raw[end - 1]]:
                    end += 1
                h, s, e = _hash_pieces(raw[begin:end], np.array([0, end - begin]), kind, fold)
                parts.append((h, s + (begin - low), e + (begin - low)))
                begin = end
            hashes, starts, ends = (np.concatenate(x) for x in zip(*parts))
            yield Words(row, 1, hashes, np.array([0, len(hashes)]), starts, ends)
        row = last


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width consecutive words, by its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i, p in enumerate(powers(_STEP, width)):
        total += hashes[i : i + n] * p
    return mix(total + np.uint64(width))


def shingle_sets(words: Words, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row; fewer words than width make one shingle, no words none."""
    every = windows(words.hashes, width)
    for a, b in zip(words.bounds[:-1], words.bounds[1:]):
        n = b - a
        if n >= width:
            yield np.unique(every[a : b - width + 1])
        elif n:
            yield windows(words.hashes[a:b], int(n))
        else:
            yield every[:0]
