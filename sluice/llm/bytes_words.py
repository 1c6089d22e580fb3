"""Texts as bytes and words as 64-bit numbers, computed on whole Arrow batches inside tasks.

Words are the maximal runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased. A word's number is a
polynomial over its bytes, finished by a bijective mix; equal words get equal numbers on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ``words`` takes about 45 bytes of memory for each byte of a piece, 16 of them in tables of powers that stay.
PIECE_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_powers: list[np.ndarray] = []


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer text is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        size = max(size, PIECE_BYTES + 1)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def _numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words' numbers, a bounded stretch of bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        begin = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, begin + PIECE_BYTES, "right")))
        stop = ends[last - 1]
        up, down = _tables(int(stop - begin) + 1)
        sums = np.zeros(stop - begin + 1, np.uint64)
        np.cumsum(_LOWER[data[begin:stop]] * up[: stop - begin], out=sums[1:])
        at, to = starts[first:last] - begin, ends[first:last] - begin
        out[first:last] = (sums[to] - sums[at]) * down[at] + (to - at).astype(np.uint64)
        first = last
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number, start byte, end byte) of each word, and how many words lie before each text (one entry more than texts)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64)
    held = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:] = False, held[:-1]
    after[-1], after[:-1] = False, held[1:]
    starts = np.flatnonzero(held & (~before | cut[:-1]))
    ends = np.flatnonzero(held & (~after | cut[1:])) + 1
    return _numbers(data, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def shingles(numbers: np.ndarray, width: int) -> np.ndarray:
    """A number for each run of ``width`` words; a shorter text has one, of the whole sequence, or none."""
    if not len(numbers):
        return numbers
    width_here = min(width, len(numbers))
    out = np.full(len(numbers) - width_here + 1, np.uint64(width_here))
    for place in range(width_here):
        out *= _BASE
        out += numbers[place : place + len(out)]
    return mix(out)


def text_shingles(numbers: np.ndarray, before: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """``shingles`` of each text in turn; ``before`` as of ``words``."""
    runs = shingles(numbers, width)
    for first, last in zip(before[:-1].tolist(), before[1:].tolist()):
        yield runs[first : last - width + 1] if last - first >= width else shingles(numbers[first:last], width)
