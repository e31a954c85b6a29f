"""Vectorised hashing of the words and word shingles of Arrow text columns.

Texts are hashed straight from the Arrow buffer, a slice of about 128 KB at a time, so
memory is bounded by the slice (or the longest single text), not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 17
SHINGLE_WORDS = 5

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        tables = []
        for step in (_BASE, _INVERSE):
            table = np.full(size, step, dtype=np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        if n > 16 * SLICE_BYTES:
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values; a bijection."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts: (first row, bytes, offsets of the texts in them); null is an empty text."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE_BYTES, "right")) - 1)
        yield row, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run ends where its text ends."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    first = offsets[:-1]
    before[first[first < len(inside)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def word_hashes(
    raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None, fold: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased if ``fold``) and, for each text, the number of its first word."""
    starts, ends = runs(~_SPACE[raw] if inside is None else inside, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    letters = _LOWER[raw] if fold else raw.astype(np.uint64)
    np.cumsum((letters + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _STEP), np.searchsorted(starts, offsets)


def chain(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, length, dtype=np.uint64)
    for i in range(length):
        h = mix(h * _STEP + words[i : i + n])
    return h


def shingles(words: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """For each text, in order: the hashes of its shingles, position by position.

    A text with fewer words than a shingle has its whole sequence as one; one without
    words has none.
    """
    every = chain(words, SHINGLE_WORDS)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE_WORDS:
            yield every[a : b - SHINGLE_WORDS + 1]
        else:
            yield chain(words[a:b], b - a) if b > a else every[:0]


def text_shingles(column: pa.Array) -> Iterator[np.ndarray]:
    """The shingles of every text of a column, in order."""
    for _, raw, offsets in slices(column):
        yield from shingles(*word_hashes(raw, offsets))
