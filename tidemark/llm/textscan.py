"""Vectorised scans over the bytes of an Arrow string column.

White space is 0x20 and 0x09 to 0x0D, all single bytes in UTF-8, so words can be cut on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18  # a scan makes some 40 bytes of arrays for each


class WordTable:
    """Results by word in bounded memory: when the young half is full the old half goes.

    The bound is in characters, each word counting WORD_COST more; a word beyond LONGEST is made each time.
    """

    WORD_COST, LONGEST = 200, 4096

    def __init__(self, characters: int):
        self.young: dict = {}
        self.old: dict = {}
        self.half, self.held = characters // 2, 0

    def put(self, word: str, make):
        """What is known of word, from the old half or made now; it is young afterwards."""
        found = self.old.get(word)
        if found is None:
            found = make(word)
        if len(word) <= self.LONGEST:
            self.held += len(word) + self.WORD_COST
            if self.held > self.half:
                self.old, self.young, self.held = self.young, {}, len(word) + self.WORD_COST
            self.young[word] = found
        return found


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; null rows are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes; a row longer than that makes a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def stretches(data: np.ndarray, begin: int, end: int, table: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """One long row in ranges of at most limit bytes, cut behind bytes outside the table; a longer run of bytes inside stays whole."""
    while begin < end:
        stop = min(end, begin + limit)
        if stop < end:
            outside = np.flatnonzero(~table[data[begin:stop]])
            while not len(outside) and stop < end:
                ahead = min(end, stop + limit)
                outside = np.flatnonzero(~table[data[stop:ahead]])[:1] + (stop - begin)
                stop = ahead
            if len(outside):
                stop = begin + int(outside[-1]) + 1
        yield begin, stop
        begin = stop


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of each row's first word (n + 1 of them)."""
    return spans(data, offsets, ~_SPACE)


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes of the table within a row, and the index of each row's first run (n + 1 of them)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = heads[1:] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of words in each row."""
    data, offsets = column_bytes(column)
    out = np.zeros(len(column), np.int64)
    for a, b in chunks(offsets):
        part = offsets[a : b + 1]
        _, _, firsts = word_spans(data[part[0] : part[-1]], part - part[0])
        out[a:b] = np.diff(firsts)
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased, from prefix sums of a polynomial.

    Words stand in order and do not overlap. They are hashed some CHUNK_BYTES of data at a time, a longer word alone.
    """
    if not len(starts) or ends[-1] - starts[0] <= CHUNK_BYTES:
        return _hashes(data, starts, ends)
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, side="right")))
        low = starts[i]
        out[i:j] = _hashes(data[low : ends[j - 1]], starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    global _powers, _inverse
    powers, inverse = _powers, _inverse
    if len(powers) <= len(data):
        n = len(data) + 1
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE, np.uint64)]), dtype=np.uint64)
        back = pow(_BASE, -1, 1 << 64)
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, back, np.uint64)]), dtype=np.uint64)
        if n <= 4 * CHUNK_BYTES:  # those of a very long word are not kept
            _powers, _inverse = powers, inverse
    terms = (_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers[: len(data)]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    raw = (sums[ends] - sums[starts]) * inverse[starts]
    return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sums_between(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of small whole numbers over ranges that stand in order, do not overlap and are not empty."""
    if not len(starts):
        return np.zeros(0, np.int64)
    bounds = np.column_stack([starts, ends]).ravel()
    bounds = bounds[:-1] if bounds[-1] == len(values) else bounds
    return np.add.reduceat(values, bounds, dtype=np.int64)[::2]
