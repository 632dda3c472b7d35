"""Words and word hashes of a column of texts, in numpy over Arrow's UTF-8 buffers.

A word is a maximal run of word bytes. Both word classes in use exclude only ASCII
characters, so cutting UTF-8 bytes cuts whole code points. Memory is about 40 bytes for
each byte of text, so batches are cut to ``BATCH_BYTES``; one longer text is one batch.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa

BATCH_BYTES = 2 << 20

_U = np.uint64


def _byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = ~_byte_set((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = ~_byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

LETTER = _byte_set((0x61, 0x7A))
PUNCTUATION = _byte_set((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

_random = np.random.Generator(np.random.PCG64(20240101))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) | _U(1)
_STEP = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Words:
    """The words of ``n`` texts: text ``row[i]`` has the i-th word, ``data[start[i]:end[i]]``."""

    n: int
    data: np.ndarray
    offset: np.ndarray
    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    @property
    def first(self) -> np.ndarray:
        """Index of each text's first word."""
        return np.cumsum(self.counts) - self.counts

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.empty(0, _U)
        length = self.end - self.start
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        power = np.full(int(length.max()), _STEP, _U)
        power[0] = 1
        power = np.multiply.accumulate(power)
        parts = _BYTE[self.data[np.repeat(self.start, length) + at]] * power[at]
        return mix(np.add.reduceat(parts, np.cumsum(length) - length) + length.astype(_U))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and each text's offset in them (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offset = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offset[0] : offset[-1]], offset - offset[0]


def words_of(column: pa.Array, kind: np.ndarray = NOT_SPACE, lower: bool = True, cut: list[tuple] | None = None) -> Words:
    """``cut``: pairs of byte classes; a word also ends between a byte of the one and a byte of the other."""
    data, offset = bytes_of(column)
    n = len(offset) - 1
    if lower:
        data = LOWER[data]
    inside = kind[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    edges = offset[offset < len(data)]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    for left, right in cut or ():
        at = np.flatnonzero(left[data[:-1]] & right[data[1:]])
        before[at + 1] = False
        after[at] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(start, offset))
    return Words(n, data, offset, start, end, counts)


def windows(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, by text: (hash, text, index of the first word in its text)."""
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    whole = np.flatnonzero(at + k <= counts[row])
    out = np.zeros(len(whole), _U)
    for i in range(k):
        out = mix(out * _STEP + hashes[whole + i] + _U(i + 1))
    return out, row[whole], at[whole]


def give_back() -> None:
    """Return freed memory to the system: Python workers stay alive, idle, after their task."""
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offset = bytes_of(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offset, offset[at] + size, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    give_back()


class IdCache:
    """Token ids of words, each distinct word encoded once while it is remembered.

    ``learn`` maps a list of words (UTF-8 bytes) to their lists of ids. What is remembered is
    for speed only: sorted arrays of hashes, places, lengths and uses (28 bytes a word, and its
    ids). Beyond ``limit`` words the half used least is forgotten.
    """

    def __init__(self, learn, limit: int = 1_000_000):
        self.learn, self.limit = learn, limit
        self.hashes = np.empty(0, _U)
        self.first = np.empty(0, np.int64)
        self.length = np.empty(0, np.int32)
        self.uses = np.empty(0, np.int64)
        self.ids = np.empty(1 << 16, np.uint32)
        self.filled = 0

    def _add(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Remember new words; ``hashes`` ascend."""
        ids = self.learn(words)
        length = np.fromiter(map(len, ids), np.int32, len(ids))
        more = int(length.sum())
        if self.filled + more > len(self.ids):
            grown = np.empty(max(2 * len(self.ids), self.filled + more), np.uint32)
            grown[: self.filled] = self.ids[: self.filled]
            self.ids = grown
        self.ids[self.filled : self.filled + more] = np.fromiter(chain.from_iterable(ids), np.uint32, more)
        first = self.filled + np.cumsum(length, dtype=np.int64) - length
        self.filled += more
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.first = np.insert(self.first, at, first)
        self.length = np.insert(self.length, at, length)
        self.uses = np.insert(self.uses, at, 0)

    def _halve(self) -> None:
        half = max(self.limit // 2, 1)
        kept = np.sort(np.argpartition(-self.uses, half - 1)[:half])
        length = self.length[kept].astype(np.int64)
        ends = np.cumsum(length)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.first[kept] - (ends - length), length)]
        self.hashes, self.length, self.uses = self.hashes[kept], self.length[kept], self.uses[kept] // 2
        self.first, self.ids, self.filled = ends - length, ids, len(ids)

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        return known

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids in each text)."""
        if not len(words.start):
            return np.empty(0, np.uint32), np.zeros(words.n, np.int64)
        hashes, example, which, times = np.unique(
            words.hashes(), return_index=True, return_inverse=True, return_counts=True
        )
        if len(self.hashes) > self.limit:
            self._halve()
        new = np.flatnonzero(~self._known(hashes))
        if len(new):
            self._add(hashes[new], [words.data[words.start[i] : words.end[i]].tobytes() for i in example[new]])
        own = np.searchsorted(self.hashes, hashes)
        self.uses[own] += times
        index = own[which]
        length = self.length[index].astype(np.int64)
        ends = np.cumsum(length)
        at = np.arange(ends[-1]) + np.repeat(self.first[index] - (ends - length), length)
        per_text = np.add.reduceat(np.append(length, 0), words.first)
        per_text[words.counts == 0] = 0
        return self.ids[at], per_text
