"""Vectorised text primitives over Arrow string batches.

Texts of a batch are handled as one byte buffer, so that words, hashes and
shingles of many documents come out of a few numpy passes and no Python string
is made per word.  Work is done in slices of about ``SLICE`` bytes; a longer
document makes a slice of its own, and is never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
DOCS = 4000  # of a slice, so that a document's index fits 12 bits
HASH_BITS = 52
HASH_MASK = np.uint64((1 << HASH_BITS) - 1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULT = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n, kept for the next slices."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE + 4096)
        have = np.ones(size, np.uint64)
        have[1:] = np.uint64(base)
        np.multiply.accumulate(have, out=have)
        if size <= 4 * SLICE:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column) -> "list[tuple[int, int, np.ndarray, np.ndarray]]":
    """(first row, last row, bytes, offsets) of each slice; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        valid = np.asarray(column.is_valid())
        if (np.diff(offs)[~valid] != 0).any():
            column = column.fill_null("")
            offs = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
            data = np.frombuffer(column.buffers()[2], np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + SLICE, "right")) - 1
        j = min(n, max(i + 1, j), i + DOCS)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of one slice: byte ranges, documents, hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offs = offs
        n = len(data)
        self.n_docs = len(offs) - 1
        solid = ~SPACE[data]
        if n:
            first = np.zeros(n + 1, bool)
            first[offs] = True
            before = np.empty(n, bool)
            before[0] = False
            before[1:] = solid[:-1]
            self.starts = np.flatnonzero(solid & (~before | first[:-1]))
            after = np.empty(n, bool)
            after[-1] = False
            after[:-1] = solid[1:]
            self.ends = np.flatnonzero(solid & (~after | first[1:])) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.doc = np.searchsorted(offs[1:], self.starts, "right")
        self.first = np.searchsorted(self.starts, offs)  # of each document's words
        self.counts = np.diff(self.first)
        self._prefix = None

    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            n = len(self.data)
            self._prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * _power(_MULT, n)[:n], out=self._prefix[1:])
        return self._prefix

    def range_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges: equal bytes, equal hash."""
        h = self.prefix()
        back = _power(pow(_MULT, -1, 1 << 64), len(self.data) + 1)
        return mix((h[ends] - h[starts]) * back[starts] + (ends - starts).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.range_hash(self.starts, self.ends)


def shingle_keys(words: Words, size: int) -> np.ndarray:
    """Sorted distinct keys ``document << 52 | hash`` of word shingles.

    A document of fewer than ``size`` words, but one at least, has all of them
    as its only shingle; one without words has none.
    """
    h, n = words.hashes(), len(words.starts)
    if not n:
        return np.zeros(0, np.uint64)
    keys = []
    if n >= size:
        whole = words.doc[: n - size + 1] == words.doc[size - 1 :]
        at = np.flatnonzero(whole)
        got = np.zeros(len(at), np.uint64)
        for k in range(size):
            got = mix(got * np.uint64(_MULT) + h[at + k])
        keys.append(words.doc[at].astype(np.uint64) << np.uint64(HASH_BITS) | got & HASH_MASK)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        got = words.counts[short].astype(np.uint64) + np.uint64(0xABCDEF)
        for k in range(size - 1):
            has = words.counts[short] > k
            at = np.minimum(words.first[short] + k, n - 1)
            got = np.where(has, mix(got * np.uint64(_MULT) + h[at]), got)
        keys.append(short.astype(np.uint64) << np.uint64(HASH_BITS) | got & HASH_MASK)
    keys = np.sort(np.concatenate(keys))
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
