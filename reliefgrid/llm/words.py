"""Words of whole texts as arrays: positions, 64-bit hashes and hashes of word windows, for a slice of documents at once.

A word is a maximal run of characters other than blank and U+0009 to U+000D. Those are single bytes in UTF-8, so words are found
on the bytes. Hashes are polynomial prefix sums modulo 2**64, mixed afterwards; all work is done on arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19  # text handled at once, which takes some sixty times that; a longer document makes a slice of its own
BYTE_BASE = 0x9E3779B97F4A7C15  # odd, as are all bases: they have an inverse modulo 2**64
WORD_BASE = 0xD1342543DE82EF95
MASK = (1 << 64) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of the sums over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & MASK, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Words of the documents of one slice: ``first[i]`` to ``first[i + 1]`` are the words of document i."""

    def __init__(self, count: int, first: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray):
        self.count, self.first, self.hashes, self.starts, self.ends, self.data = count, first, hashes, starts, ends, data
        self.sizes = np.diff(first)
        self.doc = np.repeat(np.arange(count), self.sizes)


class Reader:
    """Holds the tables of powers; one for each task."""

    def __init__(self, lower: bool, slice_bytes: int = SLICE_BYTES):
        self.slice_bytes = slice_bytes
        space = np.zeros(256, bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        self.space, self.fold, self.lower, self.size = space, fold, lower, 0
        self._grow(slice_bytes + 1)

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = n
            self.up, self.down = powers(BYTE_BASE, n), powers(pow(BYTE_BASE, -1, 1 << 64), n)
            self.wup, self.wdown = powers(WORD_BASE, n), powers(pow(WORD_BASE, -1, 1 << 64), n)

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, Words]]:
        """(index of the first document, its slice's words); a null text has no words."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        if not n:
            return
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        low = 0
        while low < n:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + self.slice_bytes, "right")) - 1)
            high = min(high, n)
            yield low, self._words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            low = high

    def _words(self, data: np.ndarray, edges: np.ndarray) -> Words:
        if self.lower:
            data = self.fold[data]
        count, n = len(edges) - 1, len(data)
        self._grow(n + 1)
        inside = ~self.space[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        inner = edges[(edges > 0) & (edges < n)]
        before[inner], after[inner - 1] = False, False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * self.up[:n], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * self.down[starts])
        return Words(count, np.searchsorted(starts, edges), hashes, starts, ends, data)

    def windows(self, words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they all lie in one document."""
        n = len(words.hashes)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        sums = self.sums(words)
        at = np.arange(n - k + 1)
        return mixed((sums[k:] - sums[:-k]) * self.wdown[at]), words.doc[: n - k + 1] == words.doc[k - 1 :]

    def sums(self, words: Words) -> np.ndarray:
        out = np.zeros(len(words.hashes) + 1, np.uint64)
        np.cumsum(words.hashes * self.wup[: len(words.hashes)], out=out[1:])
        return out

    def whole(self, words: Words, docs: np.ndarray) -> np.ndarray:
        """Hash of all words of each of these documents."""
        sums = self.sums(words)
        low, high = words.first[docs], words.first[docs + 1]
        return mixed((sums[high] - sums[low]) * self.wdown[np.minimum(low, self.size - 1)])
