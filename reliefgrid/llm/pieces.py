"""Cuts whole texts into the pieces that a byte-pair vocabulary merges within, for a slice of documents at once, on arrays.

Two cuts are known. ``spaced``: runs of letters, of numbers or of other signs, each with one blank before it, and runs of white space.
``bare``: runs of letters, single numbers and runs of other signs, in lower case, without white space. Only characters whose class is
the same in every Unicode version of the last years are classed here; a text with any other character, with a contraction or with a
special string is left to the tokenizer library, piece by piece.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from reliefgrid.llm.words import MASK, mixed, powers

SLICE_BYTES = 1 << 19
BASE = 0xA0761D6478BD642F
LETTER, NUMBER, OTHER, SPACE, FOREIGN = 1, 2, 3, 0, 4
CONTRACTION = re.compile(r"'(?:[stmd]|re|ve|ll)", re.IGNORECASE)


def classes() -> np.ndarray:
    """Class of each code point below U+2100."""
    out = np.full(0x2100, FOREIGN, np.uint8)
    for code in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]:
        kind = unicodedata.category(chr(code))[0]
        out[code] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = SPACE
    # engines differ over these control characters, and this capital letter becomes two characters
    out[[*range(0x1C, 0x20), 0x130]] = FOREIGN
    return out


class Slice:
    """Pieces of some documents: those of document i are ``first[i]`` to ``first[i + 1]``; where ``left[i]`` holds, there are none."""

    def __init__(self, texts: list[str], left: np.ndarray, first: np.ndarray, hashes: np.ndarray, starts, ends, joined: str, bare: bool):
        self.texts, self.left, self.first, self.hashes = texts, left, first, hashes
        self.starts, self.ends, self.joined, self.bare = starts, ends, joined, bare

    def piece(self, i: int) -> str:
        piece = self.joined[self.starts[i] : self.ends[i]]
        return piece.lower() if self.bare else piece


class Cutter:
    def __init__(self, bare: bool, specials: list[str]):
        self.bare, self.classes, self.size = bare, classes(), 0
        self.lower = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x2100)], np.uint32)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self._grow(SLICE_BYTES + 1)

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size, self.up, self.down = n, powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)

    def slices(self, texts: pa.Array) -> Iterator[Slice]:
        """Null texts are empty."""
        held, size = [], 0
        for text in texts.to_pylist():
            held.append(text or "")
            size += len(held[-1])
            if size >= SLICE_BYTES:
                yield self._cut(held)
                held, size = [], 0
        if held:
            yield self._cut(held)

    def _cut(self, texts: list[str]) -> Slice:
        joined = "".join(texts)
        edges = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in texts], out=edges[1:])
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(codes)
        self._grow(n + 1)
        kinds = self.classes[np.minimum(codes, 0x20FF)]
        kinds[codes > 0x20FF] = FOREIGN
        doc = np.zeros(len(texts), bool)
        for bad in self._odd(joined, kinds):
            doc[np.minimum(np.searchsorted(edges, bad, "right") - 1, len(texts) - 1)] = True
        # texts are not empty where something odd was found in them, so an edge that several share leads to the last of them
        if self.bare:
            codes = self.lower[np.minimum(codes, 0x20FF)]  # characters beyond stand in texts that are left
        begin, end = self._bounds(codes, kinds, edges[(edges > 0) & (edges < n)])
        keep = ~doc[np.searchsorted(edges, begin, "right") - 1] if doc.any() else slice(None)
        begin, end = begin[keep], end[keep]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * self.up[:n], out=sums[1:])
        hashes = mixed((sums[end] - sums[begin]) * self.down[begin])
        return Slice(texts, doc, np.searchsorted(begin, edges), hashes, begin, end, joined, self.bare)

    def _odd(self, joined: str, kinds: np.ndarray) -> Iterator[np.ndarray]:
        yield np.flatnonzero(kinds == FOREIGN)
        if "'" in joined:
            yield np.array([m.start() for m in CONTRACTION.finditer(joined)], np.int64)
        if self.special and self.special.search(joined):
            yield np.array([m.start() for m in self.special.finditer(joined)], np.int64)

    def _bounds(self, codes: np.ndarray, kinds: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(codes)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh = np.zeros(n, bool)  # begins a document
        fresh[0], fresh[inner] = True, True
        start = fresh.copy()
        start[1:] |= kinds[1:] != kinds[:-1]
        if self.bare:
            start |= kinds == NUMBER
            begin = np.flatnonzero(start)
            end = np.append(begin[1:], n)
            solid = kinds[begin] != SPACE
            return begin[solid], end[solid]
        # the last sign of a run of white space before something else: a blank joins what follows, any other stands alone
        last = np.zeros(n, bool)
        last[:-1] = (kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & ~fresh[1:]
        start |= last
        blank = np.flatnonzero(last & (codes == 0x20))
        start[blank + 1] = False
        begin = np.flatnonzero(start)
        return begin, np.append(begin[1:], n)
