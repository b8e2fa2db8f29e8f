"""Token counts by byte-pair merging with a heap and a linked list: the count is the initial symbols minus the merges.

Within a piece the adjacent pair of lowest rank, leftmost first, is merged until no pair has a rank. No identifiers are made.

Defined results: a null text is empty and has 0 tokens; each row is counted by itself, also when ids repeat or are null; an empty
table gives an empty table; columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from reliefgrid.llm.pieces import Cutter, Slice

MAX_TOKENS = 2048
CACHED_PIECES = 2_000_000  # rows of the table of known pieces in a task, 12 bytes each; beyond, pieces are counted again
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_signs() -> list[str]:
    """The visible sign that byte-level vocabularies use for each byte."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    signs, n = {}, 0
    for b in range(256):
        if b in seen:
            signs[b] = chr(b)
        else:
            signs[b], n = chr(256 + n), n + 1
    return [signs[b] for b in range(256)]


class MergeCounter:
    """Counts the tokens of one piece."""

    def __init__(self, ranks: dict[tuple[str, str], int], word_end: str):
        self.ranks, self.word_end, self.signs = ranks, word_end, byte_signs()

    def count(self, piece: str) -> int:
        return self.merged([self.signs[b] for b in piece.encode()])

    def merged(self, symbols: list[str]) -> int:
        """Initial symbols minus merges. Symbols hold the linked list: following and previous position."""
        n = count = len(symbols)
        if not n:
            return 0
        symbols[-1] += self.word_end
        ranks, get = self.ranks, self.ranks.get
        heap = [(r, i, pair) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := get(pair)) is not None]
        if not heap:
            return count
        heapq.heapify(heap)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = following[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = a + b, ""
            count -= 1
            following[i] = k = following[j]
            if k < n:
                previous[k] = i
                pair = (symbols[i], symbols[k])
                if pair in ranks:
                    heapq.heappush(heap, (ranks[pair], i, pair))
            h = previous[i]
            if h >= 0:
                pair = (symbols[h], symbols[i])
                if pair in ranks:
                    heapq.heappush(heap, (ranks[pair], h, pair))
        return count


class KnownPieces:
    """Sorted hashes of pieces already counted and their counts."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def of(self, cut: Slice, counter: MergeCounter) -> np.ndarray:
        """Count of each piece of the slice."""
        keys, at, back = np.unique(cut.hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        counts = np.zeros(len(keys), np.int32)
        counts[known] = self.counts[place[known]]
        fresh = np.flatnonzero(~known)
        counts[fresh] = [counter.count(cut.piece(i)) for i in at[fresh].tolist()]
        if len(fresh) and len(self.keys) + len(fresh) <= CACHED_PIECES:
            self.keys = np.insert(self.keys, place[fresh], keys[fresh])
            self.counts = np.insert(self.counts, place[fresh], counts[fresh])
        return counts[back]


def count_tokens(docs: DataFrame, vocabulary: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. ``vocabulary``: path of a byte-level word vocabulary, as the driver sees it."""
    source = Path(vocabulary).read_text()
    rules = json.loads(source)
    specials = [x["content"] for x in rules["added_tokens"]]
    word_end = rules["model"]["end_of_word_suffix"] or ""
    shared = docs.sparkSession.sparkContext.broadcast(source)  # one vocabulary file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(shared.value)
        ranks = {tuple(pair): i for i, pair in enumerate(json.loads(shared.value)["model"]["merges"])}
        counter, cutter, known = MergeCounter(ranks, word_end), Cutter(bare=True, specials=specials), KnownPieces()

        def by_library(text: str) -> int:
            """The library cuts the text; the pieces are merged here."""
            found, total = cutter.special.finditer(text) if cutter.special else (), 0
            at = 0
            for m in [*found, None]:
                part = text[at : m.start() if m else len(text)]
                pieces = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(part))
                total += sum(counter.merged(list(p)) for p, _ in pieces) + (m is not None)
                at = m.end() if m else at
            return total

        for batch in batches:
            totals = []
            for cut in cutter.slices(batch.column(1)):
                sums = np.concatenate(([0], np.cumsum(known.of(cut, counter), dtype=np.int64)))
                total = sums[cut.first[1:]] - sums[cut.first[:-1]]
                for i in np.flatnonzero(cut.left).tolist():
                    total[i] = by_library(cut.texts[i])
                totals.append(total)
            tokens = np.concatenate(totals) if totals else np.zeros(0, np.int64)
            size = pc.binary_length(batch.column(1).fill_null("")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(tokens, pa.int64()), pa.array(tokens > max_tokens)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, SCHEMA)
