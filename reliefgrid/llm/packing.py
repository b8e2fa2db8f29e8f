"""Sum-of-squares packing of tokenised documents into sequences of fixed length.

Every document is its token ids and one end id. A document longer than a sequence is cut into full pieces, the first of which may be
shorter. Full pieces are sequences of their own; the others are dealt over blocks of bounded size and packed block by block: a piece
goes where the sum over gaps of the squared number of open bins with that gap becomes smallest, a new bin being one of the choices.

Defined results: a null or empty text is one end id; each row is packed by itself, also when rows or ids repeat or ids are null; an
empty table gives an empty table; columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.pieces import Cutter, Slice
from reliefgrid.llm.stored import stored

CAPACITY = 2048
END_ID = 0
BLOCK_PIECES = 50_000  # pieces packed together in one task
KNOWN_TOKENS = 16_000_000  # ids kept for known pieces in a task, 4 bytes each; beyond, pieces are encoded again
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class KnownIds:
    """Token ids of the pieces met so far: sorted hashes, where their ids lie, and the ids."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    def _encoded(self, pieces: list[str]) -> list[list[int]]:
        """Pieces of a blank and letters are encoded as one text: the library cuts it into just these pieces."""
        plain = [i for i, p in enumerate(pieces) if len(p) > 1 and p[0] == " " and p[1:].isalpha()]
        rest = sorted(set(range(len(pieces))) - set(plain))
        out: list[list[int]] = [[] for _ in pieces]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        for low in range(0, len(plain), 2000):
            part = plain[low : low + 2000]
            found = self.tokenizer.encode("".join(pieces[i] for i in part), add_special_tokens=False)
            for word, token in zip(found.word_ids, found.ids, strict=True):
                out[part[word]].append(token)
        return out

    def of(self, cut: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of each piece of the slice."""
        keys, first, back = np.unique(cut.hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        at, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at[known], size[known] = self.at[place[known]], self.size[place[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            found = self._encoded([cut.piece(i) for i in first[fresh].tolist()])
            size[fresh] = [len(x) for x in found]
            new = np.fromiter((t for x in found for t in x), np.uint32, int(size[fresh].sum()))
            if self.used + len(new) > KNOWN_TOKENS:
                # start over with what this slice needs
                again = KnownIds(self.tokenizer)
                self.keys, self.at, self.size, self.used = again.keys, again.at, again.size, 0
                if len(fresh) < len(keys):
                    return self.of(cut)
                place = np.searchsorted(self.keys, keys)
            if self.used + len(new) > len(self.ids):
                self.ids = np.concatenate((self.ids[: self.used], np.zeros(max(len(self.ids), len(new)), np.uint32)))
            at[fresh] = self.used + np.cumsum(size[fresh]) - size[fresh]
            self.ids[self.used : self.used + len(new)] = new
            self.used += len(new)
            self.keys = np.insert(self.keys, place[fresh], keys[fresh])
            self.at = np.insert(self.at, place[fresh], at[fresh])
            self.size = np.insert(self.size, place[fresh], size[fresh])
        return at[back], size[back]


def gathered(ids: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces one after another, and where each piece begins."""
    ends = np.cumsum(size)
    steps = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - (ends - size), size)
    return ids[steps], np.concatenate(([0], ends))


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())  # one vocabulary file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(shared.value)
        specials = [x.content for x in library.get_added_tokens_decoder().values()]
        cutter, known = Cutter(bare=False, specials=specials), KnownIds(library)
        for batch in batches:
            names, rows, row = batch.column(0).to_pylist(), [], 0
            for cut in cutter.slices(batch.column(1)):
                at, size = known.of(cut)
                ids, begins = gathered(known.ids, at, size)
                for i in range(len(cut.texts)):
                    if cut.left[i]:
                        own = np.array(library.encode(cut.texts[i], add_special_tokens=False).ids, np.uint32)
                    else:
                        own = ids[begins[cut.first[i]] : begins[cut.first[i + 1]]]
                    own = np.append(own, np.uint32(END_ID)).astype("<u4")
                    start, piece, size_now = 0, 0, (len(own) - 1) % capacity + 1
                    while start < len(own):
                        rows.append((names[row], piece, start, size_now, crc32(own[start : start + size_now].tobytes())))
                        start, piece, size_now = start + size_now, piece + 1, capacity
                    row += 1
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, in the order given, and the number of bins.

    With N(g) open bins of gap g, a piece of length s put into gap g changes the sum of squares by 2 (N(g - s) - N(g) + 1), by
    1 - 2 N(s) where it fills the bin, and by 2 N(capacity - s) + 1 in a new bin. Ties go to the smaller gap.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)  # count[0] stays 0: full bins are not open
    bins, offsets, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for k, s in enumerate(lengths.tolist()):
        cost = np.where(count[s:] > 0, 2 * (count[: capacity + 1 - s] - count[s:] + 1), never)
        if count[s]:
            cost[0] = 1 - 2 * count[s]
        best = int(cost.argmin())
        gap = best + s
        if cost[best] <= 2 * count[capacity - s] + 1:
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            b, gap, n = n, capacity, n + 1
        bins[k], offsets[k] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets, n


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Every piece with its sequence_id and its offset there; sequences of one block are numbered from block * 2**32 on."""
    pieces = stored(
        cut_documents(docs, tokenizer_path, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces"
    )
    full, short = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    blocks = max(1, -(-short.count() // block_pieces))
    names = [*pieces.columns[:-1], "sequence_id", "offset"]

    def place(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        bins, offsets, _ = sum_of_squares(block["length"].to_numpy(), capacity)
        return block.assign(sequence_id=block["block"].astype("int64") * (1 << 32) + bins, offset=offsets)[names]

    packed = (
        short.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long"))
        .groupBy("block").applyInPandas(place, PLACES)
    )
    alone = full.select(*pieces.columns[:-1], (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
