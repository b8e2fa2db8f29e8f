"""Ranked lexical search: K2-treaps over the grid of terms and documents.

A grid has a row for each term that the items ask for and a column for each document of a shard; a point holds the impact of its term
in its document, without the term's weight. A K2-treap halves both axes at each level, keeps only cells that hold points, and stores
for each cell which of its four children exist and the greatest impact below it (as the difference to its parent's). All terms of an
item go down together: a range of documents has one cell for each term, and the weighted sum of their maxima bounds every score in
the range. Ranges are opened best first, a batch at a time, until no bound reaches the k-th score. Rows lie 512 apart, so that
ranges of 512 documents have cells that hold no other term.

Postings of the asked terms are written once, then shards are built where the postings lie, without a shuffle. A task takes each
item's k-th score along from shard to shard; before that, a bounded sample of the documents gives every item a score that at least k
documents reach, so that shards open only what can still change the result. Items go in blocks of bounded size, each against all documents.

Defined results: a null or empty text has no terms; each row of the documents is one document and each row of the items one item,
also when rows repeat or share an id; a document with a null id counts in N, L and df, and is never returned; an item without terms, or
whose terms no document holds, has no rows; equal scores come by ascending doc_id; an empty table on either side gives an empty table;
other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reliefgrid.llm.stored import stored

TOP = 20
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # the same characters in UTF-8: digits, letters, everything beyond ASCII
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
ITEM_BLOCK_BYTES = 16 << 20  # texts of the items that go against the documents at once
SHARD_DOCS = 8_192
SHARD_POINTS = 1 << 20  # a shard ends with the document that reaches it
SAMPLE_DOCS = 16_384  # documents searched first; they decide no result, only how early the others stop
ROW_GAP_BITS = 9  # less where rows would not fit in 32 bits
BATCH = 64
POPCOUNT = np.array([bin(x).count("1") for x in range(16)], np.int64)


def spread_bits(x: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers at the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def encoded(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells from the root down, level by level: the children each has (bit 2 * lower half + right half), and how far its greatest
    value lies below its parent's. Points are distinct, there is at least one."""
    codes = (spread_bits(rows) << np.uint64(1)) | spread_bits(cols)
    order = np.argsort(codes)
    codes, top = codes[order], values[order]
    children, drops = [np.zeros(len(codes), np.uint8)], []
    for _ in range(height):
        above = codes >> np.uint64(2)
        starts = np.flatnonzero(np.concatenate(([True], above[1:] != above[:-1])))
        greatest = np.maximum.reduceat(top, starts)
        drops.append(np.repeat(greatest, np.diff(np.append(starts, len(top)))) - top)
        children.append(np.bitwise_or.reduceat(np.uint8(1) << (codes & np.uint64(3)).astype(np.uint8), starts))
        codes, top = above[starts], greatest
    drops.append(top)
    return np.concatenate(children[::-1]), np.concatenate(drops[::-1]).astype(np.int32)


class Treap:
    """The cells of ``encoded`` made ready for descents; cell ``none`` stands for all that do not exist."""

    def __init__(self, children: np.ndarray, drops: np.ndarray, height: int):
        count = len(children)
        self.height, self.none = height, count
        sizes = POPCOUNT[children]
        self.first = np.append(1 + np.cumsum(sizes) - sizes, 0)
        self.children = np.append(children, np.uint8(0))
        self.top = np.zeros(count + 1, np.int64)
        self.top[0] = drops[0]
        low, high = 0, 1
        while high < count:
            below = high + int(sizes[low:high].sum())
            self.top[high:below] = np.repeat(self.top[low:high], sizes[low:high]) - drops[high:below]
            low, high = high, below

    def search(self, rows: np.ndarray, weights: np.ndarray, k: int, floor: tuple[int, int]) -> list[tuple[int, int]]:
        """Up to k best (score, column), ties to the smaller column. Of scores up to ``floor[0]`` only those equal to it in columns before
        ``floor[1]`` are wanted."""
        best: list[tuple[int, int]] = []  # a heap of (score, -column)
        todo = [(-int(self.top[0] * weights.sum()), 0, 0, np.zeros(len(rows), np.int64))]
        while todo:
            batch = []
            while todo and len(batch) < BATCH and (-todo[0][0], -todo[0][1]) > (floor[0], -floor[1]):
                score, start, level, cells = heapq.heappop(todo)
                if level < self.height:
                    batch.append((start, level, cells))
                    continue
                if len(best) < k:
                    heapq.heappush(best, (-score, -start))
                else:
                    heapq.heappushpop(best, (-score, -start))
                if len(best) == k and best[0] > (floor[0], -floor[1]):
                    floor = (best[0][0], -best[0][1])
            if not batch:
                break
            cells = np.array([x[2] for x in batch])
            shift = self.height - 1 - np.array([x[1] for x in batch])
            quadrant = ((rows[None, :] >> shift[:, None]) & 1) << 1
            have, first = self.children[cells], self.first[cells]
            for right in (0, 1):
                there = (have >> (quadrant + right)) & 1
                child = np.where(there == 1, first + POPCOUNT[have & ((1 << (quadrant + right)) - 1)], self.none)
                bounds = self.top[child] @ weights
                for i in np.flatnonzero(bounds >= max(floor[0], 1)).tolist():
                    start, level = batch[i][0] + (right << int(shift[i])), batch[i][1] + 1
                    if (bounds[i], -start) > (floor[0], -floor[1]):
                        heapq.heappush(todo, (-int(bounds[i]), start, level, child[i]))
        return [(score, -column) for score, column in best]


class Shard:
    """Treap of some documents; columns in the order of their ids."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, rows: np.ndarray, impacts: np.ndarray, terms: int):
        """``first[i]`` to ``first[i + 1]`` are the points of document i."""
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.treap = ids[order], None
        self.gap = min(ROW_GAP_BITS, 32 - terms.bit_length())
        if len(rows):
            height = max(1, ((terms - 1) << self.gap).bit_length(), (len(ids) - 1).bit_length())
            cols = np.repeat(place, np.diff(first))
            self.treap = Treap(*encoded(rows.astype(np.int64) << self.gap, cols, impacts, height), height)

    def search(self, rows: np.ndarray, weights: np.ndarray, k: int, floor: tuple[int, int]) -> list[tuple[int, int]]:
        """Up to k best (score, doc_id) above ``floor``: a score and the greatest doc_id that still counts at it."""
        if self.treap is None or not len(rows):
            return []
        column = int(np.searchsorted(self.ids, floor[1], "right")) if floor[0] else 0
        return [(s, int(self.ids[c])) for s, c in self.treap.search(rows << self.gap, weights, k, (floor[0], column))]


def terms_of(text: bytes | None) -> list[bytes]:
    return TERM.findall((text or b"").translate(FOLD))


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), row (numbers in the vocabulary), tf of every document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast({term: k for k, term in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            keep, sizes, rows, counts = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                held = terms_of(text.as_py())
                if held:
                    found = [(number[t], c) for t, c in Counter(held).items() if t in number]
                    keep.append(i)
                    sizes.append(len(held))
                    rows.append([r for r, _ in found])
                    counts.append([c for _, c in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.array(rows, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "row", "tf"],
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, n long, row array<int>, tf array<long>"), "postings")


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search_shards(table: DataFrame, asked: list, terms: int, n: int, total: int, k: int, floors: dict) -> DataFrame:
    """item, doc_id, score: the k best of each task's documents for each item. ``asked``: item, rows, weights."""
    shared = table.sparkSession.sparkContext.broadcast((asked, floors))  # of one block of items

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        held: list[tuple] = []
        points = docs = 0
        for batch in batches:
            low = 0
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            while low < batch.num_rows:
                room = np.searchsorted(np.cumsum(sizes[low:]), SHARD_POINTS - points) + 1
                high = min(batch.num_rows, low + SHARD_DOCS - docs, low + int(room))
                part = batch.slice(low, high - low)
                held.append((part, sizes[low:high]))
                points, docs, low = points + int(sizes[low:high].sum()), docs + high - low, high
                if docs >= SHARD_DOCS or points >= SHARD_POINTS:
                    yield shard(held)
                    held, points, docs = [], 0, 0
        if held:
            yield shard(held)

    def shard(held: list[tuple]) -> Shard:
        ids = np.concatenate([part.column(0).to_numpy() for part, _ in held])
        length = np.concatenate([part.column(1).to_numpy() for part, _ in held])
        rows = np.concatenate([part.column(2).flatten().to_numpy() for part, _ in held])
        tf = np.concatenate([part.column(3).flatten().to_numpy() for part, _ in held])
        sizes = np.concatenate([own for _, own in held])
        m = np.repeat(75 + (25 * length * n) // total, sizes)
        return Shard(ids, np.concatenate(([0], np.cumsum(sizes))), rows, (1_000_000_000 * tf) // (1000 * tf + 12 * m), terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, floors = shared.value
        best: dict[int, list[tuple[int, int]]] = {}
        floors = dict(floors)
        for own in shards(batches):
            for item, rows, weights in asked:
                found = own.search(rows, weights, k, floors.get(item, (0, 0)))
                if found:
                    best[item] = sorted(best.get(item, []) + found, key=lambda x: (-x[0], x[1]))[:k]
                    if len(best[item]) == k:
                        score, doc = best[item][-1]
                        floors[item] = max(floors.get(item, (0, 0)), (score, doc), key=lambda x: (x[0], -x[1]))
        for item, found in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(found), pa.int64()), pa.array([d for _, d in found], pa.int64()),
                 pa.array([s for s, _ in found], pa.int64())], names=["item", "doc_id", "score"],
            )

    rows = table.where(F.col("doc_id").isNotNull() & (F.size("row") > 0)).select("doc_id", "n", "row", "tf")
    return rows.mapInArrow(run, "item long, doc_id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank; a task's surplus is cut before the shuffle."""
    order = W.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """item, rank, doc_id, score for one block of items."""
    empty = docs.sparkSession.createDataFrame([], "item long, doc_id long, score long, rank int")
    terms = {row["item"]: Counter(terms_of(bytes(row["text"] or b""))) for row in items.collect()}  # at most ITEM_BLOCK_BYTES
    vocabulary = sorted(set().union(*terms.values()))
    if not vocabulary:
        return empty
    number = {term: r for r, term in enumerate(vocabulary)}
    table = postings(docs, vocabulary)
    sizes = table.agg(F.count("*").alias("n"), F.sum("n").alias("total")).first()
    n, total = sizes["n"], sizes["total"]
    df = {r["row"]: r["df"] for r in table.select(F.explode("row").alias("row")).groupBy("row").agg(F.count("*").alias("df")).collect()}
    asked = []
    for item, counts in terms.items():
        rows = sorted(number[t] for t in counts if number[t] in df)
        weights = [weight(df[r], n) * counts[vocabulary[r]] for r in rows]
        if rows:
            asked.append((item, np.array(rows, np.int64), np.array(weights, np.int64)))
    if not asked:
        return empty
    parts, floors = max(1, n // SAMPLE_DOCS), {}
    if parts > 1:
        sample = table.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0)
        first = best_of(search_shards(sample, asked, len(vocabulary), n, total, k, {}), k).where(F.col("rank") == k)
        floors = {r["item"]: (r["score"], r["doc_id"]) for r in first.collect()}
    return best_of(search_shards(table, asked, len(vocabulary), n, total, k, floors), k)


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for every item."""
    text = items["text"].cast("string").cast("binary")
    items = stored(items.select(items["item_id"].cast("long").alias("item_id"), text.alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    found = None
    for block in range(blocks):
        own = search_block(docs, items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block), k)
        found = own if found is None else found.unionByName(own)
    return found.join(items.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
