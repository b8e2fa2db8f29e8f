"""Repeated word sequences across and within documents, by suffix trees over groups of suffixes that share a prefix.

Suffixes start at words. Only those whose next ``window`` words may occur twice matter; they are found by anchors: of the eight-word
sequences in a window the one of least hash is its anchor, so equal windows have equal anchors, and a window whose anchor occurs once
in the corpus is unique. Anchors are a seventh of all positions; their counts become bit arrays of bounded size that every task reads.

What remains is dealt by the suffix that begins at the anchor, by a prefix of it whose length follows the anchor's count: eight words
where these leave a group that fits in memory, otherwise the longest run of words around the anchor that half of its windows share
(the anchor with six words behind it, or before it, for windows of 20), and for still larger groups that run with a salt. Neighbouring windows with one
prefix travel as one run of words, so a word is sent some four times, not twenty.

A task reads its groups in pieces of bounded size and names the nodes of their suffix trees depth by depth: words at depth one, pairs
of nodes at depths 2, 4, 8, 16 and ``window``. Names are given to words and to pairs of names, never to hashes, so two suffixes lie
below one deep node only if their words are equal. Of each deep node the earliest suffix stays and the others are marked, with the
earliest as their source. Groups that are salted or cut by the size of a piece also hand on the earliest suffix of each of their nodes
with its words, and these are merged by their words. ``maximal_repeats`` joins neighbouring marks whose sources are neighbours too.

Defined results: a null text has no words; texts shorter than a window have no windows; the earlier of two windows is that of the
smaller doc_id, then of the earlier start; rows that repeat an id are taken in the order of their texts' hashes, and equal rows are one
document, so that each keeps what the one keeps; a null id comes before all others; an empty table gives an empty table; columns other than ``doc_id`` and
``text`` are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reliefgrid.llm.stored import discard, stored
from reliefgrid.llm.words import Reader, Words, mixed

WINDOW = 20
PREFIX = 8
BITS_PER_ANCHOR = 16
MAX_BITS = 1 << 28  # 32 MB; a fuller array lets more suffixes through, never fewer
SLICE_BITS = 1 << 20
LONG_GROUP, SALTED_GROUP = 512, 4_096  # anchors that occur more often get longer prefixes, and salts
SALTS = 32
RUN = 16  # windows that travel as one run of words
PIECE_BYTES = 8 << 20  # words of runs that a task names at once
LEVELS = ("any", "long", "salted")


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours, by doubling."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = best(out[: len(out) - step], out[step:])
        done += step
    return out


class Windows:
    """Windows of the documents of one slice: where they start, their anchor, and the hashes of all sequences of PREFIX words."""

    def __init__(self, reader: Reader, words: Words, window: int):
        span = window - PREFIX + 1
        _, good = reader.windows(words, window)
        self.starts = np.flatnonzero(good)
        if not len(self.starts):
            self.grams = self.anchors = self.chosen = np.zeros(0, np.uint64)
            return
        self.grams, _ = reader.windows(words, PREFIX)
        least = sliding(self.grams, span, np.minimum)
        self.anchors = least[self.starts]
        # a position is chosen if some window that lies within a document has its anchor there
        bound = np.zeros(len(least), np.uint64)
        bound[self.starts] = self.anchors
        padded = np.concatenate((np.zeros(span - 1, np.uint64), bound, np.zeros(span - 1, np.uint64)))
        covers = np.zeros(len(least) + 2 * (span - 1), bool)
        covers[self.starts + span - 1] = True
        reach = sliding(padded, span, np.maximum)
        some = sliding(covers, span, np.logical_or)
        self.chosen = self.grams[some & (reach == self.grams)]

    def longer(self, reader: Reader, words: Words, window: int, starts: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """Hash of the anchor with the words behind it that its windows share, or before it, for windows that begin far before."""
        room = window - PREFIX
        more = room // 2
        at = np.full(len(starts), room)
        for k in range(room, -1, -1):
            at[self.grams[starts + k] == anchors] = k
        runs, _ = reader.windows(words, PREFIX + more)
        late = at > room - more
        return mixed(runs[starts + at - np.where(late, more, 0)] + np.where(late, 2, 1).astype(np.uint64))


def anchor_counts(docs: DataFrame, window: int) -> DataFrame:
    """anchor, n: positions chosen as anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lower=False)
        for batch in batches:
            for _, words in reader.slices(batch.column(0)):
                keys, counts = np.unique(Windows(reader, words, window).chosen, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["anchor", "n"]
                )

    return docs.select(docs["text"].cast("string")).mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def bit_arrays(counts: DataFrame) -> dict[str, np.ndarray]:
    """For each level a bit array of the anchors that occur often enough for it. Tasks fill slices, the driver puts them together."""
    repeated = stored(counts.where("n > 1"), "anchors")
    size = SLICE_BITS
    rows = repeated.count()
    while size < min(MAX_BITS, rows * BITS_PER_ANCHOR):
        size *= 2
    slices = size // SLICE_BITS
    spot = F.col("anchor").bitwiseAND(F.lit(size - 1))
    marks = repeated.select(
        F.floor(spot / SLICE_BITS).cast("int").alias("slice"), F.pmod(spot, F.lit(SLICE_BITS)).cast("int").alias("bit"),
        F.when(F.col("n") > SALTED_GROUP, 2).when(F.col("n") > LONG_GROUP, 1).otherwise(0).alias("level"),
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their slice, so one slice is held at a time."""
        held: tuple[int, np.ndarray] | None = None
        for batch in batches:
            at, bit, level = (c.to_numpy() for c in batch.columns)
            for s in np.unique(at).tolist():
                if held is None or held[0] != s:
                    if held:
                        yield packed(*held)
                    held = (s, np.zeros((len(LEVELS), SLICE_BITS), bool))
                own = at == s
                for k in range(len(LEVELS)):
                    held[1][k, bit[own & (level >= k)]] = True
        if held:
            yield packed(*held)

    def packed(s: int, bits: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([s], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["slice", "bits"]
        )

    parts = min(slices, 64)
    filled = marks.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(fill, "slice int, bits binary")
    out = np.zeros((len(LEVELS), slices, SLICE_BITS // 8), np.uint8)
    filled = stored(filled, "bits", free=True)
    for row in filled.toLocalIterator():
        out[:, row["slice"]] = np.frombuffer(row["bits"], np.uint8).reshape(len(LEVELS), -1)
    discard(filled, repeated)
    return {name: out[k].reshape(-1) for k, name in enumerate(LEVELS)}


RUNS = "key long, doc_id long, tie long, start int, salted boolean, words string"


def candidate_runs(docs: DataFrame, window: int) -> DataFrame:
    """key of the group, doc_id, tie (of rows that share an id), start, words of up to RUN neighbouring windows of one group."""
    bits = bit_arrays(anchor_counts(docs, window))
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = Reader(lower=False), shared.value
        mask = np.uint64(8 * len(held["any"]) - 1)

        def among(level: str, anchors: np.ndarray) -> np.ndarray:
            spot = anchors & mask
            return (held[level][spot >> np.uint64(3)] >> (np.uint64(7) - (spot & np.uint64(7))).astype(np.uint8)) & 1 == 1

        for batch in batches:
            for low, words in reader.slices(batch.column(1)):
                w = Windows(reader, words, window)
                take = among("any", w.anchors)
                if not take.any():
                    continue
                starts, key = w.starts[take], w.anchors[take]
                many, salted = among("long", key), among("salted", key)
                doc = words.doc[starts]
                ties = reader.whole(words, np.arange(words.count))
                ids = batch.column(0).slice(low, words.count)
                if many.any():
                    key[many] = w.longer(reader, words, window, starts[many], key[many])
                    # parts of a salted group follow the document, so that their earliest suffixes can be merged
                    salt = mixed(ids.fill_null(0).to_numpy().astype(np.uint64) + ties)[doc] % np.uint64(SALTS)
                    key = np.where(salted, mixed(key + salt), key)
                yield from sent(words, starts, key, salted, ids, ties, doc)

    def sent(words, starts, key, salted, ids, ties, doc) -> Iterator[pa.RecordBatch]:
        n = len(starts)
        begins = np.ones(n, bool)
        begins[1:] = (starts[1:] != starts[:-1] + 1) | (key[1:] != key[:-1])
        leader = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        heads = np.flatnonzero((np.arange(n) - leader) % RUN == 0)
        tails = np.append(heads[1:], n) - 1
        data = words.data.tobytes()
        for k in range(0, len(heads), 1 << 14):
            h, t = heads[k : k + (1 << 14)], tails[k : k + (1 << 14)]
            spans = zip(words.starts[starts[h]].tolist(), words.ends[starts[t] + window - 1].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[h].view(np.int64)), ids.take(pa.array(doc[h])), pa.array(ties[doc[h]].view(np.int64)),
                 pa.array((starts[h] - words.first[doc[h]]).astype(np.int32)), pa.array(salted[h]),
                 pa.array([data[a:b] for a, b in spans], pa.binary()).cast(pa.string())],
                names=["key", "doc_id", "tie", "start", "salted", "words"],
            )

    rows = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return rows.mapInArrow(run, RUNS)


def node_names(words: pa.Array, window: int, at: np.ndarray) -> np.ndarray:
    """Names of the nodes at depth ``window`` above the suffixes that start at the words ``at``: equal names, equal words."""
    names = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    depth = 1
    while 2 * depth <= window:
        names, depth = paired(names[:-depth], names[depth:]), 2 * depth
    return paired(names[at], names[at + window - depth])


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each different pair; both are below 2**31."""
    return pd.factorize((a << 32) | b)[0].astype(np.int64)


class Piece:
    """Runs of some groups, in the order of their suffixes: the node of each suffix and the earliest suffix of each node."""

    def __init__(self, rows: pa.Table, window: int):
        self.window = window
        doc = rows["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy()
        order = np.lexsort((rows["start"].to_numpy(), rows["tie"].to_numpy(), doc))
        rows = rows.take(pa.array(order)).combine_chunks()
        self.rows, doc = rows, doc[order]
        split = pc.ascii_split_whitespace(rows["words"].combine_chunks())
        self.words = split.flatten()
        sizes = split.value_lengths().to_numpy().astype(np.int64)
        self.counts = sizes - window + 1
        self.heads = np.cumsum(self.counts) - self.counts
        self.row = np.repeat(np.arange(len(sizes)), self.counts)
        self.offset = np.arange(len(self.row)) - self.heads[self.row]
        self.at = (np.cumsum(sizes) - sizes)[self.row] + self.offset
        self.start = rows["start"].to_numpy()[self.row].astype(np.int64) + self.offset
        names = node_names(self.words, window, self.at)
        earliest = np.zeros(names.max() + 1, np.int64)
        earliest[names[::-1]] = np.arange(len(names))[::-1]
        self.leader = earliest[names]
        tie, lead = rows["tie"].to_numpy(), self.row[self.leader]
        # rows that repeat whole are one document: their suffixes are the leader, too
        self.first = (doc[self.row] == doc[lead]) & (tie[self.row] == tie[lead]) & (self.start == self.start[self.leader])

    def suffixes(self, which: np.ndarray) -> list[pa.Array]:
        """doc_id, tie, start"""
        row = pa.array(self.row[which])
        return [self.rows["doc_id"].combine_chunks().take(row), self.rows["tie"].combine_chunks().take(row),
                pa.array(self.start[which].astype(np.int32))]

    def texts(self, which: np.ndarray) -> pa.Array:
        if not len(which):
            return pa.array([], pa.string())
        taken = self.words.take(pa.array((self.at[which][:, None] + np.arange(self.window)).ravel()))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(which) + 1) * self.window, pa.int32()), taken)
        return pc.binary_join(lists, " ")

    def leaders(self, open_rows: np.ndarray) -> np.ndarray:
        """The earliest suffix of each node of groups that go on elsewhere."""
        own = np.arange(len(self.row))
        return np.flatnonzero((self.leader == own) & open_rows[self.row])

    def masks(self) -> np.ndarray:
        """For each run a bit for each marked window."""
        bits = np.where(self.first, 0, 1 << self.offset)
        return np.bitwise_or.reduceat(bits, self.heads).astype(np.int32)


def pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[Piece, np.ndarray]]:
    """Pieces of bounded size of runs that come in order of their groups, and which rows are of groups that go on elsewhere."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None

    def piece() -> tuple[Piece, np.ndarray]:
        out = Piece(pa.Table.from_batches(held), window)
        key = out.rows["key"].to_numpy()
        cut = np.isin(key, [k for k in (last, held[-1].column(0)[-1].as_py()) if k is not None])
        return out, cut | out.rows["salted"].to_numpy()

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= PIECE_BYTES:
            yield piece()
            last, held, size = held[-1].column(0)[-1].as_py(), [], 0
    if held:
        yield piece()


SUFFIX = "doc_id long, tie long, start int"


def marked_runs(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tie, start, mask: bit k stands for the window at start + k, which also starts earlier."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "tie", "start", "mask", "node"]
        for piece, going_on in pieces(batches, window):
            masks, leaders = piece.masks(), piece.leaders(going_on)
            marked = np.flatnonzero(masks)
            yield pa.RecordBatch.from_arrays(
                [*piece.suffixes(piece.heads[marked]), pa.array(masks[marked]), pa.nulls(len(marked), pa.string())], names=names
            )
            yield pa.RecordBatch.from_arrays(
                [*piece.suffixes(leaders), pa.array(np.ones(len(leaders), np.int32)), piece.texts(leaders)], names=names
            )

    walked = stored(grouped(docs, window).mapInArrow(walk, f"{SUFFIX}, mask int, node string"), "suffixes", free=True)
    late = late_leaders(walked.where("node is not null")).select("doc_id", "tie", "start", "mask")
    return walked.where("node is null").drop("node").unionByName(late)


def grouped(docs: DataFrame, window: int) -> DataFrame:
    return candidate_runs(docs, window).repartition("key").sortWithinPartitions("key")


def late_leaders(leaders: DataFrame) -> DataFrame:
    """Those of the suffixes of one node that are not the earliest, with the earliest; parts of a group hand on one each."""
    earliest = leaders.groupBy("node").agg(F.min(F.struct("doc_id", "tie", "start")).alias("e"))
    same = F.col("doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("tie") == F.col("e.tie")) & (F.col("start") == F.col("e.start"))
    return leaders.join(earliest, "node").where(~same)


def covered(runs: pa.Array, window: int, n: int) -> np.ndarray:
    """Which of n words some marked window covers."""
    run, bit = np.nonzero((runs.field(1).to_numpy()[:, None] >> np.arange(RUN)) & 1)
    starts = runs.field(0).to_numpy()[run] + bit
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + window, n), -1)
    return np.cumsum(steps)[:n] > 0


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, joined by one space) for every document."""
    marks = (
        marked_runs(docs, window).groupBy("doc_id", "tie").agg(F.collect_set(F.struct("start", "mask")).alias("runs"))
        # at most two runs for each word of the document
        .select(F.col("doc_id").alias("id"), F.col("tie").alias("text_hash"), "runs")
    )

    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lower=False)
        for batch in batches:
            row = 0
            for _, words in reader.slices(batch.column(1)):
                ties = reader.whole(words, np.arange(words.count))
                part = batch.slice(row, words.count)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ties.view(np.int64))], names=["doc_id", "text", "tie"]
                )
                row += words.count

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lower=False)
        for batch in batches:
            marks, row = batch.column(2), 0
            for _, words in reader.slices(batch.column(1)):
                sizes, removed, texts = words.sizes, [], []
                data = words.data.tobytes()
                for i in range(words.count):
                    low, high = words.first[i], words.first[i + 1]
                    begin, end = words.starts[low:high], words.ends[low:high]
                    found = marks[row + i]
                    if found.is_valid:
                        gone = covered(found.values, window, high - low)
                        begin, end = begin[~gone], end[~gone]
                    removed.append(high - low - len(begin))
                    texts.append(b" ".join([data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, words.count), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )
                row += words.count

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = rows.mapInArrow(tied, "doc_id long, text string, tie long")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("text_hash"))
    joined = rows.join(marks.hint("shuffle_hash"), same, "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def marked_suffixes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tie, start of every window that also starts earlier, and s_doc_id, s_tie, s_start of the earliest of its node."""
    own, source = ["doc_id", "tie", "start"], ["s_doc_id", "s_tie", "s_start"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, going_on in pieces(batches, window):
            marked, leaders = np.flatnonzero(~piece.first), piece.leaders(going_on)
            yield pa.RecordBatch.from_arrays(
                [*piece.suffixes(marked), *piece.suffixes(piece.leader[marked]), pa.nulls(len(marked), pa.string())],
                names=[*own, *source, "node"],
            )
            yield pa.RecordBatch.from_arrays(
                [*piece.suffixes(leaders), *piece.suffixes(leaders), piece.texts(leaders)], names=[*own, *source, "node"]
            )

    schema = f"{SUFFIX}, s_doc_id long, s_tie long, s_start int, node string"
    walked = stored(grouped(docs, window).mapInArrow(walk, schema), "sources", free=True)
    late = stored(late_leaders(walked.where("node is not null")).select(*own, "e"), "late")
    # sources that turned out not to be the earliest give way to the earliest
    moved = late.select(*[F.col(o).alias(f"l_{o}") for o in own], "e").distinct()
    meets = F.col("s_doc_id").eqNullSafe(F.col("l_doc_id")) & (F.col("s_tie") == F.col("l_tie")) & (F.col("s_start") == F.col("l_start"))
    marks = walked.where("node is null").join(moved, meets, "left").select(
        *own, *[F.when(F.col("e").isNull(), F.col(s)).otherwise(F.col(f"e.{o}")).alias(s) for o, s in zip(own, source, strict=True)]
    )
    return marks.unionByName(late.select(*own, *[F.col(f"e.{o}").alias(s) for o, s in zip(own, source, strict=True)])).distinct()


def maximal_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length in words, s_doc_id, s_start: sequences that repeat the earliest place that holds their words, as long as
    that place goes on; a sequence whose windows have other earliest places is cut there."""
    order = W.partitionBy("doc_id", "tie").orderBy("start")

    def step(name: str):
        return F.col(name) - F.lag(name).over(order)

    goes_on = (
        (step("start") == 1) & (step("s_start") == 1) & (F.col("s_tie") == F.lag("s_tie").over(order))
        & F.col("s_doc_id").eqNullSafe(F.lag("s_doc_id").over(order))
    )
    marks = marked_suffixes(docs, window).withColumn("new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    runs = marks.withColumn("run", F.sum("new").over(order))
    return runs.groupBy("doc_id", "tie", "run").agg(
        F.min("start").alias("start"), (F.max("start") - F.min("start") + window).alias("length"),
        F.first("s_doc_id").alias("s_doc_id"), F.min("s_start").alias("s_start"),
    ).select("doc_id", "start", "length", "s_doc_id", "s_start")


def digests(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
