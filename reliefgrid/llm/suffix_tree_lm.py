"""Language-model scores from a probabilistic suffix tree over words.

The root holds the smoothed frequency of every training word. A context of up to three words is a candidate where the training text
holds it MIN_COUNT times, and a state of the tree where its next words are told apart from those of its longest state that is a
suffix: a divergence of at least MIN_DIVERGENCE. A state holds the words that follow it MIN_COUNT times; all other words get what
mass is left, in the proportions of the state below. A word is scored at the longest state that its past ends in.

The floor is a count, so the tree grows with the corpus. It is a set of tables: sequences of each length are counted by their first
words (the context) and their last words (the suffix), and divergence and smoothing are aggregates over the next words of a context.
What the tree adds to a word's own frequency is a sum over the sequences that end there: each sequence of the tree has a weight, and a
document's score is the root's plus the weights of all sequences it holds. The most frequent words, at most HEAD_ROWS, and weights, at
most twice as many, travel to the tasks. Other words are looked up by a join; other weights meet the sequences that documents hold in
ranges of their keys, and sums go back by blocks of documents. Sequences are told apart by 64-bit hashes. Bit arrays of bounded size
keep most sequences that are in no table from being dealt out; a fuller array lets more through, never fewer. To be counted, sequences
are dealt out by ranges of their contexts, heavy ones over several, many of one range in a row; the number of ranges follows the corpus,
so a range fits a task at any size. What is known of heavy contexts and suffixes goes along to the tasks that add up counts, at most
HEAVY_PARTS of a length; light ones meet their sequences in windows. Tables go as soon as their successors are written, and so do the
shuffle files behind them.

Defined results: a null text has only its end; a null id counts as empty text in the split; each row is scored by itself, also when
rows repeat; without training rows every count is 0; an empty table gives an empty table; columns other than ``doc_id`` and ``text``
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.llm.stored import discard, stored
from reliefgrid.llm.suffix_repeats import bit_arrays
from reliefgrid.llm.words import Reader, Words

DEPTH = 3
MIN_COUNT = 4
MIN_DIVERGENCE = 0.02  # nats
HEAD_ROWS = 1_000_000
SLICE_BYTES = 1 << 19  # text handled at once; what a task holds for it is some hundred times that
COUNTED_AT_ONCE = 1 << 20  # sequences a task holds before it hands on their counts
END = np.uint64(0x5DEECE66D1234567)
HEAVY_PARTS = 50_000  # a sequence is heavy that makes up this part of all training tokens; so at most as many of a length are
RANGE_TOKENS = 1 << 18  # training tokens for each range of keys
PARTITION_RANGES, MOST_PARTITIONS = 8, 8_192
ANSWERED_AT_ONCE = 1 << 21  # weights found that a task holds before it hands on their sums
BLOCK_BITS = 12  # documents of one task go in blocks of 2 ** BLOCK_BITS to where their sums meet


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


class Tokens:
    """Words and ends of a slice: hashes, and the first token of each document."""

    def __init__(self, words: Words):
        n, docs = len(words.hashes), words.count
        self.hashes = np.full(n + docs, END, np.uint64)
        self.hashes[np.arange(n) + words.doc] = words.hashes
        self.first = words.first + np.arange(docs + 1)
        self.begins = np.zeros(n + docs, bool)
        self.begins[self.first[:-1]] = True

    def sequences(self, filters: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each length up to one more than there are filters: keys of the sequences that end at each token, and whether they may
        be frequent: within a document, and context and suffix among those of the filter of their length."""
        keys, good = [self.hashes], [np.ones(len(self.hashes), bool)]
        for bits in filters:
            there = good[-1].copy()
            there[there] = among(bits, keys[-1][there])
            here = there.copy()
            here[1:] &= there[:-1]
            here[:1] = False
            here &= ~self.begins
            key, at = np.zeros(len(self.hashes), np.uint64), np.flatnonzero(here)
            key[at] = pair_key(keys[-1][at - 1], keys[-1][at])
            keys.append(key)
            good.append(here)
        return keys, good


P1, P2, P3, P4, P5 = (
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def pair_key(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Key of a sequence, from those of its context and its suffix: xxhash64(context, suffix) as in Spark."""

    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    h = np.full(len(context), 42, np.uint64)
    for x in (context, suffix):
        h = h + (P5 + np.uint64(8)) ^ turned(x * P2, 31) * P1
        h = turned(h, 27) * P1 + P4
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        h = h ^ (h >> np.uint64(32))
    return h


def among(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set."""
    spot = keys & np.uint64(8 * len(bits) - 1)
    return (bits[spot >> np.uint64(3)] >> (np.uint64(7) - (spot & np.uint64(7))).astype(np.uint8)) & 1 == 1


def bits_of(keys: DataFrame) -> np.ndarray:
    """A bit array of the column ``key``; tasks fill it, its size is bounded."""
    return bit_arrays(keys.select(F.col("key").alias("anchor"), F.lit(2).alias("n")))["any"]


class Places:
    """Places of keys in a sorted table. Keys are hashes, so their leading bits lead to within a few rows."""

    def __init__(self, table: np.ndarray):
        bits = max(1, len(table).bit_length())
        self.shift, self.n = np.uint64(64 - bits), len(table)
        self.starts = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.table = np.append(table, ~np.uint64(0))

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is missing."""
        at = self.starts[keys >> self.shift]
        less = np.flatnonzero(self.table[at] < keys)
        while len(less):
            at[less] += 1
            less = less[self.table[at[less]] < keys[less]]
        at[(self.table[at] != keys) | (at == self.n)] = -1
        return at


def training(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id"))).select(F.col("text").cast("string"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), c over all training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, many = Reader(lower=True, slice_bytes=SLICE_BYTES), [], 0
        for batch in batches:
            for _, words in reader.slices(batch.column(0)):
                held.append(Tokens(words).hashes)
                many += len(held[-1])
                if many >= COUNTED_AT_ONCE:
                    yield counted(held)
                    held, many = [], 0
        if many:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["word", "c"])

    return stored(training(docs).mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "words", free=True)


def range_bits(n: int) -> int:
    """Leading bits of a key that name its range, where training text has n tokens."""
    return max(1, (n // RANGE_TOKENS).bit_length())


def edges_of(spots: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin, and the end; of at least one value."""
    return np.append(np.flatnonzero(np.concatenate(([True], spots[1:] != spots[:-1]))), len(spots))


def cut(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of the values between each two edges."""
    offsets = pa.py_buffer(edges * values.itemsize)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, offsets, pa.py_buffer(values)]).cast(pa.binary())


def packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The values between each two edges, compressed: their number, then all first bytes, all second bytes and so on."""

    def one(part: np.ndarray) -> bytes:
        planes = np.ascontiguousarray(part.view(np.uint8).reshape(len(part), part.itemsize).T)
        return len(part).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)

    return pa.array([one(values[low:high]) for low, high in zip(edges[:-1], edges[1:], strict=True)], pa.binary())


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(blob[:4], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(memoryview(blob)[4:], n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).reshape(n)


def steps(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Differences to the value before, which compress; cumulative sums between two edges give the values again."""
    out = np.diff(values, prepend=values[:1])
    out[edges[:-1]] = values[edges[:-1]]
    return out


def spread(ctx: np.ndarray, keys: np.ndarray, heavy: Places, widths: np.ndarray, bits: int) -> np.ndarray:
    """Range of each sequence: that of its context, or one of 2 ** width where the context is heavy."""
    width = widths[heavy.of(ctx)]
    return (ctx >> np.uint64(64 - bits)) ^ np.where(width > 0, keys >> (np.uint64(64) - np.maximum(width, np.uint64(1))), np.uint64(0))


SEQUENCES = "key long, ctx long, suf long, c long, total long, kept double, short double, low double"


def sequence_counts(docs: DataFrame, filters: list[np.ndarray], n: int, level: DataFrame) -> DataFrame:
    """key, ctx, suf, c of the sequences one word longer than the last filter's that occur MIN_COUNT times in training text.

    ``level`` holds the contexts and suffixes. Where these are heavy, ``total`` and ``kept`` of the context and ``short`` and ``low`` of
    the suffix are filled in, otherwise they are null. The most frequent suffixes, at most HEAD_ROWS, are dealt out by their rank, the
    others in full.
    """
    heavy = level.where(heavy_of(n)).select("key", "c", "value", "below").toArrow()  # at most HEAVY_PARTS rows
    heavy = [x.to_numpy() for x in heavy.columns]
    order = np.argsort(heavy[0].view(np.uint64))
    heavy = [heavy[0].view(np.uint64)[order], *[np.append(x[order], 0).astype(x.dtype) for x in heavy[1:]]]
    names, often = sorted_head(head_of(level)[0], "key", "c")
    ranks = np.empty(len(names), np.uint32)
    ranks[np.argsort(-often, kind="stable")] = np.arange(1, len(names) + 1, dtype=np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast((filters, heavy, names, ranks))  # at most MAX_BITS for each length
    bits = range_bits(n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, many = Reader(lower=True, slice_bytes=SLICE_BYTES), [], 0
        filters, (heavy, c, *_), names, ranks = shared.value
        ranked = Places(names), np.append(ranks, np.uint32(0))
        # places of a heavy context in a range: about as many as a light one may have
        widths = np.append(np.clip(np.ceil(np.log2(np.maximum(c[:-1] * (HEAVY_PARTS / max(n, 1)), 1.0))), 0, bits), 0).astype(np.uint64)
        heavy = Places(heavy)
        for batch in batches:
            for _, words in reader.slices(batch.column(0)):
                keys, good = Tokens(words).sequences(filters)
                at = np.flatnonzero(good[-1])
                held.append((keys[-1][at], keys[-2][at - 1], keys[-2][at]))
                many += len(at)
                if many >= COUNTED_AT_ONCE:
                    yield dealt(held, heavy, widths, *ranked)
                    held, many = [], 0
        if many:
            yield dealt(held, heavy, widths, *ranked)

    def dealt(held: list[tuple[np.ndarray, ...]], heavy: Places, widths: np.ndarray, names: Places, ranks: np.ndarray) -> pa.RecordBatch:
        """Counted sequences, a row for each range, about in order of their contexts."""
        keys, ctx, suf = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        counts = np.diff(np.append(first, len(keys))).astype(np.uint32)
        keys, ctx, suf = keys[first], ctx[order[first]], suf[order[first]]
        spots = spread(ctx, keys, heavy, widths, bits)
        # by range, then by all but the last bits of the context: equal contexts stay together
        order = np.argsort((spots << np.uint64(64 - bits)) | (ctx >> np.uint64(bits)))
        spots, ctx, suf, counts = spots[order], ctx[order], suf[order], counts[order]
        edges, rank = edges_of(spots), ranks[names.of(suf)]
        others = np.flatnonzero(rank == 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(spots[edges[:-1]].astype(np.int64)), packed(steps(ctx, edges), edges), packed(rank, edges),
             cut(suf[others], np.searchsorted(others, edges)), packed(counts, edges)],
            names=["range", "ctx", "rank", "suf", "c"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their range; one range is held at a time."""
        at, held, (_, _, names, ranks) = None, [], shared.value
        by_rank = np.zeros(len(names) + 1, np.uint64)
        by_rank[ranks] = names
        for batch in batches:
            for at_row, *blobs in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                if at_row != at and held:
                    yield added(held, by_rank)
                    held = []
                at = at_row
                held.append([x.as_py() for x in blobs])
        if held:
            yield added(held, by_rank)

    def added(held: list[list[bytes]], by_rank: np.ndarray) -> pa.RecordBatch:
        ctx = np.concatenate([np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x, *_ in held])
        rank, c = (np.concatenate([unpacked(x[k], np.uint32) for x in held]) for k in (1, 3))
        suf = by_rank[rank]
        suf[rank == 0] = np.frombuffer(b"".join(x[2] for x in held), np.uint64)
        keys = pair_key(ctx, suf)
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sums = np.add.reduceat(c[order].astype(np.int64), first)
        first, sums = first[sums >= MIN_COUNT], sums[sums >= MIN_COUNT]
        own = order[first]
        columns = [pa.array(x) for x in (keys[first].view(np.int64), ctx[own].view(np.int64), suf[own].view(np.int64), sums)]
        heavy, c, value, below = shared.value[1]
        heavy = Places(heavy)
        for words, known in ((ctx[own], (c, below)), (suf[own], (value, below))):
            place = heavy.of(words)
            columns += [pa.array(x[place], mask=place < 0) for x in known]
        return pa.RecordBatch.from_arrays(columns, names=["key", "ctx", "suf", "c", "total", "kept", "short", "low"])

    rows = training(docs).mapInArrow(count, "range long, ctx binary, rank binary, suf binary, c binary")
    parts = min(max(1, (1 << range_bits(n)) // PARTITION_RANGES), MOST_PARTITIONS)
    rows = rows.repartition(parts, "range").sortWithinPartitions("range")
    table = stored(rows.mapInArrow(add, SEQUENCES), "sequences", free=True)
    shared.destroy()
    return table


def heavy_of(n: int) -> Column:
    """Of at most HEAVY_PARTS sequences of one length, where training text has n tokens."""
    return F.col("c") >= n / HEAVY_PARTS


def beside(sequences: DataFrame, values: DataFrame, by: str) -> DataFrame:
    """The sequences with the columns of ``values``, one row for each value of ``by``; null where there is none.

    For light contexts or suffixes only: another one is extended by at most a quarter of its places, since only sequences of MIN_COUNT
    places are rows, so no group is large.
    """
    own, names = Window.partitionBy(by), [c for c in values.columns if c != by]
    both = sequences.drop(*names).unionByName(values, allowMissingColumns=True)
    return both.withColumns({c: F.max(c).over(own) for c in names}).where(F.col("key").isNotNull())


def judged(known: DataFrame, rare: DataFrame) -> DataFrame:
    """Sequences with their ``value`` and ``weight``, and a row without ``suf`` for each context that is a state, whose weight is what it
    leaves.

    ``rare`` are the light contexts. A context's row and those of its next words meet once; heavy ones are summed up before.
    """
    p, q = F.col("c") / F.col("total"), F.pow(F.lit(10.0), F.col("kept") + F.col("short"))
    sums = {"follow": F.count("key"), "own": F.sum("c"), "mass_below": F.sum(q), "told": F.sum(p * F.ln(p / q))}
    of = rare.select(F.col("key").alias("ctx"), F.col("c").alias("total"), F.col("below").alias("kept"))
    own = Window.partitionBy("ctx")
    light = known.where("total IS NULL").drop("total", "kept").unionByName(of, allowMissingColumns=True)
    light = light.withColumns({c: F.max(c).over(own) for c in ("total", "kept")}).withColumns({c: x.over(own) for c, x in sums.items()})
    heavy = known.where("total IS NOT NULL")
    heads = heavy.groupBy("ctx").agg(F.first("total").alias("total"), F.first("kept").alias("kept"), *[x.alias(c) for c, x in sums.items()])
    heavy = heavy.join(F.broadcast(heads.drop("total", "kept")), "ctx").unionByName(heads, allowMissingColumns=True)
    rest = F.greatest(1.0 - F.col("own") / F.col("total"), F.lit(1e-12))
    rest_below = F.greatest(1.0 - F.col("mass_below"), F.lit(1e-12))
    size = F.col("total") + F.col("follow") + 1
    told = (F.col("told") + rest * F.ln(rest / rest_below) >= MIN_DIVERGENCE) & (F.col("follow") > 0)
    left = F.when(told, F.log10((1.0 - F.col("own") / size) / rest_below))
    rows = light.unionByName(heavy).withColumn("left", left).where("key IS NOT NULL OR left IS NOT NULL")
    gain = F.log10(F.col("c") / size) - F.col("left") - F.col("kept")
    a_state = F.col("key").isNull()
    return rows.select(
        F.coalesce("key", "ctx").alias("key"), "suf", F.when(a_state, F.col("total")).otherwise(F.col("c")).alias("c"),
        F.coalesce(gain, "short").alias("value"),
        F.when(a_state, F.col("left")).otherwise(F.coalesce(gain - F.col("short"), F.lit(0.0))).alias("weight"), "low", "common",
    )


def weights(docs: DataFrame, vocabulary: DataFrame, n: int, v: int) -> tuple[DataFrame, list[np.ndarray]]:
    """key, weight, c of the sequences that change a score, and the filters of frequent sequences by length.

    In logarithms, ``below`` is what the states that end a context keep for other words, without the context itself, and ``value``
    what a sequence's last word gets at its longest state, less what that state and those below keep. A word is then given the
    ``value`` of the longest frequent sequence plus what the states of its past keep. Both are telescoped: a weight is the difference
    to the sequence's suffix, so that nobody has to know which sequence is the longest.
    """
    level = stored(vocabulary.where(F.col("c") >= MIN_COUNT).select(
        F.col("word").alias("key"), "c", F.log10((F.col("c") + 0.5) / F.lit(n + 0.5 * (v + 1))).alias("value"), F.lit(0.0).alias("below")
    ), "root", free=True)
    filters, parts = [], []
    for depth in range(1, DEPTH + 1):
        filters.append(bits_of(level))
        rare = level.where(~heavy_of(n))
        longer = sequence_counts(docs, filters, n, level)
        suffix = rare.select(F.col("key").alias("suf"), F.col("value").alias("short"), F.col("below").alias("low"))
        known = beside(longer.where("short IS NULL"), suffix, "suf").withColumn("common", F.lit(False)).unionByName(
            longer.where("short IS NOT NULL").withColumn("common", F.lit(True))
        )
        known = stored(known, "next-words", free=True)
        discard(longer)
        rows = stored(judged(known, rare), "judged", free=True)
        discard(known, level)
        parts.append(rows)
        if depth < DEPTH:
            states = rows.where("suf IS NULL").select(F.col("key").alias("suf"), F.col("weight").alias("left"), F.col("c"))
            heavy = F.broadcast(states.where(heavy_of(n)).drop("c"))  # at most HEAVY_PARTS rows
            sequences = rows.where("suf IS NOT NULL").select("key", "suf", "c", "value", "low", "common")
            ends = beside(sequences.where("NOT common"), states.where(~heavy_of(n)).drop("c"), "suf").unionByName(
                sequences.where("common").join(heavy, "suf", "left")
            )
            level = stored(ends.select("key", "c", "value", (F.col("low") + F.coalesce("left", F.lit(0.0))).alias("below")), "level", free=True)
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    table = table.where("weight <> 0").groupBy("key").agg(F.sum("weight").alias("weight"), F.max("c").alias("c"))
    table = stored(table, "weights", free=True)
    discard(*parts)
    return table, filters


def head_of(table: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
    """The most frequent rows, at most ``most`` or HEAD_ROWS, and their least ``c``."""
    most = HEAD_ROWS if most is None else most
    bounds = sorted({round(2 ** (k / 16)) for k in range(48 * 16)})
    step = F.lit(bounds)
    sizes = table.select("c").groupBy(F.least("c", F.lit(bounds[-1])).alias("c")).count()
    sizes = sizes.groupBy(F.size(F.filter(step, lambda b: b <= F.col("c"))).alias("k")).agg(F.sum("count").alias("rows")).collect()
    sizes = np.bincount([r["k"] for r in sizes], [r["rows"] for r in sizes], len(bounds) + 2)
    least = next((b for k, b in enumerate(bounds, 1) if sizes[k:].sum() <= most))
    return table.where(F.col("c") >= least), least


def sorted_head(table: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    held = table.select(key, value).toArrow()  # at most as many rows as a head has
    keys, values = held.column(key).to_numpy().view(np.uint64), held.column(value).to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def counted_lists(doc: np.ndarray, keys: np.ndarray, docs: int) -> list[pa.Array]:
    """For each document its different keys, and how often it holds each."""
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    offsets = pa.array(np.searchsorted(doc[first], np.arange(docs + 1)).astype(np.int32))
    values = (pa.array(keys[first].view(np.int64)), pa.array(np.diff(np.append(first, len(keys))).astype(np.int32)))
    return [pa.ListArray.from_arrays(offsets, x) for x in values]


def log10_root(c, n: int, v: int):
    return np.log10((c + 0.5) / (n + 0.5 * (v + 1)))


DOCUMENTS = "doc_id long, held_out boolean, n_tokens long, known long, base double, sum double, rare array<long>, times array<int>"
ASKED = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("sum", pa.float64()),
    ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())),
    ("range", pa.int64()), ("row", pa.int64()), ("keys", pa.binary()), ("rest", pa.binary()),
])
ANSWERED = pa.schema([*list(ASKED)[:8], ("row", pa.int64()), ("block", pa.int64()), ("rows", pa.binary()), ("sums", pa.binary())])


def filled(schema: pa.Schema, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """Null in all other columns."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def ranged(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """An order of the keys by their ranges, the edges between these in that order, and the ranges."""
    spots = keys >> np.uint64(64 - bits)
    order = np.argsort(spots, kind="stable")
    edges = edges_of(spots[order])
    return order, edges, pa.array(spots[order[edges[:-1]]].astype(np.int64))


def offered(table: DataFrame, bits: int) -> DataFrame:
    """range, keys, rest: keys and weights of the table, a row for each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            many += batch.num_rows
            if many >= COUNTED_AT_ONCE:
                yield dealt(held)
                held, many = [], 0
        if many:
            yield dealt(held)

    def dealt(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, weight = (np.concatenate(x) for x in zip(*held, strict=True))
        order, edges, ranges = ranged(keys, bits)
        return pa.RecordBatch.from_arrays([ranges, packed(keys[order], edges), packed(weight[order], edges)], names=["range", "keys", "rest"])

    return table.select("key", "weight").mapInArrow(run, "range long, keys binary, rest binary")


def answered(asked: DataFrame, table: DataFrame, bits: int) -> DataFrame:
    """The documents of ``asked``, and for blocks of them ``rows`` and ``sums`` of the weights that ``table`` has for the sequences asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their range, and in each the weights first."""
        at, held, known, rows, found, many = None, [], None, [], [], 0
        for batch in batches:
            docs = batch.filter(pc.is_valid(batch["n_tokens"]))
            if docs.num_rows:
                block = pa.array(docs["row"].to_numpy() >> BLOCK_BITS)
                yield filled(ANSWERED, {name: docs[name] for name in ANSWERED.names[:9]} | {"block": block})
            blobs = batch.filter(pc.is_valid(batch["keys"]))
            for spot, first, keys, rest in zip(*(blobs[x].to_pylist() for x in ("range", "row", "keys", "rest")), strict=True):
                if spot != at:
                    at, held, known = spot, [], None
                keys = unpacked(keys, np.uint64)
                if first is None:
                    held.append((keys, unpacked(rest, np.float64)))
                elif held:
                    if known is None:
                        own, weight = (np.concatenate(x) for x in zip(*held, strict=True))
                        order = np.argsort(own)
                        known = own[order], weight[order]
                    place = np.minimum(np.searchsorted(known[0], keys), len(known[0]) - 1)
                    hit = known[0][place] == keys
                    rows.append(first + np.cumsum(unpacked(rest, np.uint32), dtype=np.uint32)[hit].astype(np.int64))
                    found.append(known[1][place[hit]])
                    many += len(found[-1])
                    if many >= ANSWERED_AT_ONCE:
                        yield summed(rows, found)
                        rows, found, many = [], [], 0
        if many:
            yield summed(rows, found)

    def summed(rows: list[np.ndarray], found: list[np.ndarray]) -> pa.RecordBatch:
        different, back = np.unique(np.concatenate(rows), return_inverse=True)
        edges, inside = edges_of(different >> BLOCK_BITS), (different & ((1 << BLOCK_BITS) - 1)).astype(np.uint32)
        return filled(ANSWERED, {
            "block": pa.array(different[edges[:-1]] >> BLOCK_BITS), "rows": packed(steps(inside, edges), edges),
            "sums": packed(np.bincount(back, np.concatenate(found)), edges),
        })

    both = asked.unionByName(offered(table, bits), allowMissingColumns=True)
    parts = min(max(1, (1 << bits) // (2 * PARTITION_RANGES)), MOST_PARTITIONS)
    return both.repartition(parts, "range").sortWithinPartitions("range", "row").mapInArrow(
        run, f"{DOCUMENTS}, row long, block long, rows binary, sums binary"
    )


def gathered_sums(answers: DataFrame, bits: int) -> DataFrame:
    """The documents of ``answers`` with the sums of their blocks added to ``sum``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their block, and in each the sums first."""
        at, more, last = None, None, (1 << BLOCK_BITS) - 1
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = batch["block"].to_numpy()
            edges = edges_of(blocks)
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if blocks[low] != at:
                    at, more = blocks[low], np.zeros(last + 1)
                part = batch.slice(low, high - low)
                sums = part.filter(pc.is_valid(part["rows"]))
                for rows, found in zip(sums["rows"].to_pylist(), sums["sums"].to_pylist(), strict=True):
                    more[np.cumsum(unpacked(rows, np.uint32), dtype=np.uint32)] += unpacked(found, np.float64)
                docs = part.filter(pc.is_valid(part["n_tokens"]))
                if docs.num_rows:
                    total = docs["sum"].to_numpy() + more[docs["row"].to_numpy() & last]
                    yield docs.select(ANSWERED.names[:9]).set_column(5, "sum", pa.array(total))

    parts = min(max(1, (1 << bits) // (2 * PARTITION_RANGES)), MOST_PARTITIONS)
    return answers.repartition(parts, "block").sortWithinPartitions("block", "row").mapInArrow(run, f"{DOCUMENTS}, row long")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    vocabulary = word_counts(docs)
    sizes = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = sizes["n"] or 0, sizes["v"]
    table, filters = weights(docs, vocabulary, n, v)
    head, head_least = head_of(vocabulary)
    top, top_least = head_of(table, 2 * HEAD_ROWS)
    bits = range_bits(n)
    shared = docs.sparkSession.sparkContext.broadcast(
        (*sorted_head(head, "word", "c"), *sorted_head(top, "key", "weight"), filters, bits_of(table))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, top, weight, filters, weighted = shared.value
        root, reader = np.append(log10_root(counts, n, v), 0.0), Reader(lower=True, slice_bytes=SLICE_BYTES)
        words, top, weight = Places(words), Places(top), np.append(weight, 0.0)
        own, at_row, held, many = TaskContext.get().partitionId() << 33, 0, [], 0
        for batch in batches:
            row = 0
            for _, slice_ in reader.slices(batch.column(2)):
                tokens = Tokens(slice_)
                place = words.of(tokens.hashes)
                in_head, base = place >= 0, root[place]
                gathered, rest, rest_at = np.zeros(len(tokens.hashes)), [], []
                for keys, good in zip(*tokens.sequences(filters), strict=True):
                    at = np.flatnonzero(good)
                    at = at[among(weighted, keys[at])]
                    hit = top.of(keys[at])
                    gathered[at] += weight[hit]
                    rest.append(keys[at[hit < 0]])
                    rest_at.append(at[hit < 0])
                rest, rest_at = np.concatenate(rest), np.concatenate(rest_at)
                doc = np.searchsorted(tokens.first, np.arange(len(tokens.hashes)), "right") - 1
                cuts = tokens.first[:-1]
                totals = [np.add.reduceat(x, cuts) for x in (in_head.astype(np.int64), base, gathered + base)]
                lists = counted_lists(doc[~in_head], tokens.hashes[~in_head], slice_.count)
                numbers = at_row + np.arange(slice_.count)
                yield filled(ASKED, {
                    "doc_id": batch.column(0).slice(row, slice_.count), "held_out": batch.column(1).slice(row, slice_.count),
                    "n_tokens": pa.array(np.diff(tokens.first), pa.int64()), **dict(zip(("known", "base", "sum"), map(pa.array, totals), strict=True)),
                    "rare": lists[0], "times": lists[1], "range": pa.array(numbers % (1 << bits)), "row": pa.array(own + numbers),
                })
                order = np.argsort(rest_at, kind="stable")
                held.append((rest[order], (at_row + doc[rest_at[order]]).astype(np.uint32)))
                many += len(rest)
                row, at_row = row + slice_.count, at_row + slice_.count
                if many >= COUNTED_AT_ONCE:
                    yield asked(held, own)
                    held, many = [], 0
        if many:
            yield asked(held, own)

    def asked(held: list[tuple[np.ndarray, np.ndarray]], own: int) -> pa.RecordBatch:
        """Sequences held by documents, a row for each range, with the places of the documents after ``own``."""
        keys, rows = (np.concatenate(x) for x in zip(*held, strict=True))
        order, edges, ranges = ranged(keys, bits)
        return filled(ASKED, {
            "range": ranges, "row": pa.array(np.full(len(ranges), own)), "keys": packed(keys[order], edges),
            "rest": packed(steps(rows[order], edges), edges),
        })

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, f"{DOCUMENTS}, range long, row long, keys binary, rest binary"
    )
    answers = answered(rows, table.where(F.col("c") < top_least), bits)
    scored = stored(gathered_sums(answers, bits), "scores", free=True)
    shared.destroy()
    # words that are not among the most frequent have few training places each, so no key of this join is large
    rare = scored.select("row", F.inline(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("times"))))
    rare = rare.join(vocabulary.where(F.col("c") < head_least), "word", "left")
    c = F.coalesce("c", F.lit(0))
    below = rare.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((c + F.lit(0.5)) / F.lit(n + 0.5 * (v + 1)))).alias("rest"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rest_known"),
    )
    rest = F.coalesce("rest", F.lit(0.0))
    return scored.drop("rare", "times").join(below, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rest_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + rest).alias("base_score"),
        (F.col("sum") + rest).alias("score"),
    )
