"""Near-duplicates by min-max hashing, with every link confirmed on the full shingle sets.

A document is its set of distinct five-word shingles in lower case. Under each permutation both the least and the greatest hash are
kept, so forty permutations give eighty signature values; four values make a band, and documents that share a band are candidates.
Bands are as many as keep the chance of missing a pair at the threshold below one in a million.

Documents of one set are one class and go on as one. What follows never lists the pairs of a group:

* the member that sees the largest groups is the pivot of a band's group, and every class follows the pivots it meets to a cluster;
* the sets of a cluster are sent once, in chunks of bounded size, and linked exactly in the task: all members with the pivot first,
  then those still apart through an index of their rarest shingles (sets of similarity t share one of their rarest (1 - t) n + 1);
* for candidates of different clusters the signatures decide which pairs are confirmed on their sets.

Only links that join something new leave a task. Components are found by contraction.

Defined results: no words or a null text: an empty set, linked with nothing; fewer than five words: the whole sequence is the one
shingle; rows that repeat an id are one document; a row without id is linked with nothing and kept; an empty table gives an empty
table; columns other than ``doc_id`` and ``text`` are not looked at (``one_of_each`` hands them on).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.components import components
from reliefgrid.llm.stored import BROADCAST_ROWS, stored
from reliefgrid.llm.words import Reader, Words, mixed

SHINGLE = 5
MIN_PERCENT = 80
ROWS = 4
MISS = 1e-6
CHUNK_SHINGLES = 2_000_000  # of a cluster in one task, twice: 32 MB
CHUNK_MEMBERS = 4_096  # of a band's group in one task, twice
SEED = 20


def bands_for(min_percent: int) -> int:
    """Bands, in even number, that miss a pair at the threshold with a chance of at most MISS."""
    n = math.ceil(math.log(MISS) / math.log(1 - (min_percent / 100) ** ROWS))
    return n + n % 2


def shingle_sets(reader: Reader, words: Words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of the slice."""
    windows, whole = reader.windows(words, SHINGLE)
    few = np.flatnonzero((words.sizes > 0) & (words.sizes < SHINGLE))
    singles = dict(zip(few.tolist(), reader.whole(words, few), strict=True))
    empty, out = np.zeros(0, np.uint64), []
    for i in range(words.count):
        if words.sizes[i] >= SHINGLE:
            own = np.sort(windows[words.first[i] : words.first[i + 1] - SHINGLE + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            out.append(np.array([singles[i]], np.uint64) if i in singles else empty)
    return out


def signatures(docs: DataFrame, bands: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, bands (hashes), sig (a byte of each signature value)."""
    permutations = bands // 2 * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(SEED)
        factors = random.integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shifts = random.integers(0, 1 << 63, permutations, dtype=np.uint64)
        weights = random.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        reader = Reader(lower=True)
        for batch in batches:
            counts, digests, keys, sigs = [], [], [], []
            for _, words in reader.slices(batch.column(1)):
                sets = shingle_sets(reader, words)
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                values = np.zeros((len(sets), 2 * permutations), np.uint64)
                if len(full):
                    hashes = np.concatenate([sets[i] for i in full])
                    begins = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                    for k in range(permutations):
                        permuted = hashes * factors[k] + shifts[k]
                        values[full, k] = np.minimum.reduceat(permuted, begins)
                        values[full, permutations + k] = np.maximum.reduceat(permuted, begins)
                banded = (mixed(values).reshape(len(sets), bands, ROWS) * weights).sum(2, dtype=np.uint64)
                banded = mixed(banded + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                tops = (mixed(values) >> np.uint64(56)).astype(np.uint8)
                for i, own in enumerate(sets):
                    counts.append(len(own))
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    keys.append(banded[i] if len(own) else banded[i][:0])
                    sigs.append(tops[i].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "bands", "sig"],
            )

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary"
    )


def stored_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, shingles (sorted hashes, 8 bytes each) of the documents with these ids."""
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"))
    # the ids are narrow; they are broadcast after a count only
    side = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lower=True)
        for batch in batches:
            row = 0
            for _, words in reader.slices(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(reader, words)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(sets)), pa.array(sets, pa.binary())], names=["id", "shingles"]
                )
                row += len(sets)

    return stored(texts.join(side, "id", "left_semi").mapInArrow(run, "id long, shingles binary"), "sets").distinct()


def similar(shared: int, a: int, b: int, min_percent: int) -> bool:
    return 100 * shared >= min_percent * (a + b - shared)


class Linker:
    """Links within some sets, exactly: only such as join what was apart."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], min_percent: int):
        self.ids, self.min_percent = ids, min_percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        _, self.items, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.begins = np.concatenate(([0], np.cumsum(self.sizes)))
        self.rarity, self.mark = counts, np.zeros(len(counts), bool)
        self.root = np.arange(len(ids))
        self.links: list[tuple[int, int]] = []

    def own(self, i: int) -> np.ndarray:
        return self.items[self.begins[i] : self.begins[i + 1]]

    def join(self, i: int, j: int) -> None:
        if self.root[i] != self.root[j]:
            self.links.append((int(self.ids[i]), int(self.ids[j])))
            self.root[self.root == self.root[j]] = self.root[i]

    def with_all(self, i: int) -> None:
        """Links of one member with all others."""
        self.mark[self.own(i)] = True
        shared = np.add.reduceat(self.mark[self.items].astype(np.int64), self.begins[:-1])
        self.mark[self.own(i)] = False
        union = self.sizes + self.sizes[i] - shared
        for j in np.flatnonzero(100 * shared >= self.min_percent * union).tolist():
            if j != i:
                self.join(i, j)

    def rarest(self, i: int) -> np.ndarray:
        own = self.own(i)
        keep = len(own) - -(-self.min_percent * len(own) // 100) + 1
        return own[np.lexsort((own, self.rarity[own]))[:keep]]

    def rest(self) -> None:
        """All links that join members still apart; every pair has a member outside the largest part."""
        parts, counts = np.unique(self.root, return_counts=True)
        if len(parts) == 1:
            return
        outside = np.flatnonzero(self.root != parts[counts.argmax()]).tolist()
        rare = [self.rarest(i) for i in range(len(self.ids))]
        items = np.concatenate(rare)
        owners = np.repeat(np.arange(len(rare)), [len(r) for r in rare])
        order = np.argsort(items, kind="stable")
        items, owners = items[order], owners[order]
        for i in outside:
            low, high = np.searchsorted(items, rare[i]), np.searchsorted(items, rare[i], "right")
            near = np.unique(np.concatenate([owners[a:b] for a, b in zip(low, high, strict=True)]))
            near = near[self.root[near] != self.root[i]]
            # sets of too different size cannot reach the threshold
            near = near[100 * np.minimum(self.sizes[near], self.sizes[i]) >= self.min_percent * np.maximum(self.sizes[near], self.sizes[i])]
            if not len(near):
                continue
            self.mark[self.own(i)] = True
            for j in near.tolist():
                if self.root[j] != self.root[i] and similar(int(self.mark[self.own(j)].sum()), int(self.sizes[i]), int(self.sizes[j]), self.min_percent):
                    self.join(i, j)
            self.mark[self.own(i)] = False


def chunked(rows: DataFrame, key: str, chunks: str, keys: list[str]) -> DataFrame:
    """Deals the rows of a key over ``chunks`` chunks and sends each row to every pair of chunks that has its own."""
    rows = rows.withColumn("c", F.pmod(F.xxhash64("id"), F.col(chunks)))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(chunks) - 1))
    return rows.withColumn("d", other).withColumn(keys[0], F.least("c", "d")).withColumn(keys[1], F.greatest("c", "d")).drop("c", "d")


def cluster_links(clusters: DataFrame, sets: DataFrame, min_percent: int) -> DataFrame:
    """a, b: links within clusters. ``clusters``: id, cluster, n."""
    sizes = clusters.groupBy("cluster").agg(F.sum("n").alias("all"), F.count("*").alias("members")).where("members > 1")
    chunks = F.ceil(F.col("all") / CHUNK_SHINGLES).cast("long")
    rows = clusters.join(sizes, "cluster").withColumn("chunks", F.greatest(F.lit(1).cast("long"), chunks))
    rows = chunked(rows, "cluster", "chunks", ["lo", "hi"]).select("cluster", "lo", "hi", "id").join(sets, "id")

    def link(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", ignore_index=True)
        linker = Linker(part["id"].to_numpy(), [np.frombuffer(s, np.uint64) for s in part["shingles"]], min_percent)
        pivot = np.flatnonzero(linker.ids == part["cluster"].iloc[0])
        if len(pivot):
            linker.with_all(int(pivot[0]))
        linker.rest()
        return pd.DataFrame(linker.links, columns=["a", "b"]).astype("int64")

    return rows.groupBy("cluster", "lo", "hi").applyInPandas(link, "a long, b long")


def cross_links(members: DataFrame, sets: DataFrame, min_percent: int, values: int) -> DataFrame:
    """a, b: links between clusters. ``members``: band, id, cluster, sig, of bands in which several clusters meet."""
    sizes = members.groupBy("band").agg(F.count("*").alias("size"))
    chunks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("size") / CHUNK_MEMBERS).cast("long"))
    rows = chunked(members.join(sizes, "band").withColumn("chunks", chunks), "band", "chunks", ["lo", "hi"])
    t = min_percent / 100
    # six standard deviations below the expected number of equal values at the threshold
    least = math.floor(values * t - 6 * math.sqrt(values * t * (1 - t)))

    def near(part: pd.DataFrame) -> pd.DataFrame:
        ids, clusters = part["id"].to_numpy(), part["cluster"].to_numpy()
        sigs = np.frombuffer(b"".join(part["sig"]), np.uint8).reshape(len(part), -1)
        parts, counts = np.unique(clusters, return_counts=True)
        found: list[tuple[int, int]] = []
        for i in np.flatnonzero(clusters != parts[counts.argmax()]).tolist():
            apart = np.flatnonzero(clusters != clusters[i])
            for j in apart[(sigs[apart] == sigs[i]).sum(1) >= least].tolist():
                found.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
        return pd.DataFrame(sorted(set(found)), columns=["a", "b"]).astype("int64")

    pairs = rows.groupBy("band", "lo", "hi").applyInPandas(near, "a long, b long").distinct()
    of_a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    of_b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                keep.append(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), min_percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "sa", "sb").mapInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, min_percent: int = MIN_PERCENT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept."""
    bands = bands_for(min_percent)
    signed = stored(signatures(docs, bands), "signatures")
    usable = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stored(usable.groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
    ), "classes")
    grouped = classes.select(F.explode("bands").alias("band"), "id")
    sizes = grouped.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(grouped.join(sizes, "band"), "bands")
    seen = members.groupBy("id").agg(F.sum("size").alias("seen"))
    ranked = members.join(seen, "id").select("band", "id", F.struct("seen", (-F.col("id")).alias("minus")).alias("rank"))
    pivots = ranked.groupBy("band").agg(F.max("rank").alias("best"))
    first = stored(
        ranked.select("band", "id").join(pivots, "band").groupBy("id").agg((-F.max("best")["minus"]).alias("cluster")), "clusters"
    )
    # a pivot may itself follow a better one
    above = first.select(F.col("id").alias("cluster"), F.col("cluster").alias("next"))
    clusters = stored(
        first.join(above, "cluster").select("id", F.col("next").alias("cluster"))
        .join(classes.groupBy("id").agg(F.sum("n").alias("n"), F.first("sig").alias("sig")), "id"), "clusters"
    )
    sets = stored_sets(docs, clusters.select("id"))
    within = cluster_links(clusters.select("id", "cluster", "n"), sets, min_percent)
    spread = members.select("band", "id").join(clusters.select("id", "cluster", "sig"), "id")
    mixed_bands = spread.groupBy("band").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low != high")
    between = cross_links(spread.join(mixed_bands.select("band"), "band"), sets, min_percent, bands * ROWS)
    labels = components(stored(within.unionByName(between), "links"))
    whole = classes.select("digest", "id").join(labels, "id", "left").select(
        "digest", F.coalesce("label", "id").alias("component_id")
    )
    found = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("digest")).alias("digest"))
    return found.join(whole, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, min_percent: int = MIN_PERCENT) -> DataFrame:
    """The documents that are the first of their group, in all their columns; of rows that share an id, all or none."""
    gone = near_duplicates(docs, min_percent).where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    gone = stored(gone, "duplicates")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    kept = rows.join(side, F.col("d.doc_id").cast("long") == F.col("id"), "left_anti")
    return kept.select(*[F.col("d").getField(c).alias(c) for c in docs.columns])
