"""Exact top-k search by inner product: a ball tree for each shard, searched by branch and bound.

Vectors become integers, so scores are exact. Rows are dealt over shards of bounded size; each shard gets a ball tree in the task that
searches it. A query visits nodes in the order of their bound ``q . centre + |q| * radius`` and stops where the bound lies below its
k-th score so far. Queries go round in blocks. A first pass searches one shard for each query; its k-th score then goes along with the
query to all other shards, so that they open only what can still change the result.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, nor rows with a null id; vectors
of different lengths have no score; rows that repeat an id with the same vector count once, a query is never its own partner, whatever
rows share its id; a query with fewer than k partners gets all; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reliefgrid.llm.stored import stored

TOP = 5
SCALE = 256
SHARD_ROWS = 8_192
BLOCK_QUERIES = 16_384
LEAF_ROWS = 128
SCORES = "query_id long, vec_id long, score long"


class BallTree:
    """Nodes in arrays; a node's rows are ``rows[low:high]``. Inner nodes are halved along the line between two far rows."""

    def __init__(self, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.rows = np.arange(len(vectors))
        self.low, self.high, self.left, self.centre, self.radius = [], [], [], [], []
        self._build(vectors, leaf_rows)
        self.vectors = vectors[self.rows]
        self.centres, self.radii = np.array(self.centre), np.array(self.radius)

    def _build(self, vectors: np.ndarray, leaf_rows: int) -> None:
        todo = [self._node(vectors, 0, len(vectors))]
        while todo:
            node = todo.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= leaf_rows or self.radius[node] == 0:
                continue
            own = vectors[self.rows[low:high]]
            first = own[np.square(own - self.centre[node]).sum(1).argmax()]
            second = own[np.square(own - first).sum(1).argmax()]
            middle = (high - low) // 2
            order = np.argpartition(own @ (second - first), middle)
            self.rows[low:high] = self.rows[low:high][order]
            self.left[node] = self._node(vectors, low, low + middle)
            self._node(vectors, low + middle, high)
            todo += [self.left[node], self.left[node] + 1]

    def _node(self, vectors: np.ndarray, low: int, high: int) -> int:
        own = vectors[self.rows[low:high]]
        centre = own.mean(0)
        self.low.append(low)
        self.high.append(high)
        self.left.append(-1)
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(np.square(own - centre).sum(1).max())))
        return len(self.low) - 1

    def search(self, query: np.ndarray, own_id: int, ids: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """Up to k best (score, id), ties to the smaller id; nothing below ``floor`` need be found. ``ids``: in the tree's order."""
        norm = float(np.sqrt(query @ query))
        bounds = self.centres @ query + norm * self.radii
        bounds = bounds + 1e-9 * np.abs(bounds) + 1e-6  # above any rounding; scores are integers
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        todo = [(-bounds[0], 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            if -bound < floor:
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.left[node] + 1):
                    if bounds[child] >= floor:
                        heapq.heappush(todo, (-bounds[child], child))
                continue
            low, high = self.low[node], self.high[node]
            scores = self.vectors[low:high] @ query
            for i in np.flatnonzero(scores >= floor).tolist():
                name, score = int(ids[low + i]), int(scores[i])
                if name == own_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -name))
                elif (score, -name) > best[0]:
                    heapq.heapreplace(best, (score, -name))
            if len(best) == k:
                floor = max(floor, best[0][0])
        return [(score, -name) for score, name in best]


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (whole numbers as doubles, exact in sums below 2**53) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & (F.size(v) > 0) & ~F.exists(
        v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("embedding"))
    return rows.where(usable).select("vec_id", F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v")).distinct()


def top_k(
    vectors: DataFrame, every: int = 50, k: int = TOP, scale: int = SCALE, shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best partners of every row whose id is divisible by ``every``."""
    rows = stored(quantised(vectors, scale), "vectors")
    count = rows.count()
    shards = max(1, -(-count // shard_rows))
    spread = F.xxhash64("vec_id")
    rows = rows.withColumn("n", F.size("v")).withColumn("shard", F.pmod(spread, F.lit(shards)).cast("int"))
    queries = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // block_queries))
    queries = stored(queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")), "queries")

    def search(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(shard) and len(asked):
            ids = shard["vec_id"].to_numpy()
            tree = BallTree(np.array(shard["v"].tolist()), leaf_rows)
            ids = ids[tree.rows]
            floors = asked["floor"].to_numpy()
            for name, q, floor in zip(asked["vec_id"].tolist(), asked["v"], floors, strict=True):
                found = tree.search(np.array(q), name, ids, k, floor)
                out += [(name, other, score) for score, other in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    # first pass: each query in its own shard
    keys = ["n", "shard"]
    asked = queries.withColumn("floor", F.lit(float("-inf")))
    first = stored(rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, SCORES), "first-scores")
    floors = first.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(float("-inf")).alias("floor")
    )
    # second pass: with its k-th score, in blocks, to every other shard
    others = F.sequence(F.lit(0), F.lit(shards - 1))
    sent = (
        queries.join(floors, queries["vec_id"] == floors["query_id"], "left").drop("query_id")
        .withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        .withColumnRenamed("shard", "home").withColumn("shard", F.explode(others)).where("shard != home")
    )
    parts = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["n", "shard", "block"]
    second = parts.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(search, SCORES)
    # the rank limit cuts each task's rows before they are shuffled
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        first.unionByName(second).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
