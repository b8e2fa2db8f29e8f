"""Near-duplicate vectors by collision counting over sorted one-dimensional projections.

Vectors of one label are compared by their unit vectors. A block of them is projected on many random lines; on each line the values are
sorted, and the window of every vector, centred on its own value, holds those that collide with it there. For a pair at the threshold
the number of collisions is binomial, so the count that all but one in MISS pairs reach is known; pairs that reach it are verified by
their cosine in double precision. Most pairs of a block never get that far, and no pair ever leaves its task: tasks hand on, for each
vector, how many others it links with, and one link into its group.

Exact copies are one vector with a number. A label with more vectors than a block holds goes out in parts, each part with each other, so
that no task grows. Whether a pair is found follows from its two vectors alone: the lines are the same in every block, and no size of a
label leaves a pair out. The pairs compared grow with the square of a label.

Defined results: a vector that is null, empty, zero or holds a null or non-finite entry, or whose label is null, has no links and is its
own component; vectors of different lengths have no cosine; rows that repeat an id are vectors of their own, and link as such; rows
without an id take no part; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.components import components
from reliefgrid.llm.stored import join_counted, stored

MIN_COSINE = 0.93
LINES = 24
WINDOW = 1.5  # reach of a window, in deviations of a pair at the threshold
MISS = 1e-6  # of pairs at the threshold, by the count
BLOCK_ROWS = 8_192
HOT_COPIES = 4_096  # copies of one vector; more are not dealt to one task
WIDE = 16  # a row with a vector counts as so many narrow ones before it is broadcast


def normal_cdf(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def reach(min_cosine: float) -> float:
    """Distance of unit vectors at the threshold: also the deviation of their difference on a random line."""
    return math.sqrt(max(2.0 - 2.0 * min_cosine, 1e-12))


def least_collisions(lines: int, miss: float) -> int:
    """Greatest count that a pair at the threshold misses with a chance of at most ``miss``."""
    p, below = normal_cdf(WINDOW) - normal_cdf(-WINDOW), 0.0
    for count in range(lines + 1):
        below += math.comb(lines, count) * p**count * (1 - p) ** (lines - count)
        if below > miss:
            return count
    return lines


def unit_of(vectors: pd.Series) -> np.ndarray:
    v = np.array(vectors.tolist(), float)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.square(v).sum(1, keepdims=True))


def usable(vector: Column, label: Column) -> Column:
    v = vector.cast("array<double>")
    return label.isNotNull() & (F.size(v) > 0) & ~F.exists(
        v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ) & F.exists(v, lambda x: x != 0)


def colliding(left: np.ndarray, right: np.ndarray, width: float, least: int, within: bool):
    """For each row of ``left``: places in ``right`` (after its own, ``within`` one block) that collide on ``least`` lines or more."""
    lines = left.shape[1]
    orders = np.argsort(right, axis=0, kind="stable")
    lows, highs = np.empty(left.shape, np.int64), np.empty(left.shape, np.int64)
    for j in range(lines):
        own = right[orders[:, j], j]
        lows[:, j] = np.searchsorted(own, left[:, j] - width, "left")
        highs[:, j] = np.searchsorted(own, left[:, j] + width, "right")
    orders = np.ascontiguousarray(orders.T)
    for i in range(len(left)):
        counts = np.bincount(np.concatenate([orders[j, lows[i, j] : highs[i, j]] for j in range(lines)]), minlength=len(right))
        found = np.flatnonzero(counts >= least)
        yield i, found[found > i] if within else found


def block_links(block: pd.DataFrame, min_cosine: float, lines: int) -> pd.DataFrame:
    """class, n (vectors linked with, copies counted), root (a class of its group) of the classes with links. The rows are of one label:
    one part, or two parts that are compared across."""
    across = block["first"].iloc[0] != block["second"].iloc[0]
    block = block.sort_values(["part", "class"], kind="stable")
    names, copies, unit = block["class"].to_numpy(), block["copies"].to_numpy(), unit_of(block["v"])
    middle = int((block["part"] == block["first"]).sum()) if across else 0
    drawn = np.random.default_rng((lines, unit.shape[1])).standard_normal((unit.shape[1], lines))
    lying = unit @ drawn
    left, right = (lying[:middle], lying[middle:]) if across else (lying, lying)
    n, root = np.zeros(len(names), np.int64), np.arange(len(names))
    for i, found in colliding(left, right, WINDOW * reach(min_cosine), least_collisions(lines, MISS), not across):
        found = found + middle
        found = found[unit[found] @ unit[i] >= min_cosine]
        if len(found):
            n[i] += copies[found].sum()
            n[found] += copies[i]
            met = np.unique(np.append(root[found], root[i]))
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
    linked = np.flatnonzero(n)
    return pd.DataFrame({"class": names[linked], "n": n[linked], "root": names[root[linked]]})


def vector_classes(good: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal vectors of one label: class, label, size, v, copies, vec_id (the least); and the rows of those with copies.

    Only rows whose hash repeats are brought together by their vectors; all others are classes as they are.
    """
    rows = stored(good.withColumn("h", F.xxhash64("label", "v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    again = stored(rows.groupBy("h").agg(F.count("*").alias("same")).where("same > 1").drop("same"), "repeated-hashes")
    marked = join_counted(rows, again.withColumn("again", F.lit(True)), ["h"], "left", again.count(), F.xxhash64("row"))
    marked = stored(marked, "marked-vectors")
    copied = marked.where("again").select("h", "label", "v", "vec_id", "row")
    single = marked.where("again IS NULL").select(F.col("row").alias("class"), "label", "h", "v", F.lit(1).cast("long").alias("copies"), "vec_id")
    several = copied.groupBy("label", "h", "v").agg(F.min("row").alias("class"), F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"))
    classes = single.unionByName(several).withColumn("size", F.size("v"))
    return stored(classes, "vector-classes"), copied


def class_links(classes: DataFrame, min_cosine: float, lines: int, block_rows: int) -> DataFrame:
    """class, n, root: for each task's block the classes with links. Large labels go out in parts."""
    key = ["label", "size"]
    large = classes.groupBy(*key).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts")).where("parts > 1")
    large = stored(large, "large-labels")
    parts = F.coalesce("parts", F.lit(1))
    vectors = classes.select(*key, "class", "copies", "v")
    parted = join_counted(vectors, large, key, "left", large.count(), F.xxhash64("class")).withColumn(
        "part", F.pmod(F.xxhash64("class", F.lit(1)), parts).cast("int")
    ).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    parted = parted.withColumn("first", F.least("part", "other")).withColumn("second", F.greatest("part", "other"))

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        return block_links(block, min_cosine, lines)

    blocks = parted.drop("parts", "other").groupBy(*key, "first", "second")
    return stored(blocks.applyInPandas(compare, "class long, n long, root long"), "vector-links")


def linked_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE, lines: int = LINES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row with an id."""
    rows = vectors.select(
        vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].alias("label"), vectors["embedding"].alias("v")
    ).where("vec_id IS NOT NULL")
    good = usable(F.col("v"), F.col("label"))
    classes, copied = vector_classes(rows.where(good))
    found = class_links(classes, min_cosine, lines, block_rows)
    totals = found.groupBy("class").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))).select(
        F.col("id").alias("class"), F.col("label").alias("group")
    )
    known = stored(classes.select("class", "vec_id", "copies").join(totals, "class", "left").join(groups, "class", "left").select(
        "class", "vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("group", "class").alias("group")
    ), "class-groups")
    least = stored(known.where("group <> class OR n_links > 0").groupBy("group").agg(F.min("vec_id").alias("least")), "least-ids")
    judged = join_counted(known, least, ["group"], "left", least.count(), F.xxhash64("class")).select(
        "class", "n_links", F.coalesce("least", "vec_id").alias("component_id")
    )
    judged = stored(classes.select("class", "label", "h", "v", "copies", "vec_id").join(judged, "class"), "judged-classes")
    columns = ["vec_id", "n_links", "component_id"]
    # rows of copies look up their class; a vector with very many copies has a class among few
    several = judged.where("copies > 1").select("label", "h", "v", "copies", "n_links", "component_id")
    hot = stored(several.where(F.col("copies") > HOT_COPIES).drop("copies"), "hot-classes")
    key = ["label", "h", "v"]
    left = join_counted(copied, hot.withColumn("hot", F.lit(True)), key, "left", hot.count() * WIDE, F.xxhash64("row"))
    of_hot = left.where("hot").select(*columns)
    of_others = left.where("hot IS NULL").drop("n_links", "component_id", "hot").join(
        several.where(F.col("copies") <= HOT_COPIES), key
    ).select(*columns)
    # a hash may repeat without its vector
    alone = judged.where("copies = 1").select(*columns)
    bad = rows.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return of_hot.unionByName(of_others).unionByName(alone).unionByName(bad).withColumn("kept", F.col("vec_id") == F.col("component_id"))
