"""Rank scores, worst row, keep-first, key checks and list positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.functions.numeric import known
from reliefgrid.session import cut_lineage


RANGE_VALUES = 50_000  # distinct values ordered in one task, about
BROADCAST_VALUES = 500_000
SALTS = 16


def _average_ranks(stacked: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """(metric, value, rank): average rank of each distinct value of every metric, and the number of such rows.

    Ranks are counted on the histogram of distinct values, cut into value ranges: each range is ordered on its own and
    shifted by the rows in the ranges below, so no task sees a whole column. There are as many ranges as the largest
    histogram needs.
    """
    hist = cut_lineage(stacked.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("rows")))
    sizes = hist.agg(*[F.count_if(F.col("metric") == c).alias(c) for c in columns]).first()
    ranges = max(1, -(-max(sizes) // RANGE_VALUES))
    wide = hist.select(*[F.when(F.col("metric") == c, F.col("value")).alias(c) for c in columns])
    cuts = wide.approxQuantile(columns, [i / ranges for i in range(1, ranges)], 1.0 / (2 * ranges)) if ranges > 1 else [[] for _ in columns]
    place = F.lit(0)
    for column, own in zip(columns, cuts, strict=True):
        if own:
            edges = F.array(*[F.lit(c) for c in sorted(set(own))])
            place = F.when(F.col("metric") == column, F.size(F.filter(edges, lambda c: c < F.col("value")))).otherwise(place)
    hist = hist.withColumn("range", place)
    below = hist.groupBy("metric", "range").agg(F.sum("rows").alias("in_range"))  # one row per range
    before = Window.partitionBy("metric").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    below = below.select("metric", "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("below"))
    inside = Window.partitionBy("metric", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = hist.withColumn("before", F.coalesce(F.sum("rows").over(inside), F.lit(0))).join(F.broadcast(below), ["metric", "range"])
    rank = F.col("below") + F.col("before") + (F.col("rows") + 1) / 2.0
    return ranked.select("metric", "value", rank.alias("rank")), sum(sizes)


def rank_scores(df: DataFrame, scores: dict[str, tuple[str, bool]]) -> DataFrame:
    """Add 0-100 rank scores ``{out: (column, high_is_good)}``; ties share the average rank, a missing value has no score.

    The input is checkpointed, since scores and rows read it. All columns go through one chain as (metric, value) rows;
    missing values stay out of it. Ranks come back to the rows by value: broadcast when counted few, else dealt over
    salts, so that a value that many rows share does not meet in one task.
    """
    columns = sorted({c for c, _ in scores.values()})
    work = cut_lineage(df.withColumns({c: known(c) for c in columns}).withColumn("_row", F.monotonically_increasing_id()))
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in columns])
    stacked = work.select("_row", F.inline(pairs)).where(F.col("value").isNotNull())
    ranked, count = _average_ranks(stacked.select("metric", "value"), columns)
    if count <= BROADCAST_VALUES:
        placed = stacked.join(F.broadcast(ranked), ["metric", "value"])
    else:
        salted = ranked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = stacked.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(salted, ["metric", "value", "salt"])
    total = work.count()
    best = placed.groupBy("_row").agg(*[F.max(F.when(F.col("metric") == c, F.col("rank"))).alias(f"_{k}") for k, c in enumerate(columns)])
    score = {c: (F.col(f"_{k}") - 1.0) / F.lit(total - 1) * 100.0 for k, c in enumerate(columns)}
    out = work.join(best, "_row", "left").withColumns(
        {name: score[column] if good else 100.0 - score[column] for name, (column, good) in scores.items()}
    )
    return out.drop("_row", *[f"_{k}" for k in range(len(columns))])


def worst_row(df: DataFrame, excess: str, tie: str) -> DataFrame:
    """Row with the largest excess; among equals the last one."""
    return df.orderBy(F.desc(F.coalesce(known(excess), F.lit(0.0))), F.desc(tie)).limit(1)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of every key under an explicit order; a partial aggregate, not a sort of each group."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") > 1)


def missing_from(df: DataFrame, reference: DataFrame, column: str, reference_column: str | None = None) -> DataFrame:
    """Distinct values of ``column`` that the reference does not hold."""
    other = reference.select(F.col(reference_column or column).alias(column))
    return df.select(column).distinct().join(other, column, "left_anti")


def list_margins(shortlist: DataFrame, group: str = "h_id", rank: str = "candidate_rank", score: str = "final_wsm_score") -> DataFrame:
    """Rank 1: lead over the runner-up; others: distance to the leader; 0 for a list of one."""
    order = Window.partitionBy(group).orderBy(rank)
    everyone = Window.partitionBy(group)
    leader = F.first(score).over(order)
    margin = F.when(F.col(rank) == 1, F.col(score) - F.lead(score).over(order)).otherwise(F.col(score) - leader)
    return shortlist.withColumn("score_margin", F.coalesce(F.floor(margin * 10.0 + 0.5) / 10.0, F.lit(0.0))).withColumn(
        "list_size", F.count(F.lit(1)).over(everyone)
    )


def next_or_last(events: DataFrame, key: str, order: str, now: Column) -> DataFrame:
    """Per key the first event on or after ``now``, else the last one; among equals the least, else the greatest, of the other columns."""
    rest = F.struct(*[c for c in events.columns if c != key])
    full = F.struct(order, *[c for c in events.columns if c not in (key, order)])
    upcoming = F.min_by(F.when(F.col(order) >= now, rest), F.when(F.col(order) >= now, full))
    last = F.max_by(rest, full)
    return events.groupBy(key).agg(F.coalesce(upcoming, last).alias("_e")).select(key, "_e.*")


def stack_panels(panels: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), panels)
