"""Group aggregates: baselines, seasonal indices, roll-ups, shares and allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.functions.numeric import known, rnd
from reliefgrid.session import cut_lineage

NATIONAL_LABEL = "National Mean Baseline"
DEFAULT_OCCUPANCY = 47.5


def national_baseline(
    df: DataFrame, value: str = "average_occupancy_rate_pct", by_period: bool = False, period: str | None = None
) -> DataFrame:
    """Mean over all states by year, or by year and period; ``period`` restricts the rows that count."""
    rows = df if period is None else df.where(F.col("period") == period)
    keys = ["year", "period"] if by_period else ["year"]
    out = rows.groupBy(*keys).agg(F.avg(known(value)).alias(value))
    if not by_period:
        out = out.withColumn("period", F.lit("Annual"))
    return out.select("year", "period", value, F.lit(NATIONAL_LABEL).alias("state")).orderBy("year", "period")


def national_mean(df: DataFrame, value: str = "average_occupancy_rate_pct", default: float = DEFAULT_OCCUPANCY) -> DataFrame:
    """One-row grand mean; the default stands in for an empty table."""
    return df.agg(F.coalesce(F.avg(known(value)), F.lit(default)).alias(value))


def seasonal_index(df: DataFrame, key: str = "state", period: str = "period", value: str = "value") -> DataFrame:
    """Mean of each quarter divided by the mean of the quarter means, one row per key and quarter."""
    quarters = df.where(F.col(period).isin("Q1", "Q2", "Q3", "Q4")).groupBy(key, period).agg(F.avg(known(value)).alias("mean"))
    level = Window.partitionBy(key)  # at most four rows per key
    return quarters.select(key, period, "mean", (F.col("mean") / F.avg("mean").over(level)).alias("season_index"))


def recent_mean(df: DataFrame, key: str, value: str, year: str = "year", since: int = 2023) -> DataFrame:
    return df.where(F.col(year) >= since).groupBy(key).agg(F.avg(known(value)).alias(f"recent_{value}"))


def state_rollup(df: DataFrame, with_total: bool = False) -> DataFrame:
    """District rows to state rows, optionally with one national row (state_name null) from the same pass."""
    grouped = df.rollup("state_name") if with_total else df.groupBy("state_name")
    busiest = F.min_by("destination_name", F.struct((-F.col("daily_demand_peak")).alias("minus"), F.col("destination_id")))
    return grouped.agg(
        F.avg("lat").alias("lat"),
        F.avg("lon").alias("lon"),
        F.sum("daily_demand_peak").alias("daily_demand_peak"),
        F.sum("sustainable_capacity").alias("sustainable_capacity"),
        F.sum("total_rooms").alias("total_rooms"),
        F.avg("latest_aor_pct").alias("latest_aor_pct"),
        F.avg("continuous_pressure").alias("continuous_pressure"),
        F.avg("poverty_rate").alias("poverty_rate"),
        F.count(F.lit(1)).alias("district_count"),
        busiest.alias("rep_district"),
    ).withColumn("elevation", F.greatest(F.lit(25000.0), F.col("daily_demand_peak") * 0.8))


def month_means(calendar: DataFrame, month: str = "month", value: str = "demand_multiplier") -> DataFrame:
    """Mean by calendar month ('YYYY-MM' keys), ranked high to low: at most twelve rows."""
    number = F.substring(F.col(month), 6, 2).cast("int")
    means = calendar.groupBy(number.alias("month_no")).agg(F.avg(value).alias("mean_value"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("mean_value"), "month_no")
    return means.withColumn("month_rank", F.row_number().over(order))


def top_by_value(df: DataFrame, value: str, ties: list[str], n: int) -> DataFrame:
    return df.orderBy(F.desc(value), *ties).limit(n)


def max_per_key(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    return top_by_value(df.groupBy(key).agg(F.max(value).alias(value)), value, [key], n)


def share_of_total(df: DataFrame, value: str, total_key: Column, out: str = "share_percent") -> DataFrame:
    """Percent of the row that ``total_key`` marks, or of the sum of the others when no such row exists."""
    df = cut_lineage(df)  # read by both totals and by the rows
    stated = df.where(total_key).agg(F.max(value))
    parts = df.where(~total_key)
    whole = F.coalesce(stated.scalar(), parts.agg(F.sum(value)).scalar())
    return parts.withColumn(out, F.col(value) / whole * 100.0)


def allocate(
    df: DataFrame, totals: DataFrame, key: str, weight: Column, total: str, floor: int = 350, out: str = "allocated"
) -> DataFrame:
    """Split each key's total over its rows by weight, never below ``floor``; null where the key has no total.

    The weight sum is a grouped aggregate joined back, not a window, so one key with a third of the rows still
    aggregates in parallel.
    """
    weighted = cut_lineage(df.withColumn("_w", weight))  # read by the sums and by the split
    sums = weighted.groupBy(key).agg(F.sum("_w").alias("_sum")).join(totals.select(key, total), key)
    part = F.greatest(F.lit(float(floor)), rnd(F.col(total) * F.col("_w") / F.col("_sum")))
    return weighted.join(sums, key, "left").withColumn(out, F.when(F.col(total).isNotNull(), part)).drop("_w", "_sum")


def recent_rows_mean(df: DataFrame, order: str, values: list[str], rows: int = 30) -> DataFrame:
    """Rounded means over the last ``rows`` rows (nulls skipped) and the latest order value."""
    recent = df.orderBy(F.desc(order)).limit(rows)
    return recent.agg(*[rnd(F.avg(v)).alias(f"{v}_avg") for v in values], F.max(order).alias(f"latest_{order}"))


def trailing_mean(df: DataFrame, keys: list[str], order: str, value: str, rows: int = 30) -> DataFrame:
    """Moving mean over the last ``rows`` rows of each series."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(f"trailing_{value}", F.avg(value).over(frame))


def top_share(df: DataFrame, group: str, value: str, tie: str, n: int = 5) -> DataFrame:
    """Share of each group's total held by its ``n`` largest rows."""
    df = cut_lineage(df)  # read by the totals and by the leaders
    order = Window.partitionBy(group).orderBy(F.desc(value), tie)
    head = (
        df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
        .groupBy(group).agg(F.sum(value).alias("top_value"))
    )
    return (
        df.groupBy(group).agg(F.sum(value).alias("total_value")).join(head, group)
        .withColumn("top_share", F.col("top_value") / F.col("total_value"))
    )
