"""Domain tables derived from the driver tables: suppliers play places, sales play demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.functions.capacity import SUBSYSTEMS
from reliefgrid.operators.capacity import diagnose
from reliefgrid.operators.match import prepare_places
from reliefgrid.plans.sqltext import ARCH_TYPES, MOUNTAIN, PLACE_FACTORS
from reliefgrid.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place_base(spark: SparkSession, sf_dir: str, sales: DataFrame | None = None) -> DataFrame:
    """Suppliers with demand (summed sales), formula coordinates and six capacities."""
    if sales is None:
        sales = (
            table(spark, sf_dir, "lineitem").groupBy("l_suppkey")
            .agg(F.sum("l_quantity").alias("demand"), F.count(F.lit(1)).alias("line_count"))
        )
    kept = [F.col(c) for c in sales.columns if c not in ("l_suppkey", "demand", "line_count")]
    key = F.col("s_suppkey")
    places = (
        table(spark, sf_dir, "supplier").join(sales, key == F.col("l_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    capacities = [
        (F.col("demand") * (((key * a + b) % 23) / 12.0 + 0.75)).alias(name)
        for (name, _), (a, b) in zip(SUBSYSTEMS, PLACE_FACTORS)
    ]
    return places.select(
        key.alias("destination_id"),
        F.col("s_name").alias("destination_name"),
        F.col("n_name").alias("state_name"),
        ((key * 37 % 600) / 100.0 + 1.0).alias("lat"),
        ((key * 53 % 1900) / 100.0 + 100.0).alias("lon"),
        (F.col("line_count") * 8.0).alias("total_rooms"),
        (F.greatest(F.lit(0.0), F.col("s_acctbal")) / 1000.0).alias("poverty_rate"),
        ((key * 29 % 400) / 10.0 + 40.0).alias("latest_aor_pct"),
        F.col("demand").alias("daily_demand_peak"),
        *capacities,
        *kept,
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose(place_base(spark, sf_dir))


def brand_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by supplier, brand and type: at most 150 rows per supplier."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_suppkey", "p_brand", "p_type").agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archetype measures (type shares), tags (five best brands) and sales of every supplier."""
    by_brand = brand_mix(spark, sf_dir).groupBy("l_suppkey", "p_brand").agg(
        F.sum("qty").alias("qty"),
        F.sum("n").alias("n"),
        *[F.sum(F.when(F.col("p_type") == t, F.col("qty")).otherwise(0.0)).alias(n) for n, t in ARCH_TYPES],
    )
    # a supplier has at most one row per brand here, so the list is short
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("qty")).alias("minus"), F.col("p_brand"))))
    total = F.sum("qty")
    return by_brand.groupBy("l_suppkey").agg(
        *[F.least(F.lit(1.0), F.sum(n) * 2.5 / total).alias(n) for n, _ in ARCH_TYPES],
        F.array_join(F.slice(ranked, 1, 5)["p_brand"], " | ").alias("poi_tags"),
        total.alias("demand"),
        F.sum("n").alias("line_count"),
    )


def full_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with archetypes and tags, from one pass over the sales."""
    return diagnose(place_base(spark, sf_dir, profiles(spark, sf_dir)))


def match_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_places(full_places(spark, sf_dir), mountain_pattern=MOUNTAIN)


def hotel_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, year, period, average_occupancy_rate_pct) from mean quantity.

    Lines are added up per supplier before they meet the supplier and nation names.
    """
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("q"))
        .agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))
    )
    # nations x years x quarters: small, and read twice below
    quarters = cut_lineage(
        with_nation(spark, sf_dir, lines, "l_suppkey").groupBy("state", "year", "q")
        .agg(F.sum("qty").alias("qty"), F.sum("n").alias("n"))
    )
    rate = (F.col("qty") / F.col("n") * 2.0).alias("average_occupancy_rate_pct")
    by_quarter = quarters.select("state", "year", F.concat(F.lit("Q"), F.col("q").cast("string")).alias("period"), rate)
    by_year = quarters.groupBy("state", "year").agg(F.sum("qty").alias("qty"), F.sum("n").alias("n"))
    return by_quarter.unionByName(
        by_year.select("state", "year", F.lit("Annual").alias("period"), rate)
    )


def with_nation(spark: SparkSession, sf_dir: str, df: DataFrame, supplier_key: str) -> DataFrame:
    """Add ``state`` (nation name) to rows keyed by supplier."""
    names = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(F.col("s_suppkey").alias(supplier_key), F.col("n_name").alias("state"))
    return df.join(names, supplier_key)


def customer_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", F.col("n_name").alias("market"))


def money(column: str) -> Column:
    """Exact sums of two-digit amounts."""
    return F.col(column).cast("decimal(18,2)")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month calendar derived from daily order counts."""
    orders = table(spark, sf_dir, "orders")
    days = orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("urgent"),
        F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("pending"),
    )
    # one row per month
    months = days.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.count(F.when(F.col("urgent") >= 3, 1)).alias("cuti_sekolah_days"),
        F.count(F.when(F.col("pending") >= 5, 1)).alias("public_holidays"),
        F.count(F.when((F.weekday("day") == 5) & (F.col("n") >= 6), 1)).alias("long_weekends"),
        F.sum("n").alias("n"),
    )
    months = cut_lineage(months)
    mean = months.agg(F.avg("n"))
    return months.select(
        "month", "cuti_sekolah_days", "public_holidays", "long_weekends", (F.col("n") / mean.scalar()).alias("demand_multiplier"),
        F.concat(F.lit("Events of "), F.col("month")).alias("event_highlights"),
    )


def holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which orders pile up."""
    # one row per day
    days = cut_lineage(table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("holiday_date")).agg(F.count(F.lit(1)).alias("n")))
    return days.where(F.col("n") > days.agg(F.avg("n")).scalar() * 1.25).select("holiday_date")


def daily_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events added up per day and type, in cents so that sums are exact."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.sum(money("value")).cast("double").alias("total"), F.count(F.lit(1)).alias("n")
    )
