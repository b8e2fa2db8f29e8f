"""Inbound market x category spending matrix and its queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.functions.numeric import parse_number, rnd
from reliefgrid.operators.lookup import last_value_lookup, prefer_first
from reliefgrid.operators.rollup import share_of_total, top_by_value

# Labels in the spending table.
ALL_CATEGORIES = "All spending categories"
OVERALL = "Overall"
# The twelve spending categories.
CATEGORIES = [
    "Shopping",
    "Accommodation",
    "Food & Beverages",
    "Local Transportation",
    "International Airfares",
    "Domestic Airfares",
    "Entertainment",
    "Medical",
    "Organised Tour",
    "Sports",
    "Fuel",
    "Others",
]


def _preferred(rows: DataFrame) -> DataFrame:
    return prefer_first(rows, ["year"], "audience", "Visitors", "Tourists")


def market_matrix(raw: DataFrame, order: str = "row_id", categories: list[str] | None = None) -> DataFrame:
    """(year, market, spending_category, value_rm_million, percentage_share) from the long raw table.

    Totals are one row per market and year; category amounts are share x total. ``order`` decides which of repeated
    totals is the last.
    """
    totals = _preferred(
        raw.where(
            (F.col("metric_group") == "Total expenditure") & (F.col("period_type") == "Full year") & F.col("value_rm_million").isNotNull()
        )
    )
    shares = _preferred(
        raw.where(
            (F.col("selected_period") == "Jan-Dec")
            & (F.col("metric_group") == "Expenditure components share")
            & F.col("spending_category").isin(categories or CATEGORIES)
        )
    )
    percent = F.coalesce(F.col("value_numeric"), parse_number("value_display"), F.lit(0.0))
    whole = totals.select(
        "year", "market", F.lit(ALL_CATEGORIES).alias("spending_category"),
        rnd("value_rm_million", 2).alias("value_rm_million"), F.lit(100.0).alias("percentage_share"),
    )
    known_years = totals.select("year").distinct()
    priced = last_value_lookup(
        shares.join(known_years, "year", "left_semi").select("year", "market", "spending_category", percent.alias("_pct")),
        totals.select("year", "market", F.col("value_rm_million").alias("_total"), F.col(order).alias("_order")),
        ["year", "market"], "_total", "_order",
    )
    parts = priced.select(
        "year", "market", "spending_category",
        rnd(F.col("_pct") / 100.0 * F.col("_total"), 3).alias("value_rm_million"), rnd("_pct", 2).alias("percentage_share"),
    )
    return whole.unionByName(parts).orderBy(F.desc("year"), "market", "spending_category")


def _totals_of(matrix: DataFrame, year: int) -> DataFrame:
    return matrix.where((F.col("year") == year) & (F.col("spending_category") == ALL_CATEGORIES) & F.col("market").isNotNull())


def top_markets(matrix: DataFrame, year: int = 2024, n: int = 10) -> DataFrame:
    """Largest markets with their share of the overall total (or of the sum when no overall row exists)."""
    shared = share_of_total(_totals_of(matrix, year), "value_rm_million", F.col("market") == OVERALL)
    return top_by_value(shared, "value_rm_million", ["market"], n)


def market_breakdown(matrix: DataFrame, requests: DataFrame, year: int = 2024) -> DataFrame:
    """Category rows for every requested market, matched without case; unknown markets get the overall rows."""
    rows = matrix.where((F.col("year") == year) & (F.col("spending_category") != ALL_CATEGORIES))
    national = F.lower("requested").isin("all markets", "overall", "all", "total", "national") | F.col("requested").isNull()
    target = F.lower(F.when(national, F.lit(OVERALL)).otherwise(F.col("requested")))
    present = rows.select(F.lower("market").alias("_key")).distinct()
    asked = requests.select("requested", target.alias("_target"))
    resolved = asked.join(present, asked["_target"] == present["_key"], "left").select(
        "requested", F.coalesce("_key", F.lit(OVERALL.lower())).alias("_key")
    )
    return resolved.join(rows.withColumn("_key", F.lower("market")), "_key").select(
        "requested", "market", "spending_category", "percentage_share", "value_rm_million"
    )


def national_breakdown(matrix: DataFrame, year: int = 2024) -> DataFrame:
    rows = matrix.where((F.col("year") == year) & (F.col("market") == OVERALL) & (F.col("spending_category") != ALL_CATEGORIES))
    return rows.orderBy(F.desc("value_rm_million"), "spending_category")


def market_series(matrix: DataFrame, market: str) -> DataFrame:
    """Yearly headline totals of one market."""
    return matrix.where((F.col("market") == market) & (F.col("spending_category") == ALL_CATEGORIES)).orderBy("year")


def blended_share(domestic: Column, inbound: Column) -> Column:
    return rnd(domestic * 0.5 + inbound * 0.5, 4)


def top_markets_raw(raw: DataFrame, year: int = 2024, n: int = 10) -> DataFrame:
    """Largest markets straight from the raw table: full-year visitor totals, or all totals of the year without any."""
    rows = raw.where(
        (F.col("year") == year) & (F.col("metric_group") == "Total expenditure") & (F.col("market") != OVERALL) & F.col("market").isNotNull()
    )
    strict = F.coalesce((F.col("period_type") == "Full year") & (F.col("audience") == "Visitors"), F.lit(False))
    best = rows.groupBy("market").agg(
        F.max(F.when(strict, F.col("value_rm_million"))).alias("_strict"), F.max("value_rm_million").alias("_any")
    )
    any_strict = rows.agg(F.coalesce(F.max(strict), F.lit(False))).scalar()
    value = F.when(any_strict, F.col("_strict")).otherwise(F.col("_any"))
    ranked = best.select("market", value.alias("value_rm_million")).where(F.col("value_rm_million").isNotNull())
    return top_by_value(ranked, "value_rm_million", ["market"], n)


def or_reference(breakdown: DataFrame, shares: list[float], total_rm_million: float) -> DataFrame:
    """``breakdown`` of one market, or the reference shares of the twelve categories when it has no rows."""
    names = ["spending_category", "percentage_share", "value_rm_million"]
    fixed = F.array(
        *[
            F.struct(F.lit(c).alias(names[0]), rnd(F.lit(s) * 100.0, 2).alias(names[1]), rnd(F.lit(s) * total_rm_million, 3).alias(names[2]))
            for c, s in zip(CATEGORIES, shares)
        ]
    )
    rows = breakdown.select(*names)
    spare = rows.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 0).select(F.inline(fixed))
    return rows.unionByName(spare)
