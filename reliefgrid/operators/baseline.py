"""State baseline composites from validated one-to-one merges and rank scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.operators.lookup import join_one_to_one
from reliefgrid.operators.ranking import rank_scores


def merge_inputs(tables: list[DataFrame], key: str = "state") -> DataFrame:
    return reduce(lambda a, b: join_one_to_one(a, b, key), tables)


def baseline_scores(df: DataFrame) -> DataFrame:
    """Pressure, spare capacity, community need and redistribution scores of every state."""
    ratios = df.withColumns(
        {
            "visitor_growth_2024_pct": (F.col("domestic_visitors_2024_000") / F.col("domestic_visitors_2023_000") - 1) * 100,
            "annual_visitors_per_resident": F.col("domestic_visitors_2024_000") / F.col("population_2024_000"),
            "annual_overnight_tourists_per_room": F.col("overnight_tourists_2024_000") * 1000 / F.col("hotel_rooms_2023"),
        }
    )
    ranked = rank_scores(
        ratios,
        {
            "_intensity": ("annual_visitors_per_resident", True),
            "_rooms": ("annual_overnight_tourists_per_room", True),
            "_growth": ("visitor_growth_2024_pct", True),
            "_poverty": ("poverty_rate_2024_pct", True),
            "_income": ("median_household_income_2024_rm", False),
        },
    )
    pressure = F.col("_intensity") * 0.4 + F.col("_rooms") * 0.4 + F.col("_growth") * 0.2
    return (
        ranked.withColumn("tourism_pressure_proxy_score", pressure)
        .withColumn("spare_capacity_proxy_score", 100.0 - F.col("tourism_pressure_proxy_score"))
        .withColumn("community_opportunity_proxy_score", F.col("_poverty") * 0.6 + F.col("_income") * 0.4)
        .withColumn(
            "redistribution_potential_proxy_score",
            F.col("spare_capacity_proxy_score") * 0.55 + F.col("community_opportunity_proxy_score") * 0.45,
        )
        .drop("_intensity", "_rooms", "_growth", "_poverty", "_income")
        .orderBy(F.desc("redistribution_potential_proxy_score"), "state")
    )


def household_profile(survey: DataFrame, gdp: DataFrame | None = None, snapshot: str = "2024-01-01") -> DataFrame:
    """Latest household survey rows, with services GDP of the latest year where that table has the columns."""
    current = survey.where(F.col("date").cast("string") == snapshot)
    if gdp is None or not {"state", "year", "services_gdp"} <= set(gdp.columns):
        return current
    latest = gdp.where(F.col("year") == gdp.agg(F.max("year")).scalar()).select("state", "services_gdp")
    return current.join(latest, "state", "left")


def visitors_long(wide: DataFrame, key: str = "state") -> DataFrame:
    years = [c for c in wide.columns if c != key]
    return wide.unpivot([key], years, "year", "domestic_visitors_000").withColumn("year", F.col("year").cast("int"))
