"""Spending impact of diverted visitors, for whole scenario tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.functions.capacity import congested_multiplier, income_retention
from reliefgrid.functions.numeric import or_default, rnd
from reliefgrid.operators.market import CATEGORIES, blended_share

# Fixed values per mode: nights, spend per night, output multiplier, macro volume (RM billion).
MODES = {
    "domestic": (2.45, 386.73, 1.75, 84.9),
    "inbound": (4.80, 728.50, 1.82, 106.8),
    "blended": (3.63, 557.62, 1.78, 191.7),
}
# Value-added and Type II multipliers.
GVA_MULTIPLIER = 0.8151
TYPE2_MULTIPLIER = 2.9388
# Spending shares by category, in the order of CATEGORIES.
INBOUND_SHARES = [0.3736, 0.1809, 0.1610, 0.0569, 0.0814, 0.0239, 0.0217, 0.0473, 0.0383, 0.0015, 0.0104, 0.0030]
DOMESTIC_SHARES = [0.332, 0.231, 0.254, 0.070, 0.000, 0.013, 0.025, 0.010, 0.015, 0.005, 0.040, 0.005]
# The five sectors with their categories, and the domestic survey shares.
SECTORS = {
    "shopping_retail_rm": (["Shopping"], 0.332),
    "food_beverage_rm": (["Food & Beverages"], 0.254),
    "accommodation_rm": (["Accommodation"], 0.231),
    "transport_transit_rm": (["Local Transportation", "Fuel", "Domestic Airfares", "International Airfares"], 0.123),
    "entertainment_other_rm": (["Entertainment", "Medical", "Organised Tour", "Sports", "Others"], 0.060),
}


def _by_mode(index: int) -> Column:
    mode = F.col("tourism_mode")
    return (
        F.when(mode == "inbound", F.lit(MODES["inbound"][index]))
        .when(mode == "blended", F.lit(MODES["blended"][index]))
        .otherwise(F.lit(MODES["domestic"][index]))
    )


def _overridable(column: str, index: int) -> Column:
    """The mode's own value unless the caller moved away from the domestic default."""
    given = or_default(column, MODES["domestic"][index])
    return F.when(given == MODES["domestic"][index], _by_mode(index)).otherwise(given)


def category_share(category: int) -> Column:
    """Share of one category under the row's mode; a ``market_shares`` map overrides inbound rows."""
    domestic, inbound = F.lit(DOMESTIC_SHARES[category]), F.lit(INBOUND_SHARES[category])
    mode = F.col("tourism_mode")
    return F.when(mode == "inbound", inbound).when(mode == "blended", blended_share(domestic, inbound)).otherwise(domestic)


def scenario_visitors(df: DataFrame, excess: str = "excess_demand", percent: str = "divert_pct") -> DataFrame:
    """Daily diverted visitors of a what-if and how much of the excess they offset."""
    daily = F.greatest(F.lit(500.0), F.col(excess)) * (F.col(percent) / 100.0)
    return df.withColumn("redirected_visitors_daily", daily).withColumn(
        "offset_pct", F.least(F.lit(100.0), F.col("redirected_visitors_daily") / F.greatest(F.lit(1.0), F.col(excess)) * 100.0)
    )


def impact(df: DataFrame, gva: float = GVA_MULTIPLIER, type2: float = TYPE2_MULTIPLIER) -> DataFrame:
    """Direct spend, output, value added, local income and damped multiplier of every scenario row.

    Reads ``redirected_visitors_daily``, ``days_period``, ``alos``, ``spend_per_night``, ``tourism_mode``,
    ``candidate_poverty``, ``hotspot_poverty`` and ``destination_pressure``.
    """
    mode = F.lower(F.trim(F.col("tourism_mode")))
    rows = df.withColumn("tourism_mode", F.when(mode.isin("inbound", "blended"), mode).otherwise("domestic"))
    # a small third amount is an old positional call: the values sit one place to the left
    shifted = (F.col("spend_per_night") < 50.0) & (F.col("candidate_poverty") <= 50.0) & (F.col("hotspot_poverty") == 0.0)
    rows = rows.withColumn("_shift", F.coalesce(shifted, F.lit(False))).withColumns(
        {
            "hotspot_poverty": F.when(F.col("_shift"), F.col("candidate_poverty")).otherwise(F.col("hotspot_poverty")),
            "candidate_poverty": F.when(F.col("_shift"), F.col("spend_per_night")).otherwise(F.col("candidate_poverty")),
            "spend_per_night": F.when(F.col("_shift"), F.lit(MODES["domestic"][1])).otherwise(F.col("spend_per_night")),
        }
    )
    rows = rows.withColumns(
        {
            "alos_used": _overridable("alos", 0),
            "spend_per_night_used": _overridable("spend_per_night", 1),
            "output_multiplier": _by_mode(2),
            "macro_volume_rm_billion": _by_mode(3),
            "_trips": F.greatest(F.lit(0.0), F.col("redirected_visitors_daily")) * F.col("days_period"),
        }
    ).withColumn("_nights", F.col("_trips") * F.col("alos_used"))
    rows = rows.withColumn("_direct", F.col("_nights") * F.col("spend_per_night_used"))
    direct = F.col("_direct")
    kept = income_retention(F.col("candidate_poverty"), F.col("hotspot_poverty"))
    return rows.withColumns(
        {
            "total_tourist_trips": rnd("_trips"),
            "total_tourist_nights": rnd("_nights"),
            "direct_spend_total_rm": rnd(direct, 2),
            "direct_spend_million_rm": rnd(direct / 1e6, 3),
            "total_economic_output_million_rm": rnd(direct * F.col("output_multiplier") / 1e6, 3),
            "total_gdp_value_added_million_rm": rnd(direct * gva / 1e6, 3),
            "total_type2_output_million_rm": rnd(direct * type2 / 1e6, 3),
            "capacity_adjusted_multiplier": congested_multiplier("output_multiplier", "destination_pressure"),
            "estimated_b40_income_million_rm": rnd(direct * kept / 1e6, 3),
        }
    ).drop("_trips", "_nights", "_shift")


def category_split(impacted: DataFrame) -> DataFrame:
    """One row per scenario and spending category; a ``market_shares`` map column overrides the mode's shares."""
    override = F.col("market_shares") if "market_shares" in impacted.columns else None
    rows = []
    for i, name in enumerate(CATEGORIES):
        share = category_share(i)
        if override is not None:
            given = F.coalesce(F.try_element_at(override, F.lit(name)), F.lit(0.0))
            share = F.when((F.col("tourism_mode") == "inbound") & override.isNotNull(), given).otherwise(share)
        rows.append(F.struct(F.lit(name).alias("spending_category"), share.alias("share"), rnd(F.col("_direct") * share, 2).alias("amount_rm")))
    return impacted.withColumn("_c", F.explode(F.array(*rows))).select(*impacted.columns, "_c.*").drop("_direct")


def sector_split(impacted: DataFrame) -> DataFrame:
    """Five sector amounts as columns."""
    out = {}
    for name, (members, survey_share) in SECTORS.items():
        grouped = sum((category_share(CATEGORIES.index(m)) for m in members), start=F.lit(0.0))
        share = F.when(F.col("tourism_mode") == "domestic", F.lit(survey_share)).otherwise(grouped)
        out[name] = rnd(F.col("_direct") * share, 2)
    return impacted.withColumns(out).drop("_direct")


def fiscal_ratios(impacted: DataFrame, subsidy: str = "estimated_subsidy_rm", days: str = "days_period") -> DataFrame:
    """Return on subsidy, tax yield and total trips."""
    spend = F.col("direct_spend_million_rm")
    return impacted.withColumns(
        {
            "total_trips": F.col("redirected_visitors_daily") * F.col(days),
            "fiscal_roi": spend * 1e6 / F.greatest(F.lit(1.0), F.col(subsidy)),
            "tax_yield_million_rm": spend * 0.10,
        }
    )
