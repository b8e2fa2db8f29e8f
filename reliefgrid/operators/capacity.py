"""Staged capacity and binding-constraint diagnosis over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.functions.capacity import (
    SUBSYSTEMS,
    binding_label,
    effective_capacity,
    floored_least,
    management_status,
    physical_capacity,
    real_capacity,
)
from reliefgrid.functions.numeric import at_least, rnd


def capacity_stages(
    df: DataFrame,
    area: str = "area_m2",
    space: str = "space_m2",
    hours: str = "open_hours",
    stay: str = "stay_hours",
    factors: Column | None = None,
    management: str = "management_ratio",
) -> DataFrame:
    """Physical -> real -> effective capacity."""
    factors = F.map_values("factors") if factors is None else factors
    return (
        df.withColumn("physical_capacity", physical_capacity(area, space, hours, stay))
        .withColumn("real_capacity", real_capacity("physical_capacity", factors))
        .withColumn("effective_capacity", effective_capacity("real_capacity", management))
    )


def diagnose(
    df: DataFrame, demand: str = "daily_demand_peak", subsystems: list[tuple[str, str]] | None = None
) -> DataFrame:
    """Add the binding capacity of every row and the pressure against it."""
    subsystems = subsystems or SUBSYSTEMS
    need, low = F.col("_demand"), F.col("_capacity")
    pressure = need / low
    excess = F.greatest(F.lit(0.0), need - low)
    gap = 1.0 - pressure
    return (
        df.withColumn("_demand", at_least(demand, 0.0))
        .withColumn("_capacity", floored_least([c for c, _ in subsystems]))
        .withColumn("sustainable_capacity", rnd(low, 1))
        .withColumn("binding_constraint", binding_label(subsystems))
        .withColumn("continuous_pressure", rnd(pressure, 3))
        .withColumn("pressure_percent", rnd(pressure * 100.0, 1))
        .withColumn("excess_demand", rnd(excess, 1))
        .withColumn("capacity_gap", rnd(gap, 3))
        .withColumn("capacity_gap_percent", rnd(gap * 100.0, 1))
        .withColumn("is_overcapacity", excess > 0)
        .withColumn("management_status", management_status(pressure))
        .drop("_demand", "_capacity")
    )
