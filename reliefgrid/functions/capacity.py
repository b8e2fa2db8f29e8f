"""Capacity, pressure and score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reliefgrid.functions.numeric import as_col, at_least, clip, known, or_default, rnd

# The six subsystems (column, label) in tie-break order.
SUBSYSTEMS = [
    ("cc_accommodation", "Accommodation Supply"),
    ("cc_transport", "Road & Transit Throughput"),
    ("cc_attraction", "Attraction & Amenity Space"),
    ("cc_water_waste", "Municipal Water & Waste Buffer"),
    ("cc_ecology", "Ecosystem & Slope Tolerance"),
    ("cc_social", "Resident & Social Tolerance"),
]
# Labels the master table uses for the same subsystems.
MASTER_SUBSYSTEMS = [
    ("cc_accommodation", "Accommodation Inventory"),
    ("cc_transport", "Transport / Roadway Gridlock"),
    ("cc_attraction", "Attraction Core Space Turnover"),
    ("cc_water_waste", "Clean Water Buffer (SPAN Reserve)"),
    ("cc_ecology", "Ecological Slope & Forest KSAS Buffer"),
    ("cc_social", "Local Resident Social Tolerance"),
]


def physical_capacity(area_m2: Column | str, space_m2: Column | str, hours: Column | str, stay_hours: Column | str) -> Column:
    """area / space per visitor * daily rotations; 0 when any input is not positive."""
    area, space, open_h, stay = (known(c) for c in (area_m2, space_m2, hours, stay_hours))
    valid = (area > 0) & (space > 0) & (open_h > 0) & (stay > 0)
    return F.when(valid, area / space * (open_h / stay)).otherwise(F.lit(0.0))


def real_capacity(physical: Column | str, factors: Column) -> Column:
    """physical * product of (1 - factor), each factor held in [0, 1]; ``factors`` is a map or array."""
    return F.aggregate(factors, as_col(physical).cast("double"), lambda acc, f: acc * (1.0 - clip(f, 0.0, 1.0)))


def effective_capacity(real: Column | str, management: Column | str) -> Column:
    return as_col(real) * clip(as_col(management).cast("double"), 0.0, 1.0)


def floored_least(columns: list[str]) -> Column:
    return F.least(*[at_least(c, 1.0) for c in columns])


def binding_label(subsystems: list[tuple[str, str]]) -> Column:
    """Label of the smallest capacity, the first listed on a tie."""
    low = floored_least([c for c, _ in subsystems])
    label = F.lit(subsystems[-1][1])
    for column, text in reversed(subsystems[:-1]):
        label = F.when(at_least(column, 1.0) == low, F.lit(text)).otherwise(label)
    return label


def management_status(pressure: Column) -> Column:
    return (
        F.when(pressure < 0.70, "Underutilized (High Absorption Buffer)")
        .when(pressure <= 0.85, "Healthy Utilization")
        .when(pressure <= 1.00, "High Pressure (Approaching Limit)")
        .otherwise("Overcapacity (Immediate Intervention Required)")
    )


def pressure_band(pressure: Column) -> Column:
    return F.when(pressure >= 1.0, "acute").when(pressure >= 0.80, "stressed").otherwise("normal")


def community_score(poverty_rate: Column) -> Column:
    return F.least(F.lit(100.0), rnd(poverty_rate * 8.5 + 15.0, 1))


def ecological_risk(eco_capacity: Column, demand: Column) -> Column:
    free = F.greatest(F.lit(0.0), (eco_capacity - demand) / F.greatest(F.lit(1.0), eco_capacity))
    return rnd((1.0 - F.least(F.lit(1.0), free)) * 100.0, 1)


def proportion_score(capacity_gap: Column) -> Column:
    return clip(rnd(capacity_gap * 100.0, 1), 0.0, 100.0)


def headroom_pax(capacity: Column | str, demand: Column | str) -> Column:
    cap, dem = or_default(capacity, 0.0), or_default(demand, 0.0)
    return F.when(cap > 0, F.greatest(F.lit(0.0), cap - dem)).otherwise(F.lit(0.0))


def excess_pax(capacity: Column | str, demand: Column | str) -> Column:
    """Overflow a hotspot needs to divert, 0 when its capacity is unknown."""
    cap, dem = or_default(capacity, 0.0), or_default(demand, 0.0)
    return F.when(cap > 0, F.greatest(F.lit(0.0), dem - cap)).otherwise(F.lit(0.0))


def headroom_score(headroom: Column, need: Column) -> Column:
    """Share of the needed diversion the headroom covers, 0-100; 100 when nothing is needed."""
    safe_need = F.when(need > 0, need)
    return F.coalesce(clip_null(F.greatest(F.lit(0.0), headroom) / safe_need * 100.0), F.lit(100.0))


def clip_null(value: Column) -> Column:
    return F.when(value.isNotNull(), clip(value, 0.0, 100.0))


def access_score(travel_mins: Column, rail: Column) -> Column:
    """Exponential decay of travel time with a bonus for real rail corridors."""
    base = F.exp(F.greatest(F.lit(0.0), travel_mins) * -0.0075) * 100.0
    return rnd(F.when(rail, F.least(F.lit(100.0), base + 8.0)).otherwise(base), 1)


# Road km without friction, and points lost for each km beyond.
FRICTION_FREE_KM, FRICTION_PER_KM = 60.0, 0.08


def distance_friction(distance_km: Column) -> Column:
    return F.greatest(F.lit(0.0), distance_km - FRICTION_FREE_KM) * FRICTION_PER_KM


def income_retention(candidate_poverty: Column, hotspot_poverty: Column) -> Column:
    """Share of spend kept as local low-income earnings."""
    ratio = F.greatest(F.lit(1.0), candidate_poverty / F.greatest(F.lit(0.1), hotspot_poverty))
    return F.least(F.lit(0.65), F.lit(0.35) + F.log1p(ratio) * 0.03)


def congested_multiplier(multiplier: Column | str, pressure: Column | str, elasticity: float = 0.25) -> Column:
    """Multiplier damped by pressure above 1, never below half."""
    over = F.greatest(F.lit(0.0), as_col(pressure) - 1.0)
    return rnd(as_col(multiplier) * (1.0 - F.least(F.lit(0.5), over * elasticity)), 4)
