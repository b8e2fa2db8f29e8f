"""The district master table: rooms, demand, six capacities and their diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.functions.capacity import MASTER_SUBSYSTEMS, binding_label, floored_least
from reliefgrid.functions.numeric import clip, known, or_default, rnd
from reliefgrid.functions.text import place_flag, state_name
from reliefgrid.operators.lookup import lookup
from reliefgrid.operators.rollup import allocate, recent_mean

# District tiers.
TIER_1 = ["W.P. Kuala Lumpur", "Petaling", "Johor Bahru", "Timur Laut", "Kota Kinabalu", "Kuching", "Kinta",
          "Melaka Tengah", "Cameron Highlands", "Langkawi", "Kuantan", "Bentong", "Kota Bharu", "Kuala Terengganu"]
TIER_2 = ["Miri", "Sibu", "Bintulu", "Sandakan", "Tawau", "Ranau", "Semporna", "Batu Pahat", "Muar", "Port Dickson",
          "Seremban", "Larut & Matang", "Manjung", "Klang", "Sepang", "Gombak", "Seberang Perai Tengah", "Kota Setar",
          "Kuala Muda", "Kemaman", "Besut", "Dungun"]
TIER_3 = ["Samarahan", "Kampar", "Kuala Kangsar", "Kulim", "Kubang Pasu", "Hulu Langat", "Kuala Selangor",
          "Alor Gajah", "Temerloh", "Rompin", "Kluang", "Kota Tinggi", "Pontian", "Bachok", "Pasir Mas", "Penampang",
          "Tuaran", "Barat Daya", "Seberang Perai Utara", "W.P. Putrajaya", "W.P. Labuan", "Kangar"]
PEAK_RESORTS = ["Cameron Highlands", "Melaka Tengah", "Langkawi", "Port Dickson"]
# Room weight by tier (1, 2, 3, other) and peak demand per room (resort, 1, 2, 3, other).
ROOM_WEIGHT = (2.5, 1.55, 1.0, 0.65)
DEMAND_RATIO = (1.65, 1.45, 1.30, 1.15, 0.95)
# Capacity as a multiple of demand: (strained, normal, name words, districts) by subsystem.
CAPACITY_RULES = {
    "cc_transport": (0.84, 1.35, ["cameron", "timur laut"], ["Petaling", "Johor Bahru", "W.P. Kuala Lumpur"]),
    "cc_attraction": (0.86, 1.30, [], ["Melaka Tengah", "Timur Laut"]),
    "cc_water_waste": (0.85, 1.45, ["melaka", "langkawi"], ["Port Dickson", "Semporna"]),
    "cc_ecology": (0.75, 2.30, ["cameron", "ranau"], []),
    "cc_social": (0.82, 1.55, ["timur laut"], ["Melaka Tengah"]),
}
ROOM_CAPACITY = 1.62
# Archetype by place flag (set, unset), and the tags of a place without a profile.
FLAG_ARCHETYPES = {
    "arch_heritage": ("is_heritage", 0.88, 0.35),
    "arch_nature": ("is_nature", 0.92, 0.38),
    "arch_beach": ("is_beach", 0.90, 0.05),
    "arch_urban": ("is_urban", 0.89, 0.32),
}
FOOD_ARCHETYPE = (0.92, 0.55)
DEFAULT_TAGS = "regional_tourism | local_hospitality"
# Defaults of the state lookups.
DEFAULT_ROOMS, DEFAULT_OCCUPANCY, DEFAULT_POVERTY = 15000.0, 52.0, 4.5
DEFAULT_MEAN_INCOME, DEFAULT_MEDIAN_INCOME = 7500.0, 6000.0
PROFILE_WEIGHTS = {"arch_urban": (0.8, 0.2), "arch_heritage": (0.6, 0.2), "arch_beach": (0.5, 0.1), "arch_nature": (0.4, 0.2)}


def by_tier(name: Column, values: tuple) -> Column:
    first, second, third, rest = values
    return F.when(name.isin(*TIER_1), first).when(name.isin(*TIER_2), second).when(name.isin(*TIER_3), third).otherwise(rest)


def archetypes(df: DataFrame, name: str = "district_name") -> DataFrame:
    """Profile values where known, else flag defaults, all within 0.05-0.99."""
    flags = {flag: place_flag(name, flag) for flag in ("is_beach", "is_urban", "is_nature", "is_heritage")}
    df = df.withColumns(flags)
    out = {
        a: clip(F.coalesce(known(a), F.when(F.col(flag), yes).otherwise(no)), 0.05, 0.99)
        for a, (flag, yes, no) in FLAG_ARCHETYPES.items()
    }
    food = F.when(F.col("is_urban") | F.col("is_heritage"), FOOD_ARCHETYPE[0]).otherwise(FOOD_ARCHETYPE[1])
    out["arch_food"] = clip(F.coalesce(known("arch_food"), food), 0.05, 0.99)
    out["poi_tags"] = F.coalesce("poi_tags", F.lit(DEFAULT_TAGS))
    return df.withColumns(out).drop(*flags)


def room_weight(df_name: str = "district_name") -> Column:
    """Tier weight lifted by the profile and by the number of listed attractions."""
    lift = F.lit(1.0)
    for name, (factor, default) in PROFILE_WEIGHTS.items():
        lift = lift + or_default(name, default) * factor
    listed = F.size(F.split(F.coalesce("poi_tags", F.lit("")), r"\|"))
    return by_tier(F.col(df_name), ROOM_WEIGHT) * lift * (F.least(listed, F.lit(10)) * 0.08 + 1.0)


def peak_demand(name: str = "district_name") -> Column:
    ratio = F.when(F.col(name).isin(*PEAK_RESORTS), DEMAND_RATIO[0]).otherwise(by_tier(F.col(name), DEMAND_RATIO[1:]))
    return F.col("total_rooms") * ratio * (F.col("arch_food") * 0.12 + F.col("arch_beach") * 0.08 + 1.0)


def capacities(df: DataFrame, name: str = "district_name", demand: str = "daily_demand_peak") -> DataFrame:
    low = F.lower(name)
    out = {"cc_accommodation": F.col("total_rooms") * ROOM_CAPACITY}
    for column, (strained, normal, words, districts) in CAPACITY_RULES.items():
        hit = F.col(name).isin(*districts) if districts else F.lit(False)
        if words:
            hit = hit | low.rlike("|".join(words))
        out[column] = F.col(demand) * F.when(hit, strained).otherwise(normal)
    return df.withColumns(out)


def build_master(
    districts: DataFrame,
    profiles: DataFrame,
    economy: DataFrame,
    occupancy: DataFrame,
    inventory: DataFrame,
    authorities: DataFrame | None = None,
    strict_names: bool = True,
) -> DataFrame:
    """District master from its inputs.

    ``districts``: district_name, state_name, lat, lon. ``profiles``: state_name, district_name, archetypes, poi_tags.
    ``economy``: state, poverty, income_mean, income_median. ``strict_names`` brings the state spellings of the hotel
    tables to canonical names before the lookup; without it unmatched states take the defaults.
    """

    def canonical(df: DataFrame) -> DataFrame:
        return df.withColumn("state", state_name("state")) if strict_names else df

    rooms = recent_mean(canonical(inventory), "state", "rooms_count").withColumnRenamed("state", "state_name")
    rates = recent_mean(canonical(occupancy), "state", "average_occupancy_rate_pct").withColumnRenamed("state", "state_name")
    money = economy.withColumnRenamed("state", "state_name")
    base = districts.join(profiles, ["state_name", "district_name"], "left")
    base = lookup(
        base, money, "state_name",
        {"poverty": DEFAULT_POVERTY, "income_mean": DEFAULT_MEAN_INCOME, "income_median": DEFAULT_MEDIAN_INCOME},
    )
    base = lookup(base, rates, "state_name", {"recent_average_occupancy_rate_pct": DEFAULT_OCCUPANCY})
    states = lookup(districts.select("state_name").distinct(), rooms, "state_name", {"recent_rooms_count": DEFAULT_ROOMS})
    base = allocate(base, states, "state_name", room_weight(), "recent_rooms_count", out="total_rooms").drop("recent_rooms_count")
    base = capacities(archetypes(base).withColumn("daily_demand_peak", peak_demand()))
    low, demand = floored_least([c for c, _ in MASTER_SUBSYSTEMS]), F.col("daily_demand_peak")
    base = base.withColumns({"_low": low, "binding_constraint": binding_label(MASTER_SUBSYSTEMS)})
    base = base.withColumns(
        {
            "sustainable_capacity": rnd("_low"),
            "continuous_pressure": rnd(demand / F.col("_low"), 3),
            "excess_demand_daily": rnd(F.greatest(F.lit(0.0), demand - F.col("_low"))),
            "capacity_gap": rnd((F.col("_low") - demand) / F.col("_low"), 3),
        }
    )
    by_road = (F.col("lat") < 6.0) & (F.col("lon") < 101.5) & (F.col("lat") > 3.0)
    out = base.select(
        "state_name", "district_name", F.col("district_name").alias("destination_name"), "lat", "lon", "total_rooms",
        rnd(demand).alias("daily_demand_peak"), *[rnd(c).alias(c) for c, _ in MASTER_SUBSYSTEMS], "binding_constraint",
        "sustainable_capacity", "continuous_pressure", "excess_demand_daily", "capacity_gap",
        rnd("poverty", 2).alias("poverty_rate"), rnd("income_mean").alias("mean_household_income"),
        rnd("income_median").alias("median_household_income"),
        rnd("recent_average_occupancy_rate_pct", 1).alias("latest_aor_pct"),
        *[rnd(a, 3).alias(a) for a in ("arch_heritage", "arch_nature", "arch_beach", "arch_food", "arch_urban")],
        "poi_tags", F.when(by_road, "KTM ETS & Rail").otherwise("Federal Road & Express Coach").alias("transit_mode"),
    )
    if authorities is None:
        return out
    return out.join(authorities.select("state_name", "district_name", "pbt_name"), ["state_name", "district_name"], "left")
