"""Congestion, display corridors, rail paths and route profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.functions.geo import corridor, haversine_km, is_mountain, nearest_station, rail_path
from reliefgrid.functions.numeric import rnd

# Bottlenecks in matching order: key, name words, delay multiplier, boost inside the window, boost outside, description.
BOTTLENECKS = [
    ("penang_bridge", ["timur laut", "george town", "seberang"], 1.45, 0.18, 0.06,
     "PLUS E36 Penang Bridge westbound/eastbound bottleneck"),
    ("genting_sempah", ["cameron", "lipis", "raub", "bentong"], 1.65, 0.25, 0.05,
     "LPT / KL-Karak Genting Sempah weekend holiday crawl"),
    ("menora_tunnel", ["kinta", "ipoh", "kuala kangsar", "taiping"], 1.50, 0.16, 0.04,
     "PLUS E1 KM260 Menora Tunnel steep gradient congestion"),
    ("skudai_toll", ["johor", "kulai", "singapore"], 1.35, 0.15, 0.04,
     "PLUS E2 southern industrial & cross-border commuter peak"),
]
OPEN_ROAD = "Federal Highway Trunk"
MAX_DELAY_FACTOR = 1.85


def congestion(
    df: DataFrame, origin: str, dest: str, minutes: str, at: str, bottlenecks: list | None = None
) -> DataFrame:
    """Delay factor, delay, class and bottleneck of every (pair, timestamp) row."""
    hour = F.hour(at) + F.minute(at) / 60.0
    day = F.weekday(at)
    morning, evening = hour.between(7.5, 9.5), hour.between(17.0, 19.5)
    friday, sunday = (day == 4) & (hour >= 16.5), (day == 6) & hour.between(15.0, 21.0)
    windows = {"penang_bridge": morning | evening | friday, "genting_sempah": day.isin(4, 5, 6),
               "menora_tunnel": evening | sunday, "skudai_toll": morning | evening}
    base = (
        F.when(morning, 1.28).when(evening, 1.34).when(friday, 1.42).when(sunday, 1.40)
        .when(hour.between(11.0, 15.0), 1.08).otherwise(1.0)
    )
    text = F.lower(F.concat_ws(" ", origin, dest))
    boost, place = F.lit(0.0), F.lit(OPEN_ROAD)
    for key, names, _, inside, outside, description in reversed(bottlenecks or BOTTLENECKS):
        hit = text.rlike("|".join(names))
        boost = F.when(hit, F.when(windows[key], inside).otherwise(outside)).otherwise(boost)
        place = F.when(hit, description).otherwise(place)
    factor = F.col("_factor")
    return (
        df.withColumn("_factor", F.least(F.lit(MAX_DELAY_FACTOR), base + boost))
        .withColumns(
            {
                "delay_factor": rnd(factor, 2),
                "delay_mins": F.greatest(F.lit(0.0), rnd(F.col(minutes) * (factor - 1.0))),
                "duration_mins": rnd(F.col(minutes) * factor),
                "traffic_status": F.when(factor >= 1.32, "Severe Gridlock")
                .when(factor >= 1.14, "Moderate Congestion")
                .otherwise("Free-Flow Traffic"),
                "bottleneck_node": place,
            }
        )
        .drop("_factor")
    )


def pair_corridors(
    pairs: DataFrame,
    o_at: tuple[str, str],
    d_at: tuple[str, str],
    o_name: str,
    d_name: str,
    mountain_pattern: str | None = None,
    stations: tuple[str, str] | None = None,
) -> DataFrame:
    """Add straight_km, distance_km, travel_time_mins, transit_mode and rail_viable to origin/destination rows.

    ``stations`` names columns that already hold the ``nearest_station`` of both ends: work them out once per place
    where places repeat over many pairs.
    """
    pattern = {} if mountain_pattern is None else {"pattern": mountain_pattern}
    o_stop, d_stop = (F.col(c) for c in stations) if stations else (nearest_station(*o_at), nearest_station(*d_at))
    return (
        pairs.withColumns({"_o": o_stop, "_d": d_stop, "straight_km": haversine_km(*o_at, *d_at)})
        .withColumn(
            "_way",
            corridor(F.col("straight_km"), is_mountain(o_name, **pattern) | is_mountain(d_name, **pattern), F.col("_o"), F.col("_d")),
        )
        .select(*pairs.columns, "straight_km", "_way.*")
    )


def display_corridor(df: DataFrame, claimed_mode: str, claimed_minutes: str) -> DataFrame:
    """Inferred mode and time replace the claimed ones; a rail claim stands only where rail is viable."""
    claim = F.lower(F.coalesce(F.col(claimed_mode), F.lit("Road"))).rlike("rail|ets|komuter|train|ktm")
    return df.withColumns(
        {
            "display_mode": F.coalesce(F.col("transit_mode"), F.col(claimed_mode)),
            "display_mins": F.coalesce(F.col("travel_time_mins"), F.col(claimed_minutes), F.lit(60.0)),
            "is_rail": F.coalesce(F.col("rail_viable"), claim),
            "claim_refuted": claim & ~F.coalesce(F.col("rail_viable"), F.lit(True)),
        }
    )


def rail_paths(pairs: DataFrame, o_at: tuple[str, str], d_at: tuple[str, str]) -> DataFrame:
    stops = pairs.withColumns({"_o": nearest_station(*o_at), "_d": nearest_station(*d_at)})
    return stops.withColumn("rail_path", rail_path(*o_at, *d_at, F.col("_o"), F.col("_d"))).drop("_o", "_d")


def route_profile(pairs: DataFrame, routes: DataFrame, keys: list[str], minutes: str, at: str, origin: str, dest: str) -> DataFrame:
    """Routed distance and time where a landed route exists, else the estimate, with congestion on top.

    ``routes`` has the key columns, ``routed_mins``, ``routed_km`` and ``route_source``.
    """
    joined = pairs.join(routes.select(*keys, "routed_mins", "routed_km", "route_source"), keys, "left")
    based = joined.withColumns(
        {
            "base_mins": F.coalesce(F.col("routed_mins"), F.col(minutes)),
            "eta_source": F.when(F.col("routed_mins").isNotNull(), "non-realtime").otherwise("estimated"),
            "eta_label": F.coalesce("route_source", F.lit("Heuristic estimate (offline fallback)")),
        }
    )
    return congestion(based, origin, dest, "base_mins", at).drop("routed_mins", "route_source")
