"""Congestion over timestamped pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.operators import traffic
from reliefgrid.plans.geo_plans import FLOWS, flow_pairs
from reliefgrid.plans.mapping import table
from reliefgrid.plans.registry import query
from reliefgrid.plans.sqltext import PLACE_STOP, PLACES, STOPS, corridor_columns, km, r

_PLACE_NAMES = ["Ipoh", "Cameron Highlands", "George Town", "Johor Bahru", "Kuantan"]


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.array(*[F.lit(n) for n in _PLACE_NAMES])
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "value", F.get(name, (F.col("event_id") % 5).cast("int")).alias("origin"), F.get(name, (F.col("user_id") % 5).cast("int")).alias("dest"),
        "user_id", "event_type",
    )


_TRIPS = f"trip AS (SELECT event_id, user_id, event_type, ts, value, ({_PLACE_NAMES!r})[event_id%5+1] AS origin, ({_PLACE_NAMES!r})[user_id%5+1] AS dest FROM events)"


def congestion_sql(source: str, minutes: str) -> str:
    morning, evening = "(h BETWEEN 7.5e0 AND 9.5e0)", "(h BETWEEN 17e0 AND 19.5e0)"
    friday, sunday = "(d=5 AND h>=16.5e0)", "(d=7 AND h BETWEEN 15e0 AND 21e0)"
    windows = {"penang_bridge": f"{morning} OR {evening} OR {friday}", "genting_sempah": "d IN (5,6,7)", "menora_tunnel": f"{evening} OR {sunday}", "skudai_toll": f"{morning} OR {evening}"}
    hits = [(f"regexp_matches(pair,'{'|'.join(names)}')", key, a, b, text) for key, names, _, a, b, text in traffic.BOTTLENECKS]
    boost = "CASE " + " ".join(f"WHEN {hit} THEN CASE WHEN {windows[key]} THEN {a}e0 ELSE {b}e0 END" for hit, key, a, b, _ in hits) + " ELSE 0e0 END"
    node = "CASE " + " ".join(f"WHEN {hit} THEN '{text}'" for hit, _, _, _, text in hits) + f" ELSE '{traffic.OPEN_ROAD}' END"
    return f"""clock AS (SELECT *, hour(ts)+minute(ts)/60e0 AS h, isodow(ts) AS d, lower(origin||' '||dest) AS pair FROM {source}),
    fac AS (SELECT *, least(1.85e0, CASE WHEN {morning} THEN 1.28e0 WHEN {evening} THEN 1.34e0 WHEN {friday} THEN 1.42e0 WHEN {sunday} THEN 1.40e0 WHEN h BETWEEN 11e0 AND 15e0 THEN 1.08e0 ELSE 1e0 END+{boost}) AS f, {node} AS node FROM clock),
    jam AS (SELECT *, {r('f',2)} AS delay_factor, greatest(0e0,{r(f'{minutes}*(f-1e0)')}) AS delay_mins, {r(f'{minutes}*f')} AS duration_mins,
      CASE WHEN f>=1.32e0 THEN 'Severe Gridlock' WHEN f>=1.14e0 THEN 'Moderate Congestion' ELSE 'Free-Flow Traffic' END AS traffic_status, node AS bottleneck_node FROM fac)"""


@query("congestion_profile", f"WITH {_TRIPS},{congestion_sql('trip', 'value')} SELECT event_id, delay_factor, delay_mins, duration_mins, traffic_status, bottleneck_node FROM jam")
def congestion_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = traffic.congestion(_trips(spark, sf_dir), "origin", "dest", "value", "ts")
    return out.select("event_id", "delay_factor", "delay_mins", "duration_mins", "traffic_status", "bottleneck_node")


@query(
    "route_profile",
    f"""WITH {_TRIPS}, routes AS (SELECT user_id, {r('avg(value)',1)} AS routed_mins FROM trip WHERE event_type='view' AND value>60 GROUP BY user_id),
    base AS (SELECT trip.*, coalesce(routed_mins, value) AS base_mins, CASE WHEN routed_mins IS NOT NULL THEN 'non-realtime' ELSE 'estimated' END AS eta_source,
      CASE WHEN routed_mins IS NOT NULL THEN 'landed route' ELSE 'Heuristic estimate (offline fallback)' END AS eta_label FROM trip LEFT JOIN routes USING (user_id)),
    {congestion_sql('base', 'base_mins')} SELECT event_id, eta_source, eta_label, delay_factor, duration_mins, traffic_status FROM jam""",
)
def route_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = _trips(spark, sf_dir)
    seen = trips.where("event_type = 'view' AND value > 60").groupBy("user_id").agg(F.avg("value").alias("m"))
    routes = seen.select(
        "user_id", (F.floor(F.col("m") * 10.0 + 0.5) / 10.0).alias("routed_mins"), F.lit(None).cast("double").alias("routed_km"), F.lit("landed route").alias("route_source")
    )
    out = traffic.route_profile(trips, routes, ["user_id"], "value", "ts", "origin", "dest")
    return out.select("event_id", "eta_source", "eta_label", "delay_factor", "duration_mins", "traffic_status")


@query(
    "display_corridors",
    f"""WITH {PLACES},{FLOWS},{STOPS},{PLACE_STOP},
    hub_stop AS (SELECT * FROM (SELECT hub_name, line AS hub_line, row_number() OVER (PARTITION BY hub_name ORDER BY d, ord) AS n, d FROM (SELECT *, {km('h_lat','h_lon','stop_lat','stop_lon')} AS d FROM hubs, stops) y) x WHERE n=1 AND d<=25e0),
    p AS (SELECT l_suppkey, hubs.hub_name, line, hub_line, {km('lat','lon','h_lat','h_lon')} AS d, CASE WHEN l_suppkey%3=0 THEN 'KTM Train' WHEN l_suppkey%3=1 THEN 'Road' END AS claimed
      FROM flows JOIN places ON l_suppkey=places.destination_id JOIN hubs USING (c_nationkey) LEFT JOIN place_stop ON place_stop.destination_id=l_suppkey LEFT JOIN hub_stop ON hub_stop.hub_name=hubs.hub_name),
    w AS (SELECT *, {corridor_columns('false','d','line','hub_line')} FROM p)
    SELECT l_suppkey, hub_name, transit_mode AS display_mode, travel_time_mins AS display_mins, rail_viable AS is_rail, (coalesce(claimed,'Road')='KTM Train' AND NOT rail_viable) AS claim_refuted FROM w""",
)
def display_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = traffic.pair_corridors(flow_pairs(spark, sf_dir), ("lat", "lon"), ("h_lat", "h_lon"), "destination_name", "hub_name", "no such place", ("o_stop", "d_stop"))
    key = F.col("l_suppkey") % 3
    claimed = way.withColumns({"claimed_mode": F.when(key == 0, "KTM Train").when(key == 1, "Road"), "claimed_mins": F.lit(55.0)})
    out = traffic.display_corridor(claimed, "claimed_mode", "claimed_mins")
    return out.select("l_suppkey", "hub_name", "display_mode", "display_mins", "is_rail", "claim_refuted")
