"""Capacity diagnosis and relief matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reliefgrid.operators.match import match_all
from reliefgrid.plans.mapping import match_places, places
from reliefgrid.plans.registry import query
from reliefgrid.plans.sqltext import MATCH, PLACES

_DIAGNOSIS = (
    "destination_id, daily_demand_peak, sustainable_capacity, binding_constraint, continuous_pressure, pressure_percent, "
    "excess_demand, capacity_gap, capacity_gap_percent, is_overcapacity, management_status"
)


@query("bottleneck_diagnosis", f"WITH {PLACES} SELECT {_DIAGNOSIS} FROM places")
def bottleneck_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).select(*_DIAGNOSIS.split(", "))


_BEST = (
    "h_id, c_id, candidate_rank, final_wsm_score, match_score, accessibility_score, spare_capacity_score, "
    "absolute_headroom_score, spare_capacity_blended, community_benefit_score, environmental_risk_penalty, "
    "distance_km, travel_time_mins, transit_mode, rail_viable, distance_friction_penalty, is_feasible"
)


@query("match_top3", f"{MATCH} SELECT {_BEST.replace('candidate_rank', 'candidate_rank::INTEGER AS candidate_rank')} FROM best")
def match_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = match_places(spark, sf_dir)
    return match_all(ready, ready, top_n=3).select(*_BEST.split(", "))
