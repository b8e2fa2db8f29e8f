"""Text fragments shared by the SQL the queries are checked against."""

from __future__ import annotations

from reliefgrid.functions.capacity import SUBSYSTEMS
from reliefgrid.functions.geo import (
    MODE_EXPRESSWAY,
    MODE_FEDERAL,
    MODE_LOCAL,
    MODE_MOUNTAIN_ROAD,
    MODE_RAIL_ETS,
    MODE_RAIL_JUNGLE,
    MODE_RAIL_TRANSFER,
    RAIL_LINES,
)


def r(x: str, digits: int = 0) -> str:
    return f"(floor(({x})*{10**digits}e0+0.5e0)/{10**digits}e0)"


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    dlat, dlon = f"sin(radians({lat2}-{lat1})/2e0)", f"sin(radians({lon2}-{lon1})/2e0)"
    return (
        f"(12742e0*asin(least(1e0, sqrt({dlat}*{dlat}"
        f"+cos(radians({lat1}))*cos(radians({lat2}))*{dlon}*{dlon}))))"
    )


PLACE_FACTORS = [(3, 1), (5, 2), (7, 3), (11, 4), (17, 5), (19, 6)]
MOUNTAIN = "[37]$"
ARCH_TYPES = [
    ("arch_heritage", "ECONOMY"),
    ("arch_nature", "LARGE"),
    ("arch_beach", "MEDIUM"),
    ("arch_food", "PROMO"),
    ("arch_urban", "SMALL"),
]

_caps = ", ".join(
    f"demand*(0.75e0+((s_suppkey*{a}+{b})%23)/12e0) AS {name}" for (name, _), (a, b) in zip(SUBSYSTEMS, PLACE_FACTORS)
)
_least = "least(" + ", ".join(f"greatest({n},1e0)" for n, _ in SUBSYSTEMS) + ")"
_binding = "CASE " + " ".join(f"WHEN greatest({n},1e0)=low THEN '{t}'" for n, t in SUBSYSTEMS) + " END"

# places: one row per supplier with demand, six capacities and the diagnosis columns
PLACES = f"""
sales AS (SELECT l_suppkey, sum(l_quantity) AS demand, count(*) AS line_count FROM lineitem GROUP BY l_suppkey),
place_base AS (
  SELECT s_suppkey AS destination_id, s_name AS destination_name, n_name AS state_name, s_suppkey, s_acctbal,
         1e0+(s_suppkey*37%600)/100e0 AS lat, 100e0+(s_suppkey*53%1900)/100e0 AS lon,
         line_count*8e0 AS total_rooms, greatest(0e0,s_acctbal)/1000e0 AS poverty_rate,
         40e0+(s_suppkey*29%400)/10e0 AS latest_aor_pct, demand, {_caps}
  FROM supplier JOIN sales ON s_suppkey=l_suppkey JOIN nation ON s_nationkey=n_nationkey),
place_low AS (SELECT *, {_least} AS low FROM place_base),
places AS (
  SELECT *, demand AS daily_demand_peak, {r('low',1)} AS sustainable_capacity, {_binding} AS binding_constraint,
         {r('demand/low',3)} AS continuous_pressure, {r('demand/low*100e0',1)} AS pressure_percent,
         {r('greatest(0e0,demand-low)',1)} AS excess_demand, {r('1e0-demand/low',3)} AS capacity_gap,
         {r('(1e0-demand/low)*100e0',1)} AS capacity_gap_percent, demand>low AS is_overcapacity,
         CASE WHEN demand/low<0.70e0 THEN 'Underutilized (High Absorption Buffer)'
              WHEN demand/low<=0.85e0 THEN 'Healthy Utilization'
              WHEN demand/low<=1e0 THEN 'High Pressure (Approaching Limit)'
              ELSE 'Overcapacity (Immediate Intervention Required)' END AS management_status
  FROM place_low)"""

_arch = ", ".join(
    f"least(1e0, 2.5e0*sum(CASE WHEN p_type='{t}' THEN qty ELSE 0e0 END)/sum(qty)) AS {n}" for n, t in ARCH_TYPES
)
# profiles: archetype measures and the five best-selling brands of every place
PROFILES = f"""
mix AS (SELECT l_suppkey, p_brand, p_type, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey=p_partkey
        GROUP BY l_suppkey, p_brand, p_type),
arch AS (SELECT l_suppkey, {_arch} FROM mix GROUP BY l_suppkey),
brand AS (SELECT l_suppkey, p_brand, sum(qty) AS qty FROM mix GROUP BY l_suppkey, p_brand),
tags AS (SELECT l_suppkey, string_agg(p_brand,' | ' ORDER BY qty DESC, p_brand) AS poi_tags,
                list(lower(p_brand)) AS tag_list
         FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY qty DESC, p_brand) AS n FROM brand) b
         WHERE n<=5 GROUP BY l_suppkey)"""

_stops = ", ".join(
    f"({ordinal},'{line}',{seq},'{name}',{lat}e0,{lon}e0)"
    for ordinal, (line, seq, (name, lat, lon)) in enumerate(
        (line, seq, stop) for line, stops in RAIL_LINES.items() for seq, stop in enumerate(stops)
    )
)
# stops: the rail network; place_stop: closest station of every place within 25 km
STOPS = f"stops(ord,line,seq,stop_name,stop_lat,stop_lon) AS (VALUES {_stops})"
PLACE_STOP = f"""
place_stop AS (
  SELECT * FROM (
    SELECT destination_id, ord, line, seq, stop_name, dist_km,
           row_number() OVER (PARTITION BY destination_id ORDER BY dist_km, ord) AS n
    FROM (SELECT destination_id, stops.*, {km('lat','lon','stop_lat','stop_lon')} AS dist_km FROM places, stops) d) x
  WHERE n=1 AND dist_km<=25e0)"""


def banded(mountain: str, km_column: str, values: tuple) -> str:
    m, a, b, c, d = values
    return (
        f"CASE WHEN {mountain} THEN {m} WHEN {km_column}>120e0 THEN {a} WHEN {km_column}>60e0 THEN {b} "
        f"WHEN {km_column}>25e0 THEN {c} ELSE {d} END"
    )


CIRCUITY = (1.75, 1.32, 1.35, 1.30, 1.25)
SPEED = (38.0, 70.0, 60.0, 50.0, 45.0)
LABELS = tuple(f"'{t}'" for t in (MODE_MOUNTAIN_ROAD, MODE_EXPRESSWAY, MODE_FEDERAL, MODE_FEDERAL, MODE_LOCAL))


def _num(values: tuple) -> tuple:
    return tuple(f"{v}e0" for v in values)


def corridor_columns(mountain: str, straight: str, o_line: str, d_line: str) -> str:
    """SQL for distance_km, travel_time_mins, transit_mode and rail_viable of one pair."""
    road = f"{straight}*({banded(mountain, straight, _num(CIRCUITY))})"
    mins = f"greatest(15e0,{r(f'{road}/({banded(mountain, straight, _num(SPEED))})*60e0+8e0')})"
    viable = f"({o_line} IS NOT NULL AND {d_line} IS NOT NULL AND {straight}>=15e0)"
    rail = f"greatest(20e0,{r(f'{straight}*1.25e0/75e0*60e0+18e0+CASE WHEN {o_line}<>{d_line} THEN 30e0 ELSE 0e0 END')})"
    mode = (
        f"CASE WHEN {o_line}<>{d_line} THEN '{MODE_RAIL_TRANSFER}' WHEN {o_line}='ets' THEN '{MODE_RAIL_ETS}' "
        f"ELSE '{MODE_RAIL_JUNGLE}' END"
    )
    return f"""{r(road,1)} AS distance_km,
      CASE WHEN {viable} THEN {rail} ELSE {mins} END AS travel_time_mins,
      CASE WHEN {viable} THEN {mode} ELSE {banded(mountain, straight, LABELS)} END AS transit_mode,
      {viable} AS rail_viable"""


def clip(x: str, low: str, high: str) -> str:
    return f"greatest({low},least({high},{x}))"


_side = """destination_id AS {p}_id, destination_name AS {p}_name, lat AS {p}_lat, lon AS {p}_lon,
    capacity_gap AS {p}_gap, sustainable_capacity AS {p}_capacity, daily_demand_peak AS {p}_demand,
    CASE WHEN sustainable_capacity>0 THEN greatest(0e0,sustainable_capacity-daily_demand_peak) ELSE 0e0 END AS {p}_headroom,
    CASE WHEN sustainable_capacity>0 THEN greatest(0e0,daily_demand_peak-sustainable_capacity) ELSE 0e0 END AS {p}_need,
    poverty_rate AS {p}_poverty, cc_ecology AS {p}_eco, total_rooms AS {p}_rooms,
    arch_heritage AS {p}_a1, arch_nature AS {p}_a2, arch_beach AS {p}_a3, arch_food AS {p}_a4, arch_urban AS {p}_a5,
    poi_tags AS {p}_raw_tags, tag_list AS {p}_tags, regexp_matches(lower(destination_name),'[37]$') AS {p}_mountain,
    line AS {p}_line"""
_dot = "+".join(f"h_a{i}*c_a{i}" for i in range(1, 6))
_nh, _nc = (("sqrt(" + "+".join(f"{p}_a{i}*{p}_a{i}" for i in range(1, 6)) + ")") for p in "hc")
_cos = f"CASE WHEN {_nh}>1e-9 AND {_nc}>1e-9 THEN {clip(f'({_dot})/({_nh}*{_nc})', '0e0', '1e0')} ELSE 0e0 END"
_both = "len(list_intersect(h_tags,c_tags))*1e0"

# scored: every ordered pair of two different places with its score
SCORED = f"""
place_all AS (SELECT p.*, arch_heritage, arch_nature, arch_beach, arch_food, arch_urban, poi_tags, tag_list, line
  FROM places p JOIN arch a ON a.l_suppkey=p.destination_id JOIN tags t ON t.l_suppkey=p.destination_id
  LEFT JOIN place_stop s ON s.destination_id=p.destination_id),
h_side AS (SELECT {_side.format(p='h')} FROM place_all),
c_side AS (SELECT {_side.format(p='c')} FROM place_all),
pair AS (SELECT *, {km('h_lat','h_lon','c_lat','c_lon')} AS straight_km, {_cos} AS cos_sim,
    {_both}/(len(h_tags)+len(c_tags)-{_both}) AS jaccard_sim
  FROM h_side, c_side WHERE h_id<>c_id AND lower(trim(h_name))<>lower(trim(c_name))),
pair_way AS (SELECT *, {corridor_columns('(h_mountain OR c_mountain)', 'straight_km', 'h_line', 'c_line')} FROM pair),
pair_parts AS (SELECT *,
    {r(clip('0.6e0*cos_sim+0.4e0*jaccard_sim','0e0','1e0')+'*100e0',1)} AS match_score,
    {r('CASE WHEN rail_viable THEN least(100e0,exp(-0.0075e0*travel_time_mins)*100e0+8e0) ELSE exp(-0.0075e0*travel_time_mins)*100e0 END',1)} AS accessibility_score,
    {clip(r('c_gap*100e0',1),'0e0','100e0')} AS spare_capacity_score,
    least(100e0,{r('c_poverty*8.5e0+15e0',1)}) AS community_benefit_score,
    {r('(1e0-least(1e0,greatest(0e0,(c_eco-c_demand)/greatest(1e0,c_eco))))*100e0',1)} AS environmental_risk_penalty
  FROM pair_way),
pair_abs AS (SELECT *,
    CASE WHEN h_need>0 THEN {clip(r('c_headroom/h_need*100e0',1),'0e0','100e0')}
         WHEN c_headroom>0 THEN 100e0 ELSE spare_capacity_score END AS absolute_headroom_score,
    (c_gap>0.10e0 AND c_demand<c_eco AND distance_km<=350e0) AS is_feasible
  FROM pair_parts),
pair_blend AS (SELECT *, {r('0.5e0*spare_capacity_score+0.5e0*absolute_headroom_score',1)} AS spare_capacity_blended FROM pair_abs),
scored AS (SELECT *,
    {r('greatest(0e0,distance_km-60e0)*0.08e0',1)} AS distance_friction_penalty,
    {r('greatest(0e0,' + r(clip('match_score*0.30e0+accessibility_score*0.20e0+spare_capacity_blended*0.25e0+community_benefit_score*0.20e0-environmental_risk_penalty*0.05e0','0e0','100e0'),1) + '-greatest(0e0,distance_km-60e0)*0.08e0)',1)} AS final_wsm_score
  FROM pair_blend)"""

# best: the three best candidates of every hotspot under the pool rules
BEST = """
feasible_pool AS (SELECT * FROM (SELECT *, sum(CASE WHEN is_feasible THEN 1 ELSE 0 END) OVER (PARTITION BY h_id) AS nf FROM scored) f
                  WHERE is_feasible OR nf=0),
pool AS (SELECT * FROM (SELECT *, sum(CASE WHEN distance_km<=180e0 THEN 1 ELSE 0 END) OVER (PARTITION BY h_id) AS nr,
                               count(*) OVER (PARTITION BY h_id) AS np FROM feasible_pool) q
         WHERE distance_km<=180e0 OR nr<least(3,np)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h_id ORDER BY final_wsm_score DESC, c_id) AS candidate_rank FROM pool) b
         WHERE candidate_rank<=3)"""

MATCH = f"WITH {PLACES},{PROFILES},{STOPS},{PLACE_STOP},{SCORED},{BEST}"

# rates: occupancy-like series by state, year and period
RATES = """
quarters AS (SELECT n_name AS state, year(l_shipdate)::INTEGER AS year, 'Q'||quarter(l_shipdate) AS period, sum(l_quantity) AS qty, count(*) AS n
  FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey GROUP BY 1,2,3),
rates AS (SELECT state, year, period, qty/n*2e0 AS rate FROM quarters
  UNION ALL SELECT state, year, 'Annual', sum(qty)/sum(n)*2e0 FROM quarters GROUP BY state, year)"""

# calendar, holidays: derived from daily order counts
CALENDAR = """
days AS (SELECT o_orderdate::DATE AS day, count(*) AS n, count(*) FILTER (WHERE o_orderpriority='1-URGENT') AS urgent,
  count(*) FILTER (WHERE o_orderstatus='P') AS pending FROM orders GROUP BY 1),
months AS (SELECT strftime(day,'%Y-%m') AS month, count(*) FILTER (WHERE urgent>=3) AS cuti_sekolah_days,
  count(*) FILTER (WHERE pending>=5) AS public_holidays, count(*) FILTER (WHERE isodow(day)=6 AND n>=6) AS long_weekends,
  sum(n)::BIGINT AS n FROM days GROUP BY 1),
calendar AS (SELECT month, cuti_sekolah_days, public_holidays, long_weekends, n/(SELECT avg(n) FROM months) AS demand_multiplier,
  'Events of '||month AS event_highlights FROM months),
holidays AS (SELECT day AS holiday_date FROM days WHERE n>(SELECT avg(n) FROM days)*1.25e0)"""

FEED = """
feed AS (SELECT event_type, ts::DATE AS day, sum(value::DECIMAL(18,2))::DOUBLE AS total, count(*) AS n FROM events GROUP BY 1,2)"""
