"""Attribution, scenarios and dispatch over the shortlist of every hotspot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.functions.capacity import pressure_band
from reliefgrid.functions.numeric import rnd
from reliefgrid.operators import explain, ranking
from reliefgrid.operators.match import match_all
from reliefgrid.operators.capacity import capacity_stages
from reliefgrid.plans.mapping import match_places, places, table
from reliefgrid.plans.registry import query
from reliefgrid.plans.sqltext import MATCH, PLACES, clip, r
from reliefgrid.session import cut_lineage


def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = match_places(spark, sf_dir)
    return match_all(ready, ready, top_n=3)


_POINTS = f"""pts AS (SELECT *, {r('match_score*0.30e0',1)} AS p1, {r('accessibility_score*0.20e0',1)} AS p2, {r('spare_capacity_blended*0.25e0',1)} AS p3,
    {r('community_benefit_score*0.20e0',1)} AS p4, -{r('environmental_risk_penalty*0.05e0',1)} AS p5, -{r('greatest(0e0,distance_km-60e0)*0.08e0',1)} AS p6 FROM best),
res AS (SELECT *, {r('final_wsm_score-' + r('p1+p2+p3+p4+p5+p6',1),1)} AS residual, greatest(p1,p2,p3,p4) AS top FROM pts),
main AS (SELECT *, CASE WHEN p1=top THEN 1 WHEN p2=top THEN 2 WHEN p3=top THEN 3 ELSE 4 END AS k FROM res),
parts AS (SELECT *, CASE WHEN k=1 THEN {r('p1+residual',1)} ELSE p1 END AS q1, CASE WHEN k=2 THEN {r('p2+residual',1)} ELSE p2 END AS q2,
    CASE WHEN k=3 THEN {r('p3+residual',1)} ELSE p3 END AS q3, CASE WHEN k=4 THEN {r('p4+residual',1)} ELSE p4 END AS q4 FROM main)"""


@query(
    "attribution_long",
    f"""{MATCH},{_POINTS} SELECT h_id, c_id, ord, feature, category, points FROM (
    SELECT h_id, c_id, 1 AS ord, '1. Archetype Affinity' AS feature, 'Positive Driver' AS category, q1 AS points FROM parts
    UNION ALL SELECT h_id, c_id, 2, '2. Transit Accessibility', 'Positive Driver', q2 FROM parts
    UNION ALL SELECT h_id, c_id, 3, '3. Spare Capacity', 'Positive Driver', q3 FROM parts
    UNION ALL SELECT h_id, c_id, 4, '4. B40 Community Benefit', 'Positive Driver', q4 FROM parts
    UNION ALL SELECT h_id, c_id, 5, '5. Ecological Risk Penalty', 'Risk Guardrail', p5 FROM parts
    UNION ALL SELECT h_id, c_id, 6, '6. Distance Friction', 'Risk Guardrail', p6 FROM parts) u""",
)
def attribution_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.attribution_long(shortlist(spark, sf_dir))


@query(
    "dominant_driver",
    f"""{MATCH},{_POINTS}, t AS (SELECT *, greatest(q1,q2,q3,q4) AS best_q FROM parts)
    SELECT h_id, c_id, CASE WHEN q1=best_q THEN '1. Archetype Affinity' WHEN q2=best_q THEN '2. Transit Accessibility' WHEN q3=best_q THEN '3. Spare Capacity' ELSE '4. B40 Community Benefit' END AS dominant_driver,
      best_q AS driver_points, CASE WHEN p5<=p6 THEN '5. Ecological Risk Penalty' ELSE '6. Distance Friction' END AS dominant_constraint, abs(least(p5,p6)) AS constraint_penalty,
      CASE WHEN p3>p4 THEN 'Spare Lodging Headroom' ELSE 'B40 Grassroots Uplift' END AS primary_driver FROM t""",
)
def dominant_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.dominant_parts(shortlist(spark, sf_dir))


@query(
    "shortlist_margins",
    f"""{MATCH} SELECT h_id, c_id, candidate_rank::INTEGER AS candidate_rank, count(*) OVER (PARTITION BY h_id) AS list_size,
      coalesce(CASE WHEN candidate_rank=1 THEN {r('final_wsm_score-lead(final_wsm_score) OVER (PARTITION BY h_id ORDER BY candidate_rank)',1)}
        ELSE {r('final_wsm_score-first_value(final_wsm_score) OVER (PARTITION BY h_id ORDER BY candidate_rank)',1)} END, 0e0) AS score_margin FROM best""",
)
def shortlist_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.list_margins(shortlist(spark, sf_dir)).select("h_id", "c_id", "candidate_rank", "list_size", "score_margin")


_TAGS = "list_sort(list_intersect(h_tags,c_tags))"


def _title(tags: str) -> str:
    return f"array_to_string(list_transform(({tags})[1:3], lambda t: upper(t[1])||t[2:]), ', ')"


_LABELS = ["Heritage & Culture", "Eco-Nature & Highlands", "Coastal & Marine", "Gastronomy & Agri-Tourism", "Urban & Integrated Leisure"]
_SHARED = "concat_ws(', ', " + ", ".join(f"CASE WHEN h_a{i+1}>=0.5e0 AND c_a{i+1}>=0.5e0 THEN '{t}' END" for i, t in enumerate(_LABELS)) + ")"
_TOP_PRODUCT = "greatest(" + ", ".join(f"h_a{i}*c_a{i}" for i in range(1, 6)) + ")"
_STRONGEST = "CASE " + " ".join(f"WHEN h_a{i+1}*c_a{i+1}={_TOP_PRODUCT} THEN '{t}'" for i, t in enumerate(_LABELS)) + " END"


@query(
    "explanations",
    f"""{MATCH} SELECT h_id, c_id, array_to_string({_TAGS}, ', ') AS shared_tags,
      printf('High compatibility (%.1f%% synergy across shared ', match_score) || CASE WHEN {_SHARED}<>'' THEN {_SHARED} ELSE {_STRONGEST} END || ').' ||
      CASE WHEN len({_TAGS})>0 THEN ' Features shared attraction themes ('||{_title(_TAGS)}||').' ELSE ' Features verified attractions including '||{_title('list_sort(c_tags)')}||'.' END ||
      ' Situated '||{r('distance_km')}::BIGINT||' km (~'||travel_time_mins::BIGINT||' mins) via '||transit_mode||'.' ||
      printf(' Operates with %.1f%% spare capacity headroom (', spare_capacity_score) ||
      CASE WHEN c_capacity>0 THEN '+'||format('{{:,}}', trunc(c_headroom)::BIGINT)||' pax/day buffer safely below ecological limit of '||format('{{:,}}', {r('c_eco')}::BIGINT) ELSE 'safe from bottleneck breach' END ||
      printf('; blended spare-capacity pillar %.1f incl. absolute %.1f), targeting %.1f%% district B40 community uplift.', spare_capacity_blended, absolute_headroom_score, {r('c_poverty',1)}) AS explanation FROM best""",
)
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.explanation(shortlist(spark, sf_dir)).select("h_id", "c_id", "shared_tags", "explanation")


_ABSORB = """factor AS (SELECT *, greatest(0.4e0,least(1e0,c_rooms/5000e0)) AS f FROM src),
eff AS (SELECT *, greatest(0e0,capacity_pct)*f AS e FROM factor),
gap AS (SELECT *, greatest(0e0,least(1e0,c_gap+e/100e0*(1e0-greatest(0e0,c_gap)))) AS g FROM eff),
room AS (SELECT *, g*greatest(0e0,c_capacity) AS rm, CASE WHEN c_eco>0 THEN greatest(0e0,c_eco-greatest(0e0,c_demand)) ELSE g*greatest(0e0,c_capacity) END AS er FROM gap),
""" + f"""absorbed AS (SELECT *, {r('c_gap',4)} AS original_gap, {r('g',4)} AS simulated_gap, {r('e',2)} AS effective_capacity_pct, {r('f',3)} AS room_factor,
   {r('rm',1)} AS sim_headroom_pax, {r('er',1)} AS eco_headroom_pax, {r('greatest(0e0,least(rm,er))',1)} AS max_absorbable_pax,
   CASE WHEN rm<=er THEN 'Sustainable capacity' ELSE 'Ecological / KSAS cap' END AS absorption_binding FROM room)"""
_ABSORB_OUT = "original_gap, simulated_gap, effective_capacity_pct, room_factor, sim_headroom_pax, eco_headroom_pax, max_absorbable_pax, absorption_binding"


@query("safe_absorption", f"{MATCH}, src AS (SELECT *, 20e0 AS capacity_pct FROM best),{_ABSORB} SELECT h_id, c_id, {_ABSORB_OUT} FROM absorbed")
def safe_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = explain.safe_absorption(shortlist(spark, sf_dir), expansion=F.lit(20.0))
    return out.select("h_id", "c_id", *_ABSORB_OUT.split(", "))


SCENARIOS = [("base", 0.0, 0.0, 1.0, 0.0), ("rail", 30.0, 0.0, 0.8, 500.0), ("rooms", 0.0, 25.0, 1.0, 2000.0), ("both", 45.0, 40.0, 1.2, 8000.0)]
_SCENARIO_VALUES = ", ".join(f"('{n}',{a}e0,{b}e0,{c}e0,{d}e0)" for n, a, b, c, d in SCENARIOS)
_HEAD = f"CASE WHEN h_need>0 THEN {clip('c_headroom/h_need*100e0','0e0','100e0')} ELSE 100e0 END"


def _pillars(gap: str, mins: str) -> str:
    spare = r(f"0.5e0*{clip(r(f'{gap}*100e0',1),'0e0','100e0')}+0.5e0*({_HEAD})", 1)
    access = r(f"CASE WHEN rail_viable THEN least(100e0,exp(-0.0075e0*{mins})*100e0+8e0) ELSE exp(-0.0075e0*{mins})*100e0 END", 1)
    total = (
        f"{r('match_score*0.30e0',1)}+{r(access+'*0.20e0',1)}+{r(spare+'*0.25e0',1)}+{r('community_benefit_score*0.20e0',1)}"
        f"-{r('environmental_risk_penalty*0.05e0',1)}-{r('greatest(0e0,distance_km-60e0)*0.08e0',1)}"
    )
    return r(clip(total, "0e0", "100e0"), 1)


_SIM_OUT = (
    "h_id, c_id, scenario, baseline_score, simulated_score, delta_score, is_feasible, overflow, diversion_verdict, post_headroom_pax, "
    "max_absorbable_pax, absorption_coverage_pct, time_difficulty, effective_time_reduction_mins, simulated_gap, policy_impact"
)


def _whatif(values: str) -> str:
    return f"""{MATCH}, sc(scenario,time_cut,capacity_pct,compliance,diverted) AS (VALUES {values}), src AS (SELECT * FROM best, sc),{_ABSORB},
    d AS (SELECT *, (1e0+greatest(0e0,distance_km)/100e0)*CASE WHEN rail_viable THEN 1e0 ELSE 1.4e0 END AS diff FROM absorbed),
    t AS (SELECT *, time_cut/diff AS cut, greatest(15e0,travel_time_mins-time_cut/diff) AS new_time FROM d),
    s AS (SELECT *, {_pillars('original_gap','travel_time_mins')} AS baseline_score, {_pillars('simulated_gap','new_time')} AS raw FROM t),
    u AS (SELECT *, {r('(raw-baseline_score)*compliance',2)} AS delta_score, c_demand<c_eco AS base_ok, c_demand+diverted<c_eco AS post_ok, sim_headroom_pax-diverted AS after_pax FROM s),
    w AS (SELECT *, (after_pax<0 OR NOT post_ok) AS overflow FROM u)
    SELECT h_id, c_id, scenario, baseline_score, {r(clip('baseline_score+delta_score','0e0','100e0'),1)} AS simulated_score, delta_score,
      (simulated_gap>0.10e0 AND distance_km<=350e0 AND base_ok) AS is_feasible, overflow, CASE WHEN overflow THEN 'Overflow risk' ELSE 'Absorbs diversion' END AS diversion_verdict,
      {r('after_pax',1)} AS post_headroom_pax, max_absorbable_pax, CASE WHEN diverted>0 THEN {r('max_absorbable_pax/diverted*100e0',1)} ELSE 100e0 END AS absorption_coverage_pct,
      {r('diff',3)} AS time_difficulty, {r('cut',2)} AS effective_time_reduction_mins, simulated_gap, CASE WHEN delta_score>=5 THEN 'High Priority' ELSE 'Incremental' END AS policy_impact FROM w"""


@query("whatif_scenarios", _whatif(_SCENARIO_VALUES))
def whatif_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = explain.simulate(explain.scenarios(shortlist(spark, sf_dir), SCENARIOS))
    return out.select(*_SIM_OUT.split(", "))


@query("policy_shortcut", _whatif("('policy',30e0,25e0,1e0,2000e0)"))
def policy_shortcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = explain.simulate_policy(shortlist(spark, sf_dir), time_cut=30.0, capacity_pct=25.0, diverted=2000.0)
    return out.select(*_SIM_OUT.split(", "))


@query(
    "dispatch",
    f"""{MATCH}, src AS (SELECT *, 20e0 AS capacity_pct FROM best WHERE candidate_rank=1),{_ABSORB},
    m AS (SELECT *, greatest(500e0,floor(max_absorbable_pax/1.15e0)) AS most FROM absorbed),
    q AS (SELECT *, floor(greatest(500e0,least(most,CASE WHEN h_need>0 THEN h_need ELSE most END))) AS quota FROM m),
    e AS (SELECT *, quota*1.15e0 AS effective_diverted, least(quota*1.15e0,max_absorbable_pax) AS dispatched FROM q)
    SELECT h_id, c_id, quota, {r('effective_diverted',4)} AS effective_diverted, {r('dispatched',4)} AS dispatched, {r('greatest(0e0,effective_diverted-dispatched)',4)} AS over_safe_pax,
      CASE WHEN h_need>0 THEN {r('dispatched/h_need*100e0',4)} ELSE 100e0 END AS relief_pct, {r('greatest(0e0,h_need-dispatched)',4)} AS unrelieved_pax FROM e""",
)
def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = shortlist(spark, sf_dir).where("candidate_rank = 1")
    out = explain.dispatch(explain.safe_absorption(first, expansion=F.lit(20.0)))
    rounded = ["effective_diverted", "dispatched", "over_safe_pax", "relief_pct", "unrelieved_pax"]
    return out.select("h_id", "c_id", "quota", *[rnd(c, 4).alias(c) for c in rounded])


@query(
    "vacancy_cushion",
    f"""{MATCH} SELECT h_id, c_id, {r('100e0-h.latest_aor_pct',4)} AS hotspot_vacancy, {r('100e0-c.latest_aor_pct',4)} AS relief_vacancy, {r('(100e0-c.latest_aor_pct)-(100e0-h.latest_aor_pct)',4)} AS vacancy_cushion
    FROM best JOIN places h ON h.destination_id=h_id JOIN places c ON c.destination_id=c_id WHERE candidate_rank=1""",
)
def vacancy_cushion(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = shortlist(spark, sf_dir).where("candidate_rank = 1").select("h_id", "c_id")
    rates = cut_lineage(places(spark, sf_dir).select("destination_id", "latest_aor_pct"))
    joined = first.join(rates.toDF("h_id", "h_aor"), "h_id").join(rates.toDF("c_id", "c_aor"), "c_id")
    out = explain.vacancy_cushion(joined)
    return out.select("h_id", "c_id", *[rnd(c, 4).alias(c) for c in ("hotspot_vacancy", "relief_vacancy", "vacancy_cushion")])


@query(
    "capacity_stages",
    f"""WITH f AS (SELECT p_partkey, p_size*40e0 AS area, 1e0+p_partkey%7 AS space, 6e0+p_partkey%6 AS open_h, p_partkey%5*1e0 AS stay, (p_partkey%11)/10e0 AS f1, (p_partkey%13)/20e0-0.1e0 AS f2, p_retailprice/1500e0 AS mc FROM part),
    p AS (SELECT *, CASE WHEN stay>0 THEN area/space*(open_h/stay) ELSE 0e0 END AS pcc FROM f),
    q AS (SELECT *, pcc*(1e0-greatest(0e0,least(1e0,f1)))*(1e0-greatest(0e0,least(1e0,f2))) AS rcc FROM p)
    SELECT p_partkey, {r('pcc',6)} AS physical_capacity, {r('rcc',6)} AS real_capacity, {r('rcc*greatest(0e0,least(1e0,mc))',6)} AS effective_capacity FROM q""",
)
def staged_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    sites = table(spark, sf_dir, "part").select(
        key, (F.col("p_size") * 40.0).alias("area_m2"), (key % 7 + 1.0).alias("space_m2"), (key % 6 + 6.0).alias("open_hours"),
        (key % 5 * 1.0).alias("stay_hours"), (F.col("p_retailprice") / 1500.0).alias("management_ratio"),
        F.create_map(F.lit("slope"), (key % 11) / 10.0, F.lit("season"), (key % 13) / 20.0 - 0.1).alias("factors"),
    )
    names = ["physical_capacity", "real_capacity", "effective_capacity"]
    return capacity_stages(sites).select("p_partkey", *[rnd(c, 6).alias(c) for c in names])


@query(
    "pressure_bands",
    f"""WITH {PLACES} SELECT state_name, CASE WHEN continuous_pressure>=1e0 THEN 'acute' WHEN continuous_pressure>=0.8e0 THEN 'stressed' ELSE 'normal' END AS band,
    count(*) AS place_count, count(*) FILTER (WHERE daily_demand_peak>cc_ecology) AS eco_critical FROM places GROUP BY 1,2""",
)
def pressure_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    banded = places(spark, sf_dir).withColumn("band", pressure_band(F.col("continuous_pressure")))
    return banded.groupBy("state_name", "band").agg(
        F.count(F.lit(1)).alias("place_count"), F.count(F.when(F.col("daily_demand_peak") > F.col("cc_ecology"), 1)).alias("eco_critical")
    )
