"""Calendar, lags, seasonality and forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.functions.calendar import month_start, month_label, month_year_label
from reliefgrid.functions.numeric import rnd
from reliefgrid.operators import explain, forecast, panel
from reliefgrid.operators.rollup import DEFAULT_OCCUPANCY, seasonal_index
from reliefgrid.plans.mapping import calendar, full_places, holidays, hotel_rates, places
from reliefgrid.plans.registry import query
from reliefgrid.plans.sqltext import CALENDAR, PLACES, PROFILES, RATES, r
from reliefgrid.session import cut_lineage

YEAR = 2001
RATE = "average_occupancy_rate_pct"


@query(
    "calendar_features",
    f"""WITH {CALENDAR}, m AS (SELECT *, month[6:7]::INTEGER AS month_no FROM calendar)
    SELECT month, 'Q'||((month_no-1)//3+1) AS quarter, CASE WHEN cuti_sekolah_days>=9 THEN 1e0 ELSE 0e0 END AS is_school_peak,
      CASE WHEN long_weekends>=2 THEN 1e0 ELSE 0e0 END AS is_long_weekend, {r('sin(month_no*(2e0*pi()/12e0))',9)} AS month_sin, {r('cos(month_no*(2e0*pi()/12e0))',9)} AS month_cos,
      strftime((month||'-01')::DATE,'%b') AS month_label, strftime((month||'-01')::DATE,'%b %Y') AS month_name FROM m""",
)
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = calendar(spark, sf_dir).withColumn("month_no", F.substring("month", 6, 2).cast("int"))
    out = panel.calendar_encodings(months)
    day = month_start("month")
    return out.select(
        "month", "quarter", "is_school_peak", "is_long_weekend", rnd("month_sin", 9).alias("month_sin"), rnd("month_cos", 9).alias("month_cos"),
        month_label(day).alias("month_label"), month_year_label(day).alias("month_name"),
    )


@query("upcoming_events", f"""WITH {CALENDAR} SELECT month, event_highlights, 'Q'||((month[6:7]::INTEGER-1)//3+1) AS quarter,
    month||' — '||event_highlights||' (Q'||((month[6:7]::INTEGER-1)//3+1)||')' AS label, cuti_sekolah_days FROM calendar""")
def upcoming_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.events_listing(calendar(spark, sf_dir)).select("month", "event_highlights", "quarter", "label", "cuti_sekolah_days")


_PROXIMITY = """mid AS (SELECT month, (month||'-01')::DATE+14 AS m FROM calendar),
prox AS (SELECT month, coalesce(min(holiday_date-m) FILTER (WHERE holiday_date>=m), 365) AS days_to_next,
    (count(*) FILTER (WHERE abs(holiday_date-m)<=15))*1e0 AS near_count FROM mid LEFT JOIN holidays ON true GROUP BY month)"""


@query(
    "holiday_proximity",
    f"""WITH {CALENDAR},{_PROXIMITY} SELECT month, days_to_next::INTEGER AS days_to_next, 1e0/(1e0+days_to_next) AS min_inv, {r('exp(-days_to_next/30e0)',9)} AS min_exp, near_count FROM prox""",
)
def holiday_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = panel.holiday_proximity(calendar(spark, sf_dir).select("month"), holidays(spark, sf_dir))
    return out.withColumn("min_exp", rnd("min_exp", 9))


_PANEL = f"""rate1 AS (SELECT lower(state) AS state_key, year, period, rate FROM rates),
panel AS (SELECT s.state_key, month, coalesce(q.rate, a.rate, s.m, (SELECT coalesce(avg(rate),47.5e0) FROM rate1)) AS aor
  FROM (SELECT state_key, avg(rate) AS m FROM rate1 GROUP BY 1) s CROSS JOIN calendar c
  LEFT JOIN rate1 q ON q.state_key=s.state_key AND q.year=c.month[1:4]::INTEGER AND q.period='Q'||((c.month[6:7]::INTEGER-1)//3+1)
  LEFT JOIN rate1 a ON a.state_key=s.state_key AND a.year=c.month[1:4]::INTEGER AND a.period='Annual')"""


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.occupancy_panel(hotel_rates(spark, sf_dir), calendar(spark, sf_dir))


@query("occupancy_panel", f"WITH {RATES},{CALENDAR},{_PANEL} SELECT state_key, month, {r('aor',6)} AS aor FROM panel")
def occupancy_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir).select("state_key", F.date_format("month_start", "yyyy-MM").alias("month"), rnd("aor", 6).alias("aor"))


def _lag_sql(k: int) -> str:
    return f"coalesce(max(aor) FILTER (WHERE month=strftime((m.mon||'-01')::DATE - INTERVAL {k} MONTH,'%Y-%m')), 47.5e0)"


_LAGS = f"""lags AS (SELECT m.state, m.mon, {_lag_sql(1)} AS aor_t1, ({_lag_sql(1)}+{_lag_sql(2)}+{_lag_sql(3)})/3e0 AS aor_ma3
  FROM (SELECT DISTINCT state, month AS mon FROM rates, calendar) m LEFT JOIN panel ON state_key=lower(m.state) GROUP BY 1,2)"""


@query("lag_features", f"WITH {RATES},{CALENDAR},{_PANEL},{_LAGS} SELECT state AS state_name, mon AS month, {r('aor_t1',6)} AS aor_t1, {r('aor_ma3',6)} AS aor_ma3 FROM lags")
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = calendar(spark, sf_dir).select("month")
    rows = hotel_rates(spark, sf_dir).select(F.col("state").alias("state_name")).distinct()
    listed = months.agg(F.collect_list("month")).scalar()  # a list of months
    rows = rows.withColumn("month", F.explode(listed))
    out = panel.lag_features(rows, _panel(spark, sf_dir), F.lit(DEFAULT_OCCUPANCY))
    return out.select("state_name", "month", rnd("aor_t1", 6).alias("aor_t1"), rnd("aor_ma3", 6).alias("aor_ma3"))


# place rules over supplier names, to exercise the same rule table shape
_LAST = forecast.NAME_ENDS[1]
RULES = [([f"7{_LAST}"], [([1, 2, 12], 1.16), ([9, 10], 0.86)]), ([f"3{_LAST}", f"7{_LAST}"], [([2], 1.18), ([12], 1.15)]), ([f"0{_LAST}"], [([6], 1.38)])]
_CURVES = ", ".join(f"('{n}',{i + 1},{v}e0)" for n, values in forecast.BASIS_CURVES.items() for i, v in enumerate(values))
_RULE_SQL = """CASE WHEN regexp_matches(lower(destination_name),'7$') THEN CASE WHEN month_no IN (1,2,12) THEN 1.16e0 WHEN month_no IN (9,10) THEN 0.86e0 ELSE 1e0 END
  WHEN regexp_matches(lower(destination_name),'[37]$') THEN CASE WHEN month_no=2 THEN 1.18e0 WHEN month_no=12 THEN 1.15e0 ELSE 1e0 END
  WHEN regexp_matches(lower(destination_name),'0$') THEN CASE WHEN month_no=6 THEN 1.38e0 ELSE 1e0 END ELSE 1e0 END"""
_TOTAL = "greatest(0.01e0, arch_nature+arch_urban+arch_heritage+arch_food+arch_beach)"


def _curve_sql(name: str) -> str:
    return f"(SELECT v FROM curve WHERE name='{name}' AND m=month_no)"


_ELASTIC = f"""curve(name,m,v) AS (VALUES {_CURVES}),
qmean AS (SELECT state, period, avg(rate) AS m FROM rates WHERE period<>'Annual' GROUP BY 1,2),
season AS (SELECT state, period, m/avg(m) OVER (PARTITION BY state) AS s FROM qmean),
spot AS (SELECT p.*, a.* EXCLUDE (l_suppkey), month_no, '{YEAR}-'||lpad(month_no::VARCHAR,2,'0') AS month FROM places p JOIN arch a ON a.l_suppkey=p.destination_id, (SELECT unnest(range(1,13))::INTEGER AS month_no) mm),
timed AS (SELECT spot.*, coalesce(cuti_sekolah_days,8)*1e0 AS cuti, coalesce(public_holidays,2)*1e0 AS hols, coalesce(long_weekends,1)*1e0 AS wknd, coalesce(event_highlights,'Month '||lpad(month_no::VARCHAR,2,'0')||' Period') AS event_title
  FROM spot LEFT JOIN calendar c ON c.month=spot.month),
elastic AS (SELECT timed.*, ((arch_nature*{_curve_sql('arch_nature')}+arch_urban*{_curve_sql('arch_urban')}+arch_heritage*{_curve_sql('arch_heritage')}+arch_food*{_curve_sql('arch_food')}
   +arch_beach*CASE WHEN lon>109e0 THEN {_curve_sql('arch_beach_east')} ELSE {_curve_sql('arch_beach_west')} END)/{_TOTAL})
   *(0.82e0+0.18e0*coalesce(s,1e0))*(1e0+0.10e0*(cuti/15e0)+0.08e0*(hols/3e0))*{_RULE_SQL} AS mult
  FROM timed LEFT JOIN season ON season.state=timed.state_name AND season.period='Q'||((month_no-1)//3+1))"""


def _place_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place x month rows with calendar days, state index and elasticity."""
    index = seasonal_index(hotel_rates(spark, sf_dir), value=RATE).select(F.col("state").alias("state_name"), F.col("period").alias("quarter"), "season_index")
    months = forecast.place_months(full_places(spark, sf_dir), YEAR)
    timed = panel.calendar_encodings(panel.with_calendar(months, calendar(spark, sf_dir)))
    joined = timed.join(index, ["state_name", "quarter"], "left")
    return forecast.elasticity(joined, rules=forecast.rule_table(spark, RULES), east_coast=F.col("lon") > 109.0)


@query(
    "month_elasticity",
    f"WITH {PLACES},{PROFILES},{RATES},{CALENDAR},{_ELASTIC} SELECT destination_id, month_no, event_title, {r('mult',6)} AS demand_multiplier FROM elastic",
)
def month_elasticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _place_months(spark, sf_dir)
    return out.select("destination_id", "month_no", "event_title", rnd("demand_multiplier", 6).alias("demand_multiplier"))


# places under the names that the fixed rules know, and under others; states likewise
_NAMED = ["Gombak", "Langkawi", "Kinta", "Cameron Highlands", "Melaka Tengah", "Timur Laut", "Miri", "Limbang", "Johor Bahru", "Mersing",
          "Samarahan", "Kampar", "Kubang Pasu", "Muallim", "Hulu Langat", "Mukah", "Sri Aman", "Kuching", "Miri Kampar", "Tuaran"]
_STATES = ["Sabah", "Sarawak", "Pahang", "Johor", "Kelantan", "Terengganu", "Kedah"]


def _place_rule_sql() -> str:
    out = "1e0"
    for words, seasons in reversed(forecast.PLACE_RULES):
        months = " ".join(f"WHEN month_no IN ({','.join(map(str, m))}) THEN {v}e0" for m, v in seasons)
        hit = " OR ".join(f"contains(lower(place),'{w}')" for w in words)
        out = f"CASE WHEN {hit} THEN CASE {months} ELSE 1e0 END ELSE {out} END"
    return out


@query(
    "fixed_elasticity",
    f"""WITH {PLACES},{PROFILES},{RATES},{CALENDAR},{_ELASTIC}, named AS (SELECT *, [{','.join(f"'{x}'" for x in _NAMED)}][(destination_id%{len(_NAMED)}+1)::INTEGER]||' '||destination_name AS place,
      [{','.join(f"'{x}'" for x in _STATES)}][((destination_id//3)%{len(_STATES)}+1)::INTEGER] AS st, lon-5e0 AS elon FROM elastic),
    m AS (SELECT *, ((arch_nature*{_curve_sql('arch_nature')}+arch_urban*{_curve_sql('arch_urban')}+arch_heritage*{_curve_sql('arch_heritage')}+arch_food*{_curve_sql('arch_food')}
      +arch_beach*CASE WHEN st IN ('Kelantan','Terengganu') OR (st IN ('Pahang','Johor') AND elon>102.8e0) THEN {_curve_sql('arch_beach_east')} ELSE {_curve_sql('arch_beach_west')} END)/{_TOTAL})
      *(1e0+0.10e0*(cuti/15e0)+0.08e0*(hols/3e0))*{_place_rule_sql()}
      *CASE WHEN st='Sabah' AND month_no=5 THEN 1e0+0.30e0*(0.5e0+0.5e0*arch_heritage) ELSE 1e0 END
      *CASE WHEN st='Sarawak' AND month_no=6 AND NOT contains(lower(place),'samarahan') THEN 1.20e0 ELSE 1e0 END
      *CASE WHEN st='Sarawak' AND month_no=4 AND contains(lower(place),'mukah') THEN 1.35e0 ELSE 1e0 END
      *CASE WHEN st='Sarawak' AND month_no IN (9,10) AND contains(lower(place),'sri aman') THEN 1.28e0 ELSE 1e0 END AS mult2 FROM named)
    SELECT destination_id, place AS destination_name, st AS state_name, month_no, {r('mult2',6)} AS demand_multiplier FROM m""",
)
def fixed_elasticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed place, state and coast rules over all places, which take turns at the names and states that the rules know."""
    key = F.col("destination_id")
    named = full_places(spark, sf_dir).withColumns({
        "destination_name": F.concat(F.get(F.lit(_NAMED), (key % len(_NAMED)).cast("int")), F.lit(" "), F.col("destination_name")),
        "state_name": F.get(F.lit(_STATES), (F.floor(key / 3) % len(_STATES)).cast("int")), "lon": F.col("lon") - 5.0,
    })
    months = panel.calendar_encodings(panel.with_calendar(forecast.place_months(named, YEAR), calendar(spark, sf_dir)))
    out = forecast.elasticity(months.withColumn("season_index", F.lit(None).cast("double")))
    return out.select("destination_id", "destination_name", "state_name", "month_no", rnd("demand_multiplier", 6).alias("demand_multiplier"))


@query(
    "calendar_fallback",
    f"""WITH {CALENDAR}, want AS (SELECT '20'||y||'-'||lpad(m::VARCHAR,2,'0') AS month FROM (SELECT unnest(range(1,13)) AS m) a, (SELECT unnest(['01','05']) AS y) b),
    same AS (SELECT month[6:7] AS mm, arg_min(cuti_sekolah_days, month) AS c, arg_min(public_holidays, month) AS p, arg_min(long_weekends, month) AS l FROM calendar GROUP BY 1)
    SELECT w.month, coalesce(cuti_sekolah_days, c, 5)*1e0 AS cuti_sekolah_days, coalesce(public_holidays, p, 2)*1e0 AS public_holidays, coalesce(long_weekends, l, 1)*1e0 AS long_weekends,
      coalesce(event_highlights, 'Month '||w.month[6:7]||' Period') AS event_title FROM want w LEFT JOIN calendar c USING (month) LEFT JOIN same ON mm=w.month[6:7]""",
)
def calendar_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = calendar(spark, sf_dir)
    # the twelve months of the last listed year and of a year without rows
    month = F.explode(F.sequence(F.lit(1), F.lit(12)))
    want = cal.agg(F.count(F.lit(1)).alias("_n")).select(F.explode(F.array(F.lit("2001"), F.lit("2005"))).alias("y")).select("y", month.alias("m"))
    want = want.select(F.concat("y", F.lit("-"), F.lpad(F.col("m").cast("string"), 2, "0")).alias("month"))
    return panel.with_calendar(want, cal, any_year=True)


_SCORE = f"""feat AS (SELECT e.*, daily_demand_peak*mult AS volume0, least(0.99e0, continuous_pressure/3e0) AS prob0 FROM elastic e),
vol AS (SELECT *, {r("greatest(500e0, volume0*CASE WHEN regexp_matches(lower(destination_name),'5$') THEN 1.10e0 ELSE 1e0 END)")} AS v FROM feat),
risk AS (SELECT *, {r('v/greatest(1e0,sustainable_capacity)*100e0',1)} AS stress, greatest(0e0,v-sustainable_capacity) AS excess FROM vol)"""
_RISK_LABEL = "CASE WHEN {0}>=130 THEN '🔴 CRITICAL SPIKE (>130% Cap)' WHEN {0}>=100 THEN '🟡 ELEVATED RUSH (100–130% Cap)' ELSE '🟢 NORMAL FLOW (<100% Cap)' END"
_PROB = r("(CASE WHEN stress>=130 THEN least(0.99e0,greatest(prob0,0.94e0)) WHEN stress>=105 THEN least(0.95e0,greatest(prob0,0.78e0)) WHEN stress<90 THEN least(prob0,0.20e0) ELSE prob0 END)*100e0", 1)


def _fixed_model_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk columns from a fixed linear model, so that SQL can follow them."""
    rows = forecast.feature_table(_place_months(spark, sf_dir))
    scored = rows.withColumns(
        {"volume": F.col("daily_demand_peak") * F.col("demand_multiplier"), "spike_raw_prob": F.least(F.lit(0.99), F.col("continuous_pressure") / 3.0)}
    )
    return forecast.spike_risk(scored, fragile_words=["5$"])


@query(
    "spike_risk",
    f"""WITH {PLACES},{PROFILES},{RATES},{CALENDAR},{_ELASTIC},{_SCORE} SELECT destination_id, month, v AS predicted_peak_volume, stress AS capacity_stress_pct, {_PROB} AS spike_probability_pct,
      {_RISK_LABEL.format('stress')} AS risk_level, (CASE WHEN stress>=130 THEN 14 WHEN stress>=100 THEN 7 ELSE 3 END)::INTEGER AS early_warning_lead_days, {r('excess',1)} AS excess_surge_volume,
      CASE WHEN excess>0 THEN {r('excess*0.65e0')} ELSE 0e0 END AS recommended_diversion_quota FROM risk""",
)
def spike_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _fixed_model_risk(spark, sf_dir)
    return out.select(
        "destination_id", "month", "predicted_peak_volume", "capacity_stress_pct", "spike_probability_pct", "risk_level",
        "early_warning_lead_days", rnd("excess_surge_volume", 1).alias("excess_surge_volume"), "recommended_diversion_quota",
    )


@query(
    "risk_ranking",
    f"""WITH {PLACES},{PROFILES},{RATES},{CALENDAR},{_ELASTIC},{_SCORE},
    mit AS (SELECT destination_name AS dn, excess_demand AS diverted FROM places WHERE excess_demand>0 AND continuous_pressure>=1.3e0),
    net AS (SELECT risk.*, coalesce(diverted,0e0)>0 AS active, CASE WHEN coalesce(diverted,0e0)>0 THEN greatest(0e0,v-diverted) ELSE v END AS nv, {_PROB} AS p FROM risk LEFT JOIN mit ON lower(dn)=lower(destination_name)),
    st AS (SELECT *, CASE WHEN active THEN {r('nv/greatest(1e0,sustainable_capacity)*100e0',1)} ELSE stress END AS stress_pct, greatest(0e0,nv-sustainable_capacity) AS ex FROM net),
    k AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY stress_pct DESC, ex DESC, destination_id) AS risk_rank FROM st)
    SELECT month, risk_rank::INTEGER AS risk_rank, destination_id, {r('nv',1)} AS predicted_demand, stress_pct, CASE WHEN active THEN CASE WHEN stress_pct<100 THEN least(p,18e0) WHEN stress_pct<130 THEN 55e0 ELSE p END ELSE p END AS spike_prob_pct,
      CASE WHEN ex>0 THEN {r('ex*0.65e0')} ELSE 0e0 END AS recommended_diversion, {_RISK_LABEL.format('stress_pct')} AS risk_level, active AS is_mitigated FROM k WHERE risk_rank<=10""",
)
def risk_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = _fixed_model_risk(spark, sf_dir)
    hot = places(spark, sf_dir).where("excess_demand > 0 AND continuous_pressure >= 1.3").select("destination_name", F.col("excess_demand").alias("diverted"))
    out = forecast.rank_at_risk(risk, hot, top_n=10, group=["month"])
    return out.select(
        "month", "risk_rank", "destination_id", rnd("predicted_demand", 1).alias("predicted_demand"), "stress_pct", "spike_prob_pct",
        "recommended_diversion", "risk_level", "is_mitigated",
    )


@query(
    "mitigated_curve",
    f"""WITH {PLACES},{PROFILES},{RATES},{CALENDAR},{_ELASTIC},{_SCORE}, c AS (SELECT *, greatest(0e0,v-excess_demand*0.5e0) AS m FROM risk)
    SELECT destination_id, strftime((month||'-01')::DATE,'%b %Y') AS month_name, v AS predicted_daily_demand, {r('m',2)} AS mitigated_daily_demand, {r('m/greatest(1e0,sustainable_capacity)*100e0',2)} AS mitigated_stress_pct FROM c""",
)
def mitigated_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = cut_lineage(_fixed_model_risk(spark, sf_dir))
    half = risk.select("destination_id", "month", (F.col("excess_demand") * 0.5).alias("diverted"))
    curve = forecast.forward_curve(risk).join(half, ["destination_id", "month"])
    out = explain.mitigated_curve(curve)
    return out.select(
        "destination_id", "month_name", "predicted_daily_demand", rnd("mitigated_daily_demand", 2).alias("mitigated_daily_demand"),
        rnd("mitigated_stress_pct", 2).alias("mitigated_stress_pct"),
    )


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = cut_lineage(_place_months(spark, sf_dir))  # read by each feature join
    months = panel.holiday_proximity(months, holidays(spark, sf_dir))
    return forecast.feature_table(panel.lag_features(months, _panel(spark, sf_dir), F.lit(DEFAULT_OCCUPANCY)))


@query(
    "training_table",
    f"""WITH {PLACES},{PROFILES},{RATES},{CALENDAR},{_PANEL},{_ELASTIC}, spine AS (SELECT DISTINCT month FROM elastic),
    {_PROXIMITY.replace('FROM calendar', 'FROM spine')},{_LAGS.replace('FROM rates, calendar)', 'FROM rates, spine)')}
    SELECT destination_id, month_no, noise, {r('daily_demand_peak*mult*noise',3)} AS actual_demand, CASE WHEN daily_demand_peak*mult*noise>=sustainable_capacity*1.05e0 THEN 1e0 ELSE 0e0 END AS is_spike,
      {r('daily_demand_peak/greatest(1e0,sustainable_capacity)',6)} AS base_pressure, near_count, {r('aor_t1',6)} AS aor_t1
    FROM elastic JOIN prox ON prox.month=elastic.month JOIN lags ON lags.state=elastic.state_name AND lags.mon=elastic.month, (VALUES (0.96e0),(1e0),(1.04e0)) n(noise)""",
)
def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = forecast.training_table(_features(spark, sf_dir))
    return out.select(
        "destination_id", "month_no", "noise", rnd("actual_demand", 3).alias("actual_demand"), "is_spike",
        rnd("base_pressure", 6).alias("base_pressure"), "near_count", rnd("aor_t1", 6).alias("aor_t1"),
    )


_LEVELS, _ALPHA, _N = len(forecast.NOISE), 0.5, len(forecast.FEATURES)
_NEWTON_STEPS = 16  # the SQL takes a fixed number; past the optimum a step moves nothing
_X = f"""month_no,(month_no-1)//3+1,cuti,hols,wknd,mult,base_demand,base_capacity,base_demand/greatest(1e0,base_capacity),base_demand*mult,
  1e0/(1e0+days_to_next),exp(-days_to_next/30e0),near_count,CASE WHEN cuti>=9 THEN 1e0 ELSE 0e0 END,CASE WHEN wknd>=2 THEN 1e0 ELSE 0e0 END,
  sin(month_no*(2e0*pi()/12e0)),cos(month_no*(2e0*pi()/12e0)),aor_t1,aor_ma3"""


def _solved(name: str, size: int) -> str:
    """Gauss and Jordan over the matrix of ``{name}_m``, a column a round; the solution is ``{name}_s``."""
    return f"""{name}_e(k, m) AS (SELECT 0, m FROM {name}_m UNION ALL SELECT k+1, list_transform(range(1,{size + 1}), lambda i: list_transform(range(1,{size + 2}), lambda c:
      CASE WHEN i=k+1 THEN m[i][c]/m[k+1][k+1] ELSE m[i][c]-m[i][k+1]*(m[k+1][c]/m[k+1][k+1]) END)) FROM {name}_e WHERE k<{size}),
    {name}_s AS (SELECT list_transform(m, lambda row: row[{size + 1}]) AS s FROM {name}_e WHERE k={size})"""


def _matrix(name: str, size: int, source: str, product: str, right: str, penalty: str, pull: str) -> str:
    return f"""{name}_g AS (SELECT i, j, sum(CASE WHEN j={size + 1} THEN {right} ELSE {product} END) AS v FROM {source}, range(1,{size + 1}) a(i), range(1,{size + 2}) b(j) GROUP BY i, j),
    {name}_m AS (SELECT list(v ORDER BY i) AS m FROM (SELECT i, list(v+CASE WHEN i=j THEN {penalty} WHEN j={size + 1} THEN -({pull}) ELSE 0e0 END ORDER BY j) AS v FROM {name}_g GROUP BY i))"""


_MODELS = f"""f AS (SELECT *, [{_X}]::DOUBLE[] AS x, {'+'.join(f'base_demand*mult*{n}e0' for n in forecast.NOISE)} AS ys,
    {'+'.join(f'CASE WHEN base_demand*mult*{n}e0>=base_capacity*1.05e0 THEN 1e0 ELSE 0e0 END' for n in forecast.NOISE)} AS s
  FROM (SELECT elastic.*, days_to_next, near_count, aor_t1, aor_ma3, coalesce(daily_demand_peak,8000e0) AS base_demand, coalesce(sustainable_capacity,10000e0) AS base_capacity
    FROM elastic JOIN prox ON prox.month=elastic.month JOIN lags ON lags.state=elastic.state_name AND lags.mon=elastic.month)),
st AS (SELECT count(*) AS n, [{','.join(f'avg(x[{k}])' for k in range(1, _N + 1))}] AS m, [{','.join(f'stddev_pop(x[{k}])' for k in range(1, _N + 1))}] AS sd,
  sum(ys)/({_LEVELS}*count(*)) AS my, sum(s)/({_LEVELS}*count(*)) AS ms FROM f),
z AS MATERIALIZED (SELECT f.*, my, list_transform(range(1,{_N + 1}), lambda k: CASE WHEN sd[k]>0 THEN (x[k]-m[k])/sd[k] ELSE 0e0 END)||[1e0] AS z FROM f, st),
{_matrix('vol', _N, 'z', f'{_LEVELS}*z[i]*z[j]', f'z[i]*(ys-{_LEVELS}*my)', f'{_ALPHA}e0', '0e0')},
{_solved('vol', _N)},
w0 AS (SELECT list_transform(range(1,{_N + 2}), lambda k: CASE WHEN k<={_N} THEN 0e0 ELSE ln(ms/(1e0-ms)) END) AS w FROM st),""" + ",".join(
    f"""
p{t} AS MATERIALIZED (SELECT z, s, w, 1e0/(1e0+exp(-list_inner_product(z,w))) AS p FROM z, w{t}),
{_matrix(f'n{t}', _N + 1, f'p{t}', f'{_LEVELS}*p*(1e0-p)*z[i]*z[j]', f'z[i]*(s-{_LEVELS}*p)', f'CASE WHEN i<={_N} THEN {_ALPHA}e0 ELSE 0e0 END', f'CASE WHEN i<={_N} THEN {_ALPHA}e0*(SELECT w[i] FROM w{t}) ELSE 0e0 END')},
{_solved(f'n{t}', _N + 1)},
w{t + 1} AS MATERIALIZED (SELECT list_transform(range(1,{_N + 2}), lambda k: w[k]+s[k]) AS w FROM w{t}, n{t}_s)"""
    for t in range(_NEWTON_STEPS)
) + f""",
scored AS (SELECT z.*, my+list_inner_product(z[1:{_N}], vol_s.s) AS volume0, 1e0/(1e0+exp(-list_inner_product(z,w))) AS prob0 FROM z, vol_s, w{_NEWTON_STEPS}),
predicted AS (SELECT *, {r('greatest(500e0, volume0)')} AS v FROM scored),
judged AS (SELECT *, {r('v/greatest(1e0,base_capacity)*100e0',1)} AS stress FROM predicted)"""


def _joined_sql() -> str:
    return f"""{PLACES},{PROFILES},{RATES},{CALENDAR},{_PANEL},{_ELASTIC}, spine AS (SELECT DISTINCT month FROM elastic),
    {_PROXIMITY.replace('FROM calendar', 'FROM spine')},{_LAGS.replace('FROM rates, calendar)', 'FROM rates, spine)')}"""


@query(
    "ridge_forecast",
    f"""WITH RECURSIVE {_joined_sql()},{_MODELS}
    SELECT destination_id, month, strftime((month||'-01')::DATE,'%b') AS month_label, strftime((month||'-01')::DATE,'%b %Y') AS month_name, v AS predicted_daily_demand,
      base_capacity AS sustainable_capacity, stress AS capacity_stress_pct, {_PROB} AS spike_probability_pct, {_RISK_LABEL.format('stress')} AS risk_level, event_title FROM judged""",
)
def ridge_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models fitted on the scenario table and applied to every place and month."""
    features = cut_lineage(_features(spark, sf_dir))
    rows, levels = forecast.condensed(features), len(forecast.NOISE)
    scored = forecast.model_scores(features, forecast.fit_volume(rows, levels=levels), forecast.fit_spike(rows, levels=levels))
    return forecast.forward_curve(forecast.spike_risk(scored))


_FITS = " UNION ALL ".join(f"SELECT '{f}' AS feature" for f in [*forecast.FEATURES, "intercept"])
_TRAINING = f"""WITH {PLACES},{PROFILES},{RATES},{CALENDAR},{_PANEL},{_ELASTIC},
    t AS (SELECT daily_demand_peak*mult*noise AS y, daily_demand_peak*mult*noise>=sustainable_capacity*1.05e0 AS spike FROM elastic, (VALUES (0.96e0),(1e0),(1.04e0)) n(noise)),
    k AS (SELECT count(*) AS row_count, count(*) FILTER (WHERE spike) AS spike_count, {r('avg(y)',3)} AS mean_demand FROM t)"""


def _certified(training: DataFrame, slopes: DataFrame) -> DataFrame:
    counts = training.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("is_spike") == 1.0).alias("spike_count"), rnd(F.avg("actual_demand"), 3).alias("mean_demand")
    ).first()
    return slopes.select(
        "feature", F.abs(rnd("gradient", 8)).alias("gradient"), F.lit(counts["row_count"]).cast("long").alias("row_count"),
        F.lit(counts["spike_count"]).cast("long").alias("spike_count"), F.lit(counts["mean_demand"]).alias("mean_demand"),
    )


@query("volume_fit", f"{_TRAINING}, f AS ({_FITS}) SELECT feature, 0e0 AS gradient, row_count, spike_count, mean_demand FROM f, k")
def volume_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ridge is strictly convex, so a gradient of zero for every feature is its solution."""
    training = cut_lineage(forecast.training_table(_features(spark, sf_dir)))
    model = forecast.fit_volume(forecast.condensed(training.where("noise = 1.0")), levels=len(forecast.NOISE))
    return _certified(training, forecast.optimality(training, model, "actual_demand", model.margin()))


@query("spike_fit", f"{_TRAINING}, f AS ({_FITS}) SELECT feature, 0e0 AS gradient, row_count, spike_count, mean_demand FROM f, k")
def spike_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The penalised logistic fit is strictly convex too."""
    training = cut_lineage(forecast.training_table(_features(spark, sf_dir)))
    model = forecast.fit_spike(forecast.condensed(training.where("noise = 1.0")), levels=len(forecast.NOISE))
    return _certified(training, forecast.optimality(training, model, "is_spike", forecast.chance(model.margin())))
