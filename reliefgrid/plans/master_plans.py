"""The district master table over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.functions.capacity import MASTER_SUBSYSTEMS
from reliefgrid.functions.text import PLACE_FLAGS, STATES
from reliefgrid.operators import lookup, master
from reliefgrid.plans.mapping import table
from reliefgrid.plans.registry import query
from reliefgrid.plans.sqltext import r
from reliefgrid.session import cut_lineage

# districts: every tier, and some names beyond them
DISTRICTS = [*master.TIER_1, *master.TIER_2, *master.TIER_3, "Mukah", "Pekan", "Taman Negara", "Sri Aman", "Somewhere"]
TAGS = ["caves", "rivers", "markets", "murals"]


def _quoted(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _tiered(values: tuple) -> str:
    tiers = (master.TIER_1, master.TIER_2, master.TIER_3)
    return "CASE " + " ".join(f"WHEN district_name IN ({_quoted(t)}) THEN {v}e0" for t, v in zip(tiers, values, strict=False)) + f" ELSE {values[3]}e0 END"


def _flag(name: str) -> str:
    return f"regexp_matches(lower(district_name), '{'|'.join(PLACE_FLAGS[name])}')"


def _held(value: str) -> str:
    return f"greatest(0.05e0, least(0.99e0, {value}))"


_ARCH = ", ".join(
    f"{_held(f'coalesce(p_{a}, CASE WHEN {_flag(flag)} THEN {yes}e0 ELSE {no}e0 END)')} AS {a}" for a, (flag, yes, no) in master.FLAG_ARCHETYPES.items()
)
_FOOD = _held(
    f"coalesce(p_arch_food, CASE WHEN {_flag('is_urban')} OR {_flag('is_heritage')} THEN {master.FOOD_ARCHETYPE[0]}e0 ELSE {master.FOOD_ARCHETYPE[1]}e0 END)"
)
_LIFT = "1e0" + "".join(f"+coalesce(p_{a}, {default}e0)*{factor}e0" for a, (factor, default) in master.PROFILE_WEIGHTS.items())


def _capacity(column: str) -> str:
    strained, normal, words, districts = master.CAPACITY_RULES[column]
    hits = ([f"district_name IN ({_quoted(districts)})"] if districts else []) + ([f"regexp_matches(lower(district_name), '{'|'.join(words)}')"] if words else [])
    return f"peak*CASE WHEN {' OR '.join(hits)} THEN {strained}e0 ELSE {normal}e0 END AS {column}"


_CAPS = ", ".join([f"total_rooms*{master.ROOM_CAPACITY}e0 AS cc_accommodation", *map(_capacity, master.CAPACITY_RULES)])
_LOW = "least(" + ", ".join(f"greatest({c},1e0)" for c, _ in MASTER_SUBSYSTEMS) + ")"
_BINDING = "CASE " + " ".join(f"WHEN greatest({c},1e0)=low THEN '{t}'" for c, t in MASTER_SUBSYSTEMS) + " END"

MASTER = f"""WITH known AS (SELECT {STATES!r}[s_suppkey%16+1] AS state_name, {DISTRICTS!r}[s_suppkey%{len(DISTRICTS)}+1] AS district_name, min(s_suppkey) AS k FROM supplier GROUP BY 1,2),
d AS (SELECT * FROM known UNION ALL SELECT n_name, 'New '||n_name, n_nationkey FROM nation UNION ALL SELECT DISTINCT state_name, 'New '||state_name, 7 FROM known),
p AS (SELECT state_name, district_name, (k%10)/10e0 AS p_arch_urban, (k%7)/7e0 AS p_arch_heritage, (k%5)/5e0 AS p_arch_beach, NULL::DOUBLE AS p_arch_nature, (k%9)/9e0 AS p_arch_food,
  array_to_string({TAGS!r}[1:k%4+1],' | ') AS tags FROM known),
e AS (SELECT {STATES!r}[c_custkey%16+1] AS state_name, {r('avg(abs(c_acctbal))/1000e0',4)} AS poverty, {r('avg(c_acctbal)+5000e0',2)} AS income_mean, min(c_acctbal)+6000e0 AS income_median FROM customer GROUP BY 1),
y AS (SELECT l_suppkey%16 AS s, year(l_shipdate)+24 AS year, count(*)*10e0 AS rooms, sum(l_quantity)/count(*)*2e0 AS rate FROM lineitem GROUP BY 1,2),
o AS (SELECT {STATES!r}[s+1] AS state_name, avg(rate) AS rate FROM y WHERE year>=2023 GROUP BY 1),
i AS (SELECT {STATES!r}[s+1] AS state_name, avg(rooms) AS rooms FROM y WHERE year>=2023 GROUP BY 1),
b AS (SELECT d.*, 1e0+(k*37%600)/100e0 AS lat, 100e0+(k*53%1900)/100e0 AS lon, p.* EXCLUDE (state_name, district_name), coalesce(poverty,{master.DEFAULT_POVERTY}e0) AS poverty,
  coalesce(income_mean,{master.DEFAULT_MEAN_INCOME}e0) AS income_mean, coalesce(income_median,{master.DEFAULT_MEDIAN_INCOME}e0) AS income_median,
  coalesce(rate,{master.DEFAULT_OCCUPANCY}e0) AS rate, coalesce(rooms,{master.DEFAULT_ROOMS}e0) AS rooms
  FROM d LEFT JOIN p USING (state_name, district_name) LEFT JOIN e USING (state_name) LEFT JOIN o USING (state_name) LEFT JOIN i USING (state_name)),
w AS (SELECT *, {_tiered(master.ROOM_WEIGHT)}*({_LIFT})*(least(len(string_split(coalesce(tags,''),'|')),10)*0.08e0+1e0) AS w FROM b),
a AS (SELECT *, {_ARCH}, {_FOOD} AS arch_food, coalesce(tags,'{master.DEFAULT_TAGS}') AS poi_tags, greatest(350e0, {r('rooms*w/sum(w) OVER (PARTITION BY state_name)')}) AS total_rooms FROM w),
k AS (SELECT *, total_rooms*CASE WHEN district_name IN ({_quoted(master.PEAK_RESORTS)}) THEN {master.DEMAND_RATIO[0]}e0 ELSE {_tiered(master.DEMAND_RATIO[1:])} END*(arch_food*0.12e0+arch_beach*0.08e0+1e0) AS peak FROM a),
c AS (SELECT *, {_CAPS} FROM k),
l AS (SELECT *, {_LOW} AS low FROM c)
SELECT state_name, district_name, total_rooms, {r('peak')} AS daily_demand_peak, {', '.join(f'{r(c)} AS {c}' for c, _ in MASTER_SUBSYSTEMS)}, {_BINDING} AS binding_constraint,
  {r('low')} AS sustainable_capacity, {r('peak/low',3)} AS continuous_pressure, {r('greatest(0e0,peak-low)')} AS excess_demand_daily, {r('(low-peak)/low',3)} AS capacity_gap, {r('poverty',2)} AS poverty_rate,
  {r('income_mean')} AS mean_household_income, {r('income_median')} AS median_household_income, {r('rate',1)} AS latest_aor_pct, {', '.join(f'{r(a,3)} AS {a}' for a in ('arch_heritage','arch_nature','arch_beach','arch_food','arch_urban'))},
  poi_tags, CASE WHEN lat<6e0 AND lon<101.5e0 AND lat>3e0 THEN 'KTM ETS & Rail' ELSE 'Federal Road & Express Coach' END AS transit_mode, CASE WHEN (state_name, district_name) IN (SELECT (state_name, district_name) FROM known) THEN 'Majlis '||district_name END AS pbt_name FROM l"""


def _of(names: list[str], key: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), (key % len(names)).cast("int"))


@query("master_table", MASTER)
def master_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All districts of the tables, with new districts in each state and in states that no table knows; the state tables spell with blanks."""
    key = F.col("s_suppkey")
    keyed = cut_lineage(table(spark, sf_dir, "supplier").groupBy(
        _of(STATES, key).alias("state_name"), _of(DISTRICTS, key).alias("district_name")
    ).agg(F.min("s_suppkey").alias("k")))
    k = F.col("k")
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("state_name"), F.concat(F.lit("New "), "n_name").alias("district_name"), F.col("n_nationkey").alias("k")
    )
    fresh = keyed.select("state_name").distinct().select("state_name", F.concat(F.lit("New "), "state_name").alias("district_name"), F.lit(7).alias("k"))
    districts = keyed.unionByName(nations).unionByName(fresh).select("state_name", "district_name", ((k * 37 % 600) / 100.0 + 1.0).alias("lat"), ((k * 53 % 1900) / 100.0 + 100.0).alias("lon"))
    tags = F.array_join(F.slice(F.array(*[F.lit(t) for t in TAGS]), F.lit(1), (k % 4 + 1).cast("int")), " | ")
    profiles = keyed.select(
        "state_name", "district_name", (k % 10 / 10.0).alias("arch_urban"), (k % 7 / 7.0).alias("arch_heritage"), (k % 5 / 5.0).alias("arch_beach"),
        F.lit(None).cast("double").alias("arch_nature"), (k % 9 / 9.0).alias("arch_food"), F.when(k % 4 >= 0, tags).alias("poi_tags"),
    )
    customer = F.col("c_custkey")
    economy = table(spark, sf_dir, "customer").groupBy(_of(STATES, customer).alias("state")).agg(
        (F.floor(F.avg(F.abs("c_acctbal")) / 1000.0 * 10000.0 + 0.5) / 10000.0).alias("poverty"),
        (F.floor((F.avg("c_acctbal") + 5000.0) * 100.0 + 0.5) / 100.0).alias("income_mean"), (F.min("c_acctbal") + 6000.0).alias("income_median"),
    )
    year = (F.year("l_shipdate") + 24).alias("year")
    yearly = cut_lineage(table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 16).alias("s"), year).agg(
        (F.count(F.lit(1)) * 10.0).alias("rooms_count"), (F.sum("l_quantity") / F.count(F.lit(1)) * 2.0).alias("average_occupancy_rate_pct")
    ))  # states x years
    spelled = F.concat(F.lit(" "), _of(STATES, F.col("s")), F.lit(" ")).alias("state")
    occupancy = yearly.select(spelled, "year", "average_occupancy_rate_pct")
    inventory = yearly.select(spelled, "year", "rooms_count")
    authorities = keyed.select("state_name", "district_name", F.concat(F.lit("Majlis "), "district_name").alias("pbt_name"))
    out = master.build_master(districts, profiles, economy, occupancy, inventory, authorities)
    return out.drop("destination_name", "lat", "lon")


@query("authority_lookup", "SELECT s_suppkey, s_nationkey, n_name AS authority FROM supplier JOIN nation ON s_nationkey=n_nationkey")
def authority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict lookup, where an unknown key would be an error."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("authority"))
    return lookup.require_match(rows, names, ["s_nationkey"], "authority")
