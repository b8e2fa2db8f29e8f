"""Rule violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.operators import quality
from reliefgrid.plans.mapping import full_places, table
from reliefgrid.plans.registry import query
from reliefgrid.plans.sqltext import PLACES, PROFILES
from reliefgrid.session import cut_lineage

# zones: customers as zone records, with faults that come from their numbers
ZONES = """zrow AS (SELECT c_custkey, 'k'||(CASE WHEN c_custkey%97=0 THEN 1 ELSE c_custkey END) AS key, c_custkey%17 AS t, c_custkey%5 AS cls,
   CASE WHEN c_custkey%7=0 THEN NULL ELSE c_acctbal*20e0 END AS luas, 0.5e0+(c_custkey%75)/10e0 AS lat, 98.5e0+(c_custkey%215)/10e0 AS lon,
   (c_custkey%83)*500+CASE WHEN c_custkey%29=0 THEN 250 ELSE 0 END AS radius, 1998+c_custkey%34 AS yr, CASE WHEN c_custkey%3=0 THEN 'wakil' ELSE 'tinggi' END AS conf, c_custkey%4=0 AS derived FROM customer)"""


def zone_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    number = (key % 17).cast("string")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("k"), F.when(key % 97 == 0, 1).otherwise(key).cast("string")).alias("key"),
        F.concat(F.lit("KSAS "), number).alias("ksas_code"),
        F.coalesce(quality.type_name(key % 17), F.lit("unknown")).alias("jenis_ksas"),
        F.concat(F.lit("Tahap "), (key % 5).cast("string")).alias("tahap"), F.col("c_name").alias("nama"),
        F.when(key % 7 == 0, F.lit(None)).otherwise(F.col("c_acctbal") * 20.0).alias("luas_h"),
        F.lit("a").alias("akt_1"), F.lit("b").alias("akt_0"), F.lit("n").alias("negeri"), F.lit("d").alias("daerah"),
        (key % 34 + 1998).alias("tahun_data"), ((key % 75) / 10.0 + 0.5).alias("lat"), ((key % 215) / 10.0 + 98.5).alias("lon"),
        (key % 83 * 500 + F.when(key % 29 == 0, 250).otherwise(0)).alias("radius_m"), F.lit("s").alias("sumber"), F.lit("r").alias("representation"),
        F.when(key % 3 == 0, "wakil").otherwise("tinggi").alias("keyakinan"), (key % 4 == 0).alias("area_derived"),
    )


_LEGAL = " ".join(f"WHEN t={t} THEN cls IN ({','.join(map(str, c))})" for t, c in quality.LEGAL_CLASSES.items())
_EXPECT = "(round_even(sqrt(luas/100e0/pi())*1000e0/500e0,0)*500)"
_RULES = {
    "type code": "t BETWEEN 1 AND 15",
    "protection class": "cls BETWEEN 1 AND 3",
    "type name": "t BETWEEN 1 AND 15",
    "class legal for type": f"cls BETWEEN 1 AND 3 AND CASE {_LEGAL} ELSE false END",
    "area known": "luas IS NOT NULL OR conf='wakil'",
    "area positive": "luas IS NULL OR luas>0",
    "latitude": "lat BETWEEN 0.8e0 AND 7.6e0",
    "longitude": "lon BETWEEN 99e0 AND 119.6e0",
    "radius range": "radius BETWEEN 1000 AND 40000",
    "radius step": "radius%500=0",
    "radius fits area": f"NOT derived OR coalesce(luas>=0 AND abs(radius-{_EXPECT.replace('luas', 'greatest(luas,0e0)')})<=500, false)",
    "year": "yr BETWEEN 2000 AND 2030",
}
_VIOLATIONS = " UNION ALL ".join(f"SELECT key, '{name}' AS rule FROM zrow WHERE NOT coalesce(({ok}),false)" for name, ok in _RULES.items())


@query("quality_violations", f"WITH {ZONES} {_VIOLATIONS} UNION ALL SELECT key, 'unique key' FROM zrow GROUP BY key HAVING count(*)>1")
def quality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.zone_violations(zone_rows(spark, sf_dir))


@query(
    "violation_counts",
    f"WITH {ZONES}, v AS ({_VIOLATIONS} UNION ALL SELECT key, 'unique key' FROM zrow GROUP BY key HAVING count(*)>1) SELECT rule, count(*) AS row_count FROM v GROUP BY rule",
)
def violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.zone_violations(zone_rows(spark, sf_dir)).groupBy("rule").agg(F.count(F.lit(1)).alias("row_count"))


@query("uncovered_types", "SELECT z::INTEGER AS zone_type FROM (SELECT unnest(range(1,16)) AS z) WHERE z NOT IN (SELECT p_size%13+1 FROM part)")
def uncovered_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "part").select(F.concat(F.lit("KSAS "), (F.col("p_size") % 13 + 1).cast("string")).alias("ksas_code"))
    return quality.uncovered_types(codes)


@query(
    "interest_violations",
    f"""WITH {PLACES},{PROFILES},
    t AS (SELECT CASE WHEN destination_id%11=0 THEN 'Nowhere '||destination_id%2 ELSE destination_name END AS destination, CASE WHEN destination_id%9=0 THEN 'Other' ELSE 'Hotspot' END AS category,
      continuous_pressure*80e0 AS idx, CASE WHEN destination_id%13=0 THEN 'Maytember' ELSE 'May' END AS mon, CASE WHEN destination_id%17=0 THEN ' ' ELSE poi_tags END AS q FROM places JOIN tags ON l_suppkey=destination_id)
    SELECT destination AS key, 'index range' AS rule FROM t WHERE NOT idx BETWEEN 0 AND 100 UNION ALL SELECT destination, 'month name' FROM t WHERE mon='Maytember'
    UNION ALL SELECT destination, 'category' FROM t WHERE category='Other' UNION ALL SELECT destination, 'query not blank' FROM t WHERE trim(q)=''
    UNION ALL SELECT destination, 'unique key' FROM t GROUP BY destination HAVING count(*)>1
    UNION ALL SELECT DISTINCT destination, 'known destination' FROM t WHERE destination NOT IN (SELECT destination_name FROM places)
    UNION ALL SELECT count(*)::VARCHAR, 'row count' FROM t HAVING count(*)<50""",
)
def interest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("destination_id")
    spots = cut_lineage(full_places(spark, sf_dir).select("destination_id", "destination_name", "continuous_pressure", "poi_tags"))
    listed = spots.select(
        F.when(key % 11 == 0, F.concat(F.lit("Nowhere "), (key % 2).cast("string"))).otherwise(F.col("destination_name")).alias("destination"),
        F.when(key % 9 == 0, "Other").otherwise("Hotspot").alias("category"), (F.col("continuous_pressure") * 80.0).alias("relative_search_index"),
        F.when(key % 13 == 0, "Maytember").otherwise("May").alias("peak_month"), F.when(key % 17 == 0, " ").otherwise(F.col("poi_tags")).alias("dominant_query"),
    )
    return quality.interest_violations(listed, spots)


@query(
    "total_mismatch",
    "SELECT o_orderkey, count(*) AS line_count FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY o_orderkey, o_totalprice HAVING sum(l_extendedprice::DECIMAL(18,2))>o_totalprice::DECIMAL(18,2)",
)
def total_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose stated total is below the sum of their lines."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("s"), F.count(F.lit(1)).alias("line_count")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("t"))
    return orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey")).where("s > t").select("o_orderkey", "line_count")
