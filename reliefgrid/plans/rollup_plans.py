"""Baselines, roll-ups, rankings and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.functions.numeric import rnd
from reliefgrid.operators import baseline, lookup, ranking, rollup
from reliefgrid.operators.interest import search_interest
from reliefgrid.plans.mapping import (
    calendar,
    customer_nation,
    daily_feed,
    full_places,
    hotel_rates,
    money,
    places,
    table,
    with_nation,
)
from reliefgrid.plans.registry import query
from reliefgrid.plans.sqltext import CALENDAR, FEED, PLACES, PROFILES, RATES, r
from reliefgrid.session import cut_lineage

RATE = "average_occupancy_rate_pct"


@query("national_baseline", f"WITH {RATES} SELECT year, 'Annual' AS period, {r('avg(rate)',6)} AS {RATE}, 'National Mean Baseline' AS state FROM rates GROUP BY year")
def national_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.national_baseline(hotel_rates(spark, sf_dir)).withColumn(RATE, rnd(RATE, 6))


@query("baseline_by_period", f"WITH {RATES} SELECT year, period, {r('avg(rate)',6)} AS {RATE}, 'National Mean Baseline' AS state FROM rates GROUP BY year, period")
def baseline_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.national_baseline(hotel_rates(spark, sf_dir), by_period=True).withColumn(RATE, rnd(RATE, 6))


@query("baseline_annual_rows", f"WITH {RATES} SELECT year, 'Annual' AS period, {r('avg(rate)',6)} AS {RATE}, 'National Mean Baseline' AS state FROM rates WHERE period='Annual' GROUP BY year")
def baseline_annual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.national_baseline(hotel_rates(spark, sf_dir), period="Annual").withColumn(RATE, rnd(RATE, 6))


@query("national_mean", f"WITH {RATES} SELECT {r('coalesce(avg(rate),47.5e0)',6)} AS {RATE} FROM rates")
def national_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.national_mean(hotel_rates(spark, sf_dir)).withColumn(RATE, rnd(RATE, 6))


@query(
    "seasonal_index",
    f"""WITH {RATES}, q AS (SELECT state, period, avg(rate) AS m FROM rates WHERE period<>'Annual' GROUP BY 1,2)
    SELECT state, period, {r('m',6)} AS mean, {r('m/avg(m) OVER (PARTITION BY state)',6)} AS season_index FROM q""",
)
def seasonal_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollup.seasonal_index(hotel_rates(spark, sf_dir), value=RATE)
    return out.select("state", "period", rnd("mean", 6).alias("mean"), rnd("season_index", 6).alias("season_index"))


@query(
    "recent_mean_default",
    f"""WITH {RATES}, m AS (SELECT state, avg(rate) AS v FROM rates WHERE year>=1999 GROUP BY state),
    names AS (SELECT n_name AS state FROM nation UNION ALL SELECT r_name FROM region)
    SELECT state, {r('coalesce(v,52e0)',6)} AS recent_rate FROM names LEFT JOIN m USING (state)""",
)
def recent_mean_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = rollup.recent_mean(hotel_rates(spark, sf_dir), "state", RATE, since=1999)
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("state")).unionByName(
        table(spark, sf_dir, "region").select(F.col("r_name").alias("state"))
    )
    out = lookup.lookup(names, means, "state", {f"recent_{RATE}": 52.0})
    return out.select("state", rnd(f"recent_{RATE}", 6).alias("recent_rate"))


_ROLLUP = f"""coalesce(state_name,'ALL') AS state_name, {r('avg(lat)',6)} AS lat, {r('avg(lon)',6)} AS lon, sum(daily_demand_peak) AS daily_demand_peak,
    {r('sum(sustainable_capacity)',1)} AS sustainable_capacity, sum(total_rooms) AS total_rooms, {r('avg(latest_aor_pct)',6)} AS latest_aor_pct,
    {r('avg(continuous_pressure)',6)} AS continuous_pressure, {r('avg(poverty_rate)',6)} AS poverty_rate, count(*) AS district_count,
    first(destination_name ORDER BY daily_demand_peak DESC, destination_id) AS rep_district,
    greatest(25000e0, sum(daily_demand_peak)*0.8e0) AS elevation"""


def _rounded_rollup(df: DataFrame) -> DataFrame:
    means = {c: rnd(c, 6) for c in ("lat", "lon", "latest_aor_pct", "continuous_pressure", "poverty_rate")}
    return df.withColumns({**means, "sustainable_capacity": rnd("sustainable_capacity", 1)})


@query("state_rollup", f"WITH {PLACES} SELECT {_ROLLUP} FROM places GROUP BY places.state_name")
def state_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_rollup(rollup.state_rollup(places(spark, sf_dir)))


@query("state_rollup_with_total", f"WITH {PLACES} SELECT {_ROLLUP} FROM places GROUP BY ROLLUP(places.state_name)")
def state_rollup_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollup.state_rollup(places(spark, sf_dir), with_total=True)
    return _rounded_rollup(out.withColumn("state_name", F.coalesce("state_name", F.lit("ALL"))))


@query(
    "proportional_allocation",
    f"""WITH {PLACES}, t AS (SELECT state_name, sum(total_rooms)*0.5e0 AS pool FROM places GROUP BY 1),
    w AS (SELECT destination_id, state_name, total_rooms*(1e0+0.08e0*latest_aor_pct) AS w FROM places)
    SELECT destination_id, state_name, greatest(350e0, {r('pool*w/sum(w) OVER (PARTITION BY state_name)')}) AS allocated FROM w JOIN t USING (state_name)""",
)
def proportional_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = cut_lineage(places(spark, sf_dir).select("destination_id", "state_name", "total_rooms", "latest_aor_pct"))
    totals = base.groupBy("state_name").agg((F.sum("total_rooms") * 0.5).alias("pool"))
    weight = F.col("total_rooms") * (F.col("latest_aor_pct") * 0.08 + 1.0)
    return rollup.allocate(base, totals, "state_name", weight, "pool").select("destination_id", "state_name", "allocated")


@query(
    "rank_scores",
    """WITH n AS (SELECT c_custkey, c_acctbal, count(o_orderkey) AS order_count FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1,2),
    k AS (SELECT *, rank() OVER (ORDER BY order_count) + (count(*) OVER (PARTITION BY order_count)-1)/2e0 AS r1,
          rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal)-1)/2e0 AS r2, count(*) OVER () AS t FROM n)
    SELECT c_custkey, order_count, (r1-1e0)/(t-1)*100e0 AS activity_score, 100e0-(r2-1e0)/(t-1)*100e0 AS need_score FROM k""",
)
def rank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("order_count"))
    base = table(spark, sf_dir, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "c_acctbal", F.coalesce("order_count", F.lit(0)).alias("order_count")
    )
    out = ranking.rank_scores(base, {"activity_score": ("order_count", True), "need_score": ("c_acctbal", False)})
    return out.select("c_custkey", F.col("order_count").cast("bigint").alias("order_count"), "activity_score", "need_score")


_BASE_COLUMNS = (
    "state, visitor_growth_2024_pct, annual_visitors_per_resident, annual_overnight_tourists_per_room, tourism_pressure_proxy_score, "
    "spare_capacity_proxy_score, community_opportunity_proxy_score, redistribution_potential_proxy_score"
)


def _avg_rank(column: str) -> str:
    return f"((rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column})-1)/2e0 - 1e0)/(count(*) OVER ()-1)*100e0)"


@query(
    "state_baseline",
    f"""WITH v AS (SELECT n_name AS state, count(*) FILTER (WHERE year(o_orderdate)=2000)*1e0 AS v1, count(*) FILTER (WHERE year(o_orderdate)=1999)*1e0 AS v0
      FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1),
    p AS (SELECT n_name AS state, count(*)*1e0 AS pop, sum(greatest(c_acctbal,0e0)::DECIMAL(18,2))::DOUBLE AS income FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1),
    h AS (SELECT n_name AS state, count(DISTINCT s_suppkey)*1e0 AS rooms, sum(l_quantity) AS guests FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey GROUP BY 1),
    b AS (SELECT state, (v1/v0-1)*100 AS g, v1/pop AS i, guests*1000/rooms AS o, income/pop AS inc, pop AS pov FROM v JOIN p USING (state) JOIN h USING (state)),
    s AS (SELECT state, g, i, o, {_avg_rank('i')}*0.4e0+{_avg_rank('o')}*0.4e0+{_avg_rank('g')}*0.2e0 AS pressure, {_avg_rank('pov')}*0.6e0+(100e0-{_avg_rank('inc')})*0.4e0 AS community FROM b)
    SELECT state, {r('g',6)} AS visitor_growth_2024_pct, {r('i',6)} AS annual_visitors_per_resident, {r('o',6)} AS annual_overnight_tourists_per_room,
      {r('pressure',6)} AS tourism_pressure_proxy_score, {r('100e0-pressure',6)} AS spare_capacity_proxy_score, {r('community',6)} AS community_opportunity_proxy_score,
      {r('(100e0-pressure)*0.55e0+community*0.45e0',6)} AS redistribution_potential_proxy_score FROM s""",
)
def state_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    per_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.when(year == 2000, 1)).alias("v1"), F.count(F.when(year == 1999, 1)).alias("v0")
    )
    home = customer_nation(spark, sf_dir).withColumnRenamed("market", "state")
    visits = per_customer.join(home, F.col("o_custkey") == F.col("c_custkey")).groupBy("state").agg(
        F.sum("v1").cast("double").alias("domestic_visitors_2024_000"), F.sum("v0").cast("double").alias("domestic_visitors_2023_000")
    )
    people = table(spark, sf_dir, "customer").join(home, "c_custkey").groupBy("state").agg(
        F.count(F.lit(1)).cast("double").alias("population_2024_000"),
        F.sum(F.greatest("c_acctbal", F.lit(0.0)).cast("decimal(18,2)")).cast("double").alias("income"),
    )
    people = people.select(
        "state", "population_2024_000", (F.col("income") / F.col("population_2024_000")).alias("median_household_income_2024_rm"),
        F.col("population_2024_000").alias("poverty_rate_2024_pct"),
    )
    sold = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("qty"))
    hotels = with_nation(spark, sf_dir, sold, "l_suppkey").groupBy("state").agg(
        F.count(F.lit(1)).cast("double").alias("hotel_rooms_2023"), F.sum("qty").alias("overnight_tourists_2024_000")
    )
    merged = baseline.merge_inputs([visits, people, hotels])
    out = baseline.baseline_scores(merged)
    names = _BASE_COLUMNS.split(", ")
    return out.select("state", *[rnd(c, 6).alias(c) for c in names[1:]])


@query(
    "worst_place",
    f"WITH {PLACES} SELECT destination_id, destination_name, excess_demand, continuous_pressure FROM places ORDER BY excess_demand DESC, destination_id DESC LIMIT 1",
)
def worst_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.worst_row(places(spark, sf_dir), "excess_demand", "destination_id").select(
        "destination_id", "destination_name", "excess_demand", "continuous_pressure"
    )


@query(
    "top_share",
    f"""WITH v AS (SELECT year(o_orderdate)::INTEGER AS year, n_name AS state, count(*) AS visits FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2),
    k AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY visits DESC, state) AS n FROM v)
    SELECT year, sum(visits)::BIGINT AS total_value, (sum(visits) FILTER (WHERE n<=5))::BIGINT AS top_value, (sum(visits) FILTER (WHERE n<=5))/sum(visits) AS top_share FROM k GROUP BY year""",
)
def top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    visits = per.join(customer_nation(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        "year", F.col("market").alias("state")
    ).agg(F.sum("n").alias("visits"))
    return rollup.top_share(visits, "year", "visits", "state")


@query(
    "trailing_mean",
    f"""WITH {FEED} SELECT event_type, day::VARCHAR AS day, total, {r('avg(total) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)',4)} AS trailing_total FROM feed""",
)
def trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollup.trailing_mean(daily_feed(spark, sf_dir), ["event_type"], "day", "total", rows=7)
    return out.select("event_type", F.col("day").cast("string").alias("day"), "total", rnd("trailing_total", 4).alias("trailing_total"))


_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "feed_kpis",
    f"""WITH {FEED}, d AS (SELECT day, {', '.join(f"sum(total) FILTER (WHERE event_type='{k}') AS {k}" for k in _EVENT_TYPES)} FROM feed GROUP BY day),
    t AS (SELECT * FROM d ORDER BY day DESC LIMIT 30)
    SELECT {', '.join(f"{r(f'avg({k})')} AS {k}_avg" for k in _EVENT_TYPES)}, max(day)::VARCHAR AS latest_day FROM t""",
)
def feed_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = daily_feed(spark, sf_dir).groupBy("day").pivot("event_type", _EVENT_TYPES).agg(F.sum("total"))
    out = rollup.recent_rows_mean(wide, "day", _EVENT_TYPES)
    return out.withColumn("latest_day", F.col("latest_day").cast("string"))


@query(
    "month_means",
    f"""WITH {CALENDAR}, m AS (SELECT month[6:7]::INTEGER AS month_no, avg(demand_multiplier) AS v FROM calendar GROUP BY 1)
    SELECT month_no, {r('v',6)} AS mean_value, (row_number() OVER (ORDER BY {r('v',9)} DESC, month_no))::INTEGER AS month_rank FROM m""",
)
def month_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.month_means(calendar(spark, sf_dir)).withColumn("mean_value", rnd("mean_value", 6))


@query(
    "search_index",
    f"""WITH {PLACES},{PROFILES},{CALENDAR},
    m AS (SELECT month[6:7]::INTEGER AS month_no, avg(demand_multiplier) AS v FROM calendar GROUP BY 1),
    k AS (SELECT month_no, row_number() OVER (ORDER BY v DESC, month_no) AS n, strftime(make_date(2000,month_no,1),'%B') AS nm FROM m),
    top AS (SELECT * FROM places JOIN tags ON l_suppkey=destination_id ORDER BY daily_demand_peak DESC, state_name, destination_name LIMIT 50)
    SELECT destination_name AS destination, state_name AS state, CASE WHEN continuous_pressure>=1e0 THEN 'Hotspot' ELSE 'Alternative' END AS category,
      {r('daily_demand_peak*100e0/max(daily_demand_peak) OVER ()',1)} AS relative_search_index,
      (SELECT nm FROM k WHERE n=CASE WHEN continuous_pressure>=1e0 THEN 1 ELSE 2 END) AS peak_month,
      array_to_string(string_split(poi_tags,' | ')[1:3],', ') AS dominant_query,
      'proxy: demand-normalized index; peak month from national demand calendar' AS method FROM top""",
)
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_interest(full_places(spark, sf_dir), calendar(spark, sf_dir))


@query(
    "max_per_market",
    """SELECT n_name AS market, max(o_totalprice) AS o_totalprice FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def max_per_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("o_totalprice"))
    rows = per.join(customer_nation(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    return rollup.max_per_key(rows, "market", "o_totalprice", 10)


@query(
    "dedup_first",
    """SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS n FROM orders) t WHERE n=1""",
)
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice", "o_orderdate")
    return ranking.keep_first(orders, ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY 1,2 HAVING count(*)>1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("customers_without_orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.missing_from(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


@query(
    "next_event",
    """SELECT event_type, coalesce(arg_min(event_id, ts) FILTER (WHERE ts>=TIMESTAMP '2024-01-15'), arg_max(event_id, ts)) AS event_id FROM events GROUP BY 1""",
)
def next_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    now = F.lit("2024-01-15").cast("timestamp").cast(events.schema["ts"].dataType)
    return ranking.next_or_last(events, "event_type", "ts", now).select("event_type", "event_id")


@query("latest_snapshot", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate=(SELECT max(o_orderdate) FROM orders)")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.latest_rows(table(spark, sf_dir, "orders"), "o_orderdate").select("o_orderkey", "o_custkey")


@query(
    "merge_violations",
    """SELECT p_name, count(*) AS row_count, 'left' AS side FROM part GROUP BY 1 HAVING count(*)>1
    UNION ALL SELECT s_name, count(*), 'right' FROM supplier GROUP BY 1 HAVING count(*)>1""",
)
def merge_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("p_name"))
    return lookup.merge_violations(table(spark, sf_dir, "part").select("p_name"), right, "p_name")


@query(
    "visitors_unpivot",
    """SELECT n_name AS state, year(o_orderdate)::INTEGER AS year, count(*) AS domestic_visitors_000 FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2""",
)
def visitors_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    wide = per.join(customer_nation(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("market").alias("state")).pivot("year").agg(F.sum("n"))
    return baseline.visitors_long(wide).where(F.col("domestic_visitors_000").isNotNull())


@query(
    "state_flow_share",
    f"""WITH t AS (SELECT n_name AS market, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1)
    SELECT market, value, {r('value/(SELECT sum(value) FROM t)*100e0',6)} AS share_percent FROM t""",
)
def state_flow_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("v"))
    rows = per.join(customer_nation(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).groupBy("market").agg(
        F.sum("v").cast("double").alias("value")
    )
    out = rollup.share_of_total(rows, "value", F.col("market") == "Overall")
    return out.withColumn("share_percent", rnd("share_percent", 6))
