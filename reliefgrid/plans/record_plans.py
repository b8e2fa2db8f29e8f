"""Small record operators over the driver tables: profiles, clusters, renamed and stacked panels."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.functions import text as tx
from reliefgrid.functions.numeric import rnd
from reliefgrid.functions.text import CLUSTER_NAMES, REGION_CLUSTERS, STATES
from reliefgrid.operators import baseline, lookup, quality, ranking, reports, survey
from reliefgrid.plans.mapping import customer_nation, hotel_rates, money, table
from reliefgrid.plans.registry import query
from reliefgrid.plans.sqltext import RATES, r
from reliefgrid.session import ensure_checkpoint_dir, shared_path
from reliefgrid.sources import landing, sinks
from reliefgrid.sources.readers import BOM, csv_table, csv_text, hotel_series, land, parquet_table, report_texts


@query(
    "household_profile",
    f"""WITH orderless AS (SELECT n_name||' Federal Territory' AS state, '2024-01-01' AS date, n_nationkey*1e0 AS income_mean, 0::BIGINT AS households FROM nation),
    c AS (SELECT n_name AS state, CASE WHEN c_custkey%3=0 THEN '2022-01-01' ELSE '2024-01-01' END AS date, {r('avg(c_acctbal)', 4)} AS income_mean, count(*) AS households
      FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2 UNION ALL SELECT * FROM orderless),
    g AS (SELECT n_name AS state, year(o_orderdate) AS year, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS services_gdp FROM orders JOIN customer ON o_custkey=c_custkey
      JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2)
    SELECT c.state, date, income_mean, households, services_gdp FROM c LEFT JOIN (SELECT * FROM g WHERE year=(SELECT max(year) FROM g)) g USING (state) WHERE date='2024-01-01'""",
)
def household_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two survey dates and services GDP by year; the survey also asks in states that have no orders."""
    nations = table(spark, sf_dir, "nation")
    date = F.when(F.col("c_custkey") % 3 == 0, "2022-01-01").otherwise("2024-01-01").alias("date")
    survey = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("n_name").alias("state"), date
    ).agg(rnd(F.avg("c_acctbal"), 4).alias("income_mean"), F.count(F.lit(1)).alias("households"))
    per = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum(money("o_totalprice")).alias("v"))
    orderless = nations.select(
        F.concat("n_name", F.lit(" Federal Territory")).alias("state"), F.lit("2024-01-01").alias("date"),
        F.col("n_nationkey").cast("double").alias("income_mean"), F.lit(0).cast("long").alias("households"),
    )
    gdp = per.join(customer_nation(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("market").alias("state"), "year"
    ).agg(F.sum("v").cast("double").alias("services_gdp"))
    return baseline.household_profile(survey.unionByName(orderless), gdp)


_MEMBERS = {**REGION_CLUSTERS, "West Coast": [s for c in ("Northern", "Central", "Southern") for s in REGION_CLUSTERS[c]], "All": STATES}
_ALIASES = [(alias, cluster) for cluster, aliases in CLUSTER_NAMES.items() for alias in aliases]


def _quoted(rows: list[tuple[str, str]]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in rows)


@query(
    "cluster_members",
    f"""WITH a(alias, cluster) AS (VALUES {_quoted(_ALIASES)}), m(cluster, state) AS (VALUES {_quoted([(c, s) for c, ss in _MEMBERS.items() for s in ss])}),
    s AS (SELECT s_suppkey, {STATES!r}[s_suppkey%{len(STATES)}+1] AS state FROM supplier)
    SELECT alias, s_suppkey, state FROM s JOIN m USING (state) JOIN a USING (cluster)""",
)
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of every region cluster, asked for by each of its names."""
    states = F.array(*[F.lit(s) for s in STATES])
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.get(states, (F.col("s_suppkey") % len(STATES)).cast("int")).alias("state")
    )
    found = [lookup.in_cluster(rows, "state", alias).withColumn("alias", F.lit(alias)) for alias, _ in _ALIASES]
    return ranking.stack_panels(found).select("alias", "s_suppkey", "state")


@query(
    "stacked_panels",
    """SELECT 'customer' AS panel, c_nationkey AS nation, count(*) AS row_count FROM customer GROUP BY 2
    UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2 UNION ALL SELECT 'lines', s_nationkey, count(*) FROM lineitem JOIN supplier ON l_suppkey=s_suppkey GROUP BY 2""",
)
def stacked_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels whose columns stand in different order."""
    count = F.count(F.lit(1)).alias("row_count")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    sold = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(count).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return ranking.stack_panels([
        table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(count).withColumn("panel", F.lit("customer")),
        suppliers.groupBy("nation").agg(count).withColumn("panel", F.lit("supplier")),
        sold.groupBy("nation").agg(F.sum("row_count").alias("row_count")).select(F.lit("lines").alias("panel"), "row_count", "nation"),
    ]).select("panel", "nation", "row_count")


@query(
    "hotel_series",
    f"WITH {RATES} SELECT state AS state_name, year, period AS quarter, {r('rate', 6)} AS average_occupancy_rate_pct FROM rates",
)
def hotel_series_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotel_series(hotel_rates(spark, sf_dir)).withColumn("average_occupancy_rate_pct", rnd("average_occupancy_rate_pct", 6))


_KINDS = ["tourist", "excursionist", "visitor"]
_NAMED = f"""n AS (SELECT DISTINCT 'Arrivals_'||strftime(o_orderdate, '%B')||'_'||year(o_orderdate)||'_Q'||quarter(o_orderdate)||'_'||{_KINDS!r}[o_orderkey%3+1]||'.pdf' AS file_name,
    year(o_orderdate)::INTEGER AS year, 'Q'||quarter(o_orderdate) AS period, upper(strftime(o_orderdate, '%B'))[1:3] AS short, {_KINDS!r}[o_orderkey%3+1] AS arrival_type FROM orders)"""


@query("dated_file_names", f"WITH {_NAMED} SELECT file_name, year, period, short AS month, arrival_type FROM n")
def dated_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that carry a month, a year, a quarter and a kind of arrival."""
    date = F.col("o_orderdate")
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("o_orderkey") % 3).cast("int"))
    name = F.concat(
        F.lit("Arrivals_"), F.date_format(date, "MMMM"), F.lit("_"), F.year(date).cast("string"), F.lit("_Q"), F.quarter(date).cast("string"),
        F.lit("_"), kind, F.lit(".pdf"),
    )
    names = table(spark, sf_dir, "orders").select(name.alias("file_name")).distinct()
    return names.select(
        "file_name", tx.file_year("file_name").alias("year"), tx.file_period("file_name").alias("period"),
        F.substring(tx.file_month("file_name"), 1, 3).alias("month"), tx.file_arrival_type("file_name").alias("arrival_type"),
    )


@query(
    "unread_reports",
    """SELECT CASE WHEN c_custkey%3=0 THEN 'report_'||c_custkey%100||'.pdf' ELSE 'report_2024_'||c_custkey%100||'.pdf' END AS file_name,
    CASE WHEN c_custkey%3=0 THEN 'no year in file name' ELSE 'no text' END AS reason FROM customer WHERE c_custkey%3=0 OR c_custkey%5<2""",
)
def unread_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of customers: a third has no year in its name, and of the others two fifths have no text."""
    key = F.col("c_custkey")
    number = (key % 100).cast("string")
    name = F.when(key % 3 == 0, F.concat(F.lit("report_"), number, F.lit(".pdf"))).otherwise(F.concat(F.lit("report_2024_"), number, F.lit(".pdf")))
    text = F.when(key % 5 == 0, F.lit("  ")).when(key % 5 > 1, F.col("c_name"))
    return reports.failed_files(table(spark, sf_dir, "customer").select(name.alias("file_name"), text.alias("text")))


@query("csv_round_trip", "SELECT c_custkey, c_name, c_acctbal, c_custkey%7=0 AS flagged, CASE WHEN c_custkey%4<>0 THEN c_mktsegment END AS segment FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by the CSV sink in the shared folder and read back with types and nulls."""
    ensure_checkpoint_dir(spark)
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_acctbal", (F.col("c_custkey") % 7 == 0).alias("flagged"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("segment")
    )
    folder = f"{spark.sparkContext.getCheckpointDir()}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(rows, folder)
    return csv_table(spark, folder, rows.schema)


@query(
    "landed_partitions",
    "SELECT year(o_orderdate)::INTEGER AS year, count(*) AS row_count, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1",
)
def landed_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed once, curated by year, and read by partition."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/landed-{uuid.uuid4().hex}"
    landed = land(table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice"), f"{folder}/raw")
    sinks.write_table(landed.withColumn("year", F.year("o_orderdate")), f"{folder}/curated", ["year"])
    return parquet_table(spark, f"{folder}/curated").where("year >= 1998").groupBy("year").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(money("o_totalprice")).cast("double").alias("total")
    )


@query("landed_snapshot", "SELECT o_orderpriority AS priority, count(*) AS row_count, 1::BIGINT AS snapshots, true AS fell_back FROM orders GROUP BY 1")
def landed_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed twice; the second landing breaks half way, so the first is read."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    folder = shared_path(spark, "snapshots")
    landing.land_snapshot(rows, folder)
    last = rows.agg(F.max("o_orderkey")).scalar()
    bad = rows.withColumn("o_orderkey", F.when(F.col("o_orderkey") == last, F.raise_error(F.lit("the source broke off")).cast("long")).otherwise(F.col("o_orderkey")))
    read, broken = landing.fetch_or_last(spark, folder, lambda: bad, rows.schema)
    count = landing.commits(spark, folder).agg(F.count(F.lit(1))).scalar()
    return read.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("row_count")).select(
        "priority", "row_count", count.alias("snapshots"), F.lit(broken is not None).alias("fell_back")
    )


_FIRST_DAY, _LAST_DAY = "(SELECT min(o_orderdate::DATE) FROM orders)", "(SELECT max(o_orderdate::DATE) FROM orders)"


@query(
    "table_differences",
    f"""SELECT o_orderkey, CASE WHEN o_orderdate::DATE={_LAST_DAY} THEN 'removed' ELSE 'changed' END AS change FROM orders
    WHERE o_orderdate::DATE IN ({_FIRST_DAY},{_LAST_DAY}) UNION ALL SELECT -s_suppkey-1, 'added' FROM supplier""",
)
def table_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders against a copy in the shared folder that lacks the last day, has the first day changed and rows of its own."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    first, last = rows.agg(F.min("day")).scalar(), rows.agg(F.max("day")).scalar()
    changed = F.when(F.col("day") == first, F.lit(None).cast("double")).otherwise(F.col("o_totalprice"))
    added = table(spark, sf_dir, "supplier").select(
        (-F.col("s_suppkey") - 1).alias("o_orderkey"), F.lit("2000-01-01").cast("date").alias("day"), F.lit(0.0).alias("o_totalprice")
    )
    copy = rows.where(F.col("day") != last).withColumn("o_totalprice", changed).unionByName(added)
    folder = shared_path(spark, "copy")
    sinks.write_table(copy, folder)
    return quality.differences(rows, parquet_table(spark, folder), ["o_orderkey"])


@query(
    "side_by_side_lists",
    """SELECT 2024 AS year, n_name AS state, 1 AS rank, n_name||' Park' AS attraction FROM nation UNION ALL SELECT 2024, n_name, 2, n_name||' Hill' FROM nation
    UNION ALL SELECT 2024, n_name||' '||r_name, 1, r_name||' Bay' FROM nation JOIN region ON n_regionkey=r_regionkey""",
)
def side_by_side_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a sheet with two tables beside each other, under headers, stacked into one."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own, beside = F.col("n_name"), F.concat("n_name", F.lit(" "), "r_name")

    def cell(col: int, value: Column) -> Column:
        return F.struct(F.lit(col).alias("col"), value.alias("value"))

    listed = F.concat(F.lit("1. "), own, F.lit(" Park\n2) "), own, F.lit(" Hill\n3. x"))
    cells = rows.select((F.col("n_nationkey").cast("int") + 2).alias("row"), F.inline(F.array(
        cell(1, own), cell(2, listed), cell(6, beside), cell(7, F.concat(F.lit("1. "), "r_name", F.lit(" Bay")))
    )))
    heads = rows.agg(F.lit(1).alias("row")).select("row", F.inline(F.array(
        cell(1, F.lit("Negeri")), cell(2, F.lit("1. Tarikan")), cell(6, F.lit("Jumlah")), cell(7, F.lit("1. Tarikan"))
    )))
    sheet = cells.unionByName(heads).withColumns({"year": F.lit(2024), "sheet": F.lit("8a")})
    return survey.ranked_lists(sheet, "8a", "attraction")


@query("marked_csv", "SELECT n_name AS market, CASE WHEN count(*)%2=0 THEN count(*)::VARCHAR END AS searches FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1")
def marked_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts stored as CSV whose header starts with a byte-order mark and whose gaps read N/A."""
    n = F.count(F.lit(1))
    rows = customer_nation(spark, sf_dir).groupBy("market").agg(F.when(n % 2 == 0, n.cast("string")).otherwise("N/A").alias("searches"))
    folder = shared_path(spark, "marked")
    sinks.write_csv(rows.toDF(f"{BOM}market", "searches"), folder)
    return csv_text(spark, folder)


_LEVELS = [(p.upper(), p) for p in ("Urgent", "High", "Medium", "Not Specified", "Low")]


@query(
    "report_folder",
    """WITH o AS (SELECT year(o_orderdate)::INTEGER AS year, 'Q'||quarter(o_orderdate) AS period, o_orderpriority[3:] AS level, count(*) AS n FROM orders GROUP BY ALL)
    SELECT 'AOR_'||year||'_'||period AS source_file, year, period, CASE WHEN level='NOT SPECIFIED' THEN 'Not Specified' ELSE level[1]||lower(level[2:]) END AS state,
      n::DOUBLE AS average_occupancy_rate_pct, NULL::VARCHAR AS reason FROM o
    UNION ALL SELECT DISTINCT 'AOR_undated_'||period, NULL, NULL, NULL, NULL, 'no year in file name' FROM o""",
)
def report_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly order counts as report files in the shared folder, one name broken over lines, with reports that cannot be dated."""
    date = F.col("o_orderdate")
    orders = table(spark, sf_dir, "orders").select(
        F.year(date).alias("year"), F.concat(F.lit("Q"), F.quarter(date).cast("string")).alias("period"), F.substring("o_orderpriority", 3, 20).alias("level")
    )
    counts = orders.groupBy("year", "period", "level").agg(F.count(F.lit(1)).cast("string").alias("n"))
    broken = F.concat(F.lit("NOT\n 7.5 "), F.col("n"), F.lit("\nSPECIFIED"))
    lines = counts.withColumn("line", F.when(F.col("level") == "NOT SPECIFIED", broken).otherwise(F.concat_ws(" ", "level", F.lit("7.5"), "n")))

    def written(name, *keys: str) -> DataFrame:
        text = F.array_join(F.sort_array(F.collect_list("line")), "\n")  # five lines a quarter
        return lines.groupBy(*keys).agg(text.alias("text")).select(name.alias("report"), "text")

    dated = written(F.concat_ws("_", F.lit("AOR"), F.col("year").cast("string"), "period"), "year", "period")
    undated = written(F.concat_ws("_", F.lit("AOR_undated"), "period"), "period")
    path = shared_path(spark, "reports")
    dated.unionByName(undated).write.partitionBy("report").text(path)
    texts = report_texts(spark, path, "report")
    rates = reports.occupancy_rates(texts, _LEVELS, ("NOT", "SPECIFIED")).withColumn("reason", F.lit(None).cast("string"))
    failed = reports.failed_files(texts).withColumnRenamed("file_name", "source_file")
    return rates.unionByName(failed, allowMissingColumns=True)
