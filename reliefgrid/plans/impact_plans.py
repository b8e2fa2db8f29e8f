"""Spending impact, market matrix and input-output multipliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.functions.capacity import congested_multiplier
from reliefgrid.functions.numeric import rnd
from reliefgrid.operators import impact, market, multipliers
from reliefgrid.plans.mapping import customer_nation, money, places, table
from reliefgrid.plans.registry import query
from reliefgrid.plans.sqltext import PLACES, r
from reliefgrid.session import cut_lineage, shared_path
from reliefgrid.sources import sinks
from reliefgrid.sources.readers import multiplier_json

# raw: long spending table; markets are customer nations, categories are order priorities
CATEGORY_NAMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
RAW = f"""
cell AS (SELECT year(o_orderdate)::INTEGER AS year, n_name AS market, CASE WHEN o_orderstatus='F' AND year(o_orderdate)%4<>0 THEN 'Visitors' WHEN o_orderstatus IN ('F','O') THEN 'Tourists' ELSE 'Other' END AS audience, o_orderpriority AS category,
    sum(o_totalprice::DECIMAL(18,2))::DOUBLE/1e6 AS v FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2,3,4),
tot AS (SELECT year, market, audience, {r('sum(v)',6)} AS v FROM cell GROUP BY 1,2,3 UNION ALL SELECT year, 'Overall', audience, {r('sum(v)',6)} FROM cell GROUP BY 1,3),
shr AS (SELECT year, market, audience, category, {r('sum(v)/sum(sum(v)) OVER (PARTITION BY year, market, audience)*100e0',4)} AS pct FROM cell GROUP BY 1,2,3,4
  UNION ALL SELECT year, 'Overall', audience, category, {r('sum(v)/sum(sum(v)) OVER (PARTITION BY year, audience)*100e0',4)} FROM cell GROUP BY 1,3,4),
pt AS (SELECT * FROM tot WHERE audience=CASE WHEN year IN (SELECT year FROM tot WHERE audience='Visitors') THEN 'Visitors' ELSE 'Tourists' END),
ps AS (SELECT * FROM shr WHERE audience=CASE WHEN year IN (SELECT year FROM shr WHERE audience='Visitors') THEN 'Visitors' ELSE 'Tourists' END),
matrix AS (SELECT year, market, 'All spending categories' AS spending_category, {r('v',2)} AS value_rm_million, 100e0 AS percentage_share FROM pt
  UNION ALL SELECT ps.year, ps.market, category, {r('pct/100e0*coalesce(pt.v,0e0)',3)}, {r('pct',2)} FROM ps LEFT JOIN pt ON pt.year=ps.year AND pt.market=ps.market)"""


def raw_spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total rows and share rows in one long table."""
    status = F.col("o_orderstatus")
    # leap years have no visitors, so that they fall back to tourists
    visitors = (status == "F") & (F.year("o_orderdate") % 4 != 0)
    audience = F.when(visitors, "Visitors").when(status.isin("F", "O"), "Tourists").otherwise("Other")
    per = table(spark, sf_dir, "orders").groupBy(
        "o_custkey", F.year("o_orderdate").alias("year"), audience.alias("audience"), F.col("o_orderpriority").alias("category")
    ).agg(F.sum(money("o_totalprice")).alias("v"))
    cells = per.join(customer_nation(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).groupBy("year", "market", "audience", "category").agg(
        (F.sum("v").cast("double") / 1e6).alias("v")
    )
    # years x nations x audiences x categories: small, and read by totals and shares
    cells = cut_lineage(cells)
    with_overall = cells.withColumn("market", F.explode(F.array(F.col("market"), F.lit("Overall"))))
    totals = with_overall.groupBy("year", "market", "audience").agg(F.sum("v").alias("total"))
    shares = with_overall.groupBy("year", "market", "audience", "category").agg(F.sum("v").alias("v")).join(totals, ["year", "market", "audience"])
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    total_rows = totals.select(
        "year", "market", "audience", F.lit("Total expenditure").alias("metric_group"), F.lit("Full year").alias("period_type"),
        text.alias("selected_period"), text.alias("spending_category"), none.alias("value_numeric"), text.alias("value_display"),
        rnd("total", 6).alias("value_rm_million"), F.lit(1).alias("row_id"),
    )
    share_rows = shares.select(
        "year", "market", "audience", F.lit("Expenditure components share").alias("metric_group"), F.lit("Part").alias("period_type"),
        F.lit("Jan-Dec").alias("selected_period"), F.col("category").alias("spending_category"),
        rnd(F.col("v") / F.col("total") * 100.0, 4).alias("value_numeric"), text.alias("value_display"), none.alias("value_rm_million"), F.lit(1).alias("row_id"),
    )
    return total_rows.unionByName(share_rows)


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.market_matrix(raw_spending(spark, sf_dir), categories=CATEGORY_NAMES)


@query("market_matrix", f"WITH {RAW} SELECT * FROM matrix")
def market_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir)


@query(
    "top_markets",
    f"""WITH {RAW} SELECT market, value_rm_million, {r("value_rm_million/(SELECT value_rm_million FROM matrix WHERE year=2000 AND market='Overall' AND spending_category='All spending categories')*100e0",6)} AS share_percent
    FROM matrix WHERE year=2000 AND market<>'Overall' AND spending_category='All spending categories' ORDER BY value_rm_million DESC, market LIMIT 10""",
)
def top_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = market.top_markets(matrix(spark, sf_dir), year=2000)
    return out.select("market", "value_rm_million", rnd("share_percent", 6).alias("share_percent"))


@query(
    "market_breakdown_fallback",
    f"""WITH {RAW}, req AS (SELECT upper(n_name) AS requested FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT 'All Markets'),
    t AS (SELECT requested, CASE WHEN lower(requested) IN (SELECT lower(market) FROM matrix WHERE year=2000 AND spending_category<>'All spending categories') THEN lower(requested) ELSE 'overall' END AS k FROM req)
    SELECT requested, market, spending_category, percentage_share, value_rm_million FROM t JOIN matrix ON lower(market)=k WHERE year=2000 AND spending_category<>'All spending categories'""",
)
def market_breakdown_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.upper("n_name").alias("requested")).unionByName(
        table(spark, sf_dir, "region").select(F.col("r_name").alias("requested"))
    )
    asked = names.unionByName(table(spark, sf_dir, "region").agg(F.lit("All Markets").alias("requested")))
    return market.market_breakdown(matrix(spark, sf_dir), asked, year=2000)


@query("national_breakdown", f"WITH {RAW} SELECT spending_category, percentage_share, value_rm_million FROM matrix WHERE year=2000 AND market='Overall' AND spending_category<>'All spending categories'")
def national_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.national_breakdown(matrix(spark, sf_dir), 2000).select("spending_category", "percentage_share", "value_rm_million")


@query("market_series", f"WITH {RAW} SELECT year, value_rm_million FROM matrix WHERE market='Overall' AND spending_category='All spending categories'")
def market_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.market_series(matrix(spark, sf_dir), "Overall").select("year", "value_rm_million")


_MODE = "CASE mode WHEN 'inbound' THEN {1} WHEN 'blended' THEN {2} ELSE {0} END"


def _mode(index: int) -> str:
    return _MODE.format(*[f"{impact.MODES[m][index]}e0" for m in ("domestic", "inbound", "blended")])


_SPEND = f"""sc AS (SELECT destination_id, mode, pct, greatest(500e0,excess_demand)*(pct/100e0) AS daily, excess_demand, continuous_pressure, poverty_rate FROM places,
    (VALUES ('domestic',25e0),('inbound',50e0),('blended',75e0)) m(mode,pct)),
run AS (SELECT *, daily*30*{_mode(0)}*{_mode(1)} AS direct, {_mode(2)} AS mult FROM sc)"""


def _impacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = F.array(*[F.struct(F.lit(m).alias("tourism_mode"), F.lit(p).alias("divert_pct")) for m, p in (("domestic", 25.0), ("inbound", 50.0), ("blended", 75.0))])
    base = places(spark, sf_dir).select(
        "destination_id", "excess_demand", F.col("continuous_pressure").alias("destination_pressure"), F.col("poverty_rate").alias("candidate_poverty"), F.inline(modes)
    )
    rows = impact.scenario_visitors(base).withColumns(
        {"days_period": F.lit(30), "alos": F.lit(2.45), "spend_per_night": F.lit(386.73), "hotspot_poverty": F.lit(2.0)}
    )
    return impact.impact(rows)


@query(
    "impact_scenarios",
    f"""WITH {PLACES},{_SPEND} SELECT destination_id, mode AS tourism_mode, {r('least(100e0,daily/greatest(1e0,excess_demand)*100e0)',4)} AS offset_pct, {r('daily*30')} AS total_tourist_trips, {r('direct/1e6',3)} AS direct_spend_million_rm,
      {r('direct*mult/1e6',3)} AS total_economic_output_million_rm, {r('direct*0.8151e0/1e6',3)} AS total_gdp_value_added_million_rm, {r('direct*2.9388e0/1e6',3)} AS total_type2_output_million_rm,
      {r('mult*(1e0-least(0.5e0,0.25e0*greatest(0e0,continuous_pressure-1e0)))',4)} AS capacity_adjusted_multiplier,
      {r('direct*least(0.65e0,0.35e0+0.03e0*ln(1e0+greatest(1e0,poverty_rate/2e0)))/1e6',3)} AS estimated_b40_income_million_rm FROM run""",
)
def impact_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _impacted(spark, sf_dir)
    return out.select(
        "destination_id", "tourism_mode", rnd("offset_pct", 4).alias("offset_pct"), "total_tourist_trips", "direct_spend_million_rm",
        "total_economic_output_million_rm", "total_gdp_value_added_million_rm", "total_type2_output_million_rm", "capacity_adjusted_multiplier",
        "estimated_b40_income_million_rm",
    )


_CATS = ", ".join(
    f"('{c}',{d}e0,{i}e0)" for c, d, i in zip(market.CATEGORIES, impact.DOMESTIC_SHARES, impact.INBOUND_SHARES)
)
_CAT_SHARE = f"CASE mode WHEN 'inbound' THEN i WHEN 'blended' THEN {r('d*0.5e0+i*0.5e0',4)} ELSE d END"


@query(
    "category_split",
    f"""WITH {PLACES},{_SPEND}, cats(c,d,i) AS (VALUES {_CATS}) SELECT destination_id, mode AS tourism_mode, c AS spending_category, {r(f'direct*({_CAT_SHARE})',2)} AS amount_rm FROM run, cats""",
)
def category_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.category_split(_impacted(spark, sf_dir)).select("destination_id", "tourism_mode", "spending_category", "amount_rm")


@query(
    "sector_split",
    f"""WITH {PLACES},{_SPEND}, cats(c,d,i) AS (VALUES {_CATS}), sh AS (SELECT mode, c, {_CAT_SHARE} AS s FROM cats, (VALUES ('domestic'),('inbound'),('blended')) m(mode)),
    sec(sector,c,dom) AS (VALUES {", ".join(f"('{s}','{c}',{dom}e0)" for s, (members, dom) in impact.SECTORS.items() for c in members)}),
    g AS (SELECT mode, sector, CASE WHEN mode='domestic' THEN max(dom) ELSE sum(s) END AS s FROM sh JOIN sec USING (c) GROUP BY 1,2)
    SELECT destination_id, mode AS tourism_mode, """
    + ", ".join(f"{r(f'direct*max(s) FILTER (WHERE sector={chr(39)}{s}{chr(39)})', 2)} AS {s}" for s in impact.SECTORS)
    + " FROM run JOIN g USING (mode) GROUP BY destination_id, mode, direct",
)
def sector_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.sector_split(_impacted(spark, sf_dir)).select("destination_id", "tourism_mode", *impact.SECTORS)


@query(
    "fiscal_ratios",
    f"""WITH {PLACES},{_SPEND} SELECT destination_id, mode AS tourism_mode, {r('daily*30',4)} AS total_trips, {r(r('direct/1e6',3)+'*1e6/greatest(1e0,excess_demand*100e0)',4)} AS fiscal_roi, {r(r('direct/1e6',3)+'*0.10e0',4)} AS tax_yield_million_rm FROM run""",
)
def fiscal_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _impacted(spark, sf_dir).withColumn("estimated_subsidy_rm", F.col("excess_demand") * 100.0)
    out = impact.fiscal_ratios(rows)
    return out.select("destination_id", "tourism_mode", *[rnd(c, 4).alias(c) for c in ("total_trips", "fiscal_roi", "tax_yield_million_rm")])


@query("congestion_damping", f"WITH {PLACES} SELECT destination_id, {r('1.75e0*(1e0-least(0.5e0,0.25e0*greatest(0e0,continuous_pressure-1e0)))',4)} AS effective_multiplier FROM places")
def congestion_damping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).select("destination_id", congested_multiplier(F.lit(1.75), "continuous_pressure").alias("effective_multiplier"))


# io: nations trade with each other; output is 2.5 times purchases, so each round leaves two fifths of the last change
ROUNDS = 30
_IO = """z AS (SELECT year(o_orderdate)::INTEGER AS year, sn.n_name AS i, cn.n_name AS j, sum(l_quantity) AS z FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
   JOIN nation cn ON c_nationkey=cn.n_nationkey JOIN supplier ON l_suppkey=s_suppkey JOIN nation sn ON s_nationkey=sn.n_nationkey GROUP BY 1,2,3),
s AS (SELECT year, j, sum(z)*2.5e0 AS x, sum(z)*0.9e0 AS gva, sum(z)*0.6e0 AS wages, sum(z)*0.5e0 AS cons FROM z GROUP BY 1,2),
n AS (SELECT year, j, gva/x AS v, wages/x AS w, cons/sum(wages) OVER (PARTITION BY year) AS c FROM s),
a AS (SELECT z.year, i, z.j, z/x AS a FROM z JOIN s ON s.year=z.year AND s.j=z.j),
t0 AS (SELECT year, j, 1e0 AS r, v AS g, w AS h FROM n)""" + "".join(
    f""",
t{k} AS (SELECT n.year, n.j, 1e0+coalesce(p.r,0e0) AS r, n.v+coalesce(p.g,0e0) AS g, n.w+coalesce(p.h,0e0) AS h FROM n LEFT JOIN
  (SELECT a.year, a.j, sum(a*r) AS r, sum(a*g) AS g, sum(a*h) AS h FROM a JOIN t{k - 1} t ON t.year=a.year AND t.j=a.i GROUP BY 1,2) p ON p.year=n.year AND p.j=n.j)"""
    for k in range(1, ROUNDS + 1)
) + f""",
cl AS (SELECT t.year, sum(r*c) AS rc, sum(g*c) AS gc, sum(h*c) AS hc FROM t{ROUNDS} t JOIN n ON n.year=t.year AND n.j=t.j GROUP BY 1),
m AS (SELECT t.year, t.j, r AS type1_output, g AS type1_gva, r+rc*(h/(1e0-hc)) AS type2_output, g+gc*(h/(1e0-hc)) AS type2_gva FROM t{ROUNDS} t JOIN cl ON cl.year=t.year)"""


def _trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    buyers = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year")).join(
        customer_nation(spark, sf_dir).withColumnRenamed("market", "j"), F.col("o_custkey") == F.col("c_custkey")
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    sold = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("year", "l_suppkey", "j").agg(F.sum("l_quantity").alias("z"))
    makers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("i")
    )
    edges = cut_lineage(sold.join(makers, "l_suppkey").groupBy("year", "i", "j").agg(F.sum("z").alias("z")))  # years x nations x nations
    bought = F.sum("z")
    sectors = edges.groupBy("year", "j").agg(
        (bought * 2.5).alias("x"), (bought * 0.9).alias("gva"), (bought * 0.6).alias("wages"), (bought * 0.5).alias("consumption")
    )
    return edges, sectors


@query("multipliers_iterated", f"WITH {_IO} SELECT year, j, {', '.join(f'{r(c, 6)} AS {c}' for c in multipliers.MEASURES)} FROM m")
def multipliers_iterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = multipliers.multipliers(*_trade(spark, sf_dir))
    return out.select("year", "j", *[rnd(c, 6).alias(c) for c in multipliers.MEASURES])


@query(
    "composite_multiplier",
    f"""WITH {_IO}, w AS (SELECT n_name AS j, n_nationkey+1e0 AS weight FROM nation),
    y AS (SELECT year, {', '.join(f'{r(f"sum(weight*{c})/sum(weight)", 4)} AS {c}_multiplier' for c in multipliers.MEASURES)} FROM m JOIN w USING (j) GROUP BY year)
    SELECT q AS requested_year, y.* EXCLUDE (year), y.year AS used_year FROM (SELECT unnest([1999,2000,2030])::INTEGER AS q) q LEFT JOIN y ON y.year=CASE WHEN q IN (SELECT year FROM y) THEN q ELSE NULL END""",
)
def composite_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, sectors = _trade(spark, sf_dir)
    sector_table = multipliers.multipliers(edges, sectors)
    weights = table(spark, sf_dir, "nation").select(F.col("n_name").alias("j"), (F.col("n_nationkey") + 1.0).alias("weight"))
    yearly = cut_lineage(multipliers.composite(sector_table, weights))  # one row per year
    asked = yearly.agg(F.array(F.lit(1999), F.lit(2000), F.lit(2030)).alias("q")).select(F.explode("q").alias("year"))
    return multipliers.for_years(asked, yearly)


@query("sector_multipliers", f"WITH {_IO} SELECT year, j, {r('type1_output', 6)} AS type1_output, year = 1998 AS whole_year FROM m WHERE year = 1998 OR (year = 2000 AND j = 'FRANCE')")
def sector_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sectors of one year, and one sector of another."""
    every = cut_lineage(multipliers.multipliers(*_trade(spark, sf_dir)))
    rows = multipliers.sector_rows(every, 1998).withColumn("whole_year", F.lit(True)).unionByName(
        multipliers.sector_rows(every, 2000, "FRANCE").withColumn("whole_year", F.lit(False))
    )
    return rows.select("year", "j", rnd("type1_output", 6).alias("type1_output"), "whole_year")


# a copy of every table a thousand years on whose buyers spend three times as much on the same output: each round adds more than the last
_LATER, _TOO_MUCH, _STEPS = 1000, 3.0, 8


def _with_diverging(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges, sectors = _trade(spark, sf_dir)
    later = (F.col("year") + _LATER).alias("year")
    return (
        edges.unionByName(edges.select(later, "i", "j", (F.col("z") * _TOO_MUCH).alias("z"))),
        sectors.unionByName(sectors.select(later, "j", "x", "gva", "wages", "consumption")),
    )


@query(
    "multiplier_status",
    f"""WITH {_IO} SELECT year, 6::INTEGER AS steps, true AS converged, count(*) AS sector_count, {r('sum(type1_output)', 6)} AS total_type1 FROM m GROUP BY year
    UNION ALL SELECT DISTINCT (year+{_LATER})::INTEGER, {_STEPS}::INTEGER, false, 0::BIGINT, NULL FROM z""",
)
def multiplier_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables solved together; those that diverge are reported, the others are there."""
    rows, status = multipliers.all_multipliers(*_with_diverging(spark, sf_dir), steps=_STEPS)
    sums = rows.groupBy("year").agg(F.count(F.lit(1)).alias("sector_count"), rnd(F.sum("type1_output"), 6).alias("total_type1"))
    return status.join(sums, "year", "left").select(
        "year", "steps", "converged", F.coalesce("sector_count", F.lit(0)).alias("sector_count"), "total_type1"
    )


@query(
    "multiplier_documents",
    f"""WITH {_IO}, w AS (SELECT n_name AS j, n_nationkey+1e0 AS weight FROM nation),
    y AS (SELECT year, {r('sum(weight*type2_output)/sum(weight)', 4)} AS composite_type2_output FROM m JOIN w USING (j) GROUP BY year)
    SELECT year, j, {', '.join(f'{r(c, 6)} AS {c}' for c in multipliers.MEASURES)}, composite_type2_output FROM m JOIN y USING (year)""",
)
def multiplier_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that converge, written as nested documents into the shared folder and read back by sector and as totals."""
    rows = multipliers.all_multipliers(*_with_diverging(spark, sf_dir), steps=_STEPS)[0].select(
        "year", "j", *[rnd(c, 6).alias(c) for c in multipliers.MEASURES]
    )
    weights = table(spark, sf_dir, "nation").select(F.col("n_name").alias("j"), (F.col("n_nationkey") + 1.0).alias("weight"))
    rows = cut_lineage(rows)
    folder = shared_path(spark, "multipliers")
    sinks.write_documents(multipliers.documents(rows, multipliers.composite(rows, weights)), folder)
    sectors, totals = multipliers.from_json(multiplier_json(spark, folder, lines=True))
    return sectors.join(totals, "year").select("year", "j", *multipliers.MEASURES, F.col("type2_output_multiplier").alias("composite_type2_output"))
