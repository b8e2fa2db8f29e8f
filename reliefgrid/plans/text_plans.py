"""Report lines, survey cells and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.functions import text as tx
from reliefgrid.functions.numeric import parse_number, rnd
from reliefgrid.functions.text import words
from reliefgrid.operators import lookup, reports, survey
from reliefgrid.plans.mapping import customer_nation, table
from reliefgrid.plans.registry import query
from reliefgrid.plans.sqltext import r
from reliefgrid.session import cut_lineage

# words searched in the documents, in order, with the group they stand for
ALIASES = [("license", "License"), ("token", "Token"), ("the", "English"), ("la", "French"), ("der", "German"), ("el", "Spanish")]
_ALIAS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(line, '(?i)(^|\\W){a}(\\W|$)') THEN '{n}'" for a, n in ALIASES) + " END"
_NUMBER_RE = "^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$"
_TOKENS = "list_filter(regexp_split_to_array(line,'\\s+'), lambda t: t<>'')"
_CLEAN = "list_transform({0}, lambda t: regexp_replace(trim(regexp_replace(t,'[,%]','','g')),'^\\((.*)\\)$','-\\1'))".format(_TOKENS)
_COUNTS = "list_transform(list_filter(list_transform({0}, lambda t: trim(replace(t,',',''))), lambda t: regexp_matches(t,'^\\d{{1,18}}$')), lambda t: t::BIGINT)".format(_TOKENS)

# lines: every line of every document; the file name carries a year and a quarter made from the document number
LINES = """doc AS (SELECT doc_id, 'REPORT_'||(2017+doc_id%10)||CASE WHEN doc_id%3=0 THEN '' ELSE '_Q'||(doc_id%4+1) END||'_'||lpad(doc_id::VARCHAR,9,'0') AS file_name,
    (2017+doc_id%10)::INTEGER AS year, CASE WHEN doc_id%3=0 THEN 'Annual' ELSE 'Q'||(doc_id%4+1) END AS period, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT file_name, year, period, unnest(range(0,len(ls))) AS line_no, unnest(ls) AS line FROM doc)"""


def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    quarter = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("_Q"), (key % 4 + 1).cast("string")))
    name = F.concat(F.lit("REPORT_"), (key % 10 + 2017).cast("string"), quarter, F.lit("_"), F.lpad(key.cast("string"), 9, "0"))
    return table(spark, sf_dir, "documents").select(name.alias("file_name"), "text")


@query(
    "occupancy_lines",
    f"""WITH {LINES}, t AS (SELECT *, {_ALIAS_SQL} AS state, list_transform(list_filter({_CLEAN}, lambda t: regexp_matches(t,'{_NUMBER_RE}')), lambda t: t::DOUBLE) AS n FROM lines),
    v AS (SELECT *, CASE WHEN year BETWEEN 2017 AND 2021 THEN coalesce(n[2],n[1]) WHEN year=2022 THEN n[1] ELSE n[-1] END AS v FROM t WHERE state IS NOT NULL AND len(n)>0),
    k AS (SELECT *, row_number() OVER (PARTITION BY year, period, state ORDER BY file_name, line_no) AS rn FROM v WHERE v>0)
    SELECT file_name AS source_file, year, period, state, {r('v',1)} AS average_occupancy_rate_pct FROM k WHERE rn=1""",
)
def occupancy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.occupancy_rates(report_texts(spark, sf_dir), ALIASES)


@query(
    "inventory_lines",
    f"""WITH {LINES}, t AS (SELECT *, {_ALIAS_SQL} AS state, {_COUNTS} AS n FROM lines),
    k AS (SELECT *, row_number() OVER (PARTITION BY year, period, state ORDER BY file_name, line_no) AS rn FROM t WHERE state IS NOT NULL AND len(n)>0)
    SELECT file_name AS source_file, year, period, state, n[-2] AS hotels_count, n[-1] AS rooms_count FROM k WHERE rn=1""",
)
def inventory_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hotel_inventory(report_texts(spark, sf_dir), ALIASES)


@query(
    "guest_lines",
    f"""WITH {LINES}, t AS (SELECT *, {_ALIAS_SQL} AS state, list_filter({_COUNTS}, lambda t: t>0) AS n FROM lines),
    k AS (SELECT *, row_number() OVER (PARTITION BY year, period, state ORDER BY file_name, line_no) AS rn FROM t WHERE state IS NOT NULL AND len(n)>=2)
    SELECT file_name AS source_file, year, period, state, n[1] AS domestic_guests, n[2] AS foreign_guests, coalesce(n[3], n[1]+n[2]) AS total_guests FROM k WHERE rn=1""",
)
def guest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hotel_guests(report_texts(spark, sf_dir), ALIASES, above=0)


@query(
    "arrival_lines",
    f"""WITH {LINES}, t AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)(^|\\W)the(\\W|$)') THEN 'The' WHEN regexp_matches(line, '(?i)(^|\\W)les(\\W|$)') THEN 'Les' WHEN regexp_matches(line, '(?i)(^|\\W)und(\\W|$)') THEN 'Und' END AS market, {_COUNTS} AS n FROM lines),
    k AS (SELECT *, row_number() OVER (PARTITION BY year, market ORDER BY file_name, line_no) AS rn FROM (SELECT *, list_filter(n, lambda t: t>500)[1] AS c FROM t) u WHERE market IS NOT NULL AND c IS NOT NULL)
    SELECT file_name AS source_file, year, 'annual' AS month, 'tourist' AS arrival_type, market AS origin_market, c AS arrivals_count FROM k WHERE rn=1""",
)
def arrival_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.arrivals(report_texts(spark, sf_dir), markets=["THE", "LES", "UND"])


@query(
    "failed_files",
    "SELECT url AS file_name, CASE WHEN NOT regexp_matches(url,'[0-9]{4}') THEN 'no year in file name' ELSE 'no text' END AS reason FROM pages WHERE NOT regexp_matches(url,'[0-9]{4}') OR html IS NULL OR trim(html)=''",
)
def failed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failed_files(table(spark, sf_dir, "pages").select(F.col("url").alias("file_name"), F.col("html").alias("text")))


@query(
    "file_names",
    """SELECT page_id, try_cast(nullif(regexp_extract(url,'[0-9]{4}',0),'') AS INTEGER) AS year, CASE WHEN regexp_extract(url,'Q[1-4]',0)<>'' THEN regexp_extract(url,'Q[1-4]',0) ELSE 'Annual' END AS period,
    coalesce("""
    + ", ".join(f"CASE WHEN contains(lower(url),'{m}') THEN '{m.upper()}' END" for m in tx.MONTH_TAGS)
    + """, 'annual') AS month, CASE WHEN contains(lower(url),'excursionist') THEN 'excursionist' WHEN contains(lower(url),'visitor') THEN 'visitor' ELSE 'tourist' END AS arrival_type FROM pages""",
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", tx.file_year("url").alias("year"), tx.file_period("url").alias("period"), tx.file_month("url").alias("month"),
        tx.file_arrival_type("url").alias("arrival_type"),
    )


@query(
    "number_cleanup",
    f"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text,'\\s+'), lambda t: t<>'')) AS tok FROM documents),
    c AS (SELECT doc_id, regexp_replace(trim(regexp_replace(tok,'[,%]','','g')),'^\\((.*)\\)$','-\\1') AS c FROM t)
    SELECT doc_id, count(*) AS number_count, max(c::DOUBLE) AS largest FROM c WHERE regexp_matches(c,'{_NUMBER_RE}') GROUP BY doc_id""",
)
def number_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = F.filter(F.transform(words("text"), parse_number), lambda n: n.isNotNull())
    found = table(spark, sf_dir, "documents").select("doc_id", numbers.alias("numbers")).where(F.size("numbers") > 0)
    return found.select("doc_id", F.size("numbers").cast("long").alias("number_count"), F.array_max("numbers").alias("largest"))


@query(
    "ranked_items",
    """WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x<>'') AS ls FROM conversations),
    i AS (SELECT conv_id, turn, unnest(range(1,len(ls)+1))::INTEGER AS rank, unnest(ls) AS item FROM l),
    c AS (SELECT conv_id, turn, rank, trim(regexp_replace(item,'^\\d+[.)]\\s*','')) AS item FROM i)
    SELECT conv_id, turn, rank, item FROM c WHERE length(item)>1""",
)
def ranked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(survey.ranked_items(F.col("text"))).alias("i"))
    return cells.select("conv_id", "turn", F.col("i.rank").alias("rank"), F.col("i.item").alias("item"))


def _sheet(df: DataFrame, year: str, row, col, value) -> DataFrame:
    return df.select(F.col(year).alias("year"), F.lit("10").alias("sheet"), row.cast("int").alias("row"), col.cast("int").alias("col"), value.cast("string").alias("value"))


@query(
    "origin_destination",
    """SELECT year(o_orderdate)::INTEGER AS year, 'state '||cn.n_nationkey AS origin_state, 'state '||sn.n_nationkey AS destination_state, sum(l_quantity) AS tourists_thousands
    FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN nation cn ON c_nationkey=cn.n_nationkey JOIN supplier ON l_suppkey=s_suppkey JOIN nation sn ON s_nationkey=sn.n_nationkey GROUP BY 1,2,3""",
)
def origin_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows laid out as a matrix sheet per year, then read back from the cells."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    buyers = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year")).join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    sold = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("year", "c_nationkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    flows = sold.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("year", "c_nationkey", "s_nationkey").agg(F.sum("q").alias("q"))
    flows = cut_lineage(flows)  # years x nations x nations
    years = flows.select("year").distinct()
    keys = F.explode(F.sequence(F.lit(0), F.lit(24))).alias("k")
    heads = years.select("year", keys).select("year", "k", F.concat(F.lit("state "), F.col("k").cast("string")).alias("name"))
    cells = (
        _sheet(years, "year", F.lit(0), F.lit(0), F.lit("Jadual 10"))
        .unionByName(_sheet(heads, "year", F.lit(2), F.col("k") + 4, F.col("name")))
        .unionByName(_sheet(heads, "year", F.col("k") + 3, F.lit(1), F.col("name")))
        .unionByName(_sheet(years, "year", F.lit(28), F.lit(1), F.lit("Jumlah state")))
        .unionByName(_sheet(flows, "year", F.col("c_nationkey") + 3, F.col("s_nationkey") + 4, F.format_string("%,.1f", F.col("q"))))
    )
    return survey.origin_destination(cells, state_words=["state"], anchors=("state 0", "state 1"), body_rows=26)


@query(
    "unpivot_ranks",
    """WITH c AS (SELECT year(o_orderdate)::INTEGER AS year, strftime(o_orderdate,'%B') AS month, n_name AS state, count(*) AS n FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2,3),
    k AS (SELECT *, row_number() OVER (PARTITION BY year, month ORDER BY n DESC, state) AS rank FROM c) SELECT year, month, rank::INTEGER AS rank, state FROM k WHERE rank<=5""",
)
def unpivot_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five busiest states of every month as rank columns, then as rows."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("Year"), F.date_format("o_orderdate", "MMMM").alias("Month")).agg(
        F.count(F.lit(1)).alias("n")
    )
    counts = per.join(customer_nation(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).groupBy("Year", "Month", "market").agg(F.sum("n").alias("n"))
    # one row per state and month
    best = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), F.col("market"))))["market"]
    wide = counts.groupBy("Year", "Month").agg(best.alias("b"))
    wide = wide.select("Year", "Month", *[F.coalesce(F.get("b", F.lit(i)), F.lit("0")).alias(f"Rank {i + 1}") for i in range(5)])
    return survey.search_ranks(wide)


@query(
    "component_cells",
    f"""WITH t AS (SELECT year(o_orderdate)::INTEGER AS year, o_orderpriority AS component, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v, count(*) AS n FROM orders GROUP BY 1,2)
    SELECT year, component, {r('v',2)} AS value_1, n*1e0 AS value_2 FROM t WHERE regexp_matches(lower(component),'urgent|high|low')""",
)
def component_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals written as cells of a component sheet, then read back by keyword."""
    sums = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("c")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"), F.count(F.lit(1)).alias("n")
    )
    row = F.substring("c", 1, 1).cast("int") + 4
    label = F.concat(F.col("c"), F.lit("\n"), F.lit("(english name)"))
    cells = F.array(
        F.struct(F.lit(0).alias("col"), label.alias("value")), F.struct(F.lit(1).alias("col"), F.lit("RM").alias("value")),
        F.struct(F.lit(2).alias("col"), F.format_string("%,.2f", F.col("v").cast("double")).alias("value")),
        F.struct(F.lit(3).alias("col"), F.col("n").cast("string").alias("value")),
    )
    sheet = sums.select("year", F.lit("6").alias("sheet"), row.alias("row"), F.inline(cells))
    return survey.spending_components(sheet, words=["urgent", "high", "low"]).drop("row")


@query(
    "year_series_cells",
    "SELECT n_name AS state, year(o_orderdate)::INTEGER AS year, count(*)*1e0 AS visitors FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2",
)
def year_series_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    home = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = per.join(home, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_nationkey", "n_name", "year").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts)  # nations x years

    def cell(df, row, col, value):
        return df.select(F.lit("1").alias("sheet"), row.cast("int").alias("row"), col.cast("int").alias("col"), value.cast("string").alias("value"))

    years, names = counts.select("year").distinct(), counts.select("n_nationkey", "n_name").distinct()
    sheet = (
        cell(years, F.lit(3), F.col("year") - 1990, F.col("year"))
        .unionByName(cell(names, F.col("n_nationkey") + 4, F.lit(0), F.col("n_name")))
        .unionByName(cell(years, F.lit(40), F.lit(0), F.lit("Jumlah")))
        .unionByName(cell(years, F.lit(40), F.col("year") - 1990, F.lit("1")))
        .unionByName(cell(counts, F.col("n_nationkey") + 4, F.col("year") - 1990, F.format_string("%,d", F.col("n"))))
    )
    return survey.year_header_series(sheet, "1", "visitors")


@query(
    "word_overlap",
    """WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(string_split(text,'(')[1]),'[a-z]+'), lambda x: len(x)>4)) AS ws FROM benchmark)
    SELECT item_id, len(ws)::INTEGER AS word_count, coalesce(list_sort(ws)[1],'') AS first_word FROM w""",
)
def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", tx.zone_words("text", F.lit("")).alias("w"))
    return rows.select("item_id", F.size("w").alias("word_count"), F.coalesce(F.get(F.array_sort("w"), F.lit(0)), F.lit("")).alias("first_word"))


_STATE_SQL = "CASE trim(v) WHEN 'KL' THEN 'W.P. Kuala Lumpur' WHEN 'Penang' THEN 'Pulau Pinang' WHEN 'Labuan' THEN 'W.P. Labuan' ELSE trim(v) END"


@query(
    "state_names",
    f"""WITH s AS (SELECT s_suppkey, (['KL ',' Penang','Labuan','Johor'])[s_suppkey%4+1] AS v FROM supplier)
    SELECT s_suppkey, {_STATE_SQL} AS state, lower(trim(replace({_STATE_SQL},'W.P. ',''))) AS state_key,
    CASE {_STATE_SQL} WHEN 'Pulau Pinang' THEN true WHEN 'W.P. Kuala Lumpur' THEN true WHEN 'Johor' THEN true ELSE false END AS in_west_coast,
    CASE WHEN s_suppkey%2=0 THEN 'S.P.Tengah' ELSE 'Kinta' END AS district FROM s""",
)
def state_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    spelled = F.get(F.array(F.lit("KL "), F.lit(" Penang"), F.lit("Labuan"), F.lit("Johor")), (key % 4).cast("int"))
    district = F.when(key % 2 == 0, "Seberang Perai TENGAH ").otherwise("Kinta")
    named = table(spark, sf_dir, "supplier").select(key, tx.state_name(spelled).alias("state"), tx.district_name(district).alias("district"))
    return named.select(
        "s_suppkey", "state", tx.state_key("state").alias("state_key"),
        F.array_contains(lookup.cluster_states(F.lit("west-coast")), F.col("state")).alias("in_west_coast"), "district",
    )
