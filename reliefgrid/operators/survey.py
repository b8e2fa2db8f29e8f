"""Survey workbooks as cell tables (year, sheet, row, col, value) and search ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.functions.numeric import parse_number
from reliefgrid.functions.text import first_line
from reliefgrid.session import cut_lineage

# Header and note words, component keywords and state words of the survey sheets.
HEADER_PATTERN = r"^\s*(negeri|state|jumlah|total)\s*(/.*)?$|table|jadual|nota"
COMPONENT_WORDS = ["beli", "makan", "minum", "penginapan", "pengangkutan", "minyak", "pakej", "aktiviti", "hiburan",
                   "shopping", "food"]
STATE_WORDS = ["johor", "kedah", "kelantan", "melaka", "negeri", "pahang", "perak", "perlis", "pulau", "selangor",
               "terengganu", "sabah", "sarawak", "kuala lumpur", "labuan", "putrajaya"]
RANK_PREFIX = r"^\d+[.)]\s*"


def ranked_items(cell: Column | str) -> Column:
    """array(struct(rank, item)) from a multi-line cell: blanks dropped, '1.' / '2)' removed, single letters dropped."""
    lines = F.filter(F.transform(F.split(cell, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    numbered = F.transform(
        lines, lambda x, i: F.struct((i + 1).alias("rank"), F.trim(F.regexp_replace(x, RANK_PREFIX, "")).alias("item"))
    )
    return F.filter(numbered, lambda x: F.length(x["item"]) > 1)


def _beside(cells: DataFrame, name_col: int, value_col: int) -> DataFrame:
    """Name and value cells of one row, brought together by one aggregate over the row."""
    picked = cells.where(F.col("col").isin(name_col, value_col))

    def value_at(col: int) -> Column:
        return F.max(F.when(F.col("col") == col, F.col("value")))

    return picked.groupBy("year", "row").agg(value_at(name_col).alias("state"), value_at(value_col).alias("list"))


def ranked_lists(cells: DataFrame, sheet: str, out: str, blocks: tuple[tuple[int, int], ...] = ((1, 2), (6, 7))) -> DataFrame:
    """(year, state, rank, out) from side-by-side tables of a sheet, stacked."""
    rows = cells.where(F.col("sheet") == sheet)
    stacked = None
    for name_col, value_col in blocks:
        block = _beside(rows, name_col, value_col)
        stacked = block if stacked is None else stacked.unionByName(block)
    named = stacked.where(F.col("state").isNotNull() & F.col("list").isNotNull() & ~F.lower("state").rlike(HEADER_PATTERN))
    return named.select("year", F.trim("state").alias("state"), F.explode(ranked_items("list")).alias("_i")).select(
        "year", "state", F.col("_i.rank").alias("rank"), F.col("_i.item").alias(out)
    )


def spending_components(cells: DataFrame, sheet: str = "6", words: list[str] | None = None) -> DataFrame:
    """(year, component, value_1, value_2): first two numbers of every row whose first cell names a component."""
    rows = cells.where((F.col("sheet") == sheet) & (F.col("col") <= 5))
    number = parse_number(F.col("value"))
    label = F.max(F.when(F.col("col") == 0, F.col("value")))
    numbers = F.sort_array(F.collect_list(F.when((F.col("col") >= 1) & number.isNotNull(), F.struct("col", number.alias("n")))))
    grouped = rows.groupBy("year", "row").agg(label.alias("label"), numbers.alias("_n"))  # at most five numbers per row
    hit = F.lower("label").rlike("|".join(words or COMPONENT_WORDS))
    return grouped.where(hit & (F.size("_n") > 0)).select(
        "year", "row", first_line("label").alias("component"),
        F.get("_n", F.lit(0))["n"].alias("value_1"), F.get("_n", F.lit(1))["n"].alias("value_2"),
    )


def origin_destination(
    cells: DataFrame, sheet: str = "10", state_words: list[str] | None = None, anchors: tuple[str, str] = ("johor", "perak"),
    header_rows: int = 12, body_rows: int = 24,
) -> DataFrame:
    """(year, origin_state, destination_state, tourists_thousands) from a matrix sheet.

    The header is the first row that holds both anchor names; its state cells name the columns. Origins are the first
    state word within the first four columns of the rows below; total rows are skipped.
    """
    rows = cut_lineage(cells.where((F.col("sheet") == sheet) & F.col("value").isNotNull()))  # header, columns, origins, body
    low = F.lower("value")
    is_state = low.rlike("|".join(state_words or STATE_WORDS))
    anchored = rows.where(F.col("row") < header_rows).groupBy("year", "row").agg(
        *[F.max(low.contains(a)).alias(f"_{i}") for i, a in enumerate(anchors)]
    )
    header = anchored.where(F.col("_0") & F.col("_1")).groupBy("year").agg(F.min("row").alias("_header"))
    placed = rows.join(header, "year")
    columns = placed.where((F.col("row") == F.col("_header")) & is_state).select(
        "year", "col", F.trim("value").alias("destination_state")
    )
    body = placed.where((F.col("row") > F.col("_header")) & (F.col("row") <= F.col("_header") + body_rows))
    origins = body.where((F.col("col") < 4) & is_state).groupBy("year", "row").agg(F.min_by("value", "col").alias("_o"))
    origins = origins.where(~F.lower("_o").contains("jumlah")).select("year", "row", F.trim("_o").alias("origin_state"))
    amount = parse_number(F.col("value"))
    return (
        body.withColumn("tourists_thousands", amount).where(amount.isNotNull())
        .join(columns, ["year", "col"]).join(origins, ["year", "row"])
        .select("year", "origin_state", "destination_state", "tourists_thousands")
    )


def year_header_series(
    cells: DataFrame, sheet: str, value_name: str, name_col: int = 0, drop_pattern: str = HEADER_PATTERN
) -> DataFrame:
    """(state, year, value) from a sheet whose header row holds years."""
    rows = cut_lineage(cells.where(F.col("sheet") == sheet).select("row", "col", "value"))  # header, columns, names, body
    year = F.regexp_extract("value", r"^\s*((?:19|20)\d{2})(?:\.0)?\s*$", 1).try_cast("int")
    years = rows.withColumn("year", year).where(F.col("year").isNotNull())
    header = years.groupBy("row").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2).agg(F.min("row")).scalar()
    columns = years.where(F.col("row") == header).select("col", "year")
    names = rows.where((F.col("col") == name_col) & (F.col("row") > header) & F.col("value").isNotNull())
    names = names.where(~F.lower("value").rlike(drop_pattern)).select("row", F.trim("value").alias("state"))
    amount = parse_number(F.col("value"))
    return (
        rows.where(F.col("row") > header).withColumn(value_name, amount).where(amount.isNotNull())
        .join(columns, "col").join(names, "row").select("state", "year", value_name)
    )


def search_ranks(raw: DataFrame, ranks: int = 5) -> DataFrame:
    """(year, month, rank, state) from one column per rank; rows without a first rank and fillers are dropped."""
    names = [f"Rank {i}" for i in range(1, ranks + 1)]
    long = raw.where(F.coalesce(F.trim("`Rank 1`"), F.lit("")) != "0").unpivot(["Year", "Month"], names, "rank", "state")
    state = F.trim("state")
    return long.where(state.isNotNull() & ~state.isin("", "0")).select(
        F.col("Year").cast("int").alias("year"), F.col("Month").alias("month"),
        F.substring("rank", 6, 2).cast("int").alias("rank"), state.alias("state"),
    )
