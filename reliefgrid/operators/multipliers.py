"""Input-output multipliers of any number of tables at once, by doubling over square blocks.

The rows 1'L, v'L and w'L of L = I + A + A^2 + ... are x (I + A)(I + A^2)(I + A^4)...: each step adds x A^(2^k) and squares the power, so
five steps reach 32 terms. Tables are cut into blocks of a fixed edge, held as arrays; x is one more row of blocks, so a step is one
join of blocks on the inner index and one sum by the outer ones. A table leaves the iteration when its last change is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.functions.numeric import rnd
from reliefgrid.session import cut_lineage

# Survey weights of the tourism sectors in the composite multiplier.
SECTOR_WEIGHTS = {
    "retail_wholesale": 0.3739 + 0.0389 + 0.0778 * 0.5,
    "food_beverage": 0.1625 + 0.0778 * 0.5,
    "accommodation": 0.1116,
    "refined_petroleum": 0.1265,
    "land_transport": 0.0673 * 0.80,
    "air_transport": 0.0673 * 0.20,
    "arts_recreation": 0.0416,
}
MEASURES = ["type1_output", "type1_gva", "type2_output", "type2_gva"]
FALLBACK_YEARS = [2021, 2020, 2019]
EDGE = 32  # rows and columns of a block
VECTORS = ["r", "g", "h"]


def coefficients(edges: DataFrame, sectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with a = z / x, sectors with value-added, wage and consumption coefficients).

    ``edges``: year, i, j, z (sales of i to j). ``sectors``: year, j, x, gva, wages, consumption. A non-positive
    output counts as 1. Consumption is divided by the total wages of the table.
    """
    safe = F.when(F.col("x") > 0, F.col("x")).otherwise(F.lit(1.0))
    wages = sectors.groupBy("year").agg(F.sum("wages").alias("_wages"))
    nodes = sectors.join(wages, "year").select(
        "year", "j", (F.col("gva") / safe).alias("v"), (F.col("wages") / safe).alias("w"),
        F.when(F.col("_wages") > 0, F.col("consumption") / F.when(F.col("_wages") > 0, F.col("_wages"))).otherwise(0.0).alias("c"),
    )
    output = sectors.select("year", "j", safe.alias("_x"))
    links = edges.join(output, ["year", "j"]).select("year", "i", "j", (F.col("z") / F.col("_x")).alias("a")).where(F.col("a") != 0)
    return links, nodes


def placed(nodes: DataFrame, edge: int = EDGE) -> DataFrame:
    """The sectors with their block ``bj`` and place ``p`` in it."""
    order = Window.partitionBy("year").orderBy("j")  # the sectors of one table
    at = F.row_number().over(order) - 1
    return nodes.withColumn("_at", at).withColumns(
        {"bj": F.floor(F.col("_at") / edge).cast("int"), "p": (F.col("_at") % edge).cast("int")}
    ).drop("_at")


def blocks_of(links: DataFrame, places: DataFrame, edge: int = EDGE) -> DataFrame:
    """year, bi, bj, height, m (row by row) of A, and of the vectors 1, v and w as the block row -1."""

    def arrays(cells: DataFrame, height: int) -> DataFrame:
        """Cells (year, bi, bj, at, a) as one array for each block that has any; a place without a cell holds 0."""
        grid = cells.select("year", "bi", "bj").distinct().withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(height * edge - 1))))
        full = grid.join(cells, ["year", "bi", "bj", "at"], "left").groupBy("year", "bi", "bj").agg(
            F.sort_array(F.collect_list(F.struct("at", F.coalesce("a", F.lit(0.0)).alias("a")))).alias("m")  # edge x edge entries
        )
        return full.select("year", "bi", "bj", F.lit(height).alias("height"), F.col("m")["a"].alias("m"))

    sells = places.select("year", F.col("j").alias("i"), F.col("bj").alias("bi"), F.col("p").alias("pi"))
    cells = links.join(sells, ["year", "i"]).join(places.select("year", "j", "bj", "p"), ["year", "j"]).select(
        "year", "bi", "bj", (F.col("pi") * edge + F.col("p")).alias("at"), "a"
    )
    starts = [F.lit(1.0), F.col("v"), F.col("w")]
    rows = places.select("year", F.lit(-1).alias("bi"), "bj", F.inline(F.array(*[
        F.struct((F.col("p") + k * edge).alias("at"), x.alias("a")) for k, x in enumerate(starts)
    ])))
    return arrays(cells, edge).unionByName(arrays(rows, len(starts)))


def _product(left: Column, right: Column, height: Column, edge: int) -> Column:
    """The block left x right, row by row."""

    def entry(at: Column) -> Column:
        row, column = F.floor(at / edge) * edge, at % edge
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(edge - 1)), F.lit(0.0),
            lambda sum_, k: sum_ + F.get(left, (row + k).cast("int")) * F.get(right, (k * edge + column).cast("int")),
        )

    return F.transform(F.sequence(F.lit(0), height * edge - 1), entry)


def _sum(arrays: Column) -> Column:
    """Entry by entry; a null entry makes the sum null."""
    return F.aggregate(F.slice(arrays, 2, F.size(arrays)), arrays[0], lambda s, m: F.zip_with(s, m, lambda x, y: x + y))


def _step(blocks: DataFrame, edge: int, keep: bool) -> DataFrame:
    """Every power squared and x <- x + x A^(2^k); ``keep`` leaves the x before as the block row -2."""
    right = blocks.where("bi >= 0").select("year", F.col("bi").alias("bj"), F.col("bj").alias("_bj"), F.col("m").alias("_m"))
    # the powers are left and right side, x is a left side only and one of its own summands
    products = blocks.join(right, ["year", "bj"]).select(
        "year", "bi", F.col("_bj").alias("bj"), "height", _product(F.col("m"), F.col("_m"), F.col("height"), edge).alias("m")
    )
    x = blocks.where("bi = -1")
    parts = products.unionByName(x)
    if keep:
        parts = parts.unionByName(x.withColumn("bi", F.lit(-2)))
    return parts.groupBy("year", "bi", "bj", "height").agg(_sum(F.collect_list("m")).alias("m"))  # one entry a block row


def doubled(blocks: DataFrame, steps: int = 12, tolerance: float = 1e-8, edge: int = EDGE) -> tuple[DataFrame, DataFrame]:
    """(year, bj, x of the tables that converged; year, steps, last_change, converged of all tables) from the blocks of A and x.

    Two doublings go into one checkpoint, after which the number of tables that are ready is read. Tables whose last change is below
    ``tolerance`` leave, and so do those whose change is no number any more. What is left after ``steps`` has not converged: 2^12 terms are
    enough for any table that is not next to divergence.
    """
    blocks, finished, statuses = cut_lineage(blocks), [], []
    for step in range(2, steps + 2, 2):
        blocks = cut_lineage(_step(_step(blocks, edge, False), edge, True))
        x = blocks.where("bi = -1").select("year", "bj", F.col("m").alias("x"))
        before = blocks.where("bi = -2").select("year", "bj", F.col("m").alias("b"))
        # null and NaN are beyond every tolerance
        moved = F.array_max(F.zip_with("x", "b", lambda new, old: F.coalesce(F.abs(new - old), F.lit(float("inf")))))
        status = x.join(before, ["year", "bj"]).groupBy("year").agg(F.max(moved).alias("last_change")).select(
            "year", F.lit(step).alias("steps"), "last_change", (F.col("last_change") < tolerance).alias("converged")
        )
        leaves = F.col("converged") | (F.col("last_change") >= float("inf"))
        ready, left = status.agg(F.count_if(leaves), F.count_if(~leaves)).first()
        if not left or step >= steps:
            statuses.append(status)
            finished.append(x.join(status.where("converged"), "year", "left_semi"))
            break
        if ready:
            status = cut_lineage(status)
            statuses.append(status.where(leaves))
            finished.append(x.join(status.where("converged"), "year", "left_semi"))
            blocks = blocks.join(status.where(~leaves), "year", "left_semi")
        blocks = blocks.where("bi > -2")
    rows, table = finished[0], statuses[0]
    for more in finished[1:]:
        rows = rows.unionByName(more)
    for more in statuses[1:]:
        table = table.unionByName(more)
    return rows, table


def all_multipliers(
    edges: DataFrame, sectors: DataFrame, steps: int = 12, tolerance: float = 1e-8, edge: int = EDGE
) -> tuple[DataFrame, DataFrame]:
    """(Type I and Type II output and value-added multipliers of every sector of every table that converges, status of all tables).

    Households close the table: with hc = h.c the Type II rows are r + (r.c) h / (1 - hc) and g + (g.c) h / (1 - hc).
    """
    links, nodes = coefficients(edges, sectors)
    places = cut_lineage(placed(nodes, edge))
    rows, status = doubled(blocks_of(links, places, edge), steps, tolerance, edge)
    limit = rows.join(places, ["year", "bj"]).select(
        "year", "j", "c", *[F.get("x", F.col("p") + k * edge).alias(name) for k, name in enumerate(VECTORS)]
    )
    closed = limit.groupBy("year").agg(*[F.sum(F.col(x) * F.col("c")).alias(f"{x}c") for x in VECTORS])
    lift = F.col("h") / (1.0 - F.col("hc"))
    return limit.join(closed, "year").select(
        "year", "j",
        F.col("r").alias("type1_output"), F.col("g").alias("type1_gva"),
        (F.col("r") + F.col("rc") * lift).alias("type2_output"), (F.col("g") + F.col("gc") * lift).alias("type2_gva"),
    ), status


def multipliers(edges: DataFrame, sectors: DataFrame, steps: int = 12, tolerance: float = 1e-8) -> DataFrame:
    """The multipliers of all tables; one that does not converge is an error."""
    table, status = all_multipliers(edges, sectors, steps, tolerance)
    failed = [r["year"] for r in status.where("NOT converged").select("year").orderBy("year").limit(10).collect()]
    if failed:
        raise ValueError(f"multipliers of {failed} have not converged to {tolerance}")
    return table


def composite(table: DataFrame, weights: DataFrame, sector: str = "j") -> DataFrame:
    """Weighted mean of the sector multipliers per year; ``weights`` has the sector column and ``weight``."""
    total = F.sum("weight")
    return table.join(weights, sector).groupBy("year").agg(
        *[rnd(F.sum(F.col("weight") * F.col(m)) / total, 4).alias(f"{m}_multiplier") for m in MEASURES]
    )


def documents(table: DataFrame, totals: DataFrame) -> DataFrame:
    """``value``: one nested document for each year, {year: {composite_tourism, sectors: {sector: measures}}}."""
    sector = F.struct(F.col("j").cast("string").alias("name"), *MEASURES)
    nested = table.groupBy("year").agg(F.map_from_entries(F.collect_list(F.struct(F.col("j").cast("string"), sector))).alias("sectors"))
    composite_ = F.struct(*[F.col(f"{m}_multiplier") for m in MEASURES])
    whole = nested.join(totals.select("year", composite_.alias("composite_tourism")), "year").select(
        F.create_map(F.col("year").cast("string"), F.struct("composite_tourism", "sectors")).alias("tables")
    )
    return whole.select(F.to_json("tables").alias("value"))


def for_years(requests: DataFrame, table: DataFrame, year: str = "year") -> DataFrame:
    """Rows of the requested year, else of the preferred fallback year that exists; nulls where neither does."""
    years = table.select(F.col("year").alias("_have")).distinct()
    listed = years.agg(F.collect_list("_have")).scalar()  # one entry per table year
    chosen = F.when(F.array_contains(listed, F.col(year)), F.col(year))
    for fallback in FALLBACK_YEARS:
        chosen = F.coalesce(chosen, F.when(F.array_contains(listed, F.lit(fallback)), F.lit(fallback)))
    picked = requests.select(F.col(year).alias("requested_year"), chosen.alias("_year"))
    return picked.join(table.withColumnRenamed("year", "used_year"), F.col("_year") == F.col("used_year"), "left").drop("_year")


def from_json(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sector rows, composite rows) from the nested multiplier document read by ``sources.readers.multiplier_json``."""
    years = documents.select(F.explode("tables").alias("year", "t"))
    sectors = years.select(F.col("year").cast("int").alias("year"), F.explode("t.sectors").alias("j", "s")).select("year", "j", "s.*")
    total = years.select(F.col("year").cast("int").alias("year"), "t.composite_tourism.*")
    return sectors, total


def sector_rows(table: DataFrame, year: int, sector: str | None = None) -> DataFrame:
    """Multipliers of one year, or of one sector of it."""
    rows = table.where(F.col("year") == year)
    return rows if sector is None else rows.where(F.col("j") == sector)
