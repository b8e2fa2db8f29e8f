"""Joins by great-circle distance on a latitude/longitude grid."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.functions.geo import EARTH_KM, haversine_km
from reliefgrid.session import cut_lineage

# Rows of one side that may meet in a single join group before it is split.
GROUP_ROWS = 20_000
BROADCAST_CELLS = 500_000
# Rows of one side in a block of a split cell, and pairs that a task compares; tasks follow the pairs, not the bytes of the two sides.
BLOCK_ROWS = 3_000
TASK_PAIRS = 20_000_000
# Blocks that a join is cut into before blocks get larger, and their most rows of one side: each row is sent to all blocks it meets, so
# that blocks of a fixed size would send rows that grow with the pairs.
BLOCKS = 2_000
WIDE_BLOCK_ROWS = 50_000
# Grids for far neighbours, coarse to fine, each a whole multiple of the next.
GRID_DEGREES = (8.0, 1.0, 0.125)
HALF_AROUND_KM = 20_016.0
# Upper ends of the radius classes; the last covers the globe.
RADIUS_CLASSES_KM = [1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0, 20040.0]


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Size check before a broadcast; counts no further than ``rows`` + 1."""
    return df.limit(rows + 1).count() <= rows


def _steps(radius_km: float) -> tuple[float, int]:
    """Cell edge in degrees (360 is a whole multiple of it) and the number of cells around the globe."""
    around = max(1, math.floor(360.0 / max(math.degrees(radius_km / EARTH_KM), 1e-3)))
    return 360.0 / around, around


def _cell(lat: Column, lon: Column, step: float, around: int) -> Column:
    row = F.floor((lat + 90.0) / step)
    column = F.pmod(F.floor((lon + 180.0) / step), F.lit(around))
    return (row * around + column).alias("_cell")


def _reached_cells(lat: Column, lon: Column, radius_km: float, step: float, around: int) -> Column:
    """All cells that can hold a point within the radius, exact at every latitude and across the date line."""
    reach = math.degrees(radius_km / EARTH_KM) + 1e-6
    lat_range = F.sequence(F.floor((lat - reach + 90.0) / step), F.floor((lat + reach + 90.0) / step))
    ratio = F.lit(math.sin(min(radius_km / EARTH_KM, math.pi / 2))) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))
    # near a pole the circle spans all longitudes
    lon_reach = F.when(ratio < 1.0, F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + 1e-6).otherwise(F.lit(180.0))
    first = F.floor((lon - lon_reach + 180.0) / step)
    last = F.least(F.floor((lon + lon_reach + 180.0) / step), first + (around - 1))
    lon_range = F.sequence(first, last)
    return F.flatten(
        F.transform(lat_range, lambda r: F.transform(lon_range, lambda c: r * around + F.pmod(c, F.lit(around))))
    )


def _unit(prefix: str, lat: Column | str, lon: Column | str) -> dict[str, Column]:
    """The point on the unit sphere, as three columns."""
    phi, lam = F.radians(lat), F.radians(lon)
    return {f"{prefix}x": F.cos(phi) * F.cos(lam), f"{prefix}y": F.cos(phi) * F.sin(lam), f"{prefix}z": F.sin(phi)}


def _within(distance: Column, limit: Column) -> Column:
    """``distance`` <= ``limit``, settled by the chord between the points where rounding cannot matter."""
    apart = [F.col(f"_l{a}") - F.col(f"_r{a}") for a in "xyz"]
    chord = apart[0] * apart[0] + apart[1] * apart[1] + apart[2] * apart[2]
    reached = F.col("_chord")
    return (chord <= reached * (1 + 1e-9) + 1e-15) & ((chord <= reached * (1 - 1e-9) - 1e-15) & (limit >= 0) | (distance <= limit))


def _any_within(points: str, left_at: tuple[str, str], right_at: tuple[str, str], limit: Column) -> Column:
    """Whether any of the points lies within ``limit``: by the product of the unit vectors where rounding cannot matter, in few steps as
    a function over an array is not compiled."""
    def near(p: Column) -> Column:
        product = p["_lx"] * F.col("_rx") + p["_ly"] * F.col("_ry") + p["_lz"] * F.col("_rz")
        distance = haversine_km(p[left_at[0]], p[left_at[1]], *right_at)
        return (product >= F.col("_sure")) | (product >= F.col("_least")) & (distance <= limit)

    return F.exists(points, near)


def block_side(compared: float, block_rows: int = BLOCK_ROWS) -> int:
    """Rows of one side in a block: ``block_rows``, and more where the pairs would make more than ``BLOCKS`` blocks."""
    return max(block_rows, min(WIDE_BLOCK_ROWS, math.ceil(math.sqrt(compared / BLOCKS))))


def radius_join(
    left: DataFrame,
    right: DataFrame,
    left_at: tuple[str, str],
    right_at: tuple[str, str],
    right_key: str,
    left_key: str,
    radius_km: float | None = None,
    radius_column: str | None = None,
    on: list[str] | None = None,
    distance_column: str = "straight_km",
    group_rows: int = GROUP_ROWS,
    small_right: bool | None = None,
    per_block: Callable[[DataFrame, list[str], int], DataFrame] | None = None,
    gathered: list[str] | None = None,
) -> DataFrame:
    """Every left/right pair within the radius, once, with its distance.

    The right side sits in one grid cell; the left side visits the cells its circle touches, so the match is an
    equi-join on the cell followed by the exact distance test. A crowded cell is split on both sides by key hash into
    blocks, so no task receives a whole hot cell. ``on`` adds columns both sides must share. With ``radius_column`` (on the
    right side) each right row carries its own radius, however wide: rows are joined by radius class, each class on a grid
    of its own, and the classes are those that the data hold. A null radius holds nothing.

    A right side of at most ``group_rows`` rows is broadcast instead: nothing is shuffled and no cell can be crowded.
    Callers that hold checkpointed sides and have counted the right one say so in ``small_right``; otherwise the right
    side is checkpointed and counted here, and the left side is checkpointed if it has to be read twice.

    ``per_block`` gets the pairs of each radius class, the columns by which they are dealt to tasks (none if the right side is broadcast)
    and the number of pairs compared, and returns what becomes of them: grouping by these columns and others moves no pair. Left rows
    of one ``left_key`` meet a right row in one block. Blocks keep to ``BLOCK_ROWS`` then; else they grow with the root of the pairs, and
    what is sent to them with the rows.

    ``gathered`` names left columns (``left_key`` among them) whose rows count as one: each of their combinations meets a right row once,
    where any of its points lies within the radius; other left columns and the distance are left out. The points are kept as an array.
    """
    if small_right is None:
        right = cut_lineage(right)
        small_right = has_at_most(right, group_rows)
        left = left if small_right else cut_lineage(left)
    if radius_column:
        classes = _radius_classes(right, radius_column)
        left = left if len(classes) < 2 else cut_lineage(left)
        parts = [
            _radius_join(left, right.where(own), left_at, right_at, right_key, left_key, bound, F.col(radius_column), on, distance_column, group_rows, small_right, per_block, gathered)
            for bound, own in classes
        ]
        return reduce(DataFrame.unionByName, parts)
    return _radius_join(
        left, right, left_at, right_at, right_key, left_key, radius_km, F.lit(float(radius_km)), on, distance_column, group_rows, small_right,
        per_block, gathered,
    )


def _radius_classes(right: DataFrame, radius_column: str) -> list[tuple[float, Column]]:
    """(widest radius, its rows) of every class that occurs, or of the narrowest one where the side is empty."""
    radius = F.col(radius_column)
    bounds = list(zip([float("-inf"), *RADIUS_CLASSES_KM[:-1]], RADIUS_CLASSES_KM, strict=True))
    rows = [(radius > low) & ((radius <= high) if high < RADIUS_CLASSES_KM[-1] else F.lit(True)) for low, high in bounds]
    widest = right.agg(*[F.max(F.when(own, radius.cast("double"))).alias(str(k)) for k, own in enumerate(rows)]).first()
    found = [
        (min(high, max(most, RADIUS_CLASSES_KM[0])), own) for (_, high), own, most in zip(bounds, rows, widest, strict=True) if most is not None
    ]
    return found or [(bounds[0][1], rows[0])]


def _radius_join(
    left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], right_key: str, left_key: str, reach: float,
    limit: Column, on: list[str] | None, distance_column: str, group_rows: int, small_right: bool,
    per_block: Callable[[DataFrame, list[str], int], DataFrame] | None, gathered: list[str] | None,
) -> DataFrame:
    step, around = _steps(reach)
    cell = ["_cell", *(on or [])]
    arc = F.least(limit / (2.0 * EARTH_KM), F.lit(math.pi / 2))
    placed = right.where(F.col(right_at[0]).isNotNull() & F.col(right_at[1]).isNotNull()).withColumn(
        "_cell", _cell(F.col(right_at[0]), F.col(right_at[1]), step, around)
    )
    visiting = left.where(F.col(left_at[0]).isNotNull() & F.col(left_at[1]).isNotNull()).withColumn(
        "_cell", F.explode(_reached_cells(F.col(left_at[0]), F.col(left_at[1]), reach, step, around))
    )
    points = F.lit(1)
    if gathered:
        visiting = visiting.groupBy("_cell", *dict.fromkeys([*gathered, *(on or [])])).agg(F.collect_list(F.struct(*left_at)).alias("_points"))
        points = F.size("_points")
    kept_left = [c for c in visiting.columns if c not in cell]
    extra = ["_lx", "_ly", "_lz", "_rx", "_ry", "_rz", "_chord", "_points", "_sure", "_least"]

    def ready_left(rows: DataFrame) -> DataFrame:
        """Unit vectors are worked out where they are used, so that narrow rows are sent."""
        if gathered:
            return rows.withColumn("_points", F.transform("_points", lambda p: F.struct(
                *[p[c].alias(c) for c in left_at], *[u.alias(name) for name, u in _unit("_l", p[left_at[0]], p[left_at[1]]).items()]
            )))
        return rows.withColumns(_unit("_l", *left_at))

    def ready_right(rows: DataFrame) -> DataFrame:
        rows, reached = rows.withColumns({"_chord": 4.0 * F.sin(arc) * F.sin(arc), **_unit("_r", *right_at)}), F.col("_chord")
        if gathered:
            sure = F.when(limit >= 0, 1.0 - reached * (0.5 - 5e-10) + 4e-15).otherwise(F.lit(2.0))
            rows = rows.withColumns({"_sure": sure, "_least": 1.0 - reached * (0.5 + 5e-10) - 4e-15})
        return rows

    def within(pairs: DataFrame, compared: int) -> DataFrame:
        block = [] if small_right else [*cell, "_lp", "_rp"]
        if gathered:
            kept = pairs.where(_any_within("_points", left_at, right_at, limit))
        else:
            distance = haversine_km(left_at[0], left_at[1], right_at[0], right_at[1])
            kept = pairs.where(_within(distance, limit)).withColumn(distance_column, distance)
        kept = kept.drop(*extra)
        if per_block:
            kept = per_block(kept, block, compared)
        return kept.drop("_cell", "_lp", "_rp")

    if small_right:
        return within(ready_left(visiting).join(F.broadcast(ready_right(placed)), cell), 0)
    load = cut_lineage(
        placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_right_rows"))
        .join(visiting.groupBy(*cell).agg(F.sum(points).alias("_left_rows")), cell)
        .withColumn("_pairs", F.col("_right_rows").cast("double") * F.col("_left_rows"))
    )
    cells, compared = load.agg(F.count(F.lit(1)), F.coalesce(F.sum("_pairs"), F.lit(0.0))).first()
    block_rows = min(group_rows, BLOCK_ROWS)
    block_rows = block_rows if per_block else block_side(compared, block_rows)
    load = load.select(
        *cell, F.ceil(F.col("_right_rows") / block_rows).alias("_right_parts"), F.ceil(F.col("_left_rows") / block_rows).alias("_left_parts")
    )
    # one narrow row per cell that both sides use: broadcast when few, so that no hot cell is gathered before it is split
    if cells <= BROADCAST_CELLS:
        load = F.broadcast(load)

    def part(key: str, parts: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.col(parts))

    split_right = placed.join(load, cell).select(
        *right.columns, "_cell", part(right_key, "_right_parts").alias("_rp"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_left_parts") - 1)).alias("_lp"),
    )
    split_left = visiting.join(load, cell).select(
        *cell, *kept_left, part(left_key, "_left_parts").alias("_lp"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_right_parts") - 1)).alias("_rp"),
    )
    block = [*cell, "_lp", "_rp"]
    tasks = pair_tasks(compared, pairs=max(TASK_PAIRS, block_rows * block_rows // 2))
    if tasks > 1:
        split_left, split_right = split_left.repartition(tasks, *block), split_right.repartition(tasks, *block)
    return within(ready_left(split_left).join(ready_right(split_right), block), int(compared))


def pair_tasks(compared: float, finer: int = 1, pairs: int | None = None) -> int:
    """Tasks for work that grows with so many compared pairs, since two narrow sides may make many times their rows."""
    return math.ceil(compared * finer / (pairs or TASK_PAIRS))


def _nearest_far(
    left: DataFrame, right: DataFrame, left_id: str, left_at: tuple[str, str], right_id: str, right_at: tuple[str, str], on: list[str]
) -> DataFrame:
    """(left_id, _best): nearest right point at any distance, by occupied cells.

    A cell can hold the nearest point only if its near edge is no further than the far edge of some other; each grid
    refines the cells that are left. The first grid has so few cells that those of a key fit in one array.
    """
    left = left.where(F.col(left_at[0]).isNotNull() & F.col(left_at[1]).isNotNull())
    right = right.where(F.col(right_at[0]).isNotNull() & F.col(right_at[1]).isNotNull())
    grids = [f"_g{k}" for k in range(len(GRID_DEGREES))]
    placed = right.withColumns({
        g: F.struct(F.floor((F.col(right_at[0]) + 90.0) / s).alias("y"), F.floor((F.col(right_at[1]) + 180.0) / s).alias("x"))
        for g, s in zip(grids, GRID_DEGREES, strict=True)
    })
    reached = None
    for k, (grid, step) in enumerate(zip(grids, GRID_DEGREES, strict=True)):
        cells = placed.select(*on, *grids[: k + 1]).distinct()
        if reached is None:
            packed = F.collect_list(grid)  # at most one entry for each cell of the first grid
            if on:
                reached = left.join(cells.groupBy(*on).agg(packed.alias("_cells")), on)
            else:
                reached = left.withColumn("_cells", cells.agg(packed).scalar())
            reached = reached.withColumn(grid, F.explode("_cells")).drop("_cells")
        else:
            reached = reached.join(cells, [*on, *grids[:k]])
        middle = ((F.col(f"{grid}.y") + 0.5) * step - 90.0, (F.col(f"{grid}.x") + 0.5) * step - 180.0)
        radius = math.radians(step) * math.sqrt(0.5) * EARTH_KM * 1.001 + 0.001
        away = reached.withColumns({"_lat": middle[0], "_lon": middle[1]}).withColumn("_d", haversine_km(left_at[0], left_at[1], "_lat", "_lon"))
        nearest_edge = F.min(F.col("_d") + radius).over(Window.partitionBy(left_id))
        reached = away.withColumn("_edge", nearest_edge).where(F.col("_d") - radius <= F.col("_edge")).drop("_lat", "_lon", "_d", "_edge")
    pairs = reached.join(placed, [*on, *grids]).withColumn("straight_km", haversine_km(left_at[0], left_at[1], right_at[0], right_at[1]))
    return pairs.groupBy(left_id).agg(F.min(F.struct("straight_km", right_id)).alias("_best"))


def nearest(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    left_at: tuple[str, str],
    right_id: str,
    right_at: tuple[str, str],
    on: list[str] | None = None,
    radii_km: tuple[float, ...] = (10.0, 80.0, 640.0, 20040.0),
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(left_id, nearest_<right_id>, nearest_km): closest right point, lowest id on a tie.

    The circle grows only for left rows that found nothing yet, so dense areas are settled by short joins; both sides
    are checkpointed, as every circle reads them. Rows that found nothing within the last circle but one are searched
    through the occupied cells of ever finer grids where the last one covers the globe, so that far rows do not meet all
    others. The last radius is the limit: left rows with nothing inside it are absent. A left id may repeat with different ``on`` values.
    """
    right = cut_lineage(right.select(right_id, *right_at, *(on or [])))
    small = has_at_most(right, group_rows)
    left = cut_lineage(left.select(left_id, *left_at, *(on or [])).distinct())
    found, waiting = None, left
    for radius in radii_km:
        if radius >= HALF_AROUND_KM:
            best = _nearest_far(waiting, right, left_id, left_at, right_id, right_at, on or [])
            found = best if found is None else found.unionByName(best)
            break
        pairs = radius_join(
            waiting, right, left_at, right_at, right_key=right_id, left_key=left_id, on=on, radius_km=radius,
            group_rows=group_rows, small_right=small,
        )
        best = pairs.groupBy(left_id).agg(F.min(F.struct("straight_km", right_id)).alias("_best"))
        if radius == radii_km[-1]:
            found = best if found is None else found.unionByName(best)
            break
        best = cut_lineage(best)
        found = best if found is None else found.unionByName(best)
        waiting = left.join(found.select(left_id), left_id, "left_anti")
        if waiting.isEmpty():
            break
    return found.select(
        left_id, F.col(f"_best.{right_id}").alias(f"nearest_{right_id}"), F.col("_best.straight_km").alias("nearest_km")
    )


def nearest_covering(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    left_at: tuple[str, str],
    right_id: str,
    right_at: tuple[str, str],
    radius_column: str,
    radii_km: tuple[float, ...] = (2.5, 10.0, 40.0, 160.0),
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(left_id, right_id, dist_m): of the right rows whose own radius holds the left point the nearest, lowest id on a tie.

    The circle grows only for left rows that nothing within it holds, and each circle asks only right rows whose radius goes beyond
    the circle before; the last one takes each radius as it is. Left rows that nothing holds are absent.
    """
    right = cut_lineage(right.select(right_id, *right_at, radius_column).where(F.col(radius_column) >= 0))
    left = cut_lineage(left.select(left_id, *left_at).distinct())
    widest = right.agg(F.max(radius_column)).first()[0]
    found, waiting, asked = None, left, right
    last = F.struct((F.col("straight_km") * 1000.0).alias("dist_m"), right_id)
    for radius in [r for r in radii_km if widest is not None and r < widest]:
        pairs = radius_join(
            waiting, asked, left_at, right_at, right_key=right_id, left_key=left_id, radius_km=radius, group_rows=group_rows,
            small_right=has_at_most(asked, group_rows),
        ).where(F.col("straight_km") <= F.col(radius_column))
        best = cut_lineage(pairs.groupBy(left_id).agg(F.min(last).alias("_best")))
        found = best if found is None else found.unionByName(best)
        waiting = cut_lineage(left.join(found.select(left_id), left_id, "left_anti"))
        if waiting.isEmpty():
            break
        asked = right.where(F.col(radius_column) > radius)
    else:
        pairs = radius_join(
            waiting, asked, left_at, right_at, right_key=right_id, left_key=left_id, radius_column=radius_column, group_rows=group_rows,
            small_right=has_at_most(asked, group_rows),
        )
        best = pairs.groupBy(left_id).agg(F.min(last).alias("_best"))
        found = best if found is None else found.unionByName(best)
    return found.select(left_id, F.col(f"_best.{right_id}").alias(right_id), F.col("_best.dist_m").alias("dist_m"))
