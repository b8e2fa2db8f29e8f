"""Best candidates of a hotspot by branch and bound over a pyramid of grid cells.

Places sit in leaf cells of a few places each; four cells make one of the next level. Every cell knows the box of its places and of their
archetype vectors, the union of their tags as a bitmap, and the greatest headroom and fixed score part, which together bound the score
of any pair with a place in it. Hotspots first follow their best cells down to a few leaves, whose exact scores give a floor; then
they come down from the top again through every cell whose bound reaches the floor. Cells are met by equi-joins, level by level.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.functions.capacity import FRICTION_FREE_KM, FRICTION_PER_KM, community_score, ecological_risk, proportion_score
from reliefgrid.functions.numeric import clip
from reliefgrid.session import cut_lineage

LEAF_PLACES = 4  # places of a leaf cell, on average over the ground that is covered
TOP_CELLS = 8  # cells along the longer side of the top level
BITS = 60
ROAD_FACTOR = 1.25  # the lowest road factor
SLACK = 0.3  # above all the roundings between a bound and a score
EARTH_KM = 6371.0


def tag_bits(tags: Column) -> Column:
    """Bit of each tag; two tags may share one, which only loosens the bound."""
    return F.transform(tags, lambda t: F.pmod(F.xxhash64(t), F.lit(BITS)).cast("int"))


def _power(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def pyramid(places: DataFrame, weights: dict[str, float]) -> tuple[list[DataFrame], DataFrame]:
    """(cells of each level, leaves first; places with their leaf cell). ``places`` has the columns of a candidate, prefix ``c_``."""
    edges = places.agg(F.min("c_lat"), F.max("c_lat"), F.min("c_lon"), F.max("c_lon"), F.count(F.lit(1))).first()
    if not edges[4]:
        return [], places
    high, wide = max(edges[1] - edges[0], 1e-6), max(edges[3] - edges[2], 1e-6)
    smallest = max(high, wide) / 2**20
    leaf, occupied = max(math.sqrt(high * wide * LEAF_PLACES / edges[4]), smallest), 0
    while leaf / 2 > smallest:
        # ground without places does not count: leaves shrink while that parts places
        at = F.struct(F.floor((F.col("c_lat") - edges[0]) / leaf), F.floor((F.col("c_lon") - edges[2]) / leaf))
        before, occupied = occupied, places.select(at.alias("at")).distinct().count()
        if occupied * 2 * LEAF_PLACES >= edges[4] or occupied <= 1.1 * before:
            break
        leaf /= 2
    levels = max(1, math.ceil(math.log2(max(high, wide) / leaf / TOP_CELLS)) + 1)
    fixed = (
        proportion_score(F.col("c_gap")) * (0.5 * weights["spare_capacity"]) + community_score(F.col("c_poverty")) * weights["community_benefit"]
        - ecological_risk(F.col("c_eco"), F.col("c_demand")) * weights["environmental_risk"]
    )
    placed = places.withColumns({
        "_x": F.floor((F.col("c_lat") - edges[0]) / leaf).cast("int"), "_y": F.floor((F.col("c_lon") - edges[2]) / leaf).cast("int"),
    })
    size = len(places.select("c_vec").first()[0])
    bits = F.aggregate(tag_bits(F.col("c_tags")), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(_power(b)))
    plain = F.col("c_raw_tags").isNull() | (F.size("c_tags") == 0)
    one = placed.select(
        "_x", "_y", F.col("c_lat").alias("south"), F.col("c_lat").alias("north"), F.col("c_lon").alias("west"), F.col("c_lon").alias("east"),
        F.col("c_headroom").alias("headroom"), fixed.alias("fixed"), bits.alias("bits"), plain.alias("plain"),
        *[F.get("c_vec", F.lit(k)).alias(f"lo{k}") for k in range(size)], *[F.get("c_vec", F.lit(k)).alias(f"hi{k}") for k in range(size)],
    )
    merged = [
        F.min("south").alias("south"), F.max("north").alias("north"), F.min("west").alias("west"), F.max("east").alias("east"),
        F.max("headroom").alias("headroom"), F.max("fixed").alias("fixed"), F.bit_or("bits").alias("bits"), F.max("plain").alias("plain"),
        *[F.min(f"lo{k}").alias(f"lo{k}") for k in range(size)], *[F.max(f"hi{k}").alias(f"hi{k}") for k in range(size)],
    ]
    cells = [cut_lineage(one.groupBy("_x", "_y").agg(*merged))]
    for _ in range(levels - 1):
        cells.append(cut_lineage(cells[-1].withColumns({"_x": F.floor(F.col("_x") / 2).cast("int"), "_y": F.floor(F.col("_y") / 2).cast("int")})
                                 .groupBy("_x", "_y").agg(*merged)))
    return cells, placed


def nearest_km(lat: Column, lon: Column) -> Column:
    """A lower bound of the distance to any place of the cell."""
    up = F.greatest(F.lit(0.0), F.col("south") - lat, lat - F.col("north"))
    inside = (lon >= F.col("west")) & (lon <= F.col("east"))

    def gap(edge: str) -> Column:
        apart = F.abs(lon - F.col(edge)) % 360.0
        return F.least(apart, 360.0 - apart)

    aside = F.when(inside, F.lit(0.0)).otherwise(F.least(gap("west"), gap("east")))
    narrow = F.cos(F.radians(F.greatest(F.abs(F.col("south")), F.abs(F.col("north")))))
    half = F.pow(F.sin(F.radians(up) / 2), 2) + F.greatest(F.lit(0.0), F.cos(F.radians(lat)) * narrow) * F.pow(F.sin(F.radians(aside) / 2), 2)
    return F.asin(F.least(F.lit(1.0), F.sqrt(half))) * (2 * EARTH_KM) * (1 - 1e-9)


def score_bound(weights: dict[str, float], alpha: float, size: int) -> Column:
    """What no pair of the hotspot and a place of the cell exceeds. Weights are not negative. Needs ``km``, a lower bound."""
    h = [F.get("h_vec", F.lit(k)) for k in range(size)]
    low = F.sqrt(sum((F.pow(F.greatest(F.col(f"lo{k}"), F.lit(0.0)), 2) for k in range(size)), start=F.lit(0.0)))
    along = sum((h[k] * F.col(f"hi{k}") for k in range(size)), start=F.lit(0.0))
    cos = F.when((low > 1e-9) & (F.col("h_norm") > 1e-9), F.least(F.lit(1.0), along / (low * F.col("h_norm")))).otherwise(F.lit(1.0))
    shared = F.size(F.filter("h_bits", lambda b: F.col("bits").bitwiseAND(_power(b)) != 0))
    jaccard = F.when(F.size("h_bits") > 0, shared / F.size("h_bits")).otherwise(0.0)
    mixed = cos * alpha + jaccard * (1.0 - alpha)
    similar = F.when(F.col("h_plain") | F.col("plain"), F.greatest(cos, mixed)).otherwise(mixed)
    absolute = F.when((F.col("h_need") > 0) & F.col("headroom").isNotNull(), clip(F.col("headroom") / F.col("h_need") * 100.0, 0.0, 100.0)).otherwise(100.0)
    road = F.exp(F.greatest(F.lit(15.0), F.col("km") * 1.13 + 7.5) * -0.0075) * 100.0
    rail = F.exp(F.greatest(F.lit(20.0), F.col("km") + 17.5) * -0.0075) * 100.0 + 8.0
    access = F.least(F.lit(100.0), F.when(F.col("h_rail"), F.greatest(road, rail)).otherwise(road))
    total = (
        similar * (100.0 * weights["match"]) + access * weights["accessibility"] + absolute * (0.5 * weights["spare_capacity"]) + F.col("fixed")
    )
    friction = F.greatest(F.lit(0.0), F.col("km") * ROAD_FACTOR - 0.1 - FRICTION_FREE_KM) * FRICTION_PER_KM
    return F.least(F.lit(100.0), total) - friction + SLACK


HOTSPOT = ["h_id", "h_lat", "h_lon", "h_need", "h_norm", "h_vec", "h_bits", "h_plain", "h_rail", "floor"]


def descend(
    hotspots: DataFrame, cells: list[DataFrame], weights: dict[str, float], alpha: float, size: int, within_km: float | None, keep: int | None
) -> DataFrame:
    """h_id, _x, _y: the leaves whose bound reaches the hotspot's ``floor``, and of each level only the ``keep`` best if that is given."""
    frontier = None
    for level in range(len(cells) - 1, -1, -1):
        own = cells[level]
        if frontier is None:
            # the top level is a few dozen cells
            listed = own.agg(F.collect_list(F.struct(*own.columns)).alias("l")).select("l")
            met = hotspots.withColumn("_c", F.explode(listed.scalar())).select(*HOTSPOT, "_c.*")
        else:
            up = own.withColumns({"_px": F.floor(F.col("_x") / 2).cast("int"), "_py": F.floor(F.col("_y") / 2).cast("int")})
            met = frontier.withColumnsRenamed({"_x": "_px", "_y": "_py"}).join(up, ["_px", "_py"]).drop("_px", "_py")
        met = met.withColumn("km", nearest_km(F.col("h_lat"), F.col("h_lon")))
        if within_km is not None:
            met = met.where(F.col("km") * ROAD_FACTOR - 0.1 <= within_km)
        met = met.withColumn("bound", score_bound(weights, alpha, size)).where(F.col("bound") >= F.col("floor"))
        if keep is not None:
            best = Window.partitionBy("h_id").orderBy(F.desc("bound"), "_x", "_y")
            met = met.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= keep)
        frontier = met.select(*HOTSPOT, "_x", "_y")
    return frontier.select("h_id", "_x", "_y")
